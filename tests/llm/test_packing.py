import zlib

import numpy as np

from stepfree.llm import packing
from stepfree.llm.common import ByteBpeEncoder, WordBpeEncoder, load_tokenizer, tokenizer_path

HARD = ["", "  a  b", "a\n\nb", "\ta b\n", "A.B,C. d", "x’s it's 12,5 3. é. a\x1c b", " \n ", " lead", "trail ", "ÀÉ. <|endoftext|> İx ΑΣ. Σ", "日本語 テスト。", "x², y.", "don't, won't.", "a  b"]


def test_cached_encoders_equal_the_library(documents):
    texts = HARD + [r["text"] for r in documents.select("text").limit(60).collect()]
    for name, encoder in (("byte_bpe_50k.json", ByteBpeEncoder), ("word_bpe_49k.json", WordBpeEncoder)):
        path = tokenizer_path(name)
        own, library = encoder(path), load_tokenizer(path)
        for t in texts:
            assert np.frombuffer(own.encode(t), np.uint16).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_projection_sums_signs():
    rng = np.random.default_rng(3)
    for n in (1, 7, 70_000):
        ids = rng.integers(0, 49_408, n).astype(np.uint16)
        want = packing.directions()[ids].astype(float).sum(axis=0) / np.sqrt(n)
        assert np.allclose(packing.project(ids.tobytes(), packing.packed_directions()), want)


def check(spark, docs, size=4096):
    library = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = packing.pack(docs, size=size).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] > 0 and zlib.crc32(own) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in ids.items():
        assert [x for s, n in sorted(by_doc[d]) for x in range(s, s + n)] == list(range(len(own)))
    for own in by_seq.values():
        assert [x for s, n in sorted(own) for x in range(s, s + n)] == list(range(n := sum(n for _, n in own)))
        assert n <= size and n.bit_count() == 1
    return got


def test_pieces_cover_every_id_once_without_padding(spark, documents):
    check(spark, documents)


def test_null_empty_long_and_small_sequences(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "word " * 700, 2), (4, "a b", 3), (5, "a b", 4)], "doc_id long, text string, n int")
    check(spark, docs, 64)
    assert packing.pack(docs.limit(0)).count() == 0


def test_the_curve_visits_every_cell_once_and_only_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
