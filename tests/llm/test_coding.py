import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfree.llm import tokencoder, viterbi
from stepfree.llm.common import ByteBpeEncoder, load_tokenizer, scratch_path, tokenizer_path

pytestmark = pytest.mark.usefixtures("spark")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=300), max_size=12))
def test_blocks_come_back(blocks):
    blocks = [np.array(b, np.uint16) for b in blocks]
    got = tokencoder.decode_blocks(tokencoder.encode_blocks(blocks))
    assert [g.tolist() for g in got] == [b.tolist() for b in blocks]


def test_full_blocks_shrink_and_damage_is_found():
    rng = np.random.default_rng(0)
    flat, rep = rng.integers(0, 65536, 4096).astype(np.uint16), np.resize(rng.integers(0, 50_000, 29), 4096).astype(np.uint16)
    coded = tokencoder.encode_blocks([flat, rep, np.full(4096, 65535, np.uint16), np.zeros(4096, np.uint16)])
    assert [len(g) for g in tokencoder.decode_blocks(coded)] == [4096] * 4
    assert (tokencoder.decode_blocks(coded)[0] == flat).all() and (tokencoder.decode_blocks(coded)[1] == rep).all()
    assert len(coded[1]) < 600 and len(coded[0]) < 4096 * 2.2
    assert tokencoder.decode_blocks([coded[1]])[0].tolist() == rep.tolist()  # alone
    broken = bytearray(coded[1])
    broken[40] ^= 255
    for bad in (bytes(broken), coded[1][:-2], b"xx", b"TKC0" + coded[1][4:]):
        with pytest.raises(ValueError):
            tokencoder.decode_blocks([bad])


def test_blocks_are_smaller_than_zlib_makes_them(documents):
    encoder = ByteBpeEncoder(tokenizer_path("byte_bpe_50k.json"))
    ids = b"".join(encoder.encode(r["text"] or "") + b"\0\0" for r in documents.orderBy("doc_id").collect())
    for size in (4096, tokencoder.BLOCK):
        blocks = [np.frombuffer(ids[i : i + 2 * size], "<u2") for i in range(0, len(ids), 2 * size)]
        coded = tokencoder.encode_blocks(blocks)
        assert sum(map(len, coded)) < 0.95 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)
        assert all((a == b).all() for a, b in zip(tokencoder.decode_blocks(coded), blocks, strict=True))


def test_checksums_of_parts_join():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 1000, 40_000):
        a, b = rng.bytes(37), rng.bytes(n)
        assert tokencoder.crc32_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_files_hold_every_document_in_order(spark, documents):
    extra = spark.createDataFrame([(-5, None, None, None, 0), (10**9, "", "en", "s", 0), (10**9 + 1, "word " * 9000, "en", "s", 0)], documents.schema)
    docs = documents.unionByName(extra).repartition(5)
    path = scratch_path(spark, "test-tokens")
    tokencoder.write_tokens(docs, path)
    library, start, want = load_tokenizer(tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    got = sorted(tuple(r) for r in tokencoder.read_index(spark, path).collect())
    assert got == want
    held = {}
    for r in sorted(tokencoder.read_blocks(spark, path).collect(), key=lambda r: (r["file"], r["number"], r["piece"])):
        held[r["doc_id"]] = held.get(r["doc_id"], b"") + bytes(r["ids"])
    assert {d: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for d, x in held.items()} == {d: c for d, _, _, c in want}
    clash = docs.where("doc_id < 5").selectExpr("doc_id", "text", "doc_id as d", "text as t", "1 as ids", "2 as file").union(docs.where("doc_id = 3").selectExpr("doc_id", "text", "0", "'x'", "1", "2"))
    tokencoder.write_tokens(clash, path + "-clash")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokencoder.read_index(spark, path + "-clash").collect()) == sorted((d, n, c) for d, _, n, c in want + [w for w in want if w[0] == 3] if d < 5)
    empty = scratch_path(spark, "test-empty")
    tokencoder.write_tokens(docs.limit(0), empty)
    assert tokencoder.read_index(spark, empty).count() == 0


def best_by_brute_force(vocabulary, word):
    """(score, pieces' lengths from the last) by recursion over all segmentations."""
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if p}
    memo = {0: (0, ())}
    for i in range(1, len(word) + 1):
        options = []
        for n in range(1, min(i, vocabulary.table.longest) + 1):
            p = word[i - n : i]
            s, lengths = memo[i - n]
            if p in ids:
                options.append((s + int(vocabulary.scores[ids[p]]), (n, *lengths), ids[p]))
            elif n == 1:
                options.append((s + viterbi._BYTE_SCORE * len(p.encode()), (1, *lengths), None))
        memo[i] = max(options)[:2]
    return memo[len(word)]


def test_search_finds_the_best_segmentation(documents):
    vocabulary = viterbi.Vocabulary()
    words = {w for r in documents.limit(20).collect() for w in viterbi.Encoder.split(r["text"])} | {"▁", "▁▁▁", "▁日本", "é\n\té", "▁" + "ab" * 300}
    got = vocabulary.segment(list(words))
    for w in words:
        score, lengths = best_by_brute_force(vocabulary, w)
        ids = np.frombuffer(got[w], "<u2")
        own = sum(int(vocabulary.scores[i]) if vocabulary.pieces[i] else viterbi._BYTE_SCORE for i in ids)
        assert own == score
        if all(vocabulary.pieces[i] for i in ids):
            assert tuple(len(vocabulary.pieces[i]) for i in ids[::-1]) == lengths


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_comes_back(text):
    vocabulary = test_any_text_comes_back.vocabulary
    assert vocabulary.decode(viterbi.Encoder(vocabulary).encode([text])[0]) == text


test_any_text_comes_back.vocabulary = viterbi.Vocabulary()


def test_columns_and_cases(spark, documents):
    odd = ["", "  a  b ", "▁x ▁", "日本\n\t é ￿", "x", None]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)], "doc_id long, text string, ids string")
    got = viterbi.decode(viterbi.encode(docs.union(documents.select("doc_id", "text", "lang")))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert len(got) == len(odd) + documents.count()


def test_words_of_letters_are_looked_up_without_their_spelling():
    """Words of ASCII letters, with or without what follows them, take the short way; the ids are those of the whole text."""
    from unittest import mock

    from stepfree.llm import common

    encoder = common.ByteBpeEncoder(common.tokenizer_path("byte_bpe_50k.json"))
    text = "Plain words, and (more) words! it's x1 café end.\nnext line; a'b' - 'quoted' zz...\n\n two  spaces "
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), np.uint16).tolist() == want
    with mock.patch.object(encoder, "_ids", side_effect=AssertionError), mock.patch.object(common, "_spelled", side_effect=AssertionError):
        assert encoder.words["brandnew"] and encoder.words["another,"] == encoder.words["another"] + encoder.tails[","]
    assert encoder.words[""] is None
