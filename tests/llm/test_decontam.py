"""Hits against a search of all windows, cleaning, parts of the benchmark, and odd rows."""

import hashlib
import random
import re

import pytest

from stepfree.llm import decontam
from stepfree.llm.words import DIGITS, LETTERS, byte_map, cut

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item or "")
    return len(own), sorted(hit), sorted(found)


def rows_of(spark, texts, items, window, part=decontam.PART):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontam.find_hits(docs, spark.createDataFrame(items, "item_id string, text string"), window, columns=["doc_id"], part=part)
    out = {}
    for r in found.collect():
        spans = [tuple(x) for x in r["spans"]]
        assert all(a + n < b for (a, n), (b, _) in zip(spans[:-1], spans[1:], strict=True))
        out[r["doc_id"]] = (r["n_words"], [i for a, n in spans for i in range(a, a + n)], r["items"])
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("part", [decontam.PART, 12])
@pytest.mark.parametrize("window", [1, 3, 5])
def test_equals_search_of_all_windows(spark, window, part):
    rng = random.Random(window)
    some = lambda n: " ".join(rng.choice(["a", "B", "c1", "é", "Ñu"]) for _ in range(n))
    items = [(str(i % 9), some(rng.choice([1, 2, 4, 6, 9, 14, 30]))) for i in range(8)] + [(None, some(4)), ("none", " ,.- "), ("null", None)]
    texts = [rng.choice(["", "x "]) + some(rng.randint(0, 40)) + rng.choice(["", " z. ", "-" + items[1][1]]) for _ in range(120)]
    for own, got in zip(texts, rows_of(spark, texts, items, window, max(part, window + 1)), strict=True):
        assert got == brute(own, items, window)


def test_words_of_columns():
    import pyarrow as pa

    texts = ["Ab-c1", None, "", "x", "é_É\x00ÄZ", "...", "end"]
    column = pa.array(["gone", *texts])[1:]
    got = cut(column, byte_map(LETTERS, DIGITS))
    own = got.distinct.take(pa.array(got.codes)).to_pylist()
    for i, t in enumerate(texts):
        a, z = got.bounds[i : i + 2]
        assert [w.decode() for w in own[a:z]] == words(t)
        assert [(t or "").encode()[s - got.texts[i] : e - got.texts[i]].decode().lower() for s, e in zip(got.starts[a:z], got.ends[a:z], strict=True)] == [w.lower() for w in words(t)]
    assert len(cut(pa.array([], pa.string()), byte_map(LETTERS)).codes) == 0


def test_cleaning_removes_spans_and_covered_documents(spark):
    item = "one two three four five"
    texts = ["Alpha beta! One, two-three: Four five. Gamma delta eps zeta", "zero One two three four five six", "clean text", None, ""]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in decontam.decontaminate(docs, spark.createDataFrame([("q", item)], "item_id string, text string"), window=5).collect()}
    assert sorted(out) == [0, 2, 3, 4]
    assert out[0]["text"] == "Alpha beta! . Gamma delta eps zeta" and out[2]["text"] == "clean text" and out[3]["text"] is None
    assert out[0].asDict().keys() == {"doc_id", "text", "spans"} and out[0]["spans"] == "kept"


def test_odd_rows(spark):
    items = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b c", 5)] * 2, "doc_id long, text string, ITEMS int")
    out = decontam.find_hits(docs, items)
    assert out.columns == ["doc_id", "text", "ITEMS", "n_words", "spans", "items_1"] and [r["items_1"] for r in out.collect()] == [["q"]] * 2
    assert decontam.find_hits(docs.limit(0), items).count() == 0
    assert [len(r["spans"]) for r in decontam.find_hits(docs, items.limit(0)).collect()] == [0, 0]
    long = " ".join(f"w{i % 1000}" for i in range(500_000)) + " a b c"
    got = decontam.find_hits(spark.createDataFrame([(1, long)], "doc_id long, text string"), items, columns=["doc_id"]).first()
    assert [tuple(x) for x in got["spans"]] == [(500_000, 3)]


def test_query_equals_brute_force(spark, tmp_path):
    from stepfree.llm.queries import op12_benchmark_decontamination

    sf = "/root/testdata/sf0.001"
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").collect()}
    got = {r["doc_id"]: r for r in op12_benchmark_decontamination(spark, sf).collect()}
    grams = {i: words(t) for i, t in items}
    for doc_id, text in texts.items():
        own = words(text)
        seen = {tuple(own[j : j + 10]): j for j in range(len(own) - 9)}
        hit, found = set(), set()
        for i, w in grams.items():
            for k in range(len(w) - 9):
                if tuple(w[k : k + 10]) in seen:
                    found.add(i)
        wanted = {tuple(w[k : k + 10]) for w in grams.values() for k in range(len(w) - 9)}
        for j in range(len(own) - 9):
            if tuple(own[j : j + 10]) in wanted:
                hit.update(range(j, j + 10))
        r = got[doc_id]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(own), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values()) and min(map(len, grams.values())) >= 10
