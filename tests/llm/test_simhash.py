import re

import numpy as np
import xxhash

from stepfree.llm import simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_cases():
    for text in [None, "", " \t\n", "One", "a b c", "a b c d", "A  b\tC\nd e É é", " x y", "x " * 5000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    got = simhash.near_duplicates(documents.withColumnRenamed("lang", "fp").withColumnRenamed("source", "rep")).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(fps)
    assert len(got) == len(rows)


def test_links_of_close_fingerprints_in_large_runs(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {0: base}
    for i in range(1, 400):  # a chain and a ball round it, and strangers
        flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
        fps[i] = fps[int(rng.integers(0, i))] ^ sum(1 << int(b) for b in flips) if i % 4 else int(rng.integers(0, 1 << 62))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(f), i) for f, i in {f: i for i, f in reversed(fps.items())}.items()], "fp long, rep long")
    edges = simhash.links(classes).collect()
    first = {f: i for i, f in reversed(fps.items())}
    want = plain_components({i: f for f, i in first.items()})
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = sorted((find(e["u"]), find(e["v"])))
        root[b] = a
    assert {i: find(i) for i in want} == want


def test_every_plan_obeys_the_pigeonhole_principle():
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 64)) < rng.random(64)).astype(float)
    for n in (10, 10**5, 10**8):
        plan = simhash.allot(n, x.T @ x * n / 3000)
        assert sum(t + 1 for _, t in plan) == 5
        masks = [m for m, _ in plan]
        assert all(a & b == 0 for k, a in enumerate(masks) for b in masks[k + 1 :])


def test_empty_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 3]


def test_rows_that_share_an_id_and_columns_named_like_ours(spark):
    from stepfree.llm import jaccard

    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, 1, "a"), (2, text, 2, "b"), (2, "a text of its own, which is not like the other", 3, "c"), (None, text, 4, "d"), (3, None, 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, gone string")
    for keep in (simhash.keep_first, jaccard.keep_first):
        got = keep(df)
        assert got.columns == df.columns
        assert sorted(r["_gone"] for r in got.collect()) == [1, 3, 4, 5], keep
