"""Runs against a search of all stretches, their count on known words, and odd rows."""

import hashlib
import itertools
import random

import pytest

from stepfree.llm import wordruns


def brute(words, least):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, 2 * q):
                out.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(spark, texts, least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted(wordruns.find_runs(docs, least).collect(), key=lambda r: r["doc_id"])
    return [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_every_short_sequence(spark):
    texts = [" ".join(x) for n in range(13) for x in itertools.product("ab", repeat=n)] + [" ".join(x) for n in range(9) for x in itertools.product("abc", repeat=n)]
    for (runs, text), own in zip(found(spark, texts, 2), texts, strict=True):
        want = brute(own.split(), 2)
        assert runs == want, own
        assert text == collapsed(own.split(), want)


def test_long_and_repetitive_sequences(spark):
    rng, texts = random.Random(3), [" ".join(fibonacci(400)), " ".join("a" * 300), " ".join(bin(i).count("1") % 2 * "x" + "y" for i in range(300))]
    for _ in range(400):
        parts = [[rng.choice(["la", "lalala", "lalalb", "b", "é", "zé"][: rng.randint(2, 6)]) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        own = []
        while len(own) < 150:
            own += rng.choice(parts) * rng.choice([1, 1, 2, 3, 7])
            if rng.random() < 0.2:
                own[rng.randrange(len(own))] = "b"
        texts.append(rng.choice([" ", "\t", "\r\n", " \x0b "]).join(own))
    for least in (2, 12):
        for (runs, text), own in zip(found(spark, texts, least), texts, strict=True):
            want = brute(own.split(), least)
            assert runs == want
            assert text == collapsed(own.split(), want)


def test_a_very_long_periodic_text_takes_linear_time(spark):
    runs, text = found(spark, [" ".join(["one", "two", "three"] * 400_000)], 12)[0]
    assert runs == [(0, 1_200_000, 3)] and text == "one two three"


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a b a b a b a b a b a", "a b a b a b a b a b a b", "a b " * 12]
    assert found(spark, texts, 12) == [([], ""), ([], ""), ([], ""), ([], "a"), ([], texts[4]), ([(0, 12, 2)], "a b"), ([(0, 12, 1)], "a b")]
    docs = spark.createDataFrame([(1, "x", "mine", 7)] * 2, "doc_id long, text string, Runs string, found int")
    out = wordruns.find_runs(docs)
    assert out.columns == ["doc_id", "text", "Runs", "found", "runs_1", "collapsed"] and out.count() == 2
    assert wordruns.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    import zlib

    from stepfree.llm.queries import op13_periodic_runs

    rng, rows = random.Random(5), [(None, "a b"), (3, None), (4, "")]
    rows += [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90)))) for i in range(10, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and words:
            planted += 1
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[doc_id] == (len(runs), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))
    assert planted > 20 and len(got) == len(rows)


@pytest.mark.parametrize("least", [1, 40])
def test_least_length(spark, least):
    text = "x " + "a b c " * 7 + "y"
    assert found(spark, [text], least)[0][0] == ([(1, 21, 3)] if least < 22 else [])
