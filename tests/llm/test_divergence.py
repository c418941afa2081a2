"""Distances and telling terms against sums over all terms, in several rounds and blocks, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stepfree.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "text string, lang string, source string"


def brute(rows, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    chance = lambda n, total: 1 + 10**9 * (n + 1) // total
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        size = {s: sum(counts[lang, s][t] for t in kept) + len(kept) for la, s in groups if la == lang}
        p = {s: {t: chance(counts[lang, s][t], size[s]) for t in kept} for s in size}
        n_lang = sum(size.values()) - len(size) * len(kept)
        q = {t: chance(sum(counts[lang, s][t] for s in size), n_lang + len(kept)) for t in kept}
        own = p[source]
        pair = [(sum((own[t] - p[s][t]) ** 2 // p[s][t] for t in kept), s) for s in size if s != source]
        term = [((own[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def result(docs, **parameters):
    return sorted(tuple(r) for r in divergence.audit(docs, **parameters).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(rng, n, sources=7):
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        source = rng.choice(["s", None, *(f"s{i}" for i in range(sources))] + ["hot"] * 5)
        own = rng.choices(words, weights, k=rng.randint(0, 40)) + [f"only{source}"] * rng.randint(0, 3)
        rows.append((rng.choice([" ", "-", "1", "_"]).join(own).replace("a", rng.choice("aA")), rng.choice(["x", "y", None, "Z"]), source))
    return rows + [(None, "y", "empty"), ("", "lone", "only"), ("un peu", "lone", "two"), ("12 _", "zz", "a")]


@pytest.mark.parametrize(("top", "block"), [(200, 256), (3, 2), (1, 4)])
def test_equals_sums_over_all_terms(spark, top, block):
    rows = corpus(random.Random(top), 400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(docs, top=top, block=block) == brute(rows, 3, top)


def test_rounds_stop_before_all_is_read(spark, monkeypatch):
    """With one telling term a group and steep bounds, later rounds aren't read, and the result is the same."""
    rng = random.Random(9)
    rows = [(" ".join(["mark" + str(i % 3)] * 30 + [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(60)]), "x", str(i % 3)) for i in range(300)]
    read, own = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: read.extend(p for p in paths if "/round=" in p) or own(self, *paths))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(docs, top=1) == brute(rows, 3, 1)
    terms = divergence.materialize(divergence.count_terms(docs), "t")
    assert len(read) < terms.groupBy("source").count().agg(F.max("count")).first()[0] / divergence.GROWTH
    assert sum(spark.read.parquet(p).count() for p in list(read)) < terms.count() / 2


def test_chance_is_exact_for_large_counts(spark):
    rows = [(n, t) for n, t in ((0, 1), (8_999_999_999_999_999, 9_000_000_000_000_000), (123_456_789_012_345, 8_765_432_109_876_543), (5, 7), (6, 7), (0, 9_000_000_000_000_000))]
    got = spark.createDataFrame(rows, "n long, t long").select(divergence.chance(F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // t for n, t in rows]


def test_odd_rows(spark):
    docs = spark.createDataFrame([("a b", "x", "s", 1, 2)] * 3 + [("a", "x", "t", 1, 2)], SCHEMA + ", n int, TERM int")
    assert result(docs) == brute([("a b", "x", "s")] * 3 + [("a", "x", "t")], 3, 200)
    assert result(docs.limit(0)) == []
    nothing = spark.createDataFrame([(None, None, None), ("x", None, "s")], SCHEMA)
    assert result(nothing) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    long = [("w " * 300_000 + "v", "x", "s"), ("w v", "x", "s"), ("v w u", "x", "t")]
    assert result(spark.createDataFrame(long, SCHEMA)) == brute(long, 3, 200)
