"""How far the sources of a language differ in their terms: distances between all sources, and each source's most telling terms.

Terms are counted once for each language, source and term; batches of texts are counted before anything is shuffled. A group is a
source within a language. The chance of a term in a group is ``1 + floor(10**9 * (count + 1) / (N + V))`` of a thousand millionths, with V terms kept in the
language and N occurrences of them in the group; ``f(p, q) = floor((p - q)**2 / q)`` is what a term adds to the distance from p to q.

* Pairs: most terms of a group are missing in another one, where they have the chance that a count of zero gives. So each distance is
  summed from how many terms have each count, and postings (the groups that hold a term) correct it for terms that both groups hold.
  All pairs of groups are the result; no pair of rows of text or terms is made outside a term's own posting.
* Terms: terms with the same count in a group form a bucket. As p is the same for all of them and f falls with q while q < p, the bucket's
  smallest chance in the language bounds f. Buckets are read best bound first, in rounds of growing size, until all unread bounds of a
  group are strictly below its k-th value. Each round's rows lie in a folder of their own, so unread buckets are never evaluated.

All arithmetic is exact in 64 bits, for up to 9 * 10**15 occurrences in a language.

Cases: null text, language or source is the empty string; a text without terms still makes its group occur. Repeated rows are documents of
their own. Ties rank by the item's UTF-8 bytes. An empty table gives an empty result. Columns besides the three are not read and may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, drop, materialize, scratch_path
from .components import SALTS
from .words import LETTERS, byte_map, cut

UNIT, LEAST_DOCUMENTS, TOP = 1_000_000_000, 3, 200
#: A posting is dealt out by blocks of so many groups, so that no task holds more than two blocks of one, however many groups there are.
BLOCK = 256
#: Each round of the search reads so many times the terms of the one before.
GROWTH = 8

_KEPT = byte_map(LETTERS)


def _div(a, b) -> Column:
    return F.call_function("div", a, b)


def chance(count, total) -> Column:
    """1 + floor(UNIT * (count + 1) / total), by long division in steps of 1,000 so that no product leaves 64 bits."""
    total = F.greatest(total, F.lit(1).cast("bigint"))
    rest, out = count + F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, total), (rest * 1000) % total
    return out + 1


def added(p, q) -> Column:
    """f(p, q)."""
    return _div((p - q) * (p - q), q)


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """For each language and term of a stretch of texts: its sources, and the occurrences and documents in each."""
    names = ["lang", "term", "sources", "counts", "documents"]
    for b in chunks(batches, "text"):
        words = cut(b["text"], _KEPT)
        if not len(words.codes):
            continue
        lang, source = b["lang"].dictionary_encode(), b["source"].dictionary_encode()
        langs, sources = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy()
        many, terms = len(source.dictionary), len(words.distinct)
        groups, group = np.unique(langs * many + sources, return_inverse=True)  # in order of languages
        held, times = np.unique(np.repeat(np.arange(b.num_rows), np.diff(words.bounds)) * terms + words.codes, return_counts=True)
        doc, term = held // terms, held % terms
        key = (langs[doc] * terms + term) * len(groups) + group[doc]
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts, documents, key = np.add.reduceat(times, first), np.diff(np.append(first, len(key))), key[first]
        by = source.dictionary.take(pa.array(groups[key % len(groups)] % many))
        key //= len(groups)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = pa.array(np.append(start, len(key)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (by, pa.array(counts), pa.array(documents))]
        out = pa.record_batch([lang.dictionary.take(pa.array(key[start] // terms)), words.distinct.take(pa.array(key[start] % terms)).cast(pa.string()), *lists], names=names)
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)


def count_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, text="text", lang="lang", source="source") -> DataFrame:
    """lang, term, source and n (occurrences) of all terms in at least so many documents of their language, with total (occurrences in
    the language) and lead (true in one row of each language and term)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(own) for c, own in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = rows.mapInArrow(_counted, "lang string, term string, sources array<string>, counts array<bigint>, documents array<bigint>")
    # lists go through the shuffle, and all that follows needs no other one
    each = counted.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts", "documents")).alias("x"))
    summed = each.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.sum("x.documents").alias("documents"))
    own = Window.partitionBy("lang", "term")
    whole = summed.withColumns({"total": F.sum("n").over(own), "in_documents": F.sum("documents").over(own), "first": F.min("source").over(own)})
    return whole.where(F.col("in_documents") >= least).select("lang", "term", "source", "n", "total", (F.col("source") == F.col("first")).alias("lead"))


def _dealt(left: DataFrame, right: DataFrame, on: list[str], term: str = "term", how: str = "inner") -> DataFrame:
    """An equi-join where ``on`` may be hot on the left and is unique on the right: left rows are spread by their term."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(term), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def _groups(docs: DataFrame, terms: DataFrame, buckets: DataFrame, lang: str, source: str, block: int) -> DataFrame:
    """Every group that occurs: its number within the language, size (N + V), own (terms it holds) and p0 (the chance of a term it
    lacks); kept (V), of_lang (the language's N + V) and blocks of groups."""
    occurring = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    langs = terms.groupBy("lang").agg(F.sum(F.col("lead").cast("bigint")).alias("kept"), F.sum("n").alias("of_lang"))
    sums = buckets.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("size"), F.sum("terms").alias("own"))
    out = occurring.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["kept", "of_lang", "size", "own"])
    own = Window.partitionBy("lang")
    out = out.withColumns({"size": F.col("size") + F.col("kept"), "of_lang": F.col("of_lang") + F.col("kept"), "number": F.row_number().over(own.orderBy("source")) - 1, "blocks": F.ceil(F.count("*").over(own) / block).cast("int")})
    return out.withColumn("p0", chance(F.lit(0).cast("bigint"), F.col("size")))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Sums:
    """Corrections of the distances between the groups of one block, or of two, for terms that both groups hold."""

    def __init__(self, key: tuple[str, int, int], block: int):
        self.key, self.block, self.width = key, block, block if key[1] == key[2] else 2 * block
        self.sums = np.zeros(self.width * self.width, np.int64)

    def add(self, number: np.ndarray, p: np.ndarray, p0: np.ndarray, first: np.ndarray) -> None:
        """Postings begin at each of ``first``; those of equal length are taken together."""
        (_, low, high), block = self.key, self.block
        own = number - low * block if low == high else np.where(number // block == low, number - low * block, block + number - high * block)
        sizes = np.diff(np.append(first, len(number)))
        for k in np.unique(sizes[sizes > 1]).tolist():
            heads, step = first[sizes == k], max(1, (1 << 20) // (k * k))
            for i in range(0, len(heads), step):
                at = heads[i : i + step, None] + np.arange(k)
                a, x, z = own[at], p[at], p0[at]
                s, t = a[:, :, None], a[:, None, :]
                apart = s != t if low == high else s // block != t // block
                xs, xt, zs, zt = x[:, :, None], x[:, None, :], z[:, :, None], z[:, None, :]
                more = _f(xs, xt) - _f(xs, zt) - _f(zs, xt) + _f(zs, zt)
                np.add.at(self.sums, (s * self.width + t)[apart], more[apart])

    def rows(self) -> pa.RecordBatch:
        (lang, low, high), block = self.key, self.block
        at = np.flatnonzero(self.sums)
        number = lambda x: np.where(x < block, x + low * block, x - block + high * block)
        return pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(number(at // self.width), pa.int32()), pa.array(number(at % self.width), pa.int32()), pa.array(self.sums[at])], names=["lang", "s", "t", "value"])


def _paired(block: int, batches) -> Iterator[pa.RecordBatch]:
    """Sums of rows that are sorted by language, blocks and term; the last posting waits for the batch after it."""
    sums, rest = None, None
    stream = chunks(batches, "term", 1 << 21)
    while True:
        b = next(stream, None)
        own = rest if b is None else b if rest is None else pa.concat_batches([rest, b])
        if own is None or not own.num_rows:
            break
        lang, low, high = own["lang"].dictionary_encode().indices.to_numpy(), own["low"].to_numpy(), own["high"].to_numpy()
        term = own["term"].dictionary_encode().indices.to_numpy()
        section = np.append(True, (lang[1:] != lang[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        posting = np.flatnonzero(section | np.append(True, term[1:] != term[:-1]))
        end = own.num_rows if b is None else int(posting[-1])
        rest = None if b is None else own.slice(end)
        number, p, p0 = (own[c].to_numpy().astype(np.int64) for c in ("number", "p", "p0"))
        begins = [i for i in np.flatnonzero(section).tolist() if i < end]
        for i, z in zip(begins, [*begins[1:], end], strict=True):
            key = (own["lang"][i].as_py(), int(low[i]), int(high[i]))
            if sums is None or sums.key != key:
                if sums:
                    yield sums.rows()
                sums = _Sums(key, block)
            inside = posting[(posting >= i) & (posting < z)]
            sums.add(number[i:z], p[i:z], p0[i:z], inside - i)
        if b is None:
            break
    if sums:
        yield sums.rows()


def pairs(terms: DataFrame, buckets: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item (each other source of the language) and value, the sum of f over all kept terms."""
    held = _dealt(terms.select("lang", "term", "source", "n"), groups.select("lang", "source", "number", "size", "p0", "blocks"), ["lang", "source"])
    at = (F.col("number") / block).cast("int")
    held = held.select("lang", "term", "number", chance(F.col("n"), F.col("size")).alias("p"), "p0", at.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term", "number", "p", "p0")
    held = held.repartition("lang", "low", "high", "term").sortWithinPartitions("lang", "low", "high", "term")
    both = held.mapInArrow(functools.partial(_paired, block), "lang string, s int, t int, value bigint")

    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("t"), F.col("p0").alias("q0"), F.col("own").alias("their"))
    mine = groups.select("lang", "source", F.col("number").alias("s"), "size", "p0", "own", "kept")
    neither = mine.join(other, "lang").where("s <> t").select("lang", "s", "t", "source", "item", ((F.col("kept") - F.col("own") - F.col("their")) * added(F.col("p0"), F.col("q0"))).alias("value"))
    counts = buckets.join(mine, ["lang", "source"]).select("lang", "s", "p0", "terms", chance(F.col("n"), F.col("size")).alias("p")).join(other, "lang").where("s <> t")
    one = F.array(F.struct("s", "t", (F.col("terms") * added(F.col("p"), F.col("q0"))).alias("value")), F.struct(F.col("t").alias("s"), F.col("s").alias("t"), (F.col("terms") * added(F.col("q0"), F.col("p"))).alias("value")))
    rest = counts.select("lang", F.explode(one).alias("x")).select("lang", "x.*").unionByName(both)
    whole = neither.unionByName(rest.withColumns({"source": F.lit(None).cast("string"), "item": F.lit(None).cast("string")}))
    return whole.groupBy("lang", "s", "t").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value")).select("lang", "source", "item", "value")


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def telling_terms(terms: DataFrame, buckets: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value and rank of the ``top`` terms of each group that are more likely in it than in its language."""
    spark, by = terms.sparkSession, ["lang", "source"]
    p, most = chance(F.col("n"), F.col("size")), chance(F.col("lo"), F.col("of_lang"))
    bounds = buckets.join(groups.select("lang", "source", "size", "of_lang"), by).withColumns({"p": p, "q": most}).where("p > q").withColumn("bound", added(F.col("p"), F.col("q")))
    before = F.sum("terms").over(Window.partitionBy(*by).orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")
    turn = F.when(before < top, 0).otherwise(F.floor(F.log(before / top) / F.log(F.lit(GROWTH))) + 1).cast("int")
    bounds = materialize(bounds.withColumn("round", turn).select(*by, "n", "p", "of_lang", "bound", "round"), "bounds")
    rows = _dealt(terms.select("lang", "source", "term", "n", "total"), bounds, [*by, "n"]).select(*by, F.col("term").alias("item"), "total", "p", "of_lang", "bound", "round")
    path = scratch_path(spark, "rounds")
    rows.write.partitionBy("round").parquet(path)
    kind = rows.drop("round").schema
    best = spark.createDataFrame([], "lang string, source string, item string, value bigint, rank int")
    old = None
    for turn in sorted(r["round"] for r in bounds.select("round").distinct().collect()):
        kth = best.where(F.col("rank") == top).select(*by, F.col("value").alias("kth"))
        if old is not None and bounds.where(F.col("round") >= turn).join(kth, by, "left").where("bound >= coalesce(kth, 0)").isEmpty():
            break
        own = spark.read.schema(kind).parquet(f"{path}/round={turn}")
        if old is not None:
            own = _dealt(own, kth, by, "item", "left").where("bound >= coalesce(kth, 0)")
        own = own.withColumn("q", chance(F.col("total"), F.col("of_lang"))).where("p > q").select(*by, "item", added(F.col("p"), F.col("q")).alias("value"))
        both = best.drop("rank").unionByName(own)
        best = materialize(both.withColumn("rank", _ranked(both)).where(F.col("rank") <= top), "telling")
        drop(old)
        old = best
    return best


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text="text", lang="lang", source="source", block: int = BLOCK) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: the distances of each source to all others of its language,
    and its ``top`` most telling terms."""
    terms = materialize(count_terms(docs, least, text, lang, source), "terms")
    buckets = materialize(terms.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.min("total").alias("lo")), "buckets")
    groups = materialize(_groups(docs, terms, buckets, lang, source, block), "groups")
    distances = pairs(terms, buckets, groups, block)
    first = distances.withColumn("rank", _ranked(distances))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(first, "pair").unionByName(columns(telling_terms(terms, buckets, groups, top), "term"))
