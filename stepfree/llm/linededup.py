"""Removes passages that occurred before, word by word and over line breaks, found by winnowing.

A passage is a run of consecutive words of one document; words are parted by ASCII white space, and only words count, not the
space or line breaks between them. A passage of at least ``passage`` words that also starts earlier, by (id, word), is deleted to
its last word; the earliest stays. Lines of real tables hold thousands of words and passages begin anywhere in them, so the
units that are hashed are words, not whole lines.

* Select: in every stretch of exactly ``passage`` words the smallest hash of ``passage // 2`` words is a fingerprint. It depends on
  the stretch alone, so it is at the same place of each copy of the stretch.
* Join positions: places of equal fingerprints are brought together; one that stands at a single place is done with.
* Extend: a place that has partners is extended both ways, word by word, to every stretch that selects it, and the stretches'
  hashes are joined again; where they are equal, the copy goes on. The first place of each is the origin, the others are later copies.
* Delete: the union of a document's later stretches, which is its maximal repeated passages.

So the result is exact (up to collisions of 64-bit hashes of texts and 95-bit ones of stretches) although no place is compared
with each other one, and what occurs once costs no more than its fingerprints. Equal texts are one from the start.

Hot fingerprints, which several of a bounded sample's texts hold, need no partners to be found: they skip that join, and their
stretches are dealt out by salts, whose first places are joined once more. The sample decides what is salted, never the result.

Where runs of whole lines are to go that hold fewer words than that (``least``), lines are units of their own: in every window of
two lines the one with the smaller hash is selected, and every line of ``least`` words; the shortest windows round them are joined.

Cases: a null text stays null and an empty one empty; an empty table gives an empty one. In a text that repeats itself the
first period stays. Of equal documents the smallest id keeps the text. Of a line that holds more than the passage the rest stays; a line
left without words goes. Rows that share an id are told apart by their text, and equal rows keep or lose the same words; rows without
an id are left as they are. Other columns pass through and may have any names; if one is called like the count of lines, the count
gets the next free name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, giving_back, materialize
from .components import salted_join

LEAST_WORDS = PASSAGE_WORDS = 50
#: Texts of the sample that tells hot fingerprints, in how many of them such a one is, how many there are at most, and over how many
#: tasks each is dealt.
SAMPLE, OFTEN, HOT, SALTS = 4000, 40, 1 << 16, 16
_SLOTS = 1 << 22
_WORD = re.compile(r"[^ \t-\r]+")
_FACTOR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: A batch's texts are hashed in parts of so many bytes; places within one take PLACE bits.
_PART, PLACE = 1 << 18, 28


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _FACTOR[1]
    return h ^ (h >> np.uint64(29))


def _powers(factor: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor to the power of 0 .. n - 1, and of 0 .. 1 - n (modulo 2**64)."""
    kept = _powers.kept.get(int(factor))
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        kept = _powers.kept[int(factor)] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)])) for f in (factor, np.uint64(pow(int(factor), -1, 1 << 64))))
    return kept[0][:n], kept[1][:n]


_powers.kept = {}


def _sums(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(factor, len(values))[0])])


def _words_of_bytes(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (and the last one's end); docs: the texts' places in the bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[docs] = True
    begin = ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    start = np.flatnonzero(begin)
    stop = ~space
    stop[:-1] &= space[1:] | edge[1:-1]
    end = np.flatnonzero(stop) + 1
    hashes = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):  # in parts, as a byte takes many bytes here
        last = max(first + 1, int(np.searchsorted(end, start[first] + _PART, side="right")))
        a, z = start[first], end[last - 1]
        sums = _sums(data[a:z].astype(np.uint64) + np.uint64(1), _FACTOR[2])
        s, e = start[first:last] - a, end[first:last] - a
        hashes[first:last] = (sums[e] - sums[s]) * _powers(_FACTOR[2], z - a)[1][s]
        first = last
    return _finish(hashes), np.searchsorted(start, docs)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For a column of texts: hash of every word, and where each text's words begin, with the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return _words_of_bytes(data, offsets - offsets[0])


def stretch_hashes(w: np.ndarray, n: int, factor: np.uint64 = _FACTOR[0]) -> np.ndarray:
    """Hashes of all stretches of n words."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    sums, back = _sums(w, factor), _powers(factor, len(w))[1]
    return _finish((sums[n:] - sums[:-n]) * back[: len(w) - n + 1])


def selected_words(w: np.ndarray, starts: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each stretch of ``passage`` words within one text begins, the place of its smallest hash of ``passage // 2`` words
    (the first of equal ones), and all these hashes."""
    size = max(1, passage // 2)
    h, window = stretch_hashes(w, size), passage - size + 1
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    low = np.uint64((1 << PLACE) - 1)
    least, span = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low), 1
    while span < window:
        step = min(span, window - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begin = np.flatnonzero(text[: len(least)] == text[passage - 1 :][: len(least)])
    # the place is known modulo 2**PLACE, and lies within the window
    return begin, begin + (((least[begin] & low).astype(np.int64) - begin) & int(low)), h


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("d is not null and t is not null")


def _first_of_runs(keys: list[np.ndarray], place: list[np.ndarray], held):
    """For rows sorted by keys and place: the place of the first row of each row's run, and whether it is another; held is the last batch's end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    joins = held is not None and all(k[0] == v for k, v in zip(keys, held[0], strict=True))
    run = np.cumsum(new) - 1
    first = [x[np.flatnonzero(new)] for x in place]
    if joins:
        for x, v in zip(first, held[1], strict=True):
            x[0] = v
    first = [x[run] for x in first]
    return first, np.logical_or.reduce([x != y for x, y in zip(place, first, strict=True)]), ([k[-1] for k in keys], [x[-1] for x in first])


def _often(batches):
    """Of rows sorted by key those whose key is at more than one place."""
    held = None
    for b in batches:
        if b.num_rows:
            key, h, at, d = (b[c].to_numpy() for c in ("key", "h", "at", "d"))
            (h0, at0, d0), other, held = _first_of_runs([key], [h, at, d], held)
            other &= (h != h0) | (at != at0)
            # the first place goes out with each other one; equal rows are one later
            yield pa.record_batch({c: pa.array(np.concatenate([x[other], y[other]])) for c, x, y in (("h", h, h0), ("at", at, at0), ("d", d, d0))})


def _later(passage: int):
    """Of stretches sorted by key, salt and place those that are not the first, as first << 32 | last word to delete; and the first ones of salted keys."""

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                k1, p, d, h, salt = (b[c].to_numpy() for c in ("k1", "p", "d", "h", "salt"))
                at = p & 0xFFFFFFFF
                (d0, at0, h0), other, held = _first_of_runs([k1, p >> 32, salt], [d, at, h], held)
                # a passage may overlap its own earlier copy: what the first copy holds stays
                begin = np.where((d == d0) & (h == h0), np.maximum(at, at0 + passage), at)
                last = at + passage - 1
                out = other & (begin <= last)
                again = ~other & (salt > 0)
                none = np.zeros(int(again.sum()), np.int64)
                yield pa.record_batch({
                    "d": np.concatenate([d[out], d[again]]), "h": np.concatenate([h[out], h[again]]), "run": np.concatenate([(begin << 32 | last)[out], none - 1]),
                    "k1": np.concatenate([np.zeros(int(out.sum()), np.int64), k1[again]]), "p": np.concatenate([np.zeros(int(out.sum()), np.int64), p[again]]),
                })

    return run


def _fingerprints(passage: int, hot: np.ndarray, only_hot: bool | None = None):
    """(key, h, at, d) of the fingerprints of each text. only_hot: True for those of hot keys, False for the others, None for all."""

    def run(batches):
        seen: set[int] = set()  # equal texts have equal fingerprints
        for b in batches:
            hashes = b["h"].to_pylist()
            if len(seen) > 1 << 18:
                seen.clear()
            new = []
            for i, x in enumerate(hashes):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            w, starts = word_hashes(b["t"])
            _, place, h = selected_words(w, starts, passage)
            place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
            key = h[place].view(np.int64)
            if only_hot is not None and len(key):
                keep = _among(key, hot) == only_hot
                place, key = place[keep], key[keep]
            text = np.searchsorted(starts, place, side="right") - 1
            yield pa.record_batch({"key": key, "h": b["h"].to_numpy()[text], "at": place - starts[text], "d": b["d"].to_numpy()[text]})

    return run


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _hot_keys(rows: DataFrame, passage: int, sample: int, often: int, most: int) -> np.ndarray:
    """Fingerprints at ``often`` places in about ``sample`` texts, sorted; ``most`` of them at most, the most frequent ones."""
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "d"), F.lit(1 << 30)) < int(share * (1 << 30)))
    own = drawn.mapInArrow(_fingerprints(passage, np.zeros(0, np.int64)), "key bigint, h bigint, at bigint, d bigint")
    got = own.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("a") < F.col("b")) & (F.col("n") >= often)).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(got["key"].to_numpy())


def later_passages(docs: DataFrame, passage: int = PASSAGE_WORDS, text="text", doc_id="doc_id", sample: int = SAMPLE, often: int = OFTEN) -> DataFrame:
    """d, h (of the text) and passages: the word ranges (first << 32 | last) of each document that occurred before; documents without any are absent."""
    bounded_batches(docs.sparkSession)
    rows = _texts(docs, text, doc_id)
    hot = _hot_keys(rows, passage, sample, often, HOT)
    schema = "key bigint, h bigint, at bigint, d bigint"
    joined = rows.mapInArrow(giving_back(_fingerprints(passage, hot, False)), schema).repartition("key").sortWithinPartitions("key", "h", "at", "d").mapInArrow(_often, "h bigint, at bigint, d bigint")
    known = rows.mapInArrow(giving_back(_fingerprints(passage, hot, True)), schema).select("h", "at", "d") if len(hot) else joined.limit(0)
    marks = joined.union(known).groupBy("h").agg(F.min("d").alias("d"), F.collect_set("at").alias("at"))
    # the smallest id that has a text stands for all that have it
    texts = materialize(rows.groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 < d1").select("h", "d0"), "passages-copies")
    marks = materialize(marks.join(texts, "h", "left").select(F.coalesce("d0", "d").alias("d"), "h", "at"), "passages-marks")

    # a bitmap of bounded size keeps most texts without marks out of the join
    some = np.zeros(_SLOTS, bool)
    some[marks.select(F.pmod("h", F.lit(_SLOTS)).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()] = True

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(some[b["h"].to_numpy() % _SLOTS]))

    def stretch(batches):
        for b in batches:
            if not b.num_rows:
                continue
            w, starts = word_hashes(b["t"])
            begin, place, h = selected_words(w, starts, passage)
            text = np.searchsorted(starts, begin, side="right") - 1
            # a stretch whose fingerprint is marked
            marks = b["at"]
            marked = np.zeros(len(w) + 1, bool)
            marked[marks.flatten().to_numpy() + np.repeat(starts[:-1], pc.list_value_length(marks).to_numpy())] = True
            keep = marked[place]
            begin, text, place = begin[keep], text[keep], place[keep]
            k1 = stretch_hashes(w, passage)[begin] if len(begin) else np.zeros(0, np.uint64)
            more = stretch_hashes(w, passage, _FACTOR[1])[begin] if len(begin) else np.zeros(0, np.uint64)
            p = more >> np.uint64(33) << np.uint64(32) | (begin - starts[text]).astype(np.uint64)
            d = b["d"].to_numpy()[text]
            salt = np.where(_among(h[place].view(np.int64), hot), 1 + _finish(d.view(np.uint64)) % np.uint64(SALTS), 0).astype(np.int64)
            yield pa.record_batch({"k1": k1.view(np.int64), "p": p.view(np.int64), "d": d, "h": b["h"].to_numpy()[text], "salt": salt})

    # p: 31 more bits of the hash, and the word. The join shuffles, as else a task would hold a Python worker on either side of it
    order = ["k1", F.shiftright("p", 32), "salt", "d", "p", "h"]
    stretches = rows.mapInArrow(likely, "d bigint, h bigint, t string").join(marks.hint("merge"), ["d", "h"]).select("d", "h", "t", "at").mapInArrow(stretch, "k1 bigint, p bigint, d bigint, h bigint, salt bigint")
    later = stretches.repartition("k1", "salt").sortWithinPartitions(*order).mapInArrow(giving_back(_later(passage)), "d bigint, h bigint, run bigint, k1 bigint, p bigint")
    if len(hot):
        later = materialize(later, "passages-later")
        firsts = later.where("run = -1").select("k1", "p", "d", "h", F.lit(0).cast("bigint").alias("salt"))
        later = later.where("run >= 0").union(firsts.repartition("k1").sortWithinPartitions(*order).mapInArrow(giving_back(_later(passage)), "d bigint, h bigint, run bigint, k1 bigint, p bigint"))
    found = later.groupBy("d", "h").agg(F.collect_set("run").alias("passages"))
    every = F.array(F.lit((1 << 31) - 1).cast("bigint"))
    return found.union(salted_join(rows.select("d", "h"), texts, "h").where("d > d0").select("d", "h").distinct().withColumn("passages", every))


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of the lines that are not blank: place, hash and number of words."""
    at, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        if own := line.split():
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(own).encode("utf-8", "surrogatepass")))
            words.append(len(own))
    return at, hashes, words


def selected(hashes: list[int], words: list[int], least: int) -> list[int]:
    """Fingerprint lines: minima of windows of two lines, and lines of ``least`` words."""
    out = {i for i, n in enumerate(words) if n >= least}
    out |= {i if hashes[i] < hashes[i + 1] else i + 1 for i in range(len(hashes) - 1)}
    return sorted(out)


def windows(hashes: list[int], words: list[int], least: int) -> set[tuple[int, int]]:
    """First and last line of the windows to be joined: of ``least`` words at least, each holding a selected line."""
    n, out = len(words), set()
    total = [0, *np.cumsum(words).tolist()]
    ends = np.searchsorted(total, np.array(total[:-1]) + least, side="left").tolist() if n else []  # lines a..ends[a]-1 have enough words
    for p in selected(hashes, words, least):
        a = p
        while a >= 0:
            last = max(p, ends[a] - 1)
            if last < n:
                out.add((a, last))
            if total[p + 1] - total[a] >= least:
                break
            a -= 1
        a = max(a, 0)
        if total[p + 1] - total[a] >= least:
            if p + 1 < n:
                out.add((a, p + 1))
            if a == p and p:
                out.add((p - 1, p))
    return out


def window_rows(docs: DataFrame, least: int, text="text", doc_id="doc_id") -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("d is not null and t is not null")

    def run(batches):
        for b in batches:
            k1, k2, d, h, first, last = [], [], [], [], [], []
            for doc, t, own in zip(b["d"].to_pylist(), b["t"].to_pylist(), b["h"].to_pylist(), strict=True):
                at, hashes, words = lines_of(t)
                packed = np.array(hashes, "<u8").tobytes()
                for x, y in windows(hashes, words, least):
                    key = xxhash.xxh3_128_intdigest(packed[8 * x : 8 * (y + 1)])
                    k1.append((key >> 64) - (1 << 63))
                    k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                    d.append(doc)
                    h.append(own)
                    first.append(at[x])
                    last.append(at[y])
            yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["k1", "k2", "d", "h", "first", "last"])

    return rows.mapInArrow(run, "k1 bigint, k2 bigint, d bigint, h bigint, first int, last int")


def later_runs(docs: DataFrame, least: int = LEAST_WORDS, text="text", doc_id="doc_id") -> DataFrame:
    """d, h (of the text) and runs: the line ranges (first, last) of each document that occurred before; documents without any are absent."""
    rows = materialize(window_rows(docs, least, text, doc_id), "lines-windows").withColumn("key", F.struct("k1", "k2"))
    place = F.struct("d", "first", "h", "last")
    seen = rows.groupBy("key").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").select("key", "origin")
    later = salted_join(rows.select("key", "d", "h", "first", "last"), materialize(seen, "lines-origins"), "key").where((F.col("origin.d") != F.col("d")) | (F.col("origin.first") != F.col("first")) | (F.col("origin.h") != F.col("h")))
    # a run may overlap its own earlier copy: what the first copy holds stays
    begin = F.when((F.col("origin.d") == F.col("d")) & (F.col("origin.h") == F.col("h")) & (F.col("origin.last") >= F.col("first")), F.col("origin.last") + 1).otherwise(F.col("first"))
    return later.select("d", "h", F.struct(begin.alias("first"), F.col("last")).alias("run")).where("run.first <= run.last").groupBy("d", "h").agg(F.array_sort(F.collect_set("run")).alias("runs"))


def _without(text: str, passages: list[int], runs: list[dict], least: int) -> tuple[str, int, int]:
    """The text without word ranges and line ranges, how many lines lost words or went, and how many with words are left.

    A range that is the whole text counts only for texts of ``least`` words.
    """
    lines = text.split("\n")
    gone, changed = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    for r in runs:
        gone[r["first"] : r["last"] + 1] = True
    spans = [[m.span() for m in _WORD.finditer(x)] for x in lines]
    total = sum(map(len, spans))
    word, gap = np.zeros(total, bool), np.zeros(total + 1, bool)  # gap[i]: between words i - 1 and i
    for r in passages if total >= least else ():
        first, last = r >> 32, r & 0xFFFFFFFF
        word[first : last + 1] = True
        gap[first + 1 : last + 1] = True
    gap[-1] = False
    kept, at = [], 0
    for i, (line, own) in enumerate(zip(lines, spans, strict=True)):
        lost = word[at : at + len(own)]
        at += len(own)
        if gone[i] or not own and gap[at] or own and lost.all():
            gone[i] = True
            continue
        if lost.any():
            changed[i] = True
            ends = [*(a for a, _ in own[1:]), len(line)]
            line = (line[: own[0][0]] + "".join(line[a:b] for (a, _), b, x in zip(own, ends, lost, strict=True) if not x)).rstrip()
        kept.append(line)
    return "\n".join(kept), int((gone | changed).sum()), sum(bool(x.strip()) for x in kept)


def remove_repeats(docs: DataFrame, least: int = LEAST_WORDS, text="text", doc_id="doc_id", drop_emptied: bool = False, passage: int = PASSAGE_WORDS, deleted: str = "lines_deleted") -> DataFrame:
    """All columns of docs, the text without later repeated passages, and ``deleted``: how many lines went or lost words.

    Runs of whole lines go from ``least`` words on, passages that begin or end anywhere from ``passage`` words on.
    With drop_emptied, a document that loses all its lines goes; the text that it repeats is elsewhere.
    """
    found = later_passages(docs, passage, text, doc_id)
    if least < passage:  # else such runs are passages
        found = found.join(later_runs(docs, least, text, doc_id), ["d", "h"], "full")
    else:
        found = found.withColumn("runs", F.lit(None).cast("array<struct<first:int,last:int>>"))
    d, h, own = free_name(docs, "d"), free_name(docs, "h"), free_name(docs, "runs")
    deleted = free_name(docs, deleted)
    runs = found.select(F.col("d").alias(d), F.col("h").alias(h), F.struct("passages", "runs").alias(own))
    joined = docs.join(runs, (docs[doc_id].cast("bigint") == F.col(d)) & (F.xxhash64(docs[text]) == F.col(h)), "left").drop(d, h)
    names = docs.columns

    def run(batches):
        for b in batches:
            texts, counts, stay = [], [], []
            for t, ranges in zip(b[text].to_pylist(), b[own].to_pylist(), strict=True):
                new, gone, left = (t, 0, 1) if not ranges or t is None else _without(t, ranges["passages"] or [], ranges["runs"] or [], passage)
                texts.append(new)
                counts.append(gone)
                stay.append(not drop_emptied or left > 0)
            out = pa.record_batch([pa.array(texts, b[text].type) if n == text else b[n] for n in names] + [pa.array(counts, pa.int32())], names=[*names, deleted])
            yield out.filter(pa.array(stay, pa.bool_()))

    from pyspark.sql.types import IntegerType, StructField, StructType

    return joined.mapInArrow(giving_back(run), StructType([*docs.schema.fields, StructField(deleted, IntegerType())]))
