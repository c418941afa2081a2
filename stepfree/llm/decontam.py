"""Benchmark decontamination: documents are streamed through a generalised suffix automaton of the test items' words.

The automaton holds every stretch of words of every item. While a document's words go by, its state stands for the longest stretch
that ends here and occurs in some item, and its length is tracked. Where that is at least ``window`` words, the words of the stretch
are hit: each ``window`` of them is one of an item. Items shorter than a window are hit as a whole. A word that no item has sets the
automaton back, so only stretches of known words are streamed, and those shorter than any window are passed over.

Test items go to the tasks in parts of at most ``PART`` words, each with its own automaton; beyond one part documents are streamed
once for each, and what was found goes along in a table. So what is broadcast is bounded whatever the size of the benchmark.

Cases: null texts and those without words hit nothing and are not hit; an item without words is none. Items that share an id are one
item; a null id is the empty string. Repeated documents are judged each by itself; nothing is shuffled. An empty benchmark
leaves all documents as they are, an empty table of documents gives an empty one. All columns stay, whatever their names; the new
ones take the first free name (``spans``, ``spans_1``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks, drop, free_name, materialize
from .words import DIGITS, LETTERS, byte_map, cut

WINDOW, COVERAGE = 10, 0.5
#: Words of test items that one automaton holds: it has at most twice as many states.
PART = 300_000

_KEPT = byte_map(LETTERS, DIGITS)


class Automaton:
    """Generalised suffix automaton of sequences of words; states are numbers, 0 the empty stretch."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids, self.vocabulary = window, sorted({i for i, w in items if w}), {}
        self.after, self.link, self.length = [{}], [-1], [0]
        number = {i: k for k, i in enumerate(self.ids)}
        coded = [(number[i], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.link)
        # of each state: the state of its stretches' last ``window`` words, and whole short items among its stretches' ends
        self.windows, self.short, self.hot = [-1] * n, [()] * n, bytearray(n)
        self.shortest = window
        held: dict[int, set[int]] = {}
        for s in self._by_length():
            self.windows[s] = s if self.length[s] >= window > self.length[self.link[s]] else self.windows[self.link[s]] if s else -1
        for item, words in coded:
            s = 0
            for k, w in enumerate(words, 1):
                s = self.after[s][w]
                if k >= window:
                    held.setdefault(self.windows[s], set()).add(item)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                self.short[s] = (*self.short[s], (len(words), item))
        for s in self._by_length():
            if s and self.short[self.link[s]]:
                self.short[s] = (*self.short[s], *self.short[self.link[s]])
            self.hot[s] = self.length[s] >= window or bool(self.short[s])
        self.items = {s: tuple(sorted(own)) for s, own in held.items()}

    def _by_length(self) -> list[int]:
        return sorted(range(len(self.link)), key=self.length.__getitem__)

    def _state(self, length: int, link: int, after: dict) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of those stretches of q that are p's with w: q itself, or a copy of it that is no longer than they are."""
        if self.length[p] + 1 == self.length[q]:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.after[q]))
        self.link[q] = own
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, w: int) -> int:
        if w in self.after[last]:
            return self._split(last, w, self.after[last][w])
        own, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.after[p]:
            self.after[p][w] = own
            p = self.link[p]
        if p >= 0:
            self.link[own] = self._split(p, w, self.after[p][w])
        return own

    def stream(self, words: list[int], start: int, spans: list[list[int]], found: set[int]) -> None:
        """Adds to spans (first word and the one after the last, apart and in order) and found (items) what words, from number start on, hit."""
        after, link, length, hot, window = self.after, self.link, self.length, self.hot, self.window
        s = n = 0
        for at, w in enumerate(words, start + 1):
            to = after[s].get(w)
            if to is None:
                while to is None and s:
                    s = link[s]
                    to = after[s].get(w)
                n = length[s]
            s, n = to, n + 1
            if not hot[s]:
                continue
            most = 0
            if n >= window:
                most = n
                found.update(self.items[self.windows[s]])
            for size, item in self.short[s]:
                if size <= n:
                    most = max(most, size)
                    found.add(item)
            if most:
                first = at - most
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, at])


def item_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(bytes(_KEPT)).replace(b"\0", b" ").split()


def parts(items: DataFrame, window: int, most: int, text: str, item_id: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Ids and words of the test items, some at a time, so that each part but a small first one has at most ``most`` words.

    Items with more are cut into pieces that overlap by all but one word of a window, so that no window is lost.
    """
    out, size, step = [], 0, most - window + 1
    for r in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        words = item_words(r["t"])
        for piece in [words] if len(words) <= most else (words[k : k + most] for k in range(0, len(words) - window + 1, step)):
            if out and size + len(piece) > most:
                yield out
                out, size = [], 0
            out.append((r["i"], piece))
            size += len(piece)
    yield out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _list_column(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])), pa.int32()), pa.array([x for v in values for x in v], kind))


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text="text", item_text="text", item_id="item_id", columns: list[str] | None = None, part: int = PART, names: dict[str, str] | None = None, cleaned: str | None = None) -> DataFrame:
    """The columns of docs (or those chosen) with ``n_words``, ``spans`` (start and length in words of each hit stretch), ``items``
    (ids of the items with windows in the text, in order) and, if a name is given for it, the text ``cleaned`` of the spans."""
    bounded_batches(docs.sparkSession)
    names = names or {c: free_name(docs, c) for c in ("n_words", "spans", "items")}
    left, before = parts(items, window, part, item_text, item_id), None
    own = next(left)
    for more in left:
        docs_so_far = materialize(_streamed(docs if before is None else before, own, window, text, docs.columns, names, None), "hits")
        drop(before)
        own, before = more, docs_so_far
    return _streamed(docs if before is None else before, own, window, text, columns or docs.columns, names, cleaned)


def _streamed(docs: DataFrame, part: list[tuple[str, list[bytes]]], window: int, text: str, columns: list[str], names: dict[str, str], cleaned: str | None) -> DataFrame:
    """One pass over docs with the automaton of a part; what earlier passes found is in docs already."""
    spark = docs.sparkSession
    shared, again = spark.sparkContext.broadcast(Automaton(part, window)), names["spans"] in docs.columns
    fields = [docs.schema[c] for c in columns] + [T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))), T.StructField(names["items"], T.ArrayType(T.StringType()))]
    fields += [T.StructField(cleaned, T.StringType())] if cleaned else []

    def run(batches):
        automaton = shared.value
        for b in chunks(batches, text):
            words = cut(b[text], _KEPT)
            spans, found = [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            ids = np.array([automaton.vocabulary.get(w, -1) for w in words.distinct.to_pylist()], np.int64)
            known = ids[words.codes] if len(ids) else np.zeros(0, np.int64)
            for first, end in _stretches(known >= 0, words.bounds, automaton.shortest):
                doc = int(np.searchsorted(words.bounds, first, "right")) - 1
                automaton.stream(known[first:end].tolist(), first - int(words.bounds[doc]), spans[doc], found[doc])
            found = [{automaton.ids[k] for k in own} for own in found]
            if again:
                for doc, (old, had) in enumerate(zip(b[names["spans"]].to_pylist(), b[names["items"]].to_pylist(), strict=True)):
                    spans[doc] = _merged(spans[doc] + [[x["start"], x["start"] + x["length"]] for x in old])
                    found[doc].update(had)
            spread = [[{"start": a, "length": z - a} for a, z in own] for own in spans]
            out = [b[c] for c in columns] + [pa.array(np.diff(words.bounds)), _list_column(spread, _SPAN), _list_column([sorted(own) for own in found], pa.string())]
            if cleaned:
                out.append(_cleaned(b[text], words, spans))
            yield pa.record_batch(out, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def _stretches(known: np.ndarray, bounds: np.ndarray, least: int):
    """First and end of each longest stretch of known words of one text that has at least so many."""
    edge = np.zeros(len(known) + 1, bool)
    edge[bounds] = True
    on = np.append(known, False)
    before = np.append(False, on[:-1]) & ~edge
    first = np.flatnonzero(on & ~before)
    after = np.append(on[1:], False) & ~np.append(edge[1:], True)
    end = np.flatnonzero(on & ~after) + 1
    long = end - first >= least
    return zip(first[long].tolist(), end[long].tolist(), strict=True)


def _cleaned(texts: pa.Array, words, spans: list[list[list[int]]]) -> pa.Array:
    """The texts without their spans; what stood before and after one is joined as it is. Null stays null."""
    out = texts.to_pylist()
    for doc, own in enumerate(spans):
        if own:
            data, at, rest = out[doc].encode("utf-8", "surrogatepass"), 0, []
            for first, end in own:
                k = int(words.bounds[doc])
                rest.append(data[at : int(words.starts[k + first] - words.texts[doc])])
                at = int(words.ends[k + end - 1] - words.texts[doc])
            out[doc] = b"".join([*rest, data[at:]]).decode("utf-8", "surrogatepass")
    return pa.array(out, texts.type)


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["length"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text="text", item_text="text", item_id="item_id") -> DataFrame:
    """docs without the spans that hit test items; documents of which more than ``coverage`` of the words are hit go."""
    names = {c: free_name(docs, c) for c in ("n_words", "spans", "items")}
    own = free_name(docs, "cleaned")
    found = find_hits(docs, items, window, text, item_text, item_id, names=names, cleaned=own)
    few = hit_words(F.col(names["spans"])) <= coverage * F.col(names["n_words"])
    return found.where(few).select(*(F.col(own).alias(c) if c == text else F.col(c) for c in docs.columns))
