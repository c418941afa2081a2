"""Near-duplicate documents by 64-bit SimHash and the generalised pigeonhole principle.

The bits are grouped into partitions, correlated bits together. If partition i has threshold t_i and the (t_i + 1) sum to
more than the largest distance D, two fingerprints within D bits differ by at most t_i in some partition i. Thresholds are
allotted by dynamic programming on candidate counts estimated from the bit statistics of all fingerprints; each fingerprint
probes every value within the threshold, and candidates are verified on all 64 bits.

Cases: a null text or one without words has fingerprint zero and links like any other. Equal fingerprints are one class
from the start, so copies are never expanded into pairs. Ties don't occur: a component is named by its smallest id. An
empty table gives an empty one; columns besides id and text are not read and may have any names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, without
from .components import connected_components, salted_join

WORDS, DISTANCE, SEED, BITS = 4, 4, 42, 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit by bit the majority of the XXH64 (seed 42) of all shingles, repeats included, of the A-Z lower-cased text."""
    # bytes.lower and bytes.split act on ASCII only: A-Z, and \x20 \x09-\x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = (ends[words - 1 :] if len(parts) >= words else ends[-1:]) - 1
    h, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 15):
        own = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + (1 << 15))].tolist(), last[i : i + (1 << 15)].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and h (a hash of the text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def run(batches):
        for b in batches:
            own = np.array([fingerprint(t) for t in b["t"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b["doc_id"], pa.array(own), b["h"]], names=["doc_id", "fp", "h"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint, h bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set: 64 x 64 numbers, over all rows."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            own = b["fp"].to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(own, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        i, j = np.indices(both.shape)
        yield pa.record_batch({"i": pa.array([-1, *i.ravel()], pa.int32()), "j": pa.array([-1, *j.ravel()], pa.int32()), "n": pa.array([float(n), *both.ravel()])})

    n, both = 0, np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = int(r["n"])
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; each takes the free bit that is most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size, own = len(free) // (parts - k), [min(free)]
        free -= {own[0]}
        while len(own) < size:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two random fingerprints differ in at most 0, 1, ... ``most`` of bits that are set with chances p."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return list(np.cumsum(dist))


def allot(n: int, both: np.ndarray, distance: int = DISTANCE, row_cost: float = 1.0, pair_cost: float = 0.03) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed.

    For 2 to distance + 1 partitions, dynamic programming finds the thresholds of least cost (probing rows, and estimated
    candidate pairs to verify) whose (t + 1) sum to distance + 1; the cheapest plan is taken.
    """
    n = max(n, 1)
    p, best = np.diag(both) / n, None
    for parts in range(2, distance + 2):
        groups = group_bits(n, both, parts)
        plans = {0: (0.0, [])}
        for own in groups:
            near = within(p[own], distance)
            cost = [0.0] + [n * row_cost * (1 + sum(comb(len(own), k) for k in range(t + 1))) + pair_cost * n * n / 2 * near[t] * (1 + t) for t in range(distance + 1)]
            step = {}
            for spent, (c, chosen) in plans.items():
                for use in range(distance + 2 - spent):
                    new = c + cost[use], [*chosen, use - 1]
                    if spent + use not in step or new[0] < step[spent + use][0]:
                        step[spent + use] = new
            plans = step
        c, chosen = plans[distance + 1]
        if best is None or c < best[0]:
            best = c, [(sum(1 << b for b in own), t) for own, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, most: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [sum(1 << b for b in own) for k in range(1, most + 1) for own in combinations(bits, k)]


def _links(fp: np.ndarray, rep: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within the distance in one run of equal keys; large runs give a spanning forest only."""
    n = len(fp)
    if n <= 16:
        i, j = np.triu_indices(n, 1)
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (rep[i] != rep[j]) & ~(probe[i] & probe[j])
        return rep[i[ok]], rep[j[ok]]
    left, out = np.arange(n), ([], [])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = (np.bitwise_count(fp[left] ^ fp[x]) <= distance) & ~(probe[left] & probe[x])
            if hit.any():
                new = left[hit]
                out[0].extend([rep[x]] * len(new))
                out[1].extend(rep[new])
                queue.extend(new)
                left = left[~hit]
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def _scan(distance: int):
    """Links the rows of each key; rows come sorted by key, and the last key's rows are held until the next key begins.

    A run's size is bounded by how many distinct fingerprints share a key, as equal ones are one row.
    """

    def emit(part, key, fp, rep, probe):
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        a, b = [], []
        # short runs: compare every row with the d-th after it, all runs at once
        small = np.repeat(sizes <= 64, sizes)
        run = np.repeat(np.arange(len(starts)), sizes)
        for d in range(1, min(64, int(sizes.max())) if len(sizes) else 0):
            ok = (run[d:] == run[:-d]) & small[d:]
            if not ok.any():
                break
            i = np.flatnonzero(ok)
            hit = (np.bitwise_count(fp[i] ^ fp[i + d]) <= distance) & ~(probe[i] & probe[i + d]) & (rep[i] != rep[i + d])
            a.append(rep[i[hit]])
            b.append(rep[i[hit] + d])
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
            x, y = _links(fp[s : s + n], rep[s : s + n], probe[s : s + n], distance)
            a.append(x)
            b.append(y)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.record_batch({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            own = [b[c].to_numpy(zero_copy_only=False) for c in ("part", "key", "fp", "rep", "probe")]
            own[2] = own[2].view(np.uint64)
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            at = np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))
            cut = at[-1] + 1 if len(at) else 0
            if cut:
                yield emit(*(x[:cut] for x in own))
            held = [x[cut:] for x in own]
        if held is not None:
            yield emit(*held)

    return run


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between the representatives of fingerprint classes (fp, rep) that connect all within the distance."""
    n, both = bit_statistics(classes)
    # probe: whether the row stands at a value other than its own; one direction is enough, from 0 to 1 in the lowest bit
    keys = []
    for i, (mask, most) in enumerate(allot(n, both, distance)):
        here = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        keys.append(F.struct(F.lit(i).alias("part"), here.alias("key"), F.lit(False).alias("probe")))
        for flip in _flips(mask, most):
            low = flip & -flip
            keys.append(F.when(F.col("fp").bitwiseAND(F.lit(_signed(low))) == 0, F.struct(F.lit(i).alias("part"), here.bitwiseXOR(F.lit(_signed(flip))).alias("key"), F.lit(True).alias("probe"))))
    rows = classes.select("fp", "rep", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.part", "k.key", "k.probe", "fp", "rep")
    return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_scan(distance), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, text="text", doc_id="doc_id", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, h (a hash of the text) and component_id (the smallest id reachable over links of at most ``distance`` bits) of each document."""
    fps = materialize(fingerprints(docs, text, doc_id), "simhash-fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("rep"), F.count("*").alias("n")).where("rep is not null"), "simhash-classes")
    found = connected_components(links(classes, distance))
    roots = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("root"), ((F.col("n") > 1) | F.col("root").isNotNull()).alias("shared"))
    shared = materialize(roots.where("shared").select("fp", "root"), "simhash-roots")
    return salted_join(fps, shared, "fp", how="left").select("doc_id", "fp", "h", F.coalesce("root", "doc_id").alias("component_id"))


def digits(fp="fp"):
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component; rows without an id stay.

    Rows that share an id are told apart by their texts; rows alike in both are one document, and stay or go together.
    """
    return without(docs, near_duplicates(docs.where(F.col(doc_id).isNotNull()), text, doc_id).where("doc_id <> component_id"), text, doc_id)
