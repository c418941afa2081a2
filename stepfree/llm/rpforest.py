"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Each tree splits the vectors recursively: a level has a random direction, and a node's threshold is the median of its part
of a bounded sample. A vector goes to its leaf and, where it lies closest to a threshold on its way, to the leaf on the other
side too. Vectors of one label are compared within leaves, by cosine in double precision. A label's trees are as deep as its
size needs: a label that fits one leaf is compared whole. Deeper trees divide more pairs, so there are more of them. A leaf that holds
much more than it should, as its part of the sample was small, is compared in blocks by several tasks: no row of it is left out.

A pair that meets in several leaves is counted in the first of them only, which the rows' own lists of leaves tell, so links
are counted without collecting pairs. Leaves give their connected parts, and these the components. Equal vectors are one
weighted row from the start, so copies are never compared with each other.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing. Vectors are compared with those of their own length only; each length has its own forest. Rows that share an id are counted
as vectors of their own. An empty table gives an empty one. Other columns are not read and may have any names.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .components import connected_components, salted_join
from .vectors import bounded_sample, identity, matrix, runs, starts_of, usable

COSINE, TREES, LEAF, SAMPLE = 0.93, 8, 2048, 20_000
#: For each level beyond LEVELS a forest has MORE trees.
LEVELS, MORE = 4, 4
_BLOCK = 512


@dataclass
class Forest:
    directions: np.ndarray  # [tree, level, dimension]
    thresholds: list[list[np.ndarray]]  # by tree and level: one for each node

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((trees, depth, sample.shape[1]))
        thresholds = []
        for t in range(trees):
            node, own = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                p = sample @ directions[t, level]
                cut = np.full(1 << level, np.median(p) if len(p) else 0.0)
                order = np.lexsort((p, node))
                nodes, first, size = np.unique(node[order], return_index=True, return_counts=True)
                enough = size >= 2
                cut[nodes[enough]] = p[order][(first + size // 2)[enough]]
                own.append(cut)
                node = node * 2 + (p >= cut[node])
            thresholds.append(own)
        return cls(directions, thresholds)

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """[row, 2 * tree]: a leaf, and the leaf beyond the closest threshold, each as a path of ``depth`` bits."""
        out = np.zeros((len(x), 2 * len(self.thresholds)), np.int64)
        for t, cuts in enumerate(self.thresholds):
            p = x @ self.directions[t, :depth].T if depth else np.zeros((len(x), 0))
            node, margins = np.zeros(len(x), np.int64), np.zeros((len(x), depth))
            for level in range(depth):
                margins[:, level] = p[:, level] - cuts[level][node]
                node = node * 2 + (margins[:, level] >= 0)
            out[:, 2 * t] = node
            if depth:
                turn = np.abs(margins).argmin(axis=1)
                node = np.zeros(len(x), np.int64)
                for level in range(depth):
                    right = p[:, level] >= cuts[level][node]
                    node = node * 2 + (right ^ (turn == level))
            out[:, 2 * t + 1] = node
        return out


def _compare(x, rep, weight, codes, here, least, cell=None):
    """Links of a leaf's rows: (rep, links counted here, smallest rep of its part). codes: all leaves of each row.

    If cell is given, only rows of different cells are compared.
    """
    n = len(x)
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, n, _BLOCK):
        i, j = np.nonzero(np.triu(x[a : a + _BLOCK] @ x[a:].T >= least, 1))
        i, j = i + a, j + a
        if cell is not None:
            i, j = i[cell[i] != cell[j]], j[cell[i] != cell[j]]
        for s in range(0, len(i), 1 << 17):
            u, v = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            first = np.ones(len(u), bool)
            # a pair belongs to the smallest code that both have
            for k in range(0, codes.shape[1], 2):
                for c in (codes[u, k], codes[u, k + 1]):
                    met = ((c == codes[v, k]) | (c == codes[v, k + 1])) & (c < here) & (c >= 0)
                    first &= ~met
            links += np.bincount(u[first], weight[v[first]], n).astype(np.int64) + np.bincount(v[first], weight[u[first]], n).astype(np.int64)
            roots = np.array([find(k) for k in range(n)])
            pairs = np.unique(np.sort(np.stack([roots[u], roots[v]], axis=1), axis=1), axis=0)
            for p, q in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                p, q = find(p), find(q)
                if p != q:
                    lo, hi = (p, q) if rep[p] < rep[q] else (q, p)
                    parent[hi] = lo
    root = rep[[find(k) for k in range(n)]] if n else rep
    keep = (links > 0) | (root != rep)
    return rep[keep], links[keep], root[keep]


def _links(classes: DataFrame, kind: dict, least: float, trees: int, leaf: int, sample: int) -> DataFrame:
    """rep, links and root of what is linked, part by part, among vectors of one length."""
    by_label = classes.groupBy("label").agg(F.count("*").alias("n_label"))
    total, largest = by_label.agg(F.sum("n_label"), F.max("n_label")).first()
    depth = max(0, math.ceil(math.log2(largest / leaf)))
    trees += MORE * max(0, depth - LEVELS)
    drawn = bounded_sample(classes, "x", "rep", total, sample) if depth else np.zeros((0, 1))
    if depth:
        drawn = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    forest = Forest.fit(drawn, depth, trees)
    depths = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_label") / F.lit(float(leaf))))).cast("int")
    sized = salted_join(classes, by_label.select("label", depths.alias("depth")), "label").select("label", "rep", "w", "x", "depth")

    def codes_of(b):
        label_depth, every = b["depth"].to_numpy(), np.full((b.num_rows, 2 * trees), -1, np.int64)
        for d in np.unique(label_depth):
            own = np.flatnonzero(label_depth == d)
            if not d:
                every[own, 0] = 0
                continue
            x = matrix(b["x"].take(pa.array(own)))
            got = forest.leaves(x / np.linalg.norm(x, axis=1, keepdims=True), int(d)) + (np.arange(2 * trees) // 2 << 40)
            got[:, 1::2] = np.where(got[:, 1::2] == got[:, ::2], -1, got[:, 1::2])
            every[own] = got
        return every

    def count(batches):
        for b in batches:
            every = codes_of(b)
            i, j = np.nonzero(every >= 0)
            yield pa.record_batch([pa.array(every[i, j]), b["label"].take(pa.array(i))], names=["leaf", "label"])

    # leaves that hold more than twice what they should, and over how many cells their rows are dealt
    full = sized.mapInArrow(count, f"leaf bigint, label {kind['label']}").groupBy("leaf", "label").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf) if depth else None
    large = materialize(full.select(F.xxhash64("label", "leaf").alias("k"), F.ceil(F.col("n") / leaf).cast("int").alias("cells")).groupBy("k").agg(F.max("cells").alias("cells")), "forest-large") if depth else None

    def place(batches):
        for b in batches:
            every = codes_of(b)
            i, j = np.nonzero(every >= 0)
            out = b.select(["label", "rep", "w", "x"]).take(pa.array(i))
            codes = pa.FixedSizeListArray.from_arrays(pa.array(every[i].ravel()), 2 * trees).cast(pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(every[i, j]), codes, *out.columns], names=["leaf", "codes", "label", "rep", "w", "x"])

    placed = sized.mapInArrow(place, f"leaf bigint, codes array<bigint>, label {kind['label']}, rep bigint, w bigint, x {kind['x']}").withColumn("k", F.xxhash64("label", "leaf"))
    if large is not None and not large.isEmpty():
        dealt = salted_join(placed, large, "k", how="left").withColumn("cell", F.when(F.col("cells").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")).otherwise(0))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))
        placed = dealt.withColumn("other", other).withColumn("pair", F.struct(F.least("cell", "other"), F.greatest("cell", "other"))).withColumn("k", F.xxhash64("k", "pair")).drop("cells", "pair")
    else:
        placed = placed.withColumns({"cell": F.lit(0), "other": F.lit(0)})

    def compare(batches):
        for t in runs(batches, ["k", "leaf"]):
            cuts = starts_of(t, ["k", "leaf"])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z - a < 2:
                    continue
                own = t.slice(a, z - a)
                x = matrix(own["x"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cell, other = own["cell"].to_numpy(), own["other"].to_numpy()
                got = _compare(x, own["rep"].to_numpy(), own["w"].to_numpy(), matrix(own["codes"]).astype(np.int64), int(own["leaf"][0].as_py()), least, cell if (cell != other).any() else None)
                yield pa.record_batch([pa.array(g, pa.int64()) for g in got], names=["rep", "links", "root"])

    return placed.repartition("k").sortWithinPartitions("k", "leaf").mapInArrow(compare, "rep bigint, links bigint, root bigint")


def link(vectors: DataFrame, least: float = COSINE, embedding="embedding", label="label", vec_id="vec_id", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("x"))
    rows = rows.select("*", (usable("x") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"), *identity("label", "x"))
    good = rows.where("ok")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.min("label").alias("label"), F.any_value("x").alias("x"))
    classes = materialize(classes, "forest-classes")
    # a number for each length
    sizes = sorted(r[0] for r in classes.select(F.size("x")).distinct().collect())
    kind = {"label": rows.schema["label"].dataType.simpleString(), "x": rows.schema["x"].dataType.simpleString()}
    parts = [_links(classes.where(F.size("x") == n), kind, least, trees, leaf, sample) for n in sizes]
    found = materialize(functools.reduce(DataFrame.union, parts), "forest-links") if parts else spark.createDataFrame([], "rep bigint, links bigint, root bigint")
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "rep", "w").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.where("w > 1 or links is not null or root is not null").select(F.struct("h1", "h2").alias("h"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    out = salted_join(rows.select("vec_id", F.when(F.col("ok"), F.struct("h1", "h2")).alias("h")), materialize(known, "forest-known"), "h", how="left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept"))
