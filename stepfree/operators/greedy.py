"""Greedy choices from candidate links, in parallel, with the result of taking them one by one in order.

Candidates are (a, b, d) with a < b; their order is by d, then a, then b. What a candidate meets when its turn comes depends on those
before it near its ends only. So each round decides all candidates that no undecided earlier one can still affect; the first of all is always
among them. A round is a few joins, and a table cuts its lineage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.scratch import drop, materialize

from .graph import both_ways, components, salted_join

_RANK = "struct<d: double, a: bigint, b: bigint>"
_KEY = ["a", "b", "d"]


def _ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their place in the order as a value; of those that join the same two nodes the first stays."""
    own = candidates.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").cast("double").alias("d"))
    own = own.groupBy("a", "b").agg(F.min("d").alias("d"))
    return own.withColumn("rank", F.struct("d", "a", "b"))


def _rounds(state: DataFrame, step, most: int) -> DataFrame:
    """Runs step(state), which gives all candidates with ``taken`` (null while undecided), until all are decided."""
    for _ in range(most):
        before, state = state, materialize(step(state), "greedy")
        drop(before)
        if state.where("taken is null").isEmpty():
            return state.where("taken").select(*_KEY)
    raise RuntimeError(f"undecided after {most} rounds")


def limited(candidates: DataFrame, limit: int, used: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """Those taken if each node may have ``limit`` links: a candidate is taken unless one of its ends is full. used: (node, n) had before."""
    start = materialize(_ranked(candidates).withColumn("taken", F.lit(None).cast("boolean")), "greedy")
    used = None if used is None else materialize(used.select("node", F.col("n").cast("bigint").alias("had")), "used")

    def step(state: DataFrame) -> DataFrame:
        ends = state.select("rank", "taken", F.explode(F.array("a", "b")).alias("node"))
        nodes = ends.groupBy("node").agg(F.count_if("taken").alias("full"), F.min(F.when(F.col("taken").isNull(), F.col("rank"))).alias("first"))
        if used is not None:
            nodes = nodes.join(used, "node", "left").withColumn("full", F.col("full") + F.coalesce("had", F.lit(0))).drop("had")
        at = lambda n: nodes.select(F.col("node").alias(n), F.col("full").alias(f"full_{n}"), F.col("first").alias(f"first_{n}"))
        both = state.join(at("a"), "a").join(at("b"), "b")
        turn = (F.col("first_a") == F.col("rank")) & (F.col("first_b") == F.col("rank"))
        own = F.when(F.col("taken").isNotNull(), F.col("taken")).when(F.greatest("full_a", "full_b") >= limit, False).when(turn, True)
        return both.select(*_KEY, "rank", own.alias("taken"))

    return _rounds(start, step, most_rounds)


def spanning(candidates: DataFrame, links: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """Those taken if a candidate must join parts that nothing joins yet. links: (u, v) there before.

    Each part takes its first candidate in a round; as no two candidates are equal in the order, that gives the same forest.
    """
    spark = candidates.sparkSession
    left = materialize(_ranked(candidates), "candidates")
    taken = materialize(left.select(*_KEY).limit(0), "taken")
    for _ in range(most_rounds):
        joined = taken.select(F.col("a").alias("u"), F.col("b").alias("v"))
        parts = materialize(components(joined if links is None else joined.unionByName(links.select("u", "v"))), "parts")
        part = lambda n: parts.select(F.col("node").alias(n), F.col("root").alias(f"part_{n}"))
        known = salted_join(left, part("a"), "a", how="left")
        known = salted_join(known, part("b"), "b", how="left").where("coalesce(part_a, a) <> coalesce(part_b, b)")
        before, left = left, materialize(known.select(*_KEY, "rank", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b")), "candidates")
        drop(before, parts)
        if left.isEmpty():
            return taken
        first = left.select("rank", F.explode(F.array("part_a", "part_b")).alias("part")).groupBy("part").agg(F.min("rank").alias("rank"))
        before, taken = taken, materialize(taken.unionByName(first.select("rank.*").distinct()), "taken")
        drop(before)
        kept = left.select(*_KEY, "rank")
        kept._scratch = left._scratch
        left = kept
    raise RuntimeError(f"parts left to join after {most_rounds} rounds")


def distant(candidates: DataFrame, links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Those taken if a candidate's ends must not be within three links of each other, counting those taken before. links: (u, v) there before."""
    there = materialize(both_ways(links.where("u <> v").select("u", "v").distinct()).distinct().withColumn("rank", F.lit(None).cast(_RANK)), "links")
    state = materialize(_ranked(candidates), "candidates")
    arcs = there.unionByName(both_ways(state.select(F.col("a").alias("u"), F.col("b").alias("v"), "rank"), "rank"))
    hop = lambda n: arcs.select(F.col("u").alias(f"x{n - 1}"), F.col("v").alias(f"x{n}"), F.col("rank").alias(f"r{n}"))
    earlier = lambda n: F.col(f"r{n}").isNull() | (F.col(f"r{n}") < F.col("own"))
    ask = state.select(F.col("rank").alias("own"), F.col("a").alias("x0"), "b")
    one = ask.join(hop(1), "x0").where(earlier(1))
    two = one.join(hop(2), "x1").where(earlier(2) & (F.col("x2") != F.col("x0")))
    last = arcs.select(F.col("u").alias("at"), F.col("v").alias("b"), F.col("rank").alias("r3"))
    three = two.join(last, (two["x2"] == last["at"]) & (two["b"] == last["b"])).where(earlier(3))
    on = lambda rows, *ranks: rows.select("own", F.array_distinct(F.array_compact(F.array(*ranks))).alias("on"))
    # the ways between the ends of a candidate, as the earlier candidates that each depends on, are found once
    ways = materialize(on(one.where("x1 = b"), "r1").unionByName(on(two.where("x2 = b"), "r1", "r2")).unionByName(on(three, "r1", "r2", "r3")), "ways")
    # one way by links that are there is enough; those without any way are taken
    met = ways.groupBy("own").agg(F.min(F.size("on")).alias("least"))
    state = state.join(met.withColumnRenamed("own", "rank"), "rank", "left")
    state = materialize(state.select("rank", F.when(F.col("least").isNull(), True).when(F.col("least") == 0, False).alias("taken")), "greedy")
    done = [state.where("taken").select("rank")]
    for _ in range(most_rounds):
        undecided = state.where("taken is null").select("rank")
        if undecided.isEmpty():
            taken = functools.reduce(DataFrame.unionByName, done)
            return taken.select("rank.a", "rank.b", "rank.d")
        # of the ways of candidates still undecided those by links that were not taken are closed, and links that were taken are there
        left = ways.withColumnRenamed("own", "rank").join(undecided, "rank").withColumn("way", F.monotonically_increasing_id())
        left = materialize(left, "left")
        steps = left.select("way", F.explode("on").alias("rank")).join(state.where("taken is not null"), "rank", "left")
        steps = steps.groupBy("way").agg(F.bool_or(~F.col("taken")).alias("closed"), F.collect_list(F.when(F.col("taken").isNull(), F.col("rank"))).alias("on"))
        old, ways = ways, materialize(left.select("way", F.col("rank").alias("own")).join(steps, "way").where("closed is not true").select("own", "on"), "ways")
        met = ways.groupBy("own").agg(F.min(F.size("on")).alias("least")).withColumnRenamed("own", "rank")
        new = F.when(F.col("least").isNull(), True).when(F.col("least") == 0, False).alias("taken")
        state = materialize(undecided.join(met, "rank", "left").select("rank", new), "greedy")
        done.append(state.where("taken").select("rank"))
        drop(old, left)
    raise RuntimeError(f"undecided after {most_rounds} rounds")
