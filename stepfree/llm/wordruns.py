"""Periodic runs of words: every maximal stretch of a text that repeats with some period, and the text without the repeats.

Runs are found by Lyndon arrays of the word sequence under the order of words and its reverse, each word being compared with others
only (``WordRuns.java``), so a text takes time and memory linear in its words, however periodic it is. Documents don't
meet each other: there is no shuffle.

Cases: a null text, an empty one or one of white space has no words, no runs and an empty collapsed text. Words are the same if all
their characters are. Ties don't occur: runs are ordered by start, then period. Repeated rows give repeated rows, an empty table an
empty one. All columns stay, whatever their names; the new ones are ``runs`` and ``collapsed``, or the first free name (``runs_1``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jvm
from .common import free_name

LEAST = 12
FUNCTIONS = {"word_runs": ("Find", "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")}


def find_runs(docs: DataFrame, least: int = LEAST, text: str = "text", runs: str | None = None, collapsed: str | None = None) -> DataFrame:
    """docs with ``runs`` (start, length and period of each run of at least ``least`` words and two periods) and ``collapsed``:
    the words, joined by one space, without those that any run contains after its first period."""
    jvm.register(docs.sparkSession, FUNCTIONS, "WordRuns")
    runs, collapsed, own = runs or free_name(docs, "runs"), collapsed or free_name(docs, "collapsed"), free_name(docs, "found")
    found = docs.withColumn(own, F.call_function("word_runs", docs[text], F.lit(least)))
    return found.select(*(found[c] for c in docs.columns), found[own]["runs"].alias(runs), found[own]["collapsed"].alias(collapsed))


def longest(runs) -> F.Column:
    """The run of greatest length; ties go to the smallest start, then period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
