"""Keyed streams over several batches, restarts and late rows, against a replay of all rows in order."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepfree.streaming import keyed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(rng, fold, n=160):
    out = []
    for i in range(n):
        at = START + timedelta(seconds=i * 7 + rng.randrange(3))
        inputs = (rng.choice([None, float(i)]), rng.choice([None, 5.0, 40.0, 30.0])) if fold is keyed.PROGRESS else (f"body{i}", rng.choice([None, False, False, True]))
        out.append((f"k{rng.randrange(4)}", at, i, *inputs))
    return out


@pytest.mark.parametrize("fold", [keyed.PROGRESS, keyed.ANSWERS], ids=["progress", "answers"])
def test_batches_restart_and_late_rows_equal_a_replay(spark, tmp_path, tmp_path_factory, fold):
    rng = random.Random(4)
    rows = rows_of(rng, fold)
    # each row comes up to a minute late, less than the watermark waits
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(60)))
    schema = f"who string, ts timestamp, id long, {fold.inputs}"
    folder = str(tmp_path_factory.mktemp("keyed"))

    def put(name, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name))

    def run():
        read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        return keyed.table(keyed.delivered(read, "who", "ts", "id", fold, "2 minutes"), folder)

    put("a", order[:50])
    put("b", order[50:110])
    run()
    put("c", order[110:])
    put("d", [("k0", START, 900, *rows[0][3:]), ("k1", START + timedelta(hours=5), 901, *rows[0][3:])])  # one far too late, one that ends all waiting
    got = sorted(tuple(r) for r in run().select("who", "ms", "number", *keyed._names(fold.output)).collect())
    want = []
    for who in {r[0] for r in rows}:
        own = [(int(ts.timestamp() * 1000), i, *inputs) for w, ts, i, *inputs in rows if w == who]
        want += [(who, *r) for r in keyed.replay(own, fold)]
    assert got == sorted(want)
    assert {r[2] for r in got} == set(range(160))


class Handle:
    """A key's list and timers, that counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.calls, self.got = [], set(), 0, None

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.rows = []

    def exists(self):
        return self.got is not None

    def get(self):
        return self.got if self.got is not None and not self.rows else list(self.rows)

    def update(self, value):
        self.got = value

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_crowded_key_has_one_timer_and_few_entries():
    handle, n = Handle(), 30_000
    own = keyed._Keyed(keyed.ANSWERS, "key")
    own.init(handle)
    handle.now = 0
    rows = pd.DataFrame({"ms": [i * 1000 + 1 for i in reversed(range(n))] + [None], "number": range(n + 1), "answer": "a", "error": [None, False, True] * (n // 3) + [None]})
    list(own.handleInputRows(("k",), iter([rows[:20_000], rows[20_000:]]), handle))
    assert handle.timers == {1} and handle.calls <= 12 and sum(len(r[0]) for r in handle.rows) == n
    handle.now = 10_000_000
    first = list(own.handleExpiredTimer(("k",), handle, handle))
    assert len(first[0]) == 10_000 and handle.timers == {1, 10_000_001}
    assert sum(len(r[0]) for r in handle.rows) == n - 10_000


def test_folds():
    step = lambda fold, rows: [r[2:] for r in keyed.replay(rows, fold)]
    assert step(keyed.PROGRESS, [(1, 1, 10.0, 0.0), (2, 2, 8.0, 31.0), (3, 3, 50.0, 99.0), (4, 4, 20.0, 30.0), (5, 5, 15.0, None), (6, 6, None, 31.0)]) == [
        (10.0, False, False, 0), (10.0, True, True, 1), (10.0, True, False, 1), (20.0, False, False, 1), (20.0, False, False, 1), (20.0, True, True, 2),
    ]
    rows = [(0, 1, "a", False), (19_999, 2, "b", False), (20_000, 3, "c", True), (29_999, 4, "d", False), (30_000, 5, "e", None)]
    assert step(keyed.ANSWERS, rows) == [(False, "a", False), (True, "a", False), (False, None, True), (True, None, True), (False, "e", False)]


def test_settings_are_left_as_they_were(spark):
    key = next(iter(keyed._STORE))
    before = spark.conf.get(key, None)
    old = keyed._with(spark, keyed._STORE)
    keyed._with(spark, old)
    assert spark.conf.get(key, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
