"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str) -> Column:
    """True for vectors that are not null or empty, hold neither null nor non-finite components, and are not zero."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def identity(*columns: str) -> list[Column]:
    """128 bits that stand for the value of the columns."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2")]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def bounded_sample(df: DataFrame, column: str, key: str, n: int, bound: int) -> np.ndarray:
    """About ``bound`` of the n vectors, drawn by the key's hash, on the driver."""
    share = min(1.0, bound / max(n, 1))
    got = df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(share * (1 << 30))).select(column).limit(2 * bound).toArrow()
    return matrix(got[column])


def runs(batches, keys: list[str]):
    """Regroups sorted batches so that no run of equal keys is divided; a run is held until the next key begins."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        at = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t[k].to_numpy()
            at |= c != c[-1]
        cut = int(np.flatnonzero(at)[-1]) + 1 if at.any() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
