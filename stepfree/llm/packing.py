"""Packs documents into training sequences along a Hilbert curve through hashed document vectors.

Each token id has a fixed pseudo-random direction; the mean over a document's ids, projected to a few dimensions, is put on
a grid whose cells the curve numbers. Documents are sorted by that number across the cluster and laid end to end, so that
neighbours in a sequence are alike, and cut every ``size`` ids. What is left of a partition at its end is cut into
sequences whose lengths are powers of two, which need no padding.

Cases: a null or empty text is the end id alone. Equal texts have equal keys and are ordered by id, so a hot group is split
over partitions like any other rows. An empty table gives an empty one. Columns besides id and text are not read. A document
longer than a sequence, or one at a sequence's end, continues in the next; its pieces tell where.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordBpeEncoder, bounded_batches, chunks, giving_back, materialize, shared_encoder, tokenizer_path

SIZE, END = 4096, 2
#: Words whose ids a worker keeps at most; about 200 bytes each.
WORDS = 1_000_000
DIMENSIONS, GRID_BITS = 4, 8
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def directions(n: int = 1 << 16, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed +1 or -1 for each id and dimension, from a multiplicative hash of the id."""
    with np.errstate(over="ignore"):
        h = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([((h >> np.uint64(40 + i)) & np.uint64(1)).astype(np.float32) * 2 - 1 for i in range(dimensions)], axis=1)


def packed_directions(dimensions: int = DIMENSIONS) -> np.ndarray:
    """The signs of an id as 0 and 1 in 16-bit fields of one integer, so that one sum adds them all."""
    return ((directions(dimensions=dimensions) > 0).astype(np.int64) << (16 * np.arange(dimensions))).sum(axis=1)


def project(ids: bytes, packed: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum of the ids' signs over the root of their number."""
    own, total = np.frombuffer(ids, np.uint16), np.zeros(dimensions, np.int64)
    for i in range(0, len(own), 1 << 15):  # a field holds so many
        total += (int(packed[own[i : i + (1 << 15)]].sum()) >> (16 * np.arange(dimensions))) & 0xFFFF
    return (2 * total - len(own)) / np.sqrt(max(1, len(own)))


def hilbert(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Places along the Hilbert curve of grid cells [row, dimension] (Skilling's transpose form, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Vectors are sums of signs over the root of the number of ids, so near-normal: the logistic function spreads them."""
    cells = np.floor((1 << bits) / (1 + np.exp(-1.7 * np.clip(vectors, -20, 20))))
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, text="text", doc_id="doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, key, n and ids (little-endian unsigned 16-bit, with the end id) of each document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))

    def run(batches):
        encoder, signs, stop = shared_encoder(WordBpeEncoder, tokenizer, words), packed_directions(), np.array([end], np.uint16).tobytes()
        for b in chunks(batches, "t"):
            ids = [x + stop for x in encoder.encode_column(b["t"])]
            sizes = np.array([len(x) // 2 for x in ids], np.int64)
            vectors = np.zeros((len(ids), DIMENSIONS))
            for i, x in enumerate(ids):
                vectors[i] = project(x, signs)
            yield pa.record_batch([b["doc_id"], pa.array(curve_keys(vectors)), pa.array(sizes), pa.array(ids, pa.binary())], names=["doc_id", "key", "n", "ids"])

    return rows.mapInArrow(giving_back(run), "doc_id bigint, key bigint, n bigint, ids binary")


def lengths(total: int, size: int = SIZE) -> list[int]:
    """Powers of two, falling, that sum to what is left after whole sequences."""
    rest = total % size
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(size: int):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        done, held, held_n = 0, [], 0  # held: documents that do not fill a sequence yet

        def cut(pieces, seqs):
            """Lays (doc_id, start, n, ids) end to end into the given (sequence, length)s; returns rows and the remainder."""
            rows, rest, at = [], list(pieces), 0
            for seq, length in seqs:
                used = 0
                while used < length:
                    doc, start, n, ids, total = rest[at]
                    take = min(n, length - used)
                    rows.append((doc, start, take, zlib.crc32(np.frombuffer(ids, "<u2", take).astype("<u4")), total, first + seq, used))
                    used += take
                    if take == n:
                        at += 1
                    else:
                        rest[at] = doc, start + take, n - take, ids[2 * take :], total
            return rows, rest[at:]

        def batch(rows):
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, n, ids in zip(b["doc_id"].to_pylist(), b["n"].to_pylist(), b["ids"].to_pylist(), strict=True):
                held.append((doc, 0, n, memoryview(ids), n))
                held_n += n
            whole = held_n // size
            if whole:
                rows, held = cut(held, [(done + i, size) for i in range(whole)])
                done, held_n = done + whole, held_n - whole * size
                yield batch(rows)
        if held_n:
            yield batch(cut(held, [(done + i, n) for i, n in enumerate(lengths(held_n, size))])[0])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, text="text", doc_id="doc_id", words: int = WORDS) -> DataFrame:
    """One row for each piece of a document, saying which ids it has and where it lies."""
    spark = docs.sparkSession
    ids = materialize(tokenized(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end, text, doc_id, words), "packing-ids")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.select("doc_id", "n", "ids").mapInArrow(giving_back(_pack(size)), SCHEMA)
