"""Token ids as compressed binary blocks: an adaptive range coder whose model mixes order-0, order-1 and order-2 predictions.

A block holds up to ``BLOCK`` ids, begins with an empty model and carries a checksum, so it can be read alone. For each id
order 2 and order 1 predict the ids that followed the last two ids and the last one, order 0 every id by how often it came;
weights that adapt within the block mix their chances, and the mixed chance drives the arithmetic coder (see
``TokenBlocks.java``). It runs inside the JVM, as SQL functions, as each id needs the model that the one before it left.

Files are Parquet tables of blocks, so that writing them is atomic and survives lost executors. A row has the file's number
and the block's, the coded block, and for each document in it: id, number in the file, piece, place in the file and number of ids.

Cases: a null or empty text is the end id alone. Rows that share an id stay apart, in any order; null ids come first. An
empty table gives an empty one. A text of more ids than a block takes several blocks of its own. Damage is an error: ValueError
from ``decode_blocks``, a failed job from a query. Columns besides id and text are not read and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvm
from .common import ByteBpeEncoder, bounded_batches, chunks, shared_encoder, tokenizer_path

BLOCK, END = 1 << 16, 0
#: Words whose ids a worker keeps at most; about 200 bytes each.
WORDS = 900_000
#: Blocks that one batch brings to the coder: 2 MB of ids.
_TOGETHER = 16


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded form of each array of ids, on the driver; for tests and small jobs."""
    coder = jvm.instance(SparkSession.builder.getOrCreate(), "Encode")
    return [bytes(coder.call(np.asarray(b, "<u2").tobytes())) for b in blocks]


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, on the driver; raises ValueError if a block is damaged."""
    coder = jvm.instance(SparkSession.builder.getOrCreate(), "Decode")
    try:
        return [np.frombuffer(bytes(coder.call(p)), "<u2") for p in payloads]
    except Exception as e:
        raise ValueError(f"a token block is damaged: {str(e).splitlines()[0]}") from e


def crc32_join(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings laid end to end, from theirs and the second's length."""
    return jvm.instance(SparkSession.builder.getOrCreate(), "JoinChecksums").call(a, b, length)


def _members(kind: str) -> str:
    return f"file int, block int, {kind} binary, doc_ids array<bigint>, numbers array<bigint>, pieces array<int>, places array<bigint>, sizes array<int>"


BLOCK_SCHEMA = _members("payload")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, text="text", doc_id="doc_id") -> None:
    """Encodes every text, appends the end id and writes the ids in ascending doc_id order."""
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path("byte_bpe_50k.json")
    jvm.register(spark)
    bounded_batches(spark)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).repartitionByRange(files, "d").sortWithinPartitions("d")

    def run(batches):
        from pyspark import TaskContext

        number, encoder, stop = TaskContext.get().partitionId(), shared_encoder(ByteBpeEncoder, tokenizer, WORDS), np.array([end], np.uint16).tobytes()
        blocks, done, place, doc_number = [], 0, 0, 0
        ids, members, size = [], [], 0

        def close():
            nonlocal ids, members, size
            if size:
                blocks.append((b"".join(ids), members))
                ids, members, size = [], [], 0

        def emit():
            nonlocal done, blocks
            n = len(blocks)
            column = lambda i, kind: pa.array([[m[i] for m in b[1]] for b in blocks], pa.list_(kind))
            out = [pa.array([number] * n, pa.int32()), pa.array(range(done, done + n), pa.int32()), pa.array([b[0] for b in blocks], pa.binary()), column(0, pa.int64()), column(1, pa.int64()), column(2, pa.int32()), column(3, pa.int64()), column(4, pa.int32())]
            done, blocks = done + n, []
            return pa.record_batch(out, names=["file", "block", "ids", "doc_ids", "numbers", "pieces", "places", "sizes"])

        for b in chunks(batches, "t"):
            for doc, own in zip(b["d"].to_pylist(), encoder.encode_column(b["t"]), strict=True):
                own += stop
                if size and size + len(own) // 2 > BLOCK:
                    close()
                for piece, i in enumerate(range(0, len(own), 2 * BLOCK)):
                    part = own[i : i + 2 * BLOCK]
                    if size + len(part) // 2 > BLOCK:
                        close()
                    ids.append(part)
                    members.append((doc, doc_number, piece, place, len(part) // 2))
                    size += len(part) // 2
                    place += len(part) // 2
                doc_number += 1
                if len(blocks) >= _TOGETHER:
                    yield emit()
        close()
        if blocks:
            yield emit()

    rows.mapInArrow(run, _members("ids")).withColumn("ids", F.call_function("token_block_encode", "ids")).withColumnRenamed("ids", "payload").write.parquet(path)


def _pieces(spark: SparkSession, path: str, function: str, name: str) -> DataFrame:
    """One row for each piece of a document in a block, with what the function makes of it."""
    jvm.register(spark)
    own = F.arrays_zip("numbers", "pieces", "doc_ids", "places", "sizes", F.call_function(function, "payload", "sizes").alias(name))
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("file", F.explode(own).alias("p"))
    return rows.select("file", F.col("p.numbers").alias("number"), F.col("p.pieces").alias("piece"), F.col("p.doc_ids").alias("doc_id"), F.col("p.places").alias("at"), F.col("p.sizes").cast("bigint").alias("n"), F.col("p")[name].alias(name))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each piece of a document in a block: file, number, piece, doc_id, at (place in the file), n and ids."""
    return _pieces(spark, path, "token_block_parts", "ids")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("file", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    # a row for each file, however many documents there are
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    parts = _pieces(spark, path, "token_block_checksums", "crc")
    whole = parts.groupBy("file", "number").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    crc = F.aggregate(rest, F.col("parts")[0]["crc"], lambda a, x: F.call_function("token_checksums_join", a, x["crc"], 4 * x["n"]))
    return whole.join(F.broadcast(before), "file").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", F.when(F.size("parts") > 1, crc).otherwise(F.col("parts")[0]["crc"]).alias("ids_crc32"))
