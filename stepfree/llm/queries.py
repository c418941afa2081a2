"""The queries that apply each operator to its whole table, in the form of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, htmltext, langid, linededup, packing, postings, rpforest, simhash, tokencoder, urlfilter, viterbi, wordruns
from .common import scratch_path
from .oracles import OP11, OP12, OP13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(urlfilter.labelled_urls(spark)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.link(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_deleted, and length and digest of the text that is left."""
    kept = linededup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "lines_deleted", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.digits().alias("fingerprint"), "component_id")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokencoder.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokencoder.read_index(spark, path)


def op9_subword_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and checksum of the ids, digest of the text decoded from them, and whether it is the text."""
    coded = viterbi.decode(viterbi.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_ids", "ids_crc32", F.md5("decoded").alias("decoded_md5"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    n_hit = decontam.hit_words(F.col("spans"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _planted(text, doc_id):
    """The text, in which every tenth document's words from a on repeat with a period p, as the contract of op13 says."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n, h = F.size(words), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    base = F.slice(words, a + 1, p)
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(base, F.ceil((n - a) / p).cast("int")))), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = wordruns.find_runs(docs.select("doc_id", _planted(docs["text"], docs["doc_id"]).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), wordruns.longest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    own = (op1_language_id, op2_html_text, op3_url_filter, op4_embedding_near_dedup, op5_line_dedup, op6_simhash_near_dedup, op7_nearest_neighbours, op8_token_output, op9_subword_encoding, op10_packing, op11_source_divergence, op12_benchmark_decontamination, op13_periodic_runs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"op11_source_divergence": OP11, "op12_benchmark_decontamination": OP12, "op13_periodic_runs": OP13}
