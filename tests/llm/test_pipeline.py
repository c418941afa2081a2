import numpy as np

import corpus_pipeline
from stepfree.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_is_clean_and_the_columns(spark, documents):
    docs, passage = documents, " ".join(f"alpha{i} beta{i}" for i in range(40))
    top = documents.agg({"doc_id": "max"}).first()[0]
    extra = [(top + 1, "12 34 !!", "en", "s", 8), (top + 2, None, None, None, None), (top + 3, f"Tail of the first.\n{passage}", "en", "s", 9), (top + 4, f"{passage}\nHead of the second, which goes on.", "en", "s", 9)]
    text = documents.where("length(text) > 2000").orderBy("doc_id").first()["text"]
    extra += [(top + 5, text, "en", "s", len(text))]  # an exact copy
    docs = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language_id"](spark, docs, SF)
    assert docs.columns == documents.columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, r in before.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    docs = corpus_pipeline.materialize(stages["line_dedup"](spark, docs, SF), "test")
    assert docs.schema.simpleString() == documents.schema.simpleString()
    lines = {r["doc_id"]: r for r in docs.collect()}
    assert top + 5 not in lines
    assert passage in lines[top + 3]["text"] and lines[top + 4]["text"] == "Head of the second, which goes on." and lines[top + 4]["n_chars"] == len(lines[top + 4]["text"])
    assert all(before[i]["text"] == r["text"] or len(r["text"]) < len(before[i]["text"]) for i, r in lines.items())
    last = stages["simhash_near_dedup"](spark, docs, SF)
    assert last.columns == documents.columns
    fps = {i: simhash.fingerprint(r["text"]) for i, r in lines.items()}
    gone = lines.keys() - {r["doc_id"] for r in last.collect()}
    assert all(any((fps[i] ^ fps[j]).bit_count() <= 4 for j in fps if j < i or j not in gone and j != i) for i in gone)


def test_run_packs_every_id_once(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for own in by.values():
        assert np.concatenate([np.arange(s, s + n) for s, n, _ in sorted(own)]).tolist() == list(range(own[0][2]))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "packing"]


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_empty_and_odd_rows_pass_all_stages(spark, documents):
    odd = [(None, "words without an id", None, None, None), (7, None, None, None, None), (8, "12 34", "en", "s", 5), (9, "the same words", None, "s", 14), (9, "the same words", None, "s", 14), (10, "the same words", None, "s", 14)]
    for rows, want in (([], set()), (odd, {9})):
        docs = spark.createDataFrame(rows, documents.schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert {r["doc_id"] for r in docs.collect()} - {None} == want


def test_line_dedup_minds_no_names_of_columns(spark):
    """A column called as the stage's own count, and none called n_chars."""
    passage = " ".join(f"alpha{i} beta{i}" for i in range(40))
    rows = [(1, f"First.\n{passage}", "x", 5), (2, f"{passage}\nWhat is left of it.", "y", 5)]
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_deleted string, n_chars int")
    got = {r["doc_id"]: r for r in stage(spark, docs, SF).collect()}
    assert got[2].asDict() == {"doc_id": 2, "text": "What is left of it.", "lines_deleted": "y", "n_chars": 19} and got[1]["n_chars"] == 5
    assert {r["text"] for r in stage(spark, docs.drop("n_chars"), SF).collect()} == {rows[0][1], "What is left of it."}
