from itertools import product

import numpy as np

from stepfree.llm import langid


def test_word_scores_sum_over_all_segmentations():
    pieces = ["", "a", "b", "ab", "▁", "▁a", "ba", "bab"]
    rng = np.random.default_rng(0)
    probs = rng.random((len(pieces), 2))
    model = langid.LanguageModel(["x", "y"], pieces, probs)

    def total(word, k):
        out = 0.0
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            p = 1.0
            for x in parts:
                p *= probs[pieces.index(x), k] if x in pieces[1:] else (langid._FLOOR if len(x) == 1 else 0)
            out += p
        return out

    words = ["▁", "▁a", "▁abab", "▁babab", "▁ac", "▁bababab"]
    got = model.word_scores(words)
    for w in words:
        assert np.allclose(np.exp(got[w]), [total(w, 0), total(w, 1)])
    # expected counts: each word's pieces weigh as many characters as it has, when no character is unknown
    used = model.expected(words[:4], np.ones((4, 2)))
    sizes = np.array([len(p) for p in pieces])
    assert np.allclose(sizes @ used, sum(map(len, words[:4])))
    assert np.isfinite(model.word_scores(["▁" + "ab" * 3000])["▁" + "ab" * 3000]).all()


def test_held_out_accuracy_and_cases(spark, documents):
    more = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123 !", None, "s", 0), (10**6 + 2, "", "en", None, 0)], documents.schema)
    docs = documents.unionByName(more)
    got = {r["doc_id"]: r for r in langid.identify(spark, docs).collect()}
    assert len(got) == docs.count()
    for i in range(10**6, 10**6 + 3):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels_or_rows(spark, documents):
    assert {r["lang_pred"] for r in langid.identify(spark, documents.withColumn("lang", documents.lang.substr(9, 1)).where("false")).collect()} == set()
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.identify(spark, documents.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_expected_counts_of_long_words():
    """Equal to sums over all segmentations, and defined where a word's probability is below what a double holds."""
    pieces, rng = ["", "a", "b", "ab", "▁"], np.random.default_rng(1)
    model = langid.LanguageModel(["x"], pieces, rng.random((5, 1)) * 1e-3)
    long = "▁" + "ab" * 400
    got = model.expected([long], np.ones((1, 1)))[:, 0]
    p = model.probs[:, 0]
    share = p[3] / (p[3] + p[1] * p[2])  # each "ab" is one piece or two, apart from the others
    assert np.allclose(got, [0, 400 * (1 - share), 400 * (1 - share), 400 * share, 1])


def test_unlabelled_tables_are_kept(spark, documents):
    from pyspark.sql import functions as F

    docs = documents.limit(20).withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(10**6, "12 !", None, "s", 4), (10**6 + 1, None, None, "s", 0)], documents.schema))
    assert langid.keep_identified(docs, langid.fit(docs)).count() == 20


def test_numerals_are_no_letters():
    from stepfree.llm.langid import letter_runs

    assert letter_runs("½ ² ① Ⅷ 五 12 a1b é_ñ x²y") == ["五", "a", "b", "é", "ñ", "x", "y"] and letter_runs("a1b_c") == ["a", "b", "c"]
