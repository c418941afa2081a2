import random

from stepfree.llm import linededup


def brute_force(docs, least):
    """Marks every line of every run of ``least`` words that starts earlier, less what overlaps the earliest copy."""
    seqs = {}
    for d, t in docs:
        seqs[d] = [(i, " ".join(x.split()), len(x.split())) for i, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for d in sorted(seqs):
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a, len(s)):
                first.setdefault(tuple(x[1] for x in s[a : b + 1]), (d, a, b))
    gone = {d: set() for d in seqs}
    for d, s in seqs.items():
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(x[2] for x in s[a : b + 1]) < least:
                    continue
                d0, a0, b0 = first[tuple(x[1] for x in s[a : b + 1])]
                if (d0, a0) == (d, a):
                    continue
                start = max(a, b0 + 1) if d0 == d else a
                gone[d].update(range(start, b + 1))
    return {d: [s[i][1] for i in range(len(s)) if i not in gone[d]] for d, s in seqs.items()}


def test_equals_brute_force_where_copies_do_not_overlap(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 4, 8, 12]))) for _ in range(14)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            lines.append(rng.choice(pool) if rng.random() < 0.7 else " ".join(f"u{rng.randrange(9999)}" for _ in range(6)))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  \t"]))
        docs.append((d, "\n".join(dict.fromkeys(lines))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (1, 10, 20):
        got = {r["doc_id"]: [" ".join(x.split()) for x in r["text"].split("\n") if x.strip()] for r in linededup.remove_repeats(df, least).collect()}
        assert got == brute_force(docs, least)


def test_a_text_that_repeats_itself_keeps_its_first_period(spark):
    df = spark.createDataFrame([(1, "\n".join(["a b"] * 100)), (2, "x\n" + "\n".join(["c d e"] * 3))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(df, 10).collect()}
    assert got == {1: "\n".join(["a b"] * 5), 2: "x\nc d e\nc d e\nc d e"}


def test_passage_of_fifty_words_goes_and_clean_text_stays(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(5, f"own five\n{passage}\nend", "a"), (7, f"{passage}", "b"), (6, f"head\n {passage}  \ntail", "c"), (8, None, "d"), (9, "", "e"), (10, "short\nshort", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {r["doc_id"]: (r["text"], r["lines_deleted"], r["runs"]) for r in linededup.remove_repeats(df).collect()}
    assert got == {5: (rows[0][1], 0, "a"), 7: ("", 1, "b"), 6: ("head\ntail", 1, "c"), 8: (None, 0, "d"), 9: ("", 0, "e"), 10: ("short\nshort", 0, None)}
    assert sorted(r["doc_id"] for r in linededup.remove_repeats(df, drop_emptied=True).collect()) == [5, 6, 8, 9, 10]
    assert linededup.remove_repeats(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"first\n{passage}"), (2, f"clean\nown words here"), (2, f"other\n{passage}"), (2, f"other\n{passage}")]
    got = sorted(r["text"] for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0][1], rows[1][1], "other", "other"])


def plain_passages(docs, least):
    """Words that stay, by looking every stretch of ``least`` words up in a table of first places."""
    seqs, first, gone = {d: t.split() for d, t in docs}, {}, {d: set() for d, _ in docs}
    for d in sorted(seqs):
        for a in range(len(seqs[d]) - least + 1):
            d0, a0 = first.setdefault(tuple(seqs[d][a : a + least]), (d, a))
            gone[d].update(range(max(a, a0 + least) if d0 == d else a, a + least) if (d0, a0) != (d, a) else ())
    return {d: [w for i, w in enumerate(s) if i not in gone[d]] for d, s in seqs.items()}


def test_passages_within_lines_equal_brute_force(spark):
    rng = random.Random(6)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    pool, docs = [new(rng.choice([49, 50, 51, 70, 120])) for _ in range(8)], []
    for d in range(40):
        words = new(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.choice([0, 0, rng.randrange(20)])
            words += p[a:] + new(rng.randrange(30))
        docs.append((d, "".join(w + rng.choice([" "] * 30 + ["\n", "  ", "\n\n"]) for w in words)))
    docs += [(50, docs[7][1]), (51, docs[7][1] + "tail"), (52, "a b c " * 40), (53, "few words"), (54, "few words")]
    got = {r["doc_id"]: r for r in linededup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_passages(docs, 50)
    assert {d: r["text"].split() for d, r in got.items()} == want
    assert all((r["lines_deleted"] > 0) == (len(want[d]) < len(t.split())) and (r["lines_deleted"] or r["text"] == t) for d, t in docs for r in [got[d]])


def test_rest_of_a_line_stays_as_it_was(spark):
    passage = " ".join(f"p{i}" for i in range(62))
    rows = [(1, f"own words {passage}, and on"), (2, f"  Head  of it. {passage} tail\tstays\n\nnext"), (3, f"x\n{passage[:150]}\n\n{passage[151:]}\ny")]
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2][0] == "  Head  of it. p61 tail\tstays\n\nnext" and got[2][1] == 1


def test_copies_that_overlap_and_hot_passages_equal_brute_force(spark):
    rng = random.Random(8)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    long, common = new(150), new(64)
    docs = []
    for d in range(60):
        a, b = rng.randrange(60), rng.randrange(20)
        words = new(rng.randrange(20)) + long[a : a + 40 + rng.randrange(60)] + long[a + 20 : a + 75] + new(rng.randrange(3))
        if d % 3 == 0:
            words += common[b:] + new(2) + common
        docs.append((d, " ".join(words)))
    docs += [(70, " ".join(["x", "y"] * 80)), (71, " ".join(["y", "x"] * 80)), (72, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for sample in (0, 10**9):  # nothing is hot, or all that is there twice
        found = {r["d"]: sorted(r["passages"]) for r in linededup.later_passages(df, sample=sample, often=2).groupBy("d").agg({"passages": "first"}).selectExpr("d", "`first(passages)` as passages").collect()}
        gone = {d: {w for r in own for w in range(r >> 32, min(1000, r & 0xFFFFFFFF) + 1)} for d, own in found.items()}
        want = plain_passages(docs, 50)
        assert {d: [w for i, w in enumerate(t.split()) if i not in gone.get(d, ())] for d, t in docs} == want


def test_columns_with_any_names_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    names = ["d", "h", "_d", "_h", "runs", "_runs", "d_1", "lines_deleted"]
    df = spark.createDataFrame([(1, passage, *range(8)), (2, passage + " more", *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = linededup.remove_repeats(df)
    assert got.columns == [*df.columns, "lines_deleted_1"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["text"] == "more" and rows[2]["lines_deleted_1"] == 1 and [rows[2][n] for n in names] == list(range(8))


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    texts = ["", "a bb  ccc", None, "ccc\n bb\ta", "é日 a", " ", "x" * 5000 + " bb"]
    w, starts = linededup.word_hashes(pa.array([t or "" for t in texts]).slice(1))
    own = [w[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    assert [len(x) for x in own] == [3, 0, 3, 2, 0, 2]
    assert own[0] == own[2][::-1] and own[3][1] == own[0][0] and own[5][1] == own[0][1] and len(set(w.tolist())) == 5
    part, linededup._PART = linededup._PART, 8
    try:
        assert linededup.word_hashes(pa.array([t or "" for t in texts]).slice(1))[0].tolist() == w.tolist()
    finally:
        linededup._PART = part
