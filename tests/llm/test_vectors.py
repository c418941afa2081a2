import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfree.llm import postings, rpforest

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"
NAN, INF = float("nan"), float("inf")


def clustered(seed=0, n=900, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dims))
    x = centres[rng.integers(0, 60, n)] + rng.standard_normal((n, dims)) * rng.choice([0, 0.05, 0.2, 0.9], n)[:, None]
    return [(int(i) * 3, [float(np.float32(v)) for v in row], int(rng.integers(0, 3)), None) for i, row in enumerate(x)]


ODD = [(10_000, None, 1, "a"), (10_001, [], 1, "a"), (10_002, [0.0] * 16, 1, None), (10_003, [NAN] * 16, 1, None), (10_004, [1.0] * 15 + [INF], 1, None), (10_005, [1.0] * 15 + [None], 1, None), (10_006, [1.0] * 16, None, None)]


def usable(rows, labels=True):
    return [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and not (labels and r[2] is None)]


@pytest.mark.parametrize("leaf", [2048, 100])
def test_links_equal_brute_force(spark, leaf):
    rows = clustered() + ODD
    got = {r["vec_id"]: r for r in rpforest.link(spark.createDataFrame(rows, SCHEMA), leaf=leaf, trees=12).collect()}
    assert len(got) == len(rows)
    good = usable(rows)
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    np.fill_diagonal(near, False)
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, r in enumerate(good):
            low = min([root[r[0]]] + [root[good[j][0]] for j in np.flatnonzero(near[i])])
            if low < root[r[0]]:
                root[r[0]], changed = low, True
    links = dict.fromkeys(root, 0) | {r[0]: int(n) for r, n in zip(good, near.sum(axis=1), strict=True)}
    if leaf == 2048:
        assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (links[i], root[i], root[i] == i) for i in root}
    else:
        assert all(r["n_links"] <= links[i] for i, r in got.items())
        assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(links.values())
        assert np.mean([r["component_id"] == root[i] for i, r in got.items()]) >= 0.97


def test_neighbours_are_exact_where_found_and_recall_is_high(spark):
    rows = clustered(1, 3000) + ODD + [(20_000 + i, [3.0] + [0.5] * 15, 0, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = postings.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    good = usable(rows, labels=False)
    x, ids = np.array([r[1] for r in good]), np.array([r[0] for r in good])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        score = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        exact = dict(zip(ids.tolist(), score, strict=True))
        assert all(abs(r["score"] - exact[r["vec_id"]]) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.95
    copies = [r["vec_id"] for r in by[20_000] if r["vec_id"] > 20_000]
    assert len(copies) > 5 and copies == list(range(20_001, 20_001 + len(copies)))


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, None), (1, [0.5, 0.5], 1, None), (2, [0.5, 0.5], 2, None)], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in postings.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert postings.nearest(df.limit(0), F.lit(True)).count() == 0
    assert rpforest.link(df.limit(0)).count() == 0
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rpforest.link(df).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def test_every_leaf_path_can_be_followed():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 8))
    forest = rpforest.Forest.fit(x, 4, 3)
    leaves = forest.leaves(x, 4)
    for t in range(3):
        sizes = np.bincount(leaves[:, 2 * t], minlength=16)
        assert sizes.max() <= 2 * 500 / 16 + 8
        assert (leaves[:, 2 * t] != leaves[:, 2 * t + 1]).all()


def plain_links(rows):
    """n_links of every row: equal labels and lengths, cosine of 0.93 or more."""
    good, links = usable(rows), {r[0]: 0 for r in rows}
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                links[a[0]] += (x @ y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    return links


def test_vectors_of_several_lengths(spark):
    rows = clustered(4, 300) + [(20_000 + 20 * i, r[1] + [0.5], r[2], None) for i, r in enumerate(clustered(5, 200))] + [(40_000, [1.0] * 17 + [2.0], 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_links(rows)
    assert {r["vec_id"]: r["n_links"] for r in rpforest.link(df).collect()} == want
    deep = {r["vec_id"]: r["n_links"] for r in rpforest.link(df, leaf=20, trees=16).collect()}
    assert deep.keys() == want.keys() and all(deep[i] <= want[i] for i in want) and sum(deep.values()) >= 0.95 * sum(want.values())
    got, sizes = {}, {r[0]: len(r[1]) for r in rows}
    for r in postings.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {r[0] for r in rows if r[0] % 20 == 0} - {40_000}
    assert all(len(own) == 20 and all(sizes[q] == sizes[i] for i in own) for q, own in got.items())


def test_leaf_that_outgrows_its_size_is_compared_in_blocks(spark):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(16)
    rows = [(i, [float(v) for v in hot + 0.02 * rng.standard_normal(16)], 0, None) for i in range(400)] + [(1000 + i, [float(v) for v in rng.standard_normal(16)], 0, None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_links(rows)
    # the sample knows nothing of the group, which stays in few leaves
    few = df.where("vec_id >= 1000").unionByName(df.where("vec_id < 1000"))
    got = {r["vec_id"]: r for r in rpforest.link(few, leaf=30, sample=8, trees=16).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(want.values())
    assert all(got[i]["n_links"] <= want[i] for i in want) and {got[i]["component_id"] for i in range(400)} == {0}
