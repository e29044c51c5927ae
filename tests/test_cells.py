"""Pruned exact neighbours: equal to comparing all pairs, and most pairs are not compared."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabml.operators import cells
from tabml.operators.neighbors import KnnImputer, knn_candidates, knn_predict

SCHEMA = "id long, vec array<double>, y double"


def rows_frame(spark, X, names=("_qid", "_vec")):
    rows = [(i, [float(x) for x in v], float(i % 7)) for i, v in enumerate(X)]
    return spark.createDataFrame(rows, SCHEMA).toDF(*names, *(["_y"] if len(names) == 2 else [])).select(*names, "_y")


def clustered(rng, n, d, groups=40):
    return rng.uniform(-100, 100, (groups, d))[rng.integers(0, groups, n)] + rng.normal(0, 1, (n, d))


def brute(Q, R, k):
    D = cells.distances(Q, R)
    return {i: [(int(j), D[i, j]) for j in sorted(range(len(R)), key=lambda j: (D[i, j], j)) if np.isfinite(D[i, j])][:k] for i in range(len(Q))}


@pytest.mark.parametrize("kind", ["clustered", "even", "ties"])
def test_neighbours_equal_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "clustered":
        X = clustered(rng, 1500, 5)
    elif kind == "even":
        X = rng.normal(0, 1, (700, 8))
    else:
        X = rng.integers(0, 3, (700, 3)).astype(float)  # a third of the rows share a few places
        X[:250] = 1.0
    Q, R = X[:len(X) // 3], X[len(X) // 3:]
    counted = {}
    got = knn_candidates(rows_frame(spark, Q), rows_frame(spark, R, ("_rid", "_vec", "_y")[:2]), 5, block_rows=50, counted=counted).collect()
    want = brute(Q, R, 5)
    for i in range(len(Q)):
        mine = sorted((r for r in got if r._qid == i), key=lambda r: r._rank)
        assert [r._rid for r in mine] == [j for j, _ in want[i]]
        assert np.allclose([r._dist for r in mine], [x for _, x in want[i]]) and [r._y for r in mine] == [j % 7 for j, _ in want[i]]
    if kind == "clustered":
        assert sum(counted["pairs"]) < 0.2 * len(Q) * len(R), counted


def test_few_and_no_rows(spark):
    q, r = rows_frame(spark, np.eye(3)), rows_frame(spark, np.eye(3)[:2], ("_rid", "_vec"))
    assert sorted((x._qid, x._rid, x._rank) for x in knn_candidates(q, r, 5).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 0, 1), (2, 1, 2)]
    assert knn_candidates(q, r.where("false"), 5).collect() == []
    assert knn_candidates(q.where("false"), r, 5, block_rows=1).collect() == []


def brute_fill(X, k, means):
    out = X.copy()
    D = cells.distances(X, X)
    for i, j in zip(*np.nonzero(np.isnan(X))):
        near = sorted((D[i, r], X[r, j]) for r in range(len(X)) if not np.isnan(X[r, j]) and np.isfinite(D[i, r]))[:k]
        out[i, j] = np.mean([v for _, v in near]) if near else means[j]
    return out


def test_imputed_values_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    X = np.round(clustered(rng, 500, 4), 2)
    X[rng.random(X.shape) < 0.15] = np.nan
    X[0], X[1] = np.nan, [np.nan, np.nan, np.nan, 5.0]
    X[2:40] = X[50]  # many rows of one place, with its gaps
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[None if np.isnan(x) else float(x) for x in v]) for i, v in enumerate(X)], "id long, a double, b double, c double, d double")
    model = KnnImputer(inputCols=names, k=3).fit(df)
    model._set(blockRows=20)
    got = {r.id: [r[c] for c in names] for r in model.transform(df).collect()}
    want = brute_fill(X, 3, np.nanmean(X, axis=0))
    assert len(got) == 500 and np.allclose([got[i] for i in range(500)], want)


def test_bounds_are_below_all_distances(spark):
    rng = np.random.default_rng(5)
    X = clustered(rng, 400, 3)
    X[rng.random(X.shape) < 0.2] = np.nan
    placed, figures = cells.place(rows_frame(spark, X, ("_rid", "_vec")), 400, 30)
    assert len(figures.count) > 5 and figures.count.sum() == 400
    D, bounds = cells.distances(X, X), figures.bounds(X)
    at = {r._rid: r._cell for r in placed.select("_rid", "_cell").collect()}
    for r in range(400):
        assert (bounds[:, at[r]] <= D[:, r]).all()


def test_a_crowded_cell_is_cut_into_packs(spark):
    rows = spark.range(1000).select(F.col("id").alias("_id"), F.array(F.lit(1.0)).alias("_vec"), F.lit(0.0).alias("_y"), F.lit(0).alias("_cell"))
    sizes = [len(r._ids) // 8 for r in cells.packs(rows, spark.createDataFrame([(0, 1000)], "_cell int, n long"), 50).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 100


def test_queries_are_repeated_for_groups_of_cells_only(spark, monkeypatch):
    """Rows without structure: every query visits every cell, yet the written visits stay near the size of the queries."""
    written = []

    def stored(df, name, old=cells._stored):
        out = old(df, name)
        if name == "knn-visits":
            numbers = F.length("q_rows") / 8 if "q_rows" in out.columns else F.size("_vec")
            written.append(out.agg(F.sum(numbers)).first()[0] or 0)
        return out

    monkeypatch.setattr(cells, "_stored", stored)
    X = np.random.default_rng(7).normal(0, 1, (2600, 32))
    got = knn_candidates(rows_frame(spark, X[:600]), rows_frame(spark, X[600:], ("_rid", "_vec")), 5, block_rows=16).collect()
    assert sum(written) < 4 * 600 * 32, written
    want = brute(X[:600], X[600:], 5)
    for i in range(0, 600, 50):
        assert [r._rid for r in sorted((r for r in got if r._qid == i), key=lambda r: r._rank)] == [j for j, _ in want[i]]


def test_nearest_of_a_block_by_products_and_by_differences():
    """Ties, far offsets, infinite values and masked cells give what all distances give."""
    rng = np.random.default_rng(11)
    at = np.repeat(np.arange(4), 25).astype(np.int32)
    for R in (rng.normal(0, 1, (100, 6)), rng.integers(0, 2, (100, 6)).astype(float), rng.normal(1e8, 1e-3, (100, 6)),
              np.where(rng.random((100, 6)) < 0.02, np.inf, rng.normal(0, 1, (100, 6))), np.where(rng.random((100, 6)) < 0.1, np.nan, rng.normal(0, 1, (100, 6)))):
        Q = np.vstack([R[:20], R[:20] + 0.5])
        mask = rng.random((40, 4)) < 0.7
        tau = np.where(rng.random(40) < 0.5, np.inf, 1.5)
        D = np.where(mask[:, at] & (cells.distances(Q, R) <= tau[:, None]), cells.distances(Q, R), np.inf)
        rid = rng.permutation(100).astype(np.int64)
        got = next(cells.rows_of_block(7)(np.arange(40), Q, rid, R, rid * 0.5, at, mask, tau))
        for i in range(40):
            near = sorted((D[i, j], rid[j]) for j in range(100) if np.isfinite(D[i, j]))[:7]
            mine = got[got["_qid"] == i]
            assert list(zip(mine["_dist"], mine["_rid"])) == near and (mine["_v"] == mine["_rid"] * 0.5).all()


def test_votes_of_rows_without_structure(spark):
    """Majority of the five nearest, smallest class on ties, over many cells that every query visits."""
    X = np.random.default_rng(9).normal(0, 1, (900, 24))
    found = knn_candidates(rows_frame(spark, X[:200]), rows_frame(spark, X[200:], ("_rid", "_vec")), 5, block_rows=16)
    got = {r["_qid"]: r["_pred"] for r in knn_predict(found, "classification").collect()}
    for i, near in brute(X[:200], X[200:], 5).items():
        votes = [j % 7 for j, _ in near]
        assert got[i] == min(votes, key=lambda c: (-votes.count(c), c))


def test_written_packs_lie_in_small_row_groups(spark):
    """A reader or writer holds a row group, so its size must not grow with the packs of a task."""
    import glob

    import pyarrow.parquet as pq

    from tabml.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/knn-*"))
    values = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(1 << 20)) / (1 << 20))
    rows = spark.range(12000).select(F.col("id").alias("_qid"), values.alias("_vec"))
    refs = rows.where("_qid < 4000").select(F.col("_qid").alias("_rid"), "_vec", F.lit(0.0).alias("_y"))
    found = knn_candidates(rows, refs, 1, block_rows=128).where("_qid < 4000")
    assert found.agg(F.count("*").alias("n"), F.sum((F.col("_qid") == F.col("_rid")).cast("int")).alias("own")).first() == (4000, 4000)
    sizes = {}
    for path in set(glob.glob(f"{base}/knn-*")) - before:
        groups = [pq.ParquetFile(f).metadata.row_group(g) for f in glob.glob(f"{path}/*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
        kind = path.split("/")[-1].rsplit("-", 1)[0]
        sizes[kind] = max([sizes.get(kind, 0), *(g.total_byte_size for g in groups)])
    pack = cells.PACK_NUMBERS * 8
    assert 0 < sizes["knn-visits"] < (8 << 20) + 2 * pack and 0 < sizes["knn-packs"] < (8 << 20) + 2 * pack, sizes


def test_gaps_of_a_training_part_are_searched_once(spark, monkeypatch):
    """The prepared training part is that of the fit: only the test part is searched besides."""
    from tabml.operators import neighbors
    from tabml.plans.recipe import prepare
    searches = []
    monkeypatch.setattr(neighbors, "nearest", lambda *a, old=neighbors.nearest, **b: (searches.append(1), old(*a, **b))[1])
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 6 == 0 else float(a), float(b), int(a + b > 1)) for i, (a, b) in enumerate(rng.random((240, 2)))]
    fr = prepare(spark.createDataFrame(rows, "id long, a double, b double, y int"), target="y", key="id", task="classification")
    assert fr.train.count() + fr.test.count() > 200 and len(searches) == 2, searches


def test_gaps_read_few_cells(spark):
    """The third nearest of the first round bounds the second one, which else compares all pairs."""
    rng = np.random.default_rng(13)
    X = clustered(rng, 1500, 3)
    X[::5, 1] = np.nan
    frame = rows_frame(spark, X, ("_rid", "_vec"))
    gaps = frame.where("_rid % 5 = 0").select(F.col("_rid").alias("_qid"), "_vec")
    counted = {}
    found = cells.nearest(gaps, frame.withColumn("_y", F.lit(0.0)), 3, 1500, 50, values=True, counted=counted)
    got = {r._qid: r.v for r in found.groupBy("_qid").agg(F.avg("_v").alias("v")).collect()}
    want = brute_fill(X, 3, np.nanmean(X, axis=0))
    assert all(np.isclose(got[i], want[i, 1]) for i in range(0, 1500, 5))
    assert sum(counted["pairs"]) < 0.4 * 300 * 1500, counted


def test_columns_are_computed_once_for_a_row_without_gaps(spark):
    """Whether a row has gaps is told from its computed columns, not by computing them once more."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(i):
        calls.add(1)
        return float(i)

    df = spark.range(100).withColumn("a", costly("id")).withColumn("b", F.when(F.col("id") > 0, F.col("id").cast("double")))
    model = KnnImputer(inputCols=["a", "b"], k=1).fit(df.where("id < 50"))
    before = calls.value
    out = model.transform(df).collect()
    assert len(out) == 100 and all(r.a == r.id and r.b == (r.id or 1) for r in out) and calls.value - before <= 200 + 100, calls.value - before


def test_many_rows_in_few_files_go_to_all_cores(spark):
    rows = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert cells._spread(rows, cells.SPREAD_ROWS).rdd.getNumPartitions() == cores
    assert cells._spread(rows, 1000).rdd.getNumPartitions() == 1
