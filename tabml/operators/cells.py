"""Exact nearest neighbours over cells of reference rows, with bounds that leave most cells unread.

Reference rows go to the nearest of a few pivots (rows drawn by hash).  A cell knows its number of rows, how
many of them have each column, the box around them and their largest distance to the pivot.  From this
follows a lower bound of the distance of a query to any row of the cell: the distance to the box over
the columns that all rows of the cell have, and, where no value is missing, the distance to the pivot less the radius.
Queries go through the cells in two rounds:

1. the cells of the least bounds that together have ``k`` rows, which gives a true distance ``tau``;
2. every other cell whose bound does not exceed ``tau``.

What the rounds return therefore holds the exact ``k`` nearest, for any data; on data without structure the second
round reads all cells, as exact search must.

Missing values are NaN.  The distance is ``sqrt(d / common * sum of squared differences over the common
columns)``, the Euclidean one where nothing is missing; rows without a common column, and non-finite distances, are
no neighbours.

Scale: neighbouring cells form groups of about ``GROUP_ROWS`` rows, and rows travel as packs (one row each) of a group; a
crowded cell is cut into several.  Queries are packed by the group they are nearest to.  A pack of queries is repeated for the groups
that its queries visit only, with a mask of the cells that each of them visits; packs meet in an equi-join on the group, which
Spark can split, and a task goes through a pair of packs by matrices of ``MATRIX`` numbers.  The driver holds the cells' figures: at
most ``MAX_CELLS`` rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

MAX_CELLS = 2048
#: Numbers in the cells' figures at most (wide rows get fewer cells).
MAX_FIGURES = 1 << 21
#: Rows of a group of cells (wide rows: fewer, ``PACK_NUMBERS`` numbers), and numbers of a matrix that a task works on at a time.
GROUP_ROWS = 2048
PACK_NUMBERS = 1 << 18
MATRIX = 1 << 18
#: Part of a bound that rounding may add to it.
ROUNDING = 1e-9
#: Rows of a table that is spread over all cores.
SPREAD_ROWS = 50_000
CANDIDATES = "_qid long, _j int, _rid long, _dist double, _v double"
_PACK = "_cell int, _part long, _ids binary, _rows binary, _ys binary, _ats binary"
#: How packs are written.  Parquet looks at sizes after 100 rows only, 100 MB and more of packs: a page of that size is held and compressed as
#: one, and a reader holds all rows of a row group.
PACKED = {"parquet.block.size": 8 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
          "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def stack(series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=float) for v in series])


def distances(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """All distances; inf where no column is common.  Differences column by column, so that equal rows tie exactly."""
    d = Q.shape[1]
    total = np.zeros((len(Q), len(R)))
    if not np.isnan(Q).any() and not np.isnan(R).any():
        diff = np.empty_like(total)
        for c in range(d):
            np.subtract(Q[:, c][:, None], R[:, c][None, :], out=diff)
            diff *= diff
            total += diff
        return np.sqrt(total)
    common = np.zeros_like(total)
    for c in range(d):
        both = ~np.isnan(Q[:, c])[:, None] & ~np.isnan(R[:, c])[None, :]
        diff = np.where(both, Q[:, c][:, None] - R[:, c][None, :], 0.0)
        total += diff * diff
        common += both
    return np.where(common > 0, np.sqrt(total * d / np.where(common > 0, common, 1.0)), np.inf)


def least(D: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite (distance, tie) of each row."""
    near = np.isfinite(D)
    if D.shape[1] > k:
        near &= D <= np.partition(D, k - 1, axis=1)[:, k - 1:k]
    rows, cols = np.nonzero(near)
    return _first_of_rows(rows, cols, D[rows, cols], tie, k)[:2]


def _first_of_rows(rows, cols, dist, tie, k: int):
    """Of pairs (row, column, distance), the ``k`` smallest (distance, tie) of each row, in that order."""
    order = np.lexsort((tie[cols], dist, rows))
    by_row = rows[order]
    mine = order[np.arange(len(order)) - np.searchsorted(by_row, by_row) < k]
    return rows[mine], cols[mine], dist[mine]


def _table(qid, j, rid, dist, v) -> pd.DataFrame:
    return pd.DataFrame({"_qid": qid, "_j": np.broadcast_to(np.int32(j), qid.shape), "_rid": rid, "_dist": dist, "_v": v})


def _near_pairs(Q: np.ndarray, R: np.ndarray, seen, tau: np.ndarray, k: int):
    """Pairs that may be among the ``k`` nearest of their row, with their distances; None where products cannot tell.

    Products of whole matrices give the squared distances up to ``slack``: the k nearest lie within twice that of the k-th
    such figure.  Only the pairs within it get their distance, by differences as in ``distances``."""
    if np.isnan(Q).any() or np.isnan(R).any():
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        q, r = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", R, R)
        about = q[:, None] + r - 2.0 * (Q @ R.T)
        slack = 16 * (Q.shape[1] + 4) * np.finfo(float).eps * (q + r.max(initial=0.0)) + 1e-300
        reach = tau * tau * (1 + 1e-12) + slack
    if not np.isfinite(about).all():
        return None
    if seen is not None:
        about[~seen] = np.inf
    if len(R) > k:
        reach = np.minimum(reach, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slack)
    near = about <= reach[:, None]
    if seen is not None:
        near &= seen
    rows, cols = np.nonzero(near)
    total = np.zeros(len(rows))
    for c in range(Q.shape[1]):
        diff = Q[rows, c] - R[cols, c]
        total += diff * diff
    return rows, cols, np.sqrt(total)


def _seen_distances(Q: np.ndarray, R: np.ndarray, at: np.ndarray, mask: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Distances to the rows of the cells that ``mask`` has (``at``: the rows' places in it); inf elsewhere and beyond ``tau``."""
    D = np.full((len(Q), len(R)), np.inf)
    for c in np.unique(at):
        rows, cols = np.flatnonzero(mask[:, c]), np.flatnonzero(at == c)
        if len(rows):
            D[np.ix_(rows, cols)] = distances(Q[rows], R[cols])
    D[D > tau[:, None]] = np.inf
    return D


def rows_of_block(k: int):
    """Per query the ``k`` nearest rows of a block by (distance, id); ``_v`` is the row's label."""
    def block(qid, Q, rid, R, y, at, mask, tau):
        pairs = _near_pairs(Q, R, None if mask.all() else mask[:, at], tau, k)
        if pairs is None:
            D = _seen_distances(Q, R, at, mask, tau)
            rows, cols = least(D, rid, k)
            dist = D[rows, cols]
        else:
            rows, cols, dist = pairs
            good = np.isfinite(dist) & (dist <= tau[rows])
            rows, cols, dist = _first_of_rows(rows[good], cols[good], dist[good], rid, k)
        yield _table(qid[rows], 0, rid[cols], dist, y[cols])
    return block


def values_of_block(k: int):
    """Per query and missing column the ``k`` nearest rows of a block that have it, by (distance, value); ``_v`` is the value."""
    def block(qid, Q, rid, R, y, at, mask, tau):
        D = _seen_distances(Q, R, at, mask, tau)
        for j in range(Q.shape[1]):
            gaps, donors = np.flatnonzero(np.isnan(Q[:, j])), np.flatnonzero(~np.isnan(R[:, j]))
            if not len(gaps) or not len(donors):
                continue
            part, value = D[np.ix_(gaps, donors)], R[donors, j]
            rows, cols = least(part, value, k)
            yield _table(qid[gaps[rows]], j, rid[donors[cols]], part[rows, cols], value[cols])
    return block


@dataclass
class Cells:
    """Figures of the cells, one row of each array per cell."""

    count: np.ndarray    # rows
    have: np.ndarray     # rows with a value, by column
    low: np.ndarray      # box
    high: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray   # inf where a row or the pivot lacks a value

    def bounds(self, X: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows ``X`` to the rows of each cell."""
        d = X.shape[1]
        present, all_have, any_has = ~np.isnan(X), self.have == self.count[:, None], self.have > 0
        out = np.zeros((len(X), len(self.count)))
        common = present.astype(float) @ any_has.T.astype(float)  # at most
        for c in range(len(self.count)):
            use = present & all_have[c]
            gap = np.where(use, np.maximum(np.maximum(self.low[c] - X, X - self.high[c]), 0.0), 0.0)
            out[:, c] = np.einsum("ij,ij->i", gap, gap)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(common > 0, np.sqrt(out * d / np.maximum(common, 1.0)), np.inf)
        whole = present.all(axis=1)
        ball = np.flatnonzero(np.isfinite(self.radius))
        if whole.any() and len(ball):
            away = distances(X[whole], self.pivot[ball]) - self.radius[ball]
            out[np.ix_(whole, ball)] = np.maximum(out[np.ix_(whole, ball)], away)
        return out * (1 - ROUNDING) - ROUNDING * np.abs(np.where(np.isfinite(out), out, 0.0))

    def first(self, X: np.ndarray, bounds: np.ndarray, k: int, values: bool) -> np.ndarray:
        """Cells of the first round (rows x cells): the least bounds that have ``k`` rows together, for each
        missing column if ``values``."""
        middle = np.where(self.low <= self.high, (self.low + self.high) / 2, np.nan)
        order = np.lexsort((distances(X, middle), bounds), axis=-1)
        reached = np.isfinite(np.take_along_axis(bounds, order, 1))
        need = np.zeros(len(X), int)
        for j in range(X.shape[1]) if values else [-1]:
            has = (self.have[:, j] if values else self.count)[order] * reached
            before = np.cumsum(has, axis=1) - has
            due = np.isnan(X[:, j]) if values else np.ones(len(X), bool)
            need = np.maximum(need, np.where(due, (before < k).sum(axis=1), 0))
        take = (np.arange(order.shape[1]) < need[:, None]) & reached
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, 1)
        return out

    def useful(self, X: np.ndarray, values: bool) -> np.ndarray:
        """Cells that have a row which can be a neighbour (rows x cells)."""
        if not values:
            return np.broadcast_to(self.count > 0, (len(X), len(self.count)))
        return (np.isnan(X).astype(int) @ (self.have > 0).T.astype(int)) > 0


def _spread(df: DataFrame, n: int) -> DataFrame:
    """``df`` over all cores if its ``n`` rows are work for them and lie in fewer partitions: rows of a few numbers lie in few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if n >= SPREAD_ROWS and df.rdd.getNumPartitions() < cores else df


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**(PACKED if "binary" in dict(df.dtypes).values() else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chunks(n: int, width: int):
    """Slices of ``n`` rows so that a matrix of ``width`` columns holds ``MATRIX`` numbers or so."""
    step = max(1, MATRIX // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _nearest_pivot(pivots: np.ndarray):
    def work(batches):
        for pdf in batches:
            for part in _chunks(len(pdf), len(pivots)):
                some = pdf.iloc[part]
                D = distances(stack(some["_vec"]), pivots)
                cell = np.where(np.isfinite(D), D, np.inf).argmin(axis=1)
                yield some.assign(_cell=cell.astype(np.int32), _away=D[np.arange(len(D)), cell])
    return work


def _figures(batches):
    """Figures of each cell in a batch, one row each."""
    for pdf in batches:
        if pdf.empty:
            continue
        X, cells = stack(pdf["_vec"]), pdf["_cell"].to_numpy()
        away = np.where(np.isnan(X).any(axis=1), np.inf, pdf["_away"].to_numpy())
        for c in np.unique(cells):
            mine = X[cells == c]
            has = ~np.isnan(mine)
            yield pd.DataFrame({"_cell": [c], "n": [len(mine)], "have": [has.sum(axis=0).tolist()],
                                "low": [np.where(has, mine, np.inf).min(axis=0).tolist()],
                                "high": [np.where(has, mine, -np.inf).max(axis=0).tolist()], "radius": [away[cells == c].max()]})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_cell": pdf["_cell"][:1], "n": [int(pdf["n"].sum())], "have": [stack(pdf["have"]).sum(axis=0).astype(int).tolist()],
                         "low": [stack(pdf["low"]).min(axis=0).tolist()], "high": [stack(pdf["high"]).max(axis=0).tolist()],
                         "radius": [pdf["radius"].max()]})


def place(refs: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, Cells | None]:
    """``refs`` (_rid, _vec, _y) with their cell, and the cells' figures (None without rows)."""
    first = refs.select("_vec").head()
    if first is None:
        return refs, None
    most = max(1, min(MAX_CELLS, MAX_FIGURES // max(1, len(first[0]))))
    # the rows of least hash: they follow the rows' density, and a lost task draws them again
    drawn = refs.select("_vec").where(F.size("_vec") > 0).orderBy(F.xxhash64("_rid"), "_rid").limit(max(1, min(most, -(-n // block_rows)))).collect()
    pivots = np.unique(stack([r[0] for r in drawn]), axis=0)
    placed = _stored(refs.mapInPandas(_nearest_pivot(pivots), "_rid long, _vec array<double>, _y double, _cell int, _away double"), "knn-cells")
    schema = "_cell int, n long, have array<long>, low array<double>, high array<double>, radius double"
    rows = {r._cell: r for r in placed.select("_vec", "_cell", "_away").mapInPandas(_figures, schema).groupBy("_cell").applyInPandas(_merged, schema).collect()}
    d = pivots.shape[1]

    def column(name, empty):
        return np.array([getattr(rows[c], name) if c in rows else empty for c in range(len(pivots))], float)

    cells = Cells(column("n", 0).astype(int), column("have", [0] * d).astype(int), column("low", [np.inf] * d),
                  column("high", [-np.inf] * d), pivots, column("radius", np.inf))
    return placed, cells


def grouped(cells: Cells, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each cell, its place in the group, and the rows of a pack.  Cells join along a chain of nearest pivots until a group
    has a pack's rows."""
    size = max(block_rows, min(GROUP_ROWS, PACK_NUMBERS // max(1, cells.pivot.shape[1])))
    n = len(cells.count)
    left, chain, away = np.ones(n, bool), [0], np.zeros(n)
    while len(chain) < n:
        left[chain[-1]] = False
        away = np.where(left, np.nan_to_num(distances(cells.pivot[chain[-1]:chain[-1] + 1], cells.pivot)[0], nan=np.inf, posinf=1e300), np.inf)
        chain.append(int(away.argmin()))
    group, place, now, rows = np.zeros(n, int), np.zeros(n, int), -1, 0
    for c in chain:
        if now < 0 or rows + cells.count[c] > size:
            now, rows, at = now + 1, 0, 0
        group[c], place[c] = now, at
        rows, at = rows + cells.count[c], at + 1
    return group, place, size


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_id")
    return pd.DataFrame({"_cell": pdf["_cell"][:1], "_part": pdf["_part"][:1], "_ids": [pdf["_id"].to_numpy(np.int64).tobytes()],
                         "_rows": [stack(pdf["_vec"]).tobytes()], "_ys": [pdf["_y"].to_numpy(float).tobytes()],
                         "_ats": [pdf["_at"].to_numpy(np.int32).tobytes()]})


def packs(rows: DataFrame, counts: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` (_id, _vec, _y, _cell and, if they have it, _at) in packs of about ``block_rows``; ``counts``: rows of each cell."""
    parts = counts.select("_cell", F.ceil(F.col("n") / block_rows).alias("_parts"))
    dealt = rows.join(F.broadcast(parts), "_cell").withColumn("_part", F.pmod(F.xxhash64("_id"), "_parts"))
    at = F.col("_at") if "_at" in rows.columns else F.lit(0)
    return dealt.select("_cell", "_part", "_id", "_vec", "_y", at.cast("int").alias("_at")).groupBy("_cell", "_part").applyInPandas(_pack, _PACK)


_ASKING = "_cell int, q_ids binary, q_rows binary, q_taus binary, q_mask binary, _pairs long"


def _compared(block):
    def work(batches):
        for pdf in batches:
            for q_ids, q_rows, q_taus, q_mask, ids, rows, ys, ats in pdf.itertuples(index=False, name=None):
                qid, rid, at = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(ats, np.int32)
                Q, R = np.frombuffer(q_rows).reshape(len(qid), -1), np.frombuffer(rows).reshape(len(rid), -1)
                mask, tau, y = np.frombuffer(q_mask, bool).reshape(len(qid), -1), np.frombuffer(q_taus), np.frombuffer(ys)
                for part in _chunks(len(qid), len(rid)):
                    yield from block(qid[part], Q[part], rid, R, y, at, mask[part], tau[part])
    return work


def _homes(cells: Cells, group: np.ndarray):
    """The group that each query is nearest to, as ``_cell``."""
    def work(batches):
        for pdf in batches:
            for part in _chunks(len(pdf), len(group) // 4):
                some = pdf.iloc[part]
                home = group[cells.bounds(stack(some["_vec"])).argmin(axis=1)]
                yield pd.DataFrame({"_id": some["_qid"], "_vec": some["_vec"], "_cell": home.astype(np.int32)})
    return work


def _visits(cells: Cells, group: np.ndarray, place: np.ndarray, k: int, values: bool, second: bool):
    """From packs of queries, a row for each group that they visit: the queries that do, their ``tau`` and the cells that each visits."""
    order = np.lexsort((place, group))
    starts = np.searchsorted(group[order], np.arange(group.max() + 2))

    def go(X, tau):
        bounds = cells.bounds(X)
        out = cells.first(X, bounds, k, values)
        if second:
            out = ~out & (bounds <= tau[:, None]) & np.isfinite(bounds)
        return out & cells.useful(X, values)

    def work(batches):
        for pdf in batches:
            for ids, rows, ys in zip(pdf["_ids"], pdf["_rows"], pdf["_ys"]):
                qid, tau = np.frombuffer(ids, np.int64), np.frombuffer(ys)
                X = np.frombuffer(rows).reshape(len(qid), -1)
                visit = np.concatenate([go(X[part], tau[part]) for part in _chunks(len(qid), len(group) // 4)])[:, order]
                for g in range(len(starts) - 1):
                    mask = visit[:, starts[g]:starts[g + 1]]
                    some = np.flatnonzero(mask.any(axis=1))
                    if len(some):
                        pairs = int(mask.sum(axis=0) @ cells.count[order[starts[g]:starts[g + 1]]])
                        yield pd.DataFrame({"_cell": [np.int32(g)], "q_ids": [qid[some].tobytes()], "q_rows": [X[some].tobytes()],
                                            "q_taus": [tau[some].tobytes()], "q_mask": [mask[some].tobytes()], "_pairs": [pairs]})
    return work


def nearest(queries: DataFrame, refs: DataFrame, k: int, n_refs: int, block_rows: int, values: bool = False,
            counted: dict | None = None) -> DataFrame:
    """The exact ``k`` nearest of ``refs`` (_rid, _vec, _y) for each of ``queries`` (_qid, _vec): ``CANDIDATES`` and ``_rank``
    by (distance, id), or, if ``values``, of each missing column by (distance, value).  ``counted`` gets the pairs compared in each round."""
    spark = queries.sparkSession
    if values:
        refs, queries = _spread(refs, n_refs), _spread(queries, n_refs)
    placed, cells = place(refs.select("_rid", "_vec", F.col("_y").cast("double").alias("_y")), n_refs, block_rows)
    tie = "_v" if values else "_rid"
    if cells is None:
        return spark.createDataFrame([], CANDIDATES + ", _rank int")
    group, at, size = grouped(cells, block_rows)
    sizes = np.bincount(group, cells.count).astype(int)
    counts = spark.createDataFrame([(g, int(n)) for g, n in enumerate(sizes) if n], "_cell int, n long")
    of_cell = F.broadcast(spark.createDataFrame([(c, int(g), int(p)) for c, (g, p) in enumerate(zip(group, at))], "_cell int, _group int, _at int"))
    dealt = placed.withColumnRenamed("_rid", "_id").join(of_cell, "_cell").drop("_cell").withColumnRenamed("_group", "_cell")
    ref_packs = packs(dealt, counts, size)
    several = len(cells.count) > 1
    if several:
        ref_packs = _stored(ref_packs, "knn-packs")
    block = (values_of_block if values else rows_of_block)(k)
    best = Window.partitionBy("_qid", "_j").orderBy("_dist", tie)
    homes = _stored(queries.select("_qid", "_vec").mapInPandas(_homes(cells, group), "_id long, _vec array<double>, _cell int"), "knn-homes")
    asked = homes.groupBy("_cell").agg(F.count("*").alias("n"))

    def searched(rows: DataFrame, second: bool) -> DataFrame:
        """``rows``: queries with their home and, as ``_y``, ``tau``."""
        asking = _stored(packs(rows, asked, size).mapInPandas(_visits(cells, group, at, k, values, second), _ASKING), "knn-visits")
        if counted is not None:
            counted.setdefault("pairs", []).append(int(asking.agg(F.sum("_pairs")).first()[0] or 0))
        return ref_packs.join(asking, "_cell").select("q_ids", "q_rows", "q_taus", "q_mask", "_ids", "_rows", "_ys", "_ats").mapInPandas(_compared(block), CANDIDATES)

    found = searched(homes.withColumn("_y", F.lit(float("inf"))), False)
    if several:
        found = _stored(found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank"), "knn-first")
        each = found.groupBy("_qid", "_j").agg(F.count("*").alias("n"), F.max("_dist").alias("tau"))
        tau = each.groupBy(F.col("_qid").alias("_id")).agg(F.sum((F.col("n") >= k).cast("int")).alias("full"), F.max("tau").alias("tau"))
        # a NaN of a list that went through pandas is null
        due = F.size(F.filter("_vec", lambda x: x.isNull() | F.isnan(x))) if values else F.lit(1)
        again = homes.join(tau, "_id", "left").select(
            "_id", "_vec", "_cell", F.when(F.col("full") == due, F.col("tau")).otherwise(F.lit(float("inf"))).alias("_y"))
        found = found.unionByName(searched(again, True))
    return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
