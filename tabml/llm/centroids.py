"""Exact integer k-means with an n-simplex projection in front of the comparisons.

Vectors become integers floor(64 x).  A few of the first centroids serve as pivots: their pairwise distances fix a
simplex, and a vector's cached distances to them place it as that simplex's apex (coordinates in the pivots'
span and the altitude above it).  For a vector and a centroid the distance of the two apexes on the same side is a
lower bound of their true distance and that of the apexes on opposite sides an upper bound.  Every round computes
these bounds from the stored apexes, drops the centroids whose lower bound exceeds the least upper bound, and
compares what is left by exact squared distances of integers (ties: the smaller number).  Floating point only filters, with a
margin well above its error; assignments, sums and the floored means are integers throughout.

Scale: vectors and apexes are written once and read once a round; a task returns sums of its vectors per centroid and
component, split in 32-bit limbs so that partial sums of any size add up exactly in Spark.  Nothing is dealt by
vector or cluster, so a hot vector or cluster is spread over all tasks.  The driver holds the centroids only (at most
16 vectors), and tasks get them with the code.

Defined cases: a vector takes part if it has exactly 64 components, none null or non-finite; a null id takes part
and comes last among the first centroids; repeated rows are separate vectors, rows of one id are ordered by their
components; fewer vectors than 16 give fewer centroids; empty centroids stay; components of more than 2^26 are compared
as Python integers without a filter, and sums of distances that exceed a long (as such a distance does) are null; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ready, settled, stored

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Pivots at most: apexes have so many coordinates.
PIVOTS = 10
#: A candidate pivot is left out if its altitude over the simplex so far is less than this part of the largest distance.
FLAT = 1e-3
#: Bounds are off by less than this part of the distances involved (64-bit floats; altitudes near 0 lose half the digits).
MARGIN = 1e-5
#: Components of this magnitude or more are worked on as Python integers.
LARGE = 1 << 26
LONG = (1 << 63) - 1
#: Vectors worked on together.
BLOCK = 4096


def kept(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows that take part."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(v) == SIZE) & F.coalesce(fine, F.lit(False)))


def whole(x) -> int:
    """floor(64 x), exact for every finite double."""
    top, bottom = float(x).as_integer_ratio()
    return SCALE * top // bottom


def integers(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole components (zeros for large ones), and which rows are large."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), SIZE)
    with np.errstate(over="ignore"):
        q = np.floor(flat * SCALE)
    large = ~(np.abs(q) < LARGE).all(axis=1)
    q[large] = 0
    return q.astype(np.int64), large


@dataclass
class Simplex:
    """Pivots (rows of integers) and the inverse of the Cholesky factor of their Gram matrix from the first on."""

    pivots: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, candidates: np.ndarray, most: int = PIVOTS) -> "Simplex":
        """Choose pivots: the first candidate, then always the one of the largest altitude over those chosen."""
        chosen, rest = [0], list(range(1, len(candidates)))
        while rest and len(chosen) < most:
            simplex = cls._built(candidates[chosen])
            _, height = simplex.apexes(simplex.distances(candidates[rest]))
            far = int(np.argmax(height))
            if height[far] <= FLAT * np.sqrt(float(max(1, simplex.distances(candidates[rest]).max()))):
                break
            chosen.append(rest.pop(far))
        return cls._built(candidates[chosen])

    @classmethod
    def _built(cls, pivots: np.ndarray) -> "Simplex":
        edges = (pivots[1:] - pivots[0]).astype(np.float64)
        gram = edges @ edges.T
        return cls(pivots, np.linalg.inv(np.linalg.cholesky(gram)) if len(edges) else np.zeros((0, 0)))

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows to the pivots."""
        return np.stack([np.einsum("ij,ij->i", q - p, q - p) for p in self.pivots], axis=1)

    def apexes(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the pivots' span, and altitude, of points with these squared distances."""
        ends = np.einsum("ij,ij->i", self.pivots - self.pivots[0], self.pivots - self.pivots[0])[1:]
        inner = (d2[:, :1] + ends - d2[:, 1:]) / 2.0
        base = inner @ self.inverse.T
        return base, np.sqrt(np.maximum(0.0, d2[:, 0] - np.einsum("ij,ij->i", base, base)))


def candidates(base: np.ndarray, height: np.ndarray, first: np.ndarray, other: tuple) -> np.ndarray:
    """Which centroids may be nearest: rows x centroids.  ``first``: distances of the rows to the first pivot."""
    c_base, c_height, c_first = other
    flat = ((base[:, None, :] - c_base) ** 2).sum(axis=2)
    low = np.sqrt(flat + (height[:, None] - c_height) ** 2)
    high = np.sqrt(flat + (height[:, None] + c_height) ** 2)
    margin = MARGIN * (first[:, None] + c_first + 1.0)
    return low - margin <= (high + margin).min(axis=1, keepdims=True)


def nearest(q: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid among those that may be; ties: the smaller number."""
    row, number = np.nonzero(may)
    apart = q[row] - centroids[number]
    d2 = np.einsum("ij,ij->i", apart, apart)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(d2, starts)
    hit = np.flatnonzero(d2 == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    _, at = np.unique(row[hit], return_index=True)
    return number[hit[at]], least


class Assigner:
    """Nearest centroids of batches of stored rows (vector, base, height, first)."""

    def __init__(self, simplex: Simplex | None, centroids: list):
        self.exact = centroids
        self.large = [j for j, c in enumerate(centroids) if any(abs(x) >= LARGE for x in c)]
        self.small = np.array([j for j in range(len(centroids)) if j not in self.large], np.int64)
        self.plain = np.array([centroids[j] for j in self.small], np.int64).reshape(-1, SIZE)
        self.other = None
        if simplex is not None and len(self.small):
            d2 = simplex.distances(self.plain)
            self.other = (*simplex.apexes(d2), np.sqrt(d2[:, 0].astype(np.float64)))

    def __call__(self, vectors, base, height, first):
        """Of each row its centroid, its squared distance (Python integers) and its whole components; large rows, which
        have zeros there, come as a dict besides."""
        q, is_large = integers(vectors)
        number, d2 = np.full(len(q), -1, np.int64), np.empty(len(q), object)
        plain = np.flatnonzero(~is_large)
        for i in range(0, len(plain) if len(self.small) else 0, BLOCK):
            at = plain[i:i + BLOCK]
            may = np.ones((len(at), len(self.small)), bool) if self.other is None else candidates(base[at], height[at], first[at], self.other)
            found, d2[at] = nearest(q[at], may, self.plain)
            number[at] = self.small[found]
        exact = {int(i): [whole(x) for x in vectors[int(i)].as_py()] for i in np.flatnonzero(is_large)}
        for i in range(len(q)) if self.large else exact:
            v = exact.get(i) or q[i].tolist()
            rest = self.large if i not in exact else range(len(self.exact))
            best = [(int(d2[i]), int(number[i]))] if number[i] >= 0 else []
            d2[i], number[i] = min(best + [(sum((a - b) ** 2 for a, b in zip(v, self.exact[j])), j) for j in rest])
        return number, d2, q, exact


def _apex_columns(batch, places=("base", "height", "first")):
    width = len(batch.column("base")[0].as_py()) if len(batch) else 0
    base = np.asarray(batch.column("base").flatten(), np.float64).reshape(len(batch), width)
    return base, np.asarray(batch.column("height")), np.asarray(batch.column("first"))


def _projected(simplex: Simplex | None, schema: pa.Schema):
    """Batches (id, vector) with apexes; rows of large components get zeros."""
    def work(batches):
        for batch in batches:
            q, large = integers(batch.column("vector"))
            if simplex is None:
                base, height, first = np.zeros((len(q), 0)), np.zeros(len(q)), np.zeros(len(q))
            else:
                d2 = simplex.distances(q)
                base, height = simplex.apexes(d2)
                first = np.sqrt(d2[:, 0].astype(np.float64))
            offsets = np.arange(len(q) + 1, dtype=np.int32) * base.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.ListArray.from_arrays(offsets, base.ravel()),
                                              pa.array(height), pa.array(first)], schema=schema)
    return settled(work)


def _limbs(value: int, n: int) -> list[int]:
    """``value`` in base 2^32; all limbs but the last are not negative."""
    out = []
    for _ in range(n - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _summed(assign: Assigner, n_limbs: int):
    """Per task: the sum of each centroid's vectors by component, in limbs; component -1 has their number."""
    names = ["cluster", "component", *[f"l{i}" for i in range(n_limbs)]]

    def work(batches):
        k = len(assign.exact)
        total, count = [[0] * SIZE for _ in range(k)], [0] * k
        for batch in batches:
            number, _, q, exact = assign(batch.column("vector"), *_apex_columns(batch))
            for j in range(k):
                mine = number == j
                count[j] += int(mine.sum())
                part = q[mine].sum(axis=0)  # fewer than 2^36 rows of less than 2^26
                total[j] = [a + int(b) for a, b in zip(total[j], part)]
            for i, v in exact.items():
                j = int(number[i])
                total[j] = [a + b for a, b in zip(total[j], v)]
        rows = [[j, m, *_limbs(x, n_limbs)] for j in range(k) if count[j] for m, x in enumerate([count[j], *total[j]], -1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)
    return settled(work)


def _assigned(assign: Assigner):
    def work(batches):
        for batch in batches:
            number, d2, _, _ = assign(batch.column("vector"), *_apex_columns(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(number.astype(np.int32)), pa.array([int(x) if x <= LONG else None for x in d2], pa.int64())],
                names=["id", "cluster", "distance"])
    return settled(work)


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> list:
    """The ``clusters`` vectors of ``rows`` (id, vector) whose ids' digests are smallest, as integers."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    best = rows.select(order.alias("order"), "vector").orderBy(F.col("order").asc_nulls_last(), "vector").limit(clusters).collect()
    return [[whole(x) for x in r.vector] for r in best]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    ready(spark)
    rows = kept(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    centroids = first_centroids(rows, clusters)
    plain = np.array([c for c in centroids if all(abs(x) < LARGE for x in c)], np.int64).reshape(-1, SIZE)
    simplex = Simplex.of(plain) if len(plain) else None
    schema = T.StructType([*rows.schema.fields, T.StructField("base", T.ArrayType(T.DoubleType())), T.StructField("height", T.DoubleType()),
                           T.StructField("first", T.DoubleType())])
    apexes = stored(rows.mapInArrow(_projected(simplex, to_arrow_schema(schema)), schema), "centroid-apexes")
    n_limbs = 6 if rows.schema["vector"].dataType.elementType == T.FloatType() else 36
    sums = T.StructType([T.StructField(c, T.LongType()) for c in ("cluster", "component", *[f"l{i}" for i in range(n_limbs)])])
    for _ in range(rounds if centroids else 0):
        found = apexes.mapInArrow(_summed(Assigner(simplex, centroids), n_limbs), sums).groupBy("cluster", "component").agg(
            *[F.sum(f"l{i}").alias(f"l{i}") for i in range(n_limbs)]).collect()
        value = {(r.cluster, r.component): sum(r[f"l{i}"] << (32 * i) for i in range(n_limbs)) for r in found}
        centroids = [[value[j, m] // value[j, -1] for m in range(SIZE)] if (j, -1) in value else c for j, c in enumerate(centroids)]
    out = T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return spark.createDataFrame([], out), centroids
    return apexes.mapInArrow(_assigned(Assigner(simplex, centroids)), out), centroids


def _total(rows: list) -> int | None:
    """The sum of all distances in ``rows`` as a long; null if any of them or the sum is beyond one."""
    total = sum(int(r.total or 0) for r in rows)
    return total if total <= LONG and all(r.n == r.known for r in rows) else None


def digest(vectors: DataFrame) -> DataFrame:
    """The per-vector contract columns."""
    found, centroids = cluster(vectors.select("vec_id", "embedding"))
    found = stored(found, "centroid-clusters")
    each = found.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("known"),
                                        F.sum(F.col("distance").cast("decimal(28,0)")).alias("total")).collect()  # 16 rows
    sums = [(r.cluster, _total([r]), _total(each), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in each]
    sums = vectors.sparkSession.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
