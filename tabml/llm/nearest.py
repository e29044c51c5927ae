"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

*Index.*  Vectors are split into bands, each of norms down to half its largest, and queries are scaled to norm 1.
In a band, largest inner product becomes smallest distance by one dimension more (what a vector's norm
lacks to the band's largest one).  Centroids of every band are fitted on a bounded sample; every vector is
assigned to a list of its band.  Scaling goes by powers of two, so norms of any size neither overflow nor round.  Vectors are turned by a random rotation, so that any first dimensions are a fair sample.

*Search.*  A query probes its nearest lists of every band.  Candidates are scanned in column blocks: after each block
the partial distance, scaled to all dimensions, is tested against the query's current k-th best, and a
candidate is abandoned if it is farther by more than ``1 + EPSILON / sqrt(d)`` allows.  Those that
reach the last block no farther than the k-th best, or tied with it within float error (``SLACK``), are scored in
double precision on the original vectors and compete for the k best by score and id.

Equal vectors are one candidate, which stands for its smallest ids (as many as any query can get).

The number of probed lists is measured for each band when the index is fitted: the smallest that finds ``TARGET``
of the true neighbours of sample queries in the sample, by brute force in double precision (data without
clusters probes nearly all lists).

Lists are dealt to groups of about ``GROUP_ROWS`` vectors; lists above that, and queries above
``GROUP_QUERIES`` in a group, are split by hash, so a task holds bounded blocks.  A query meets each
group once and gets at most k rows from it.  The index model (centroids and rotation) is a
bounded broadcast.

Defined cases: vectors that are null, empty, zero, of another length than most (ties: the longer), or hold null or
non-finite components take no part; rows of equal id are each a candidate, but none of a query of
that id, and one query (the smallest vector); ties go to the smaller id; with fewer than k
candidates all are returned, and queries probe on until their lists hold k others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .frames import ready, stored

#: Bounded sample of the index fit, and its queries for measuring recall.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
TARGET = 0.975
EPSILON = 2.1
#: Distances (of vectors of norm 1) that float32 may not tell apart.
SLACK = 1e-5
#: Columns of the blocks after the first, which has twice as many.
BLOCK = 8
GROUP_ROWS, GROUP_QUERIES = 8_192, 4_096
ITERATIONS = 10


def participants(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, v) of the rows that take part, vectors as double arrays."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"), v.alias("v")).where(
        F.col("vec").isNotNull() & F.col("v").isNotNull())
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(ids, v): every vector once, with so many of its smallest ids that any query finds ``k`` that
    are not its own: ``k + 1`` ids, each at most ``k`` times."""
    counted = rows.groupBy("v", "vec").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    # the ranking is cut before the shuffle, so a large group of copies does not meet in one task
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec"))
    few = counted.withColumn("place", place).where(F.col("place") <= k + 1)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec", "n"))), lambda x: F.array_repeat(x["vec"], x["n"])))
    return few.groupBy("v").agg(ids.alias("ids")).select("ids", "v")


def log_norms(v: np.ndarray) -> np.ndarray:
    """Binary logarithms of the norms."""
    e = np.frexp(np.abs(v).max(1))[1]
    x = np.ldexp(v, -e[:, None])
    return e + 0.5 * np.log2((x * x).sum(1))


class Index:
    """Centroids and numbers of probed lists of every band of norms, and the rotation.  ``top``: binary logarithm of the
    largest norm; ``rows``: vectors in each band that has any (band b: norms from 2 ** (top - b) down)."""

    def __init__(self, sample: np.ndarray, rows: dict[int, int], top: float, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.top, self.exponent = top, math.ceil(top)
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x, band = self.lifted(sample), self.bands(sample)
        centroids, self.first, at = [], {}, 0
        for b in sorted(rows):
            y = x[band == b]
            lists = max(1, min(4096, round(math.sqrt(rows[b]) / 4), len(y) // 8))
            self.first[b] = (at, at + lists)
            at += lists
            c = y[rng.choice(len(y), lists, replace=False)] if len(y) else np.zeros((1, d), np.float32)
            for _ in range(ITERATIONS if lists > 1 else 0):
                own = self.distances(y, c).argmin(1)
                for one in range(lists):
                    if (own == one).any():
                        c[one] = y[own == one].mean(0)
            centroids.append(c)
        self.centroids = np.concatenate(centroids)
        #: of every list
        self.band, self.probes = (np.zeros(at, np.int64) for _ in range(2))
        for b, (i, j) in self.first.items():
            self.band[i:j], self.probes[i:j] = b, j - i
        if len(x) > 2 * k and at > len(rows):
            own = self.lists(sample)
            q, _ = self.scaled(sample[:SAMPLE_QUERIES])
            near = np.argpartition(-(q @ self.shrunk(sample).T), k, axis=1)[:, :k + 1]
            needed = np.take_along_axis(self.places(self.lifted(sample[:SAMPLE_QUERIES], query=True)), own[near], 1) + 1
            for b, (i, j) in self.first.items():
                some = np.sort(needed[self.band[own[near]] == b])
                self.probes[i:j] = some[min(len(some) - 1, math.ceil(TARGET * len(some)))] if len(some) else 1

    def bands(self, v: np.ndarray) -> np.ndarray:
        return np.floor(np.maximum(self.top - log_norms(v), 0)).astype(np.int64)

    @staticmethod
    def scaled(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries of components up to 1, and the exponents taken from them."""
        e = np.frexp(np.abs(queries).max(1, initial=0))[1]
        return np.ldexp(queries, -e[:, None]), e

    def shrunk(self, v: np.ndarray) -> np.ndarray:
        """Vectors by the scale of the largest norm."""
        return np.ldexp(v, -self.exponent)

    def lifted(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors by their band's largest norm with the dimension that makes norms equal, or queries of norm 1 with 0
        there; rotated."""
        if query:
            x, _ = self.scaled(v)
            x = x / np.sqrt((x * x).sum(1))[:, None]
            extra = np.zeros(len(v))
        else:
            x = np.ldexp(v, (self.bands(v) - self.exponent)[:, None]) / 2.0 ** (self.top - self.exponent)
            extra = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.concatenate([x, extra[:, None]], 1).astype(np.float32) @ self.turn

    def lists(self, v: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        x, band, out = self.lifted(v), self.bands(v), np.zeros(len(v), np.int64)
        for b in np.unique(band):
            i, j = self.first[int(b)]
            of = band == b
            out[of] = i + self.distances(x[of], self.centroids[i:j]).argmin(1)
        return out

    def places(self, q: np.ndarray) -> np.ndarray:
        """How many lists of its band are nearer to each query than each list."""
        out = np.zeros((len(q), len(self.centroids)), np.int64)
        for i, j in self.first.values():
            order = np.argsort(self.distances(q, self.centroids[i:j]), axis=1, kind="stable")
            np.put_along_axis(out[:, i:j], order, np.arange(j - i)[None, :].repeat(len(q), 0), 1)
        return out

    def limits(self, score: np.ndarray, queries: np.ndarray, band: int) -> np.ndarray:
        """Distances at which candidates of a band have these (scaled) scores."""
        with np.errstate(over="ignore"):
            return 2 - 2 * np.ldexp(score, band) / (np.sqrt((queries * queries).sum(1)) * 2.0 ** (self.top - self.exponent))

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)

    @staticmethod
    def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        out = np.empty(len(queries))
        for i in range(0, len(out), 1 << 14):
            out[i:i + (1 << 14)] = np.einsum("ij,ij->i", queries[i:i + (1 << 14)], candidates[i:i + (1 << 14)])
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, k: int) -> tuple[Index, int]:
    """The index of ``rows`` (ids, v), and their number."""
    def highest(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([log_norms(_matrix(batch.column(0))).max()]), pa.array([batch.num_rows])], ["top", "n"])

    top, count = rows.select("v").mapInArrow(highest, "top double, n long").agg(F.max("top"), F.sum("n")).first()
    if not count:
        return None, 0

    def banded(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.maximum(top - log_norms(_matrix(batch.column(0))), 0)).astype(np.int64))], ["band"])

    # one row per band: powers of two between the norms, of which there are few
    sizes = {r["band"]: r["count"] for r in rows.select("v").mapInArrow(banded, "band long").groupBy("band").count().collect()}
    rate = min(1.0, 1.5 * SAMPLE / count)
    order = F.xxhash64("v", F.lit("sample"))
    drawn = rows.where(F.pmod(order, F.lit(1 << 32)) <= F.lit(rate * (1 << 32))).select("v", order.alias("hash")).orderBy("hash", "v").limit(SAMPLE)

    def work(batches):
        parts = [(_matrix(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        v, hashes = (np.concatenate(x) for x in zip(*parts))
        rng = np.random.default_rng(3)
        v = v[np.lexsort((*v.T[::-1], hashes))][rng.permutation(len(v))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Index(v, sizes, top, k))])], ["model"])

    model = drawn.repartition(1).mapInArrow(work, "model binary").first().model
    return pickle.loads(model), count


def scan(index: Index, candidates: np.ndarray, lists: np.ndarray, ids: np.ndarray, sole: np.ndarray, queries: np.ndarray, own: np.ndarray, probed: np.ndarray, bands: np.ndarray, k: int):
    """(query row, candidate row, scaled score) of the k nearest of each query among the candidates of its probed
    lists (``probed``: queries x lists, the group's lists numbered as ``lists`` is; ``bands``: theirs).  ``ids``: the two smallest
    different ids of each candidate; ``sole``: it has the first one only."""
    c, q = index.lifted(candidates), index.lifted(queries, query=True)
    candidates, (queries, _) = index.shrunk(candidates), index.scaled(queries)
    d = c.shape[1]
    cuts = [0, *range(min(2 * BLOCK, d), d, BLOCK), d]
    best = np.full((len(q), k), -np.inf)
    name = np.full((len(q), k), np.iinfo(np.int64).max)
    at = np.full((len(q), k), -1, np.int64)
    order = np.argsort(lists, kind="stable")
    edges = np.searchsorted(lists[order], np.arange(probed.shape[1] + 1))
    for one in range(probed.shape[1]):
        members = order[edges[one]:edges[one + 1]]
        askers = np.flatnonzero(probed[:, one])
        for i in range(0, len(members), 1024):
            rows = members[i:i + 1024]
            for j in range(0, len(askers), 256):
                who = askers[j:j + 256]
                x, y = q[who], c[rows]
                limit = index.limits(best[who, -1], queries[who], int(bands[one])).astype(np.float32)
                partial = np.zeros((len(who), len(rows)), np.float32)
                pairs = None
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if pairs is None:  # most are alive: whole blocks
                        partial += index.distances(x[:, a:z], y[:, a:z])
                    else:
                        partial[pairs] += ((x[pairs[0], a:z] - y[pairs[1], a:z]) ** 2).sum(1)
                    if z < d:
                        bound = np.maximum(limit, 0) * np.float32((1 + EPSILON / math.sqrt(z)) ** 2 * z / d) + np.float32(SLACK)
                        if pairs is None:
                            dead = partial > bound[:, None]
                            partial[dead] = np.inf
                            if dead.mean() > 0.75:
                                pairs = np.nonzero(~dead)
                        else:
                            dead = partial[pairs] > bound[pairs[0]]
                            partial[pairs[0][dead], pairs[1][dead]] = np.inf
                            pairs = tuple(p[~dead] for p in pairs)
                partial[(own[who][:, None] == ids[rows, 0][None, :]) & sole[rows][None, :]] = np.inf
                if len(rows) > k:  # of these no more than the k nearest and their ties can count
                    limit = np.minimum(limit, np.partition(partial, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero(partial <= (limit + np.float32(SLACK))[:, None])
                alive = np.isfinite(partial[a, b])
                a, b = a[alive], rows[b[alive]]
                score = index.scores(queries[who[a]], candidates[b])
                smallest = np.where(ids[b, 0] == own[who[a]], ids[b, 1], ids[b, 0])
                better = (score > best[who[a], -1]) | ((score == best[who[a], -1]) & (smallest < name[who[a], -1]))
                a, b, score, smallest = a[better], b[better], score[better], smallest[better]
                # merged with those kept so far: by score, then id
                asks = np.concatenate([np.repeat(np.arange(len(who)), k), a])
                score = np.concatenate([best[who].ravel(), score])
                smallest = np.concatenate([name[who].ravel(), smallest])
                b = np.concatenate([at[who].ravel(), b])
                sort = np.lexsort((b < 0, smallest, -score, asks))
                asks = asks[sort]
                first = sort[np.arange(len(asks)) - np.searchsorted(asks, asks) < k].reshape(len(who), k)
                best[who], name[who], at[who] = score[first], smallest[first], b[first]
    found = at >= 0
    return np.nonzero(found)[0], at[found], best[found]


#: ``key`` orders the scores of a query, also where ``score`` overflows.
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("key", T.DoubleType())])


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row that meets ``is_query`` (a condition on ``vec``) its ``k`` nearest others:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ready(spark)
    rows = participants(vectors, id_col, vector_col)
    nodes = stored(distinct(rows, k), "ann-vectors")
    index, count = fit(nodes, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                lists = shared.value.lists(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32))], ["ids", "v", "list"])

    listed = stored(nodes.mapInArrow(assign, "ids array<long>, v array<double>, list int"), "ann-lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row per list: bounded by the index
        sizes[r["list"]] = r["count"]
    # lists are dealt to groups, the largest first to the emptiest; a list above the size of a group is cut
    groups = max(1, math.ceil(count / GROUP_ROWS), min(len(sizes), 2 * spark.sparkContext.defaultParallelism))
    load, group_of = np.zeros(groups), np.zeros(len(sizes), np.int64)
    for one in np.argsort(-sizes, kind="stable"):
        group_of[one] = load.argmin()
        load[group_of[one]] += sizes[one]
    cuts = np.maximum(1, np.ceil(np.bincount(group_of, sizes, groups) / (2 * GROUP_ROWS))).astype(np.int64)

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            place = shared.value.places(shared.value.lifted(_matrix(batch.column(1)), query=True))
            member = place < shared.value.probes
            order = np.argsort(np.where(member, -1, place), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            np.put_along_axis(member, order, np.take_along_axis(member, order, 1) | (before <= k), 1)
            row, chosen = np.nonzero(member)
            key = np.unique(row * groups + group_of[chosen])
            row_of, group = key // groups, key % groups
            lists = [np.flatnonzero(member[r] & (group_of == g)).tolist() for r, g in zip(row_of, group)]
            picked = batch.take(pa.array(row_of))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(group.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))],
                                             ["vec", "v", "grp", "lists"])

    chosen = rows.where(is_query).groupBy("vec").agg(F.min("v").alias("v"))
    asked = stored(chosen.mapInArrow(probe, "vec long, v array<double>, grp int, lists array<int>"), "ann-queries")
    crowd = {r["grp"]: r["count"] for r in asked.groupBy("grp").count().collect()}
    asks = [max(1, math.ceil(crowd.get(g, 0) / GROUP_QUERIES)) for g in range(groups)]
    grp = F.element_at(F.array(*[F.lit(int(g)) for g in group_of]), F.col("list") + 1)
    n_cut = F.array(*[F.lit(int(c)) for c in cuts])
    n_ask = F.array(*[F.lit(a) for a in asks])
    whole = listed.withColumn("grp", grp)
    left = (whole.withColumn("cut", F.pmod(F.xxhash64("v"), F.element_at(n_cut, F.col("grp") + 1)).cast("int"))
            .withColumn("ask", F.explode(F.sequence(F.lit(0), F.element_at(n_ask, F.col("grp") + 1) - 1))))
    right = (asked.withColumn("ask", F.pmod(F.xxhash64("vec", F.lit("ask")), F.element_at(n_ask, F.col("grp") + 1)).cast("int"))
             .withColumn("cut", F.explode(F.sequence(F.lit(0), F.element_at(n_cut, F.col("grp") + 1) - 1))))

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "key": pa.array([], pa.float64())})
        names = c["ids"].combine_chunks()
        flat, starts = names.flatten().to_numpy(), np.concatenate([[0], np.cumsum(names.value_lengths().to_numpy())])
        own = q["vec"].to_numpy()
        v, w = _matrix(c["v"].combine_chunks()), _matrix(q["v"].combine_chunks())
        # ids are sorted: the first other one follows the copies of the smallest
        other = np.maximum.reduceat(flat, starts[:-1])
        sole = flat[starts[:-1]] == other
        follows = np.where(flat > np.repeat(flat[starts[:-1]], np.diff(starts)), flat, np.iinfo(np.int64).max)
        ids = np.stack([flat[starts[:-1]], np.where(sole, other, np.minimum.reduceat(follows, starts[:-1]))], 1)
        held, lists = np.unique(c["list"].to_numpy(), return_inverse=True)
        lookup = {int(n): i for i, n in enumerate(held)}
        probed = np.zeros((len(own), len(held)), bool)
        for r, some in enumerate(q["lists"].to_pylist()):
            probed[r, [lookup[x] for x in some if x in lookup]] = True
        a, b, score = scan(shared.value, v, lists, ids, sole, w, own, probed, shared.value.band[held], k)
        # every candidate found is as many rows as it has ids
        size = np.diff(starts)[b]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[b], size)
        a, score, vec = np.repeat(a, size), np.repeat(score, size), flat[place]
        others = vec != own[a]
        a, score, vec = a[others], score[others], vec[others]
        order = np.lexsort((vec, -score, a))
        a, score, vec = a[order], score[order], vec[order]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, score, vec = a[kept], score[kept], vec[kept]
        with np.errstate(over="ignore"):
            whole = np.ldexp(score, shared.value.scaled(w)[1][a] + shared.value.exponent)
        return pa.table({"query_id": own[a], "vec_id": vec, "score": whole, "key": score})

    met = left.groupBy("grp", "cut", "ask").cogroup(right.groupBy("grp", "cut", "ask")).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract columns: every 20th vector's 20 nearest."""
    return search(embeddings.select("vec_id", "embedding"), F.col("vec") % 20 == 0)
