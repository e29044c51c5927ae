"""Boosted trees from sums of gradients and Hessians.

Rows are cut into bins once (at most 256 a feature; a feature with fewer values keeps them all) and stored as blocks.  A
pass sums gradient, Hessian and rows per (class, node, feature, bin) in every task, over the bins that a feature has; the sums
meet by (class, node, run of features) in one shuffle, where the best cut is found.  A model takes hundreds of passes over the same
stored blocks, so a pass is a job of two stages without a plan of its own:

    gain = GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)        leaf = -rate * G / (H + l2)

The driver holds trees only.  Sums are added in the order of tasks, so a recomputed task changes nothing.  A table that is one
task's share (``TASK_ROWS``) goes through the same passes inside that task.

* Growth by *levels* ("XGBoost") splits every node down to ``maxDepth``.
* Growth by *leaves* ("LightGBM") splits the leaf of greatest gain until there are ``maxLeaves``; depth is unlimited for
  ``maxDepth`` 0.  A pass also looks below the leaves that may be split next, so a tree takes about as many
  passes as it has levels; the tree is the one that splitting leaf by leaf gives.
* Three and more classes are one softmax model: the trees of all classes grow in the same passes.

Missing values (NaN) go right.  Ties: greater gain, then the smaller feature, then the smaller cut; among leaves the path (L
before R).  Labels of a classifier are 0 to n - 1.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import DataError
from ..session import shared_dir

#: Bins of a feature at most (they are bytes).
MAX_BINS = 256
#: Rows that a task should have, and bytes of bins in a block.
TASK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 20
#: Rows that a task of a pass has at least, as far as there are partitions.
PASS_ROWS = 1 << 13
#: Bytes of the sums that a task holds in a pass; more nodes than fit are looked at in further passes.
PASS_BYTES = 64 << 20
#: Bins of features whose sums travel together, and bytes of sums that a task merges before there are more of them.
RUN_BINS, MERGE_BYTES = 1 << 15, 4 << 20
#: Rounds after which the margins are written, so that a pass walks few earlier trees.
STORE_EVERY = 5
#: A split needs more gain than this.
MIN_GAIN = 1e-6

_BLOCK = "bins binary, label binary, margin binary"


def _p(name, doc, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


# ---------------------------------------------------------------- bins

def bin_cuts(df: DataFrame, features_col: str, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the ascending cuts; bin b holds the x with cut[b-1] < x <= cut[b].  All values but the greatest where there
    are at most ``max_bins``, else quantiles."""
    arr = df.select(vector_to_array(features_col).alias("x"))

    def merge(seen, j, new):
        held = seen.get(j, np.zeros(0))
        if len(held) <= max_bins:
            seen[j] = np.unique(np.concatenate([held, new[~np.isnan(new)]]))[:max_bins + 1]

    def rows(seen):
        return pd.DataFrame({"j": np.array(list(seen), np.int32), "v": [v.tobytes() for v in seen.values()]})

    def few(batches):
        seen: dict = {}
        for batch in batches:
            X = _matrix(batch["x"]) if len(batch) else np.zeros((0, 0))
            for j in range(X.shape[1]):
                merge(seen, j, X[:, j])
        yield pa.RecordBatch.from_pandas(rows(seen), schema=pa.schema([("j", pa.int32()), ("v", pa.binary())]), preserve_index=False)

    def met(batches):
        seen: dict = {}
        for pdf in batches:
            for j, v in zip(pdf["j"], pdf["v"]):
                merge(seen, j, np.frombuffer(v))
        yield rows(seen)

    schema = "j int, v binary"
    # a task has at most max_bins + 1 values of a feature; one more than max_bins tells that there are too many
    found = {r["j"]: np.frombuffer(r["v"]) for r in arr.mapInArrow(few, schema).repartition("j").mapInPandas(met, schema).collect()}
    small = {j: v[:-1] for j, v in found.items() if len(v) <= max_bins}
    wide = sorted(set(found) - set(small))
    if wide:
        at = [i / max_bins for i in range(1, max_bins)]
        long = arr.select(F.posexplode("x").alias("j", "v")).where(F.col("j").isin(wide) & ~F.isnan("v"))
        for r in long.groupBy("j").agg(F.percentile_approx("v", at, 100 * max_bins).alias("q")).collect():
            small[r["j"]] = np.unique(np.array(r["q"], float))
    return [small[j] for j in range(len(small))]


def _gradients(task: str, y: np.ndarray, m: np.ndarray, factor: float):
    """Gradient and Hessian of every row and class."""
    if task == "regression":
        return m - y[:, None], np.ones_like(m)
    if m.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(m - m.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(m.shape[1])), np.maximum(factor * p * (1 - p), 1e-16)


# --------------------------------------------------------------- trees

class Tree:
    """A growing tree: arrays by node; ``cut`` is a bin while it grows."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.depth, self.path = [-1], [0], [0], [0], [0], [""]
        self.split: dict = {}   # node -> its best split (``_Plan.best``), or None

    def open_up(self, node: int) -> list[int]:
        """Give a node with a known split its children."""
        s = self.split[node]
        self.feature[node], self.cut[node] = s["feature"], s["cut"]
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for side in "LR":
            self.feature.append(-1)
            for column in (self.cut, self.left, self.right):
                column.append(0)
            self.depth.append(self.depth[node] + 1)
            self.path.append(self.path[node] + side)
        return [self.left[node], self.right[node]]

    def best_first(self, leaves: float) -> tuple[list[int], list[int]]:
        """The nodes split so far, in order, and those to open before one can go on."""
        chosen, heap = [], []

        def offer(node):
            s = self.split.get(node)
            if s is not None:
                heapq.heappush(heap, (-s["gain"], self.path[node], node))
        offer(0)
        while heap and len(chosen) + 1 < leaves:
            node = heap[0][2]
            if self.feature[node] < 0:
                near = [(-s["gain"], self.path[i], i) for i, s in self.split.items() if s is not None and self.feature[i] < 0 and i != node]
                room = int(min(leaves - 2 - len(chosen), len(near)))
                return chosen, [node, *(i for _, _, i in heapq.nsmallest(room, near))]
            heapq.heappop(heap)
            chosen.append(node)
            offer(self.left[node])
            offer(self.right[node])
        return chosen, []

    def arrays(self):
        return tuple(np.array(c, np.int32) for c in (self.feature, self.cut, self.left, self.right))


def _walk(tree, X: np.ndarray) -> np.ndarray:
    """The node that every row ends in."""
    feature, cut, left, right = tree[:4]
    at, rows = np.zeros(len(X), np.int32), np.arange(len(X))
    while True:
        node = at[rows]
        inner = feature[node] >= 0
        if not inner.all():
            rows, node = rows[inner], node[inner]
        if not len(rows):
            return at
        at[rows] = np.where(X[rows, feature[node]] <= cut[node], left[node], right[node])


def _finished(tree: Tree, chosen: list[int], rate: float, l2: float, by_rows: bool) -> dict:
    """The tree of the chosen splits: the s-th split's children are nodes 2 s + 1 and 2 s + 2."""
    s0 = tree.split[0]
    sums = {0: (s0["g"], s0["h"], s0["n"])}
    number, size = {0: 0}, 2 * len(chosen) + 1
    out = {"feature": [-1] * size, "cut": [0] * size, "left": [0] * size, "right": [0] * size, "gain": [0.0] * size,
           "value": [0.0] * size, "cover": [0.0] * size}
    for step, node in enumerate(chosen):
        s, i = tree.split[node], number[node]
        out["feature"][i], out["cut"][i], out["gain"][i] = s["feature"], s["cut"], s["gain"]
        for child, at, part in ((tree.left[node], 2 * step + 1, (s["gl"], s["hl"], s["nl"])),
                                (tree.right[node], 2 * step + 2, (s["g"] - s["gl"], s["h"] - s["hl"], s["n"] - s["nl"]))):
            number[child], sums[child] = at, part
        out["left"][i], out["right"][i] = 2 * step + 1, 2 * step + 2
    for node, i in number.items():
        g, h, n = sums[node]
        out["value"][i] = -rate * g / (h + l2) if h + l2 > 0 else 0.0
        out["cover"][i] = n if by_rows else h
    return out


@dataclass(frozen=True)
class _Plan:
    """What a fit needs to know in tasks."""
    task: str
    classes: int      # margins of a row
    sizes: tuple      # bins of every feature
    factor: float     # of the Hessian of three and more classes
    l2: float
    min_h: float
    min_n: int
    rate: float
    deepest: float
    leaves: float
    rounds: int
    by_leaf: bool

    @property
    def features(self) -> int:
        return len(self.sizes)

    def runs(self) -> list[tuple[int, int]]:
        """Features (first, end) whose sums travel together."""
        ends, held = [0], 0
        for j, size in enumerate(self.sizes):
            if held and held + size > RUN_BINS:
                ends.append(j)
                held = 0
            held += size
        return list(zip(ends, [*ends[1:], len(self.sizes)]))

    def read(self, row, recent):
        """Bins, labels and margins of a block."""
        y = np.frombuffer(row.label)
        bins = np.frombuffer(row.bins, np.uint8).reshape(len(y), self.features)
        m = np.frombuffer(row.margin).reshape(len(y), self.classes).copy()
        for c, tree in recent:
            m[:, c] += tree[4][_walk(tree, bins)]
        return bins, y, m

    def moved(self, recent, batches):
        """Blocks whose margins hold the recent trees."""
        for pdf in batches:
            yield pdf.assign(margin=[self.read(row, recent)[2].tobytes() for row in pdf.itertuples(index=False)])

    def sums(self, growing, recent, wanted, batches):
        """(class, node, sums of shape 3 x bins of all features) of the wanted nodes over a task's blocks."""
        slots = []
        for c, shape in enumerate(growing):
            slot = np.full(len(shape[0]), -1, np.int64)
            mine = [node for cls, node in wanted if cls == c]
            slot[mine] = np.arange(len(mine))
            slots.append((slot, mine))
        total = [[np.zeros((3, len(mine), size)) for size in self.sizes] for _, mine in slots]
        for rows in batches:
            for row in rows:
                bins, y, m = self.read(row, recent)
                g, h = _gradients(self.task, y, m, self.factor)
                for c, (slot, mine) in enumerate(slots):
                    if not mine:
                        continue
                    s = slot[_walk(growing[c], bins)]
                    here = np.flatnonzero(s >= 0)
                    base, gc, hc, mat = s[here], g[here, c], h[here, c], bins[here].T
                    for j, size in enumerate(self.sizes):
                        at, sums = base * size + mat[j], total[c][j]
                        for i, w in enumerate((gc, hc, None)):
                            sums[i] += np.bincount(at, weights=w, minlength=len(mine) * size).reshape(sums[i].shape)
        for c, (_, mine) in enumerate(slots):
            for i, node in enumerate(mine):
                each = np.concatenate([sums[:, i] for sums in total[c]], axis=1)
                if each[2].any():
                    yield c, node, each

    def best(self, cls: int, node: int, first: int, end: int, sums: np.ndarray) -> dict:
        """The best cut of a node over the features from ``first`` to before ``end``, whose bins ``sums`` has; gain -inf without any."""
        sizes = np.array(self.sizes[first:end])
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        gl, hl, nl = left = np.concatenate([np.cumsum(sums[:, a - k:a], axis=1) for a, k in zip(ends, sizes)], axis=1)
        G, H, N = left[:, ends - 1][:, of]
        least = max(self.min_n, 1)
        ok = (nl >= least) & (N - nl >= least) & (hl >= self.min_h) & (H - hl >= self.min_h)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl ** 2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G ** 2 / (H + self.l2)
        gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
        i = int(np.argmax(gain))
        f = int(of[i])
        return {"cls": cls, "node": node, "feature": first + f, "cut": int(i - ends[f] + sizes[f]), "gain": float(gain[i]), "g": float(G[i]),
                "h": float(H[i]), "n": float(N[i]), "gl": float(gl[i]), "hl": float(hl[i]), "nl": float(nl[i])}


def _better(found: dict, s: dict) -> None:
    """Keep the greater gain; the smaller feature among equals."""
    at = (s["cls"], s["node"])
    if at not in found or (-s["gain"], s["feature"]) < (-found[at]["gain"], found[at]["feature"]):
        found[at] = s


def _boost(plan: _Plan, one_pass, stored, every: int):
    """All trees, one after the other.  ``one_pass(growing, recent, wanted)`` gives the best cuts of the wanted nodes;
    ``stored(recent)`` moves the margins on and is called after every ``every`` rounds."""
    recent: list = []
    for made in range(plan.rounds):
        growing = [Tree() for _ in range(plan.classes)]
        wanted, totals = [(c, 0) for c in range(plan.classes)], {}
        while wanted:
            for (c, node), s in one_pass([t.arrays() for t in growing], recent, wanted).items():
                if node == 0:
                    totals[c] = s
                growing[c].split[node] = s if s["gain"] > MIN_GAIN else None
            wanted = []
            for c, t in enumerate(growing):
                mine: list = []
                # children on the deepest level are leaves and need no look
                while not mine and (nodes := t.best_first(plan.leaves)[1]):
                    for node in nodes:
                        mine += [(c, child) for child in t.open_up(node) if t.depth[child] < plan.deepest]
                wanted += mine
        for c, t in enumerate(growing):
            chosen, _ = t.best_first(plan.leaves)
            t.split[0] = totals[c]
            tree = _finished(t, chosen, plan.rate, plan.l2, plan.by_leaf)
            recent.append((c, tuple(np.array(tree[x], np.int32) for x in ("feature", "cut", "left", "right")) + (np.array(tree["value"]),)))
            yield tree
        if (made + 1) % every == 0 and made + 1 < plan.rounds:
            stored(recent)
            recent = []


# ----------------------------------------------------------- estimator

class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    task = _p("task", "'regression' or 'classification'", TypeConverters.toString)
    nClasses = _p("nClasses", "number of classes", TypeConverters.toInt)
    growth = _p("growth", "'level' or 'leaf'", TypeConverters.toString)
    rounds = _p("rounds", "boosting rounds", TypeConverters.toInt)
    rate = _p("rate", "learning rate", TypeConverters.toFloat)
    maxDepth = _p("maxDepth", "deepest level; 0: no limit", TypeConverters.toInt)
    maxLeaves = _p("maxLeaves", "leaves of a tree; 0: no limit", TypeConverters.toInt)
    l2 = _p("l2", "penalty of leaf values", TypeConverters.toFloat)
    minHessian = _p("minHessian", "least Hessian sum of a child", TypeConverters.toFloat)
    minRows = _p("minRows", "least rows of a child", TypeConverters.toInt)
    maxBins = _p("maxBins", "bins of a feature", TypeConverters.toInt)


def _fit_in_passes(plan: _Plan, blocks: DataFrame) -> list[dict]:
    """One job a pass."""
    spark = blocks.sparkSession
    folder = shared_dir(spark, f"boosting-{uuid.uuid4().hex}")
    per_pass = max(1, PASS_BYTES // (sum(plan.sizes) * 24))
    runs, made = plan.runs(), 0
    starts = np.cumsum([0, *plan.sizes])

    def kept(frame: DataFrame) -> DataFrame:
        nonlocal made
        path, made = f"{folder}/{made}", made + 1
        frame.write.parquet(path)
        return spark.read.schema(_BLOCK).parquet(path).persist(StorageLevel.MEMORY_AND_DISK)

    blocks = kept(blocks)
    rows = blocks.rdd
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merged(parts):
        held: dict = {}
        for _, (key, part, sums) in parts:
            held.setdefault(key, []).append((part, sums))
        for (c, node, run), mine in held.items():
            first, end = runs[run]
            total = np.zeros((3, starts[end] - starts[first]))
            for _, sums in sorted(mine):
                total += np.frombuffer(sums).reshape(total.shape)
            yield plan.best(c, node, first, end, total)

    def one_pass(growing, recent, wanted):
        found: dict = {}
        for at in range(0, len(wanted), per_pass):
            some = wanted[at:at + per_pass]
            place = {key: i for i, key in enumerate(some)}

            def partial(part, blocks, some=some):
                for c, node, each in plan.sums(growing, recent, some, [blocks]):
                    for run, (first, end) in enumerate(runs):
                        yield place[c, node] * len(runs) + run, ((c, node, run), part, each[:, starts[first]:starts[end]].tobytes())
            size = 24 * int(starts[-1]) * len(some) * rows.getNumPartitions()
            sums = rows.mapPartitionsWithIndex(partial).partitionBy(min(most, len(some) * len(runs), -(-size // MERGE_BYTES)))
            for s in sums.mapPartitions(merged).collect():
                _better(found, s)
        return found

    def stored(recent):
        nonlocal blocks, rows
        held, late = blocks, list(recent)
        blocks = kept(held.mapInPandas(lambda batches: plan.moved(late, batches), _BLOCK))
        blocks.count()
        rows = blocks.rdd
        held.unpersist()

    done = list(_boost(plan, one_pass, stored, STORE_EVERY))
    blocks.unpersist()
    return done


def _fit_in_one_task(plan: _Plan, blocks: DataFrame) -> list[dict]:
    """The same passes inside the one task that has all rows of a table of ``TASK_ROWS`` at most: a job a pass would take
    hundreds of times as long as its work."""
    def whole(batches):
        held = list(batches)
        if not held:
            return

        def one_pass(growing, recent, wanted):
            blocks = (pdf.itertuples(index=False) for pdf in held)
            return {(c, node): plan.best(c, node, 0, plan.features, each) for c, node, each in plan.sums(growing, recent, wanted, blocks)}

        def stored(recent):
            held[:] = list(plan.moved(recent, held))
        yield pd.DataFrame([(i, json.dumps(t)) for i, t in enumerate(_boost(plan, one_pass, stored, 1))], columns=["i", "tree"])

    return [json.loads(r["tree"]) for r in sorted(blocks.mapInPandas(whole, "i int, tree string").collect())]


class HistogramBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Second-order boosting; see the module's text."""

    @keyword_only
    def __init__(self, task="regression", nClasses=2, growth="level", rounds=100, rate=0.3, maxDepth=6, maxLeaves=0, l2=1.0,
                 minHessian=1.0, minRows=1, maxBins=MAX_BINS, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(task="regression", nClasses=2, growth="level", rounds=100, rate=0.3, maxDepth=6, maxLeaves=0, l2=1.0,
                         minHessian=1.0, minRows=1, maxBins=MAX_BINS)
        self._set(**self._input_kwargs)

    def _start(self, df: DataFrame) -> tuple[int, list[float]]:
        """Rows, and the margins before the first tree: mean, log odds or logs of the class shares."""
        label = F.col(self.getLabelCol()).cast("double")
        if self.getOrDefault(self.task) == "regression":
            n, mean = df.agg(F.count(label), F.avg(label)).first()
            return n, [float(mean or 0.0)]
        k = self.getOrDefault(self.nClasses)
        counts = {int(r[0]): r[1] for r in df.groupBy(label.alias("y")).count().where("y IS NOT NULL").limit(k + 1).collect()}
        if any(c < 0 or c >= k for c in counts) or len(counts) > k:
            raise DataError(f"Labels of {k} classes are 0 to {k - 1}.")
        n = sum(counts.values())
        share = [min(max(counts.get(c, 0) / max(n, 1), 1e-12), 1 - 1e-12) for c in range(k)]
        return n, [math.log(share[1] / share[0])] if k == 2 else [math.log(s) for s in share]

    def _blocks(self, df: DataFrame, cuts, start, n: int) -> DataFrame:
        rows = max(1, min(1 << 14, BLOCK_BYTES // max(1, len(cuts))))
        k, start = len(start), np.array(start)
        arr = df.where(F.col(self.getLabelCol()).isNotNull()).select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))

        def cut_rows(batches):
            for batch in batches:
                for at in range(0, len(batch), rows):
                    part = batch.slice(at, rows)
                    X = _matrix(part["x"])
                    bins = np.empty(X.shape, np.uint8)
                    for j, c in enumerate(cuts):
                        bins[:, j] = np.searchsorted(c, X[:, j], side="left")
                    yield pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "label": [part["y"].to_numpy(zero_copy_only=False).tobytes()],
                                                      "margin": [np.tile(start, (len(X), 1)).astype(float).tobytes()]})

        share = TASK_ROWS if n <= TASK_ROWS else PASS_ROWS
        parts = max(1, min(arr.rdd.getNumPartitions(), -(-n // share)))
        return arr.coalesce(parts).mapInArrow(cut_rows, _BLOCK)

    def _fit(self, df: DataFrame):
        get = lambda p: self.getOrDefault(p)
        n, start = self._start(df)
        if not n:
            raise DataError("No labelled rows to learn from.")
        cuts = bin_cuts(df, self.getFeaturesCol(), min(get(self.maxBins), MAX_BINS))
        if not cuts:
            raise DataError("Need at least one feature.")
        k, by_leaf = len(start), get(self.growth) == "leaf"
        plan = _Plan(get(self.task), k, tuple(len(c) + 1 for c in cuts), k / (k - 1) if by_leaf and k > 1 else 2.0, get(self.l2),
                     get(self.minHessian), get(self.minRows), get(self.rate), get(self.maxDepth) or math.inf, get(self.maxLeaves) or math.inf,
                     get(self.rounds), by_leaf)
        if plan.deepest == math.inf and plan.leaves == math.inf:
            raise DataError("Trees need a limit of depth or of leaves.")
        blocks = self._blocks(df, cuts, start, n)
        if n <= TASK_ROWS and n * len(cuts) <= PASS_BYTES:
            done = _fit_in_one_task(plan, blocks)
        else:
            done = _fit_in_passes(plan, blocks)
        flat = {name: [v for t in done for v in t[name]] for name in ("feature", "left", "right", "gain", "value", "cover")}
        at = [float(cuts[f][b]) if f >= 0 else 0.0 for t in done for f, b in zip(t["feature"], t["cut"])]
        return BoostedTrees(task=plan.task, nClasses=get(self.nClasses), growth=get(self.growth), start=start, nFeatures=plan.features, threshold=at,
                            size=[len(t["feature"]) for t in done], featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), **flat)


class BoostedTrees(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trees one after the other in flat lists; tree i adds to class i mod (number of margins)."""
    start = _p("start", "margins before the first tree", TypeConverters.toListFloat)
    nFeatures = _p("nFeatures", "number of features", TypeConverters.toInt)
    size = _p("size", "nodes of every tree", TypeConverters.toListInt)
    feature = _p("feature", "feature of a split, -1: a leaf", TypeConverters.toListInt)
    threshold = _p("threshold", "rows with x <= threshold go left", TypeConverters.toListFloat)
    left = _p("left", "left child", TypeConverters.toListInt)
    right = _p("right", "right child", TypeConverters.toListInt)
    gain = _p("gain", "gain of a split", TypeConverters.toListFloat)
    value = _p("value", "value of a node", TypeConverters.toListFloat)
    cover = _p("cover", "rows (leaf growth) or Hessian (level growth) of a node", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, task="regression", nClasses=2, growth="level", start=None, nFeatures=0, size=None, feature=None, threshold=None,
                 left=None, right=None, gain=None, value=None, cover=None, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._setDefault(task="regression", nClasses=2, growth="level")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def __getattr__(self, name):
        # only a classifier has a number of classes, as in pyspark.ml
        if name == "numClasses" and self.getOrDefault(self.task) == "classification":
            return self.getOrDefault(self.nClasses)
        raise AttributeError(name)

    def trees(self) -> list[dict]:
        """Every tree's arrays by node."""
        names = ("feature", "threshold", "left", "right", "gain", "value", "cover")
        flat = {n: np.array(self.getOrDefault(getattr(self, n))) for n in names}
        ends = np.cumsum([0, *self.getOrDefault(self.size)])
        return [{n: flat[n][a:b] for n in names} for a, b in zip(ends[:-1], ends[1:])]

    def nodes(self) -> list[tuple]:
        """(tree, node, path, feature, threshold, gain, value, cover) of every node; feature -1 is a leaf."""
        out = []
        for i, t in enumerate(self.trees()):
            path = {0: ""}
            for node in range(len(t["feature"])):
                if t["feature"][node] >= 0:
                    path[int(t["left"][node])], path[int(t["right"][node])] = path[node] + "L", path[node] + "R"
            out += [(i, n, path[n], int(t["feature"][n]), *(float(t[c][n]) for c in ("threshold", "gain", "value", "cover"))) for n in path]
        return out

    @property
    def featureImportances(self):
        """Growth by levels: mean gain of a feature's splits; by leaves: number of its splits; both scaled to sum 1."""
        f, g = np.array(self.getOrDefault(self.feature)), np.array(self.getOrDefault(self.gain))
        d = self.getOrDefault(self.nFeatures)
        count = np.bincount(f[f >= 0], minlength=d).astype(float)
        found = count if self.getOrDefault(self.growth) == "leaf" else np.bincount(f[f >= 0], weights=g[f >= 0], minlength=d) / np.maximum(count, 1)
        return Vectors.dense(found / found.sum() if found.sum() > 0 else found)

    def _transform(self, df: DataFrame) -> DataFrame:
        start = np.array(self.getOrDefault(self.start))
        k = len(start)
        trees = [tuple(t[c] for c in ("feature", "threshold", "left", "right", "value")) for t in self.trees()]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margins(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            X = np.concatenate(xs.to_numpy()).reshape(len(xs), -1)
            m = np.tile(start, (len(X), 1))
            for i, t in enumerate(trees):
                m[:, i % k] += t[4][_walk(t, X)]
            return pd.Series(list(m))

        m = margins(vector_to_array(self.getFeaturesCol()))
        if self.getOrDefault(self.task) == "regression":
            return df.withColumn(self.getPredictionCol(), m[0])
        raw = vector_to_array("rawPrediction")
        if k == 1:
            out = df.withColumn("rawPrediction", m).withColumn("rawPrediction", array_to_vector(F.array(-F.col("rawPrediction")[0], F.col("rawPrediction")[0])))
            p = 1.0 / (1.0 + F.exp(-raw[1]))
            out = out.withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
        else:
            out = df.withColumn("rawPrediction", array_to_vector(m))
            e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
            out = out.withColumn("probability", array_to_vector(F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))
        p = vector_to_array("probability")
        return out.withColumn(self.getPredictionCol(), (F.array_position(p, F.array_max(p)) - 1).cast("double"))
