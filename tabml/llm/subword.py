"""Subword-bag text classification: features, NumPy training and scoring.

A text's features are its words, the byte n-grams of each word with one white-space byte at
either side and one for a word met again ``1..repeats`` words later, hashed into ``2 ** bits``
buckets.  Every bucket has a learned vector; a bag of features is the mean of its vectors, and a
softmax over two classes sits on top.  Vectors and softmax are trained together by
stochastic gradient descent with per-bucket step sizes (AdaGrad).

A bag is the whole document, or (``passage`` words) a passage of it: then the document's logit is
that of its highest passage, so that a single word tells in a text of any length.  Training
goes over whole documents first, then over the passage that is highest at the time, and puts the
bias halfway between the classes of a fifth of the rows that is set aside for it.

For scoring the softmax is applied to the bucket vectors once: since a bag's vector is a
mean, its logit is the mean of the buckets' logits.  The model shipped to the tasks
is one float per bucket, of fixed size, and scoring is one pass over the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ready, settled
from .words import LOWER, SPACE, VERBATIM, slices

#: Bytes scored at a time.
PIECE = 1 << 20
#: Passages of more than twice this size are cut.
PASSAGE_BYTES = 64


@dataclass(frozen=True)
class Subwords:
    """How texts become features."""

    lower: bool
    bits: int = 18
    shortest: int = 3
    longest: int = 5
    repeats: int = 0
    passage: int = 0
    #: Leave out a word that equals the one before it.
    once: bool = False
    #: Empty features in every mean: a bag of few features has a small one.
    pad: int = 0

    def features(self, piece):
        """Per kind of feature: (buckets, byte place of each)."""
        to = LOWER if self.lower else VERBATIM
        piece.split(SPACE)
        words = piece.hashes(to)
        row = np.repeat(np.arange(len(piece)), np.diff(piece.bounds))
        kept = np.ones(len(words), bool)
        if self.once and len(words):
            kept[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        yield (words[kept] >> np.uint64(64 - self.bits)).astype(np.int64), piece.starts[kept]
        for back in range(1, self.repeats + 1):
            at = np.flatnonzero((words[back:] == words[:-back]) & (row[back:] == row[:-back])) + back
            yield np.full(len(at), back - 1, np.int64), piece.starts[at]
        data = to[piece.buf].astype(np.uint32) + np.uint32(1)
        # blank[i]: white space before byte i, and row starts
        space = np.concatenate([[0], np.cumsum(SPACE[piece.buf])])
        edge = np.zeros(len(data) + 1, np.int32)
        edge[piece.offsets[1:-1]] = 1
        edge = np.cumsum(edge)
        out = np.zeros(len(data) + 1, np.int32)
        np.add.at(out, piece.starts[~kept] - 1, 1)
        np.add.at(out, piece.ends[~kept], -1)
        out = np.cumsum(out)
        h = data.copy()
        for n in range(2, self.longest + 1):
            h = h[:len(data) - n + 1] * np.uint32(0x01000193) ^ data[n - 1:]
            if n < self.shortest or not len(h):
                continue
            m = len(h)
            inside = (space[n - 1:n - 1 + m] == space[1:1 + m]) & (edge[n - 1:n - 1 + m] == edge[:m])
            at = np.flatnonzero(inside & (out[:m] == 0))
            mixed = h[at]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D + 2 * n)
            mixed ^= mixed >> np.uint32(12)
            mixed *= np.uint32(0x297A2D39)
            yield (mixed >> np.uint32(32 - self.bits)).astype(np.int64), at

    def bags(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """Byte places at which the bags of a split slice begin (and the end), and the
        first bag of each row (and the number of bags)."""
        if not self.passage:
            return piece.offsets, np.arange(len(piece) + 1)
        n = np.maximum(1, np.diff(piece.bounds) // self.passage)  # the last one takes the rest
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(first[-1]) - np.repeat(first[:-1], n)
        word = np.repeat(piece.bounds[:-1], n) + place * self.passage
        at = np.repeat(piece.offsets[:-1], n)
        later = place > 0
        at[later] = piece.starts[word[later]]
        return self._cut(np.append(at, piece.offsets[-1]), first)

    @staticmethod
    def _cut(edges: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with every bag of more than twice ``PASSAGE_BYTES`` in even pieces of that size at most."""
        size = np.diff(edges)
        n = np.where(size > 2 * PASSAGE_BYTES, -(-size // PASSAGE_BYTES), 1)
        if (n == 1).all():
            return edges, first
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], n)
        at = np.repeat(edges[:-1], n) + place * np.repeat(size, n) // np.repeat(n, n)
        return np.append(at, edges[-1]), total[first]

    def sample(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """One whole text for training: buckets and counts, or, with passages, the
        buckets in order of place and the length of each passage."""
        if not self.passage:
            total = np.zeros(1 << self.bits, np.int64)
            for piece in _bounded(text):
                for ids, _ in self.features(piece):
                    total += np.bincount(ids, minlength=len(total))
            ids = np.flatnonzero(total)
            return ids.astype(np.int32), total[ids].astype(np.int32)
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for piece in _bounded(text):
            found, at = (np.concatenate(x) for x in zip(*self.features(piece)))
            order = np.argsort(at, kind="stable")
            ids.append(found[order].astype(np.int32))
            lengths.append(np.diff(np.searchsorted(at[order], self.bags(piece)[0])).astype(np.int32))
        return np.concatenate(ids), np.concatenate(lengths)

    def logits(self, column, table: np.ndarray) -> np.ndarray:
        """Mean of ``table`` over the features of each text's (highest) bag; 0 without features."""
        out = np.zeros(len(column))
        for piece in slices(column, PIECE):
            parts = list(self.features(piece))
            edges, first = self.bags(piece)
            total, count = np.zeros(len(edges) - 1), np.zeros(len(edges) - 1)
            for ids, at in parts:
                cuts = np.searchsorted(at, edges)
                sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
                total += sums[cuts[1:]] - sums[cuts[:-1]]
                count += np.diff(cuts)
            out[piece.first:piece.first + len(piece)] = np.maximum.reduceat(total / np.maximum(count + self.pad, 1), first[:-1])
        return out


def _bounded(text: str | None):
    yield from slices(pa.array([text or ""], pa.large_string()), PIECE)


@dataclass(frozen=True)
class Training:
    """Settings of the fit.  ``per_class``: documented bound of the training sample; of each class
    the labelled documents with the smallest hash of the id are taken.  ``epochs`` go over whole
    documents, ``sharp`` over their highest passages."""

    per_class: int = 2500
    dim: int = 8
    epochs: int = 12
    sharp: int = 0
    rate: float = 0.5
    #: Start of the squared gradients: a bucket met once or twice moves little.
    prior: float = 1e-12
    #: Highest passages of a document of label 0 that are learned from at a time.
    below: int = 1
    seed: int = 7


class _Net:
    def __init__(self, size: int, how: Training):
        rng = np.random.default_rng(how.seed)
        self.vectors = rng.uniform(-0.5, 0.5, (size, how.dim)).astype(np.float32) / how.dim
        self.squares = np.full(size, how.prior, np.float32)
        self.soft = rng.uniform(-0.5, 0.5, (how.dim, 2)).astype(np.float32)
        self.bias, self.bias_sq = np.zeros(2, np.float32), np.full(2, 1e-6, np.float32)
        self.soft_sq = np.full((how.dim, 2), 1e-6, np.float32)

    def step(self, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
        """One gradient step on a bag: distinct buckets and their shares."""
        held = self.vectors[ids]
        x = share @ held
        z = x @ self.soft + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        down = self.soft @ p
        self.squares[ids] += share * share * float(down @ down)
        held -= (rate * share / np.sqrt(self.squares[ids]))[:, None] * down
        self.vectors[ids] = held
        g = np.outer(x, p)
        self.soft_sq += g * g
        self.bias_sq += p * p
        self.soft -= 0.1 * rate * g / np.sqrt(self.soft_sq)
        self.bias -= 0.1 * rate * p / np.sqrt(self.bias_sq)

    def table(self) -> np.ndarray:
        return (self.vectors @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32)


def _shares(ids: np.ndarray, counts: np.ndarray | None, pad: int) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        ids, counts = np.unique(ids, return_counts=True)
    return ids, counts.astype(np.float32) / max(1, int(counts.sum()) + pad)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], features: Subwords, how: Training) -> tuple[np.ndarray, float]:
    """Logit per bucket and bias, from (label, *sample) rows."""
    if not rows:
        return np.zeros(1 << features.bits, np.float32), 0.0
    net, rng = _Net(1 << features.bits, how), np.random.default_rng(how.seed + 1)
    aside = rows[::5] if how.sharp and len(rows) >= 100 else []
    rows = [r for i, r in enumerate(rows) if i % 5] if aside else rows
    for epoch in range(how.epochs):
        for r in rng.permutation(len(rows)):
            label, ids, counts = rows[r]
            net.step(*_shares(ids, None if features.passage else counts, features.pad), label, how.rate * (1 - epoch / how.epochs))
    for epoch in range(how.sharp):
        for r in rng.permutation(len(rows)):
            label, ids, lengths = rows[r]
            rate = how.rate * (1 - epoch / how.sharp)
            if not len(ids):
                net.step(*_shares(ids, None, features.pad), label, rate)
                continue
            ends = np.cumsum(lengths)
            sums = np.concatenate([[0.0], np.cumsum(net.vectors[ids] @ (net.soft[:, 1] - net.soft[:, 0]), dtype=np.float64)])
            height = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths + features.pad, 1)
            for top in np.argsort(-height, kind="stable")[:1 if label else how.below]:
                net.step(*_shares(ids[ends[top] - lengths[top]:ends[top]], None, features.pad), label, rate)
    table, bias = net.table(), float(net.bias[1] - net.bias[0])
    return table, bias - _middle(aside, features, table, bias)


def _middle(rows, features: Subwords, table: np.ndarray, bias: float) -> float:
    """The logit halfway between the classes of rows that were not trained on, if they stand apart (else
    0): trained on highest passages alone, the bias leans to the class that has more of them."""
    logits = ([], [])
    for label, ids, lengths in rows:
        ends = np.cumsum(lengths)
        sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
        logits[label].append(((sums[ends] - sums[ends - lengths]) / np.maximum(lengths + features.pad, 1)).max(initial=0.0) + bias)
    if not logits[0] or not logits[1]:
        return 0.0
    high, low = np.quantile(logits[0], 0.99), np.quantile(logits[1], 0.01)
    return (high + low) / 2 if low > high else 0.0


COUNTED = T.StructType([T.StructField("order", T.LongType()), T.StructField("label", T.IntegerType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
MODEL = T.StructType([T.StructField("logits", T.BinaryType()), T.StructField("bias", T.DoubleType())])


def _count(features: Subwords):
    def work(batches):
        for batch in batches:
            texts = batch.column(2)
            done = [features.sample(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in done], pa.binary()),
                                              pa.array([c.tobytes() for _, c in done], pa.binary())], COUNTED.names)
    return settled(work)


def _fit(features: Subwords, how: Training):
    def work(batches):
        rows = []
        for batch in batches:
            for order, label, ids, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append((order, label, np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32)))
        rows.sort(key=lambda r: r[:2])
        logits, bias = train([r[1:] for r in rows], features, how)
        yield pa.RecordBatch.from_arrays([pa.array([logits.tobytes()], pa.binary()), pa.array([bias])], MODEL.names)
    return settled(work)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, features: Subwords, how: Training,
        id_col: str = "doc_id", text_col: str = "text", learn=None) -> tuple[np.ndarray, float]:
    """Train on labelled documents (``label_col`` 0 or 1) whose id passes ``learn`` (a
    condition on the column ``id``).  Only the bounded sample's ids are broadcast and only
    its counts meet in one task; the driver receives the model."""
    ready(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)")
    if learn is not None:
        known = known.where(learn)
    order = F.xxhash64("id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).select("id", "label", order.alias("order")).orderBy("order", "id").limit(how.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("id", "order").agg(F.min("label").alias("label"))  # an id labelled twice is taken once
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    # one text an id, before anything leaves the scan's tasks: an id may be in any number of rows
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "order", "label").agg(F.min("body").alias("body")).select("order", "label", "body")
    model = sample.mapInArrow(_count(features), COUNTED).repartition(1).mapInArrow(_fit(features, how), MODEL).first()
    return np.frombuffer(model.logits, np.float32), model.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], features: Subwords, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out``, in place of one of that name."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches):
        logits, bias = shared.value
        for batch in batches:
            z = features.logits(batch.column(at), logits) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, f"s{batch.num_columns}"])

    names = docs.columns
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*df.schema.fields, T.StructField(f"s{len(names)}", T.DoubleType())])
    kept = [i for i, n in enumerate(names) if n.lower() != out.lower()]
    return df.mapInArrow(work, schema).select(*[f"c{i}" for i in kept], f"s{len(names)}").toDF(*[names[i] for i in kept], out)
