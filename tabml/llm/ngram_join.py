"""Exact n-gram Jaccard self-join by vertical partitioning.

A document's set holds its distinct n-word shingles as 64-bit hashes; the hash order is
the global order of n-grams.  Documents of equal sets are one node.

1. *Fragments.*  The order is cut into fragments and a set into its segments.  Two sets that link
   differ in at most ``D`` n-grams (``D`` follows from the smaller size), hence in at most ``D``
   fragments.  The fragments come in ``G`` groups of three; were at most one of each
   group's segments equal, over ``D`` would differ once ``G > D / 2``, so some group has two equal
   ones.  The three pairs of each group's segments are sent to the task of their hash, and linked
   sets meet there.  Two segments hold about five n-grams from all over the text, so a shared
   passage or a frequent n-gram rarely brings documents together.  Empty pairs of segments are
   not sent: ``G`` has ``E`` groups more than needed, and a set with more than
   ``E`` groups that hold such pairs sends all.  A set is cut once for its size class and once for
   each smaller class in reach, so partners are cut alike.
2. *Candidate parts.*  Sets that meet are chained, not paired; the parts of this graph (connected
   components) hold every link.
3. *Overlaps.*  The texts of each part meet in one task, or, above ``PART_WEIGHT``, in
   one task per pair of blocks of compatible sizes.  There the shared n-grams are cut into
   fragments again, partial overlaps of all pairs are counted per fragment as a matrix product
   and summed per pair.  Only the links' forest and each set's number of links leave the task.

No pair of documents becomes a row, nothing is sampled or capped, and the shuffled bytes
follow the input: signatures (about half as many as n-grams at 0.85, 0.8 of them at 0.8), the texts once, and
the texts of candidate parts once more (more often only within parts above the bound).

Defined cases: a text of fewer than ``n`` words is one shingle of all its words; a text
without words (or null) has ``n_shingles`` 0, links with nothing and is its own component;
repeated rows are copies of each other; a null id never becomes a component id unless
all ids of the component are null.  Hash equality (64 bits) stands for equality of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, local_roots
from .frames import ready, row_key, settle, settled, shuffle_parts, stored, unused
from .words import LOWER, SPACE, grams, mix, slices, whole

#: Growth of the size classes.
CLASS_RATIO = 1.3
#: Weight of a candidate part (or of two blocks of it) that is compared in one task: its shingles,
#: and ``SET_WEIGHT`` for each set, which bounds the matrix of pairs too.
PART_WEIGHT = 2_000_000
SET_WEIGHT = 500
#: Signatures gathered in a task before they are sent on.
FLUSH = 500_000
#: Cells of an overlap fragment's matrix.
CELLS = 4_000_000


class Rule:
    """Shingle length and threshold ``num / den`` with the cuts that follow from them."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * CLASS_RATIO)))
        self.low = np.array(low, np.int64)
        most = self.low[1:] - 1
        #: most n-grams in which linked sets differ, the smaller one being of the class
        self.differ = most * (den - num) // num
        need = self.differ // 2 + 1
        weak = 3 * need * np.exp(-2 / 3 * self.low[:-1] / need)  # groups with an empty pair
        self.spare = np.where(need < 8, 0, np.ceil(weak + 3 * np.sqrt(weak))).astype(np.int64)
        self.groups = need + self.spare

    def classes(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, class) pairs: each size under its own class and the smaller ones that
        may hold a partner."""
        own = np.searchsorted(self.low, n, "right") - 1
        rows = np.flatnonzero(n > 0)
        out, k = [], own[rows]
        while len(rows):
            out.append((rows, k))
            k = k - 1
            reach = (k >= 0) & ((self.low[np.maximum(k, 0) + 1] - 1) * self.den >= n[rows] * self.num)
            rows, k = rows[reach], k[reach]
        return out


def shingle_sets(piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a slice's rows, and the rows' bounds."""
    piece.split(SPACE)
    h = piece.hashes(LOWER)
    g = grams(h, words)
    bounds = piece.bounds
    parts = []
    for i in range(len(piece)):
        a, z = bounds[i], bounds[i + 1]
        if z - a >= words:
            s = g[a:z - words + 1]
            s.sort()
            parts.append(s)
        else:
            parts.append(np.array([whole(h[a:z])], np.uint64) if z > a else h[:0])
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[at]


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    n = np.diff(bounds).astype(np.uint64)
    return mix(_sum(mix(flat), bounds) + mix(n)).view(np.int64)


def signatures(flat: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of every pair of segments that is sent."""
    n = np.diff(bounds)
    top, mixed = flat >> np.uint64(32), mix(flat)
    sent, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows, k in rule.classes(n):
        some = rule.differ[k] > 0  # else only equal sets link
        rows, k = rows[some], k[some]
        if not len(rows):
            continue
        m, sizes = 3 * rule.groups[k], n[rows]
        first = np.cumsum(m) - m
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[rows], sizes)
        place = first[owner] + ((top[at] * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        total = np.zeros(int(m.sum()), np.uint64)
        total[place[new]] = np.add.reduceat(mixed[at], new)
        held = np.bincount(place, minlength=len(total))
        of = np.repeat(np.arange(len(rows)), m)
        label = (k[of].astype(np.uint64) << np.uint64(48)) + (np.arange(len(total)) - first[of]).astype(np.uint64)
        segment = mix(total ^ mix(label)).reshape(-1, 3)
        held = held.reshape(-1, 3)
        pair = mix(segment.sum(1, keepdims=True) - segment)
        weak = held.sum(1, keepdims=True) == held
        of = of[::3]
        every = np.bincount(of, weak.any(1), len(rows)) > rule.spare[k]
        send = ~weak | every[of][:, None]
        sent.append(pair[send])
        owners.append(np.broadcast_to(rows[of][:, None], send.shape)[send])
    return np.concatenate(sent), np.concatenate(owners)


#: A signature travels as its low 40 bits, in two columns; a bucket's chance matches only cost comparisons.
SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sig", T.BinaryType()), T.StructField("sig_top", T.BinaryType()),
                     T.StructField("sets", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
                     T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()),
                     T.StructField("set", T.LongType()), T.StructField("n", T.LongType())])
MET = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("set", T.LongType()),
                    T.StructField("n", T.LongType()), T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _arrow(schema: T.StructType, **columns) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], kinds[f.dataType]) if f.name in columns else pa.nulls(n, kinds[f.dataType])
         for f in schema.fields], schema.names)


def _send(rule: Rule, parts: int):
    """Texts -> one row per document, and signatures in blobs per bucket."""
    def flush(held):
        sig, sets, sizes = (np.concatenate(x) for x in zip(*held))
        bucket = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        sig, sets, sizes, bucket = sig[order], sets[order], sizes[order], bucket[order]
        ids, first = np.unique(bucket, return_index=True)
        cut = [*first.tolist(), len(sig)]
        spans = list(zip(cut[:-1], cut[1:]))
        parts_of = (("sig", sig.astype(np.uint32)), ("sig_top", (sig >> np.uint64(32)).astype(np.uint8)), ("sets", sets), ("sizes", sizes))
        return _arrow(SENT, bucket=ids, **{name: [x[a:z].tobytes() for a, z in spans] for name, x in parts_of})

    def work(batches):
        held, count = [], 0
        for batch in batches:
            ids, sizes = [], []
            for piece in slices(batch.column(2)):
                flat, bounds = shingle_sets(piece, rule.words)
                n, own = np.diff(bounds), set_ids(flat, bounds)
                ids.append(own)
                sizes.append(n)
                # copies in a slice are sent once
                _, first = np.unique(own, return_index=True)
                once = np.zeros(len(own), bool)
                once[first] = True
                keep = np.repeat(once, n)
                slim = np.concatenate([[0], np.cumsum(np.where(once, n, 0))])
                sig, row = signatures(flat[keep], slim, rule)
                held.append((sig, own[row], n[row].astype(np.int32)))
                count += len(sig)
                if count >= FLUSH:
                    yield flush(held)
                    held, count = [], 0
            if ids:
                own, n = np.concatenate(ids), np.concatenate(sizes)
                # rows are dealt by document: copies of one text do not meet in a task
                dealt = batch.column(0).to_numpy().view(np.uint64) % np.uint64(parts)
                yield _arrow(SENT, bucket=dealt.astype(np.int32), key=batch.column(0), doc=batch.column(1), n=n,
                             set=pa.array(own, mask=n == 0))
        if count:
            yield flush(held)
    return settled(work)


def _meet(rule: Rule):
    """A bucket's signatures -> the forest of sets that share one."""
    def work(batches):
        held = []
        for batch in batches:
            lone = batch.filter(batch.column(1).is_null())
            if lone.num_rows:
                yield _arrow(MET, key=lone.column(5), doc=lone.column(6), set=lone.column(7), n=lone.column(8))
            blobs = batch.filter(batch.column(1).is_valid())
            for low, top, sets, sizes in zip(*(blobs.column(k).to_pylist() for k in (1, 2, 3, 4))):
                sig = np.frombuffer(top, np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)
                held.append((sig, np.frombuffer(sets, np.int64), np.frombuffer(sizes, np.int32)))
        if not held:
            return
        sig, sets, sizes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(sig, kind="stable")
        same = sig[order[1:]] == sig[order[:-1]]
        keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        sig, sets, sizes = sig[keep], sets[keep], sizes[keep].astype(np.int64)
        order = np.lexsort((sets, sizes, sig))
        sig, sets, sizes = sig[order], sets[order], sizes[order]
        linked = np.flatnonzero((sig[1:] == sig[:-1]) & (sets[1:] != sets[:-1]) & (sizes[1:] * rule.num <= sizes[:-1] * rule.den))
        names, at = np.unique(np.concatenate([sets[linked], sets[linked + 1]]), return_inverse=True)
        root = local_roots(len(names), at[:len(linked)], at[len(linked):])
        far = np.flatnonzero(root != np.arange(len(names)))
        yield _arrow(MET, u=names[far], v=names[root[far]])
    return settled(work)


def overlaps(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections: the shared n-grams in fragments of the order,
    partial overlaps counted for each and summed."""
    count = len(bounds) - 1
    owner = np.repeat(np.arange(count), np.diff(bounds))
    order = np.argsort(flat, kind="stable")
    h, owner = flat[order], owner[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    rank = np.cumsum(new) - 1
    shared = np.bincount(rank)[rank] > 1
    rank, owner = rank[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]).astype(np.int64)])) if len(rank) else rank
    total = np.zeros((count, count), np.float32 if len(flat) < 1 << 24 else np.float64)
    width = max(64, CELLS // count)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (k, k + width))
        part = np.zeros((count, min(width, int(column[z - 1]) - k + 1)), total.dtype)
        part[owner[a:z], column[a:z] - k] = 1
        total += part @ part.T
    return total


LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("links", T.LongType())])


def _compare(rule: Rule):
    """Texts of whole parts, or of two blocks of one part -> (set, root, number of links)."""
    def work(table: pa.Table) -> pa.Table:
        flats, sizes = [], []
        for piece in slices(table["body"]):
            flat, bounds = shingle_sets(piece, rule.words)
            flats.append(flat)
            sizes.append(np.diff(bounds))
        flat, n = np.concatenate(flats), np.concatenate(sizes)
        bounds = np.concatenate([[0], np.cumsum(n)])
        own = set_ids(flat, bounds)
        wanted, part, side, copies = (table[c].to_numpy() for c in ("set", "part", "side", "copies"))
        order = np.lexsort((own, side, part))
        order = order[own[order] == wanted[order]]
        repeat = np.concatenate([[False], (own[order[1:]] == own[order[:-1]]) & (part[order[1:]] == part[order[:-1]])]) if len(order) else np.zeros(0, bool)
        order = order[~repeat]
        cuts = np.concatenate([[0], np.flatnonzero(part[order[1:]] != part[order[:-1]]) + 1, [len(order)]]) if len(order) else [0]
        out = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            rows = order[a:z]
            size = n[rows]
            inter = overlaps(np.concatenate([flat[bounds[r]:bounds[r + 1]] for r in rows]), np.concatenate([[0], np.cumsum(size)]))
            s, weight, found, links = side[rows], copies[rows], [], np.zeros(len(rows), np.int64)
            for i in range(0, len(rows), 256):
                some = inter[i:i + 256].astype(np.float64)
                joined = rule.den * some >= rule.num * (size[i:i + 256, None] + size[None, :] - some)
                joined[np.arange(len(some)), np.arange(i, i + len(some))] = False
                if s.max() > 0:  # two blocks: pairs within one belong to another task
                    joined &= s[i:i + 256, None] != s[None, :]
                links[i:i + 256] = joined @ weight
                found.append(np.stack(np.nonzero(joined)) + np.array([[i], [0]]))
            root = local_roots(len(rows), *np.concatenate(found, 1))
            del inter, found
            names = own[rows]
            low = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(low, root, names)
            out.append((names, low[root], links))
        u, v, links = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        settle()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(links, pa.int64())})
    return work


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: key (``row_key`` of id and text), doc (id), n_shingles,
    component_id, component (of sets; null without words) and n_links (documents linked)."""
    ready(docs.sparkSession)
    rule = Rule(words, num, den)
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc"),
                         F.col(f"`{text_col}`").alias("body"))
    parts = shuffle_parts(source)
    met = stored(source.mapInArrow(_send(rule, parts), SENT).repartitionById(parts, F.col("bucket"))
                 .mapInArrow(_meet(rule), MET), "ngram-met")
    rows = met.where("u IS NULL").select("key", "doc", "set", "n")
    sets = rows.where("set IS NOT NULL").groupBy("set").agg(
        F.min("key").alias("key"), F.min("doc").alias("doc"), F.count("*").alias("copies"), F.max("n").alias("n"))
    near = connected_components(met.where("u IS NOT NULL").select("u", "v"), "ngram-parts")
    cand = stored(near.join(sets, near.node == sets.set).select("set", F.col("root").alias("super"), "key", "copies", "n"), "ngram-cand")
    placed = stored(_places(cand, rule), "ngram-placed")
    texts = source.select("key", "body").join(placed.hint("shuffle_hash"), "key")
    compared = stored(texts.groupBy("task").applyInArrow(_compare(rule), LINKS), "ngram-links")
    comp = connected_components(compared.where("u <> v").select("u", "v"), "ngram-comp")
    links = compared.groupBy("u").agg(F.sum("links").alias("links"))
    least = (sets.join(comp, sets.set == comp.node, "left")
             .select("set", "doc", "copies", F.coalesce("root", "set").alias("component")))
    named = least.groupBy("component").agg(F.min("doc").alias("component_id"))
    known = stored(least.join(named, "component").join(links, F.col("set") == F.col("u"), "left")
             .select("set", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ngram-known")
    return rows.join(known, "set", "left").select(
        "key", "doc", F.col("n").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _places(cand: DataFrame, rule: Rule) -> DataFrame:
    """In which tasks each candidate set is compared: parts up to ``PART_WEIGHT`` are dealt whole
    to shared tasks; larger ones are cut by size and hash into blocks, a task per pair of
    blocks of compatible sizes."""
    cost = F.col("n") + SET_WEIGHT
    total = cand.groupBy("super").agg(F.sum(cost).alias("weight"))
    small = total.where(F.col("weight") <= PART_WEIGHT)
    amount = small.agg(F.sum("weight")).first()[0] or 0
    tasks = max(1, -(-amount // (PART_WEIGHT // 2)), cand.sparkSession.sparkContext.defaultParallelism * (amount > 0))
    whole_parts = cand.join(small, "super").select(
        "key", "set", "copies", F.pmod(F.xxhash64("super"), F.lit(tasks)).alias("task"), F.col("super").alias("part"), F.lit(0).alias("side"))
    big = cand.join(total.where(F.col("weight") > PART_WEIGHT).select("super"), "super").withColumn(
        "band", F.floor(F.log(F.col("n").cast("double")) / np.log(1.5)))
    bands = big.groupBy("super", "band").agg(
        F.ceil(F.sum(cost) / (PART_WEIGHT // 2)).alias("cuts"), F.min("n").alias("least"), F.max("n").alias("most"))
    big = big.join(bands.select("super", "band", "cuts"), ["super", "band"]).withColumn("cut", F.pmod(F.xxhash64("set"), F.col("cuts")))
    blocks = bands.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    one = blocks.select("super", F.col("band").alias("band1"), F.col("cut").alias("cut1"), F.col("most").alias("most1"))
    two = blocks.select("super", F.col("band").alias("band2"), F.col("cut").alias("cut2"), F.col("least").alias("least2"))
    pairs = one.join(two, "super").where(
        ((F.col("band1") < F.col("band2")) | ((F.col("band1") == F.col("band2")) & (F.col("cut1") <= F.col("cut2"))))
        & (F.col("most1") * rule.den >= F.col("least2") * rule.num)).withColumn(
        "task", F.xxhash64("super", "band1", "cut1", "band2", "cut2"))
    same = (F.col("band1") == F.col("band2")) & (F.col("cut1") == F.col("cut2"))
    sides = pairs.select("super", F.col("band1").alias("band"), F.col("cut1").alias("cut"), "task",
                         F.when(same, 0).otherwise(1).alias("side")).union(
        pairs.where(~same).select("super", "band2", "cut2", "task", F.lit(2)))
    blocked = big.join(sides, ["super", "band", "cut"]).select(
        "key", "set", "copies", "task", F.col("task").alias("part"), "side")
    return whole_parts.union(blocked)


def digest(docs: DataFrame) -> DataFrame:
    """The per-document contract columns."""
    return ngram_jaccard_join(docs.select("doc_id", "text")).select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component (smallest id, ties by content; repeated
    rows once).  Documents without words all stay."""
    found = stored(ngram_jaccard_join(docs, id_col, text_col, words, num, den).where("component IS NOT NULL").select("key", "doc", "component"), "ngram-found")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "key")).alias("best")).select("component", F.col("best.key").alias("best"))
    # members don't meet by component: a key is the best of its own or of none
    rows = found.groupBy("key").agg(F.count("*").alias("rows")).join(best.select(F.col("best").alias("key"), "best"), "key", "left")
    # what goes, and what stays but is there more than once: small tables beside the texts, which move only if these are large
    mark = unused(docs, "__key")
    gone = stored(rows.where("best IS NULL OR rows > 1").select(F.col("key").alias(mark)), "ngram-gone")
    repeated = stored(rows.where("best IS NOT NULL AND rows > 1").select(F.col("key").alias(mark)), "ngram-repeated")
    keyed = docs.withColumn(mark, row_key(id_col, text_col))
    once = keyed.join(gone, mark, "left_anti").drop(mark).select(docs.columns)
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(repeated, mark, "left_semi").dropDuplicates([mark]).drop(mark).select(docs.columns))
