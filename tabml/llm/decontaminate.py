"""Benchmark decontamination by suffix arrays of the training text.

Every slice of the documents is a shard.  In a shard the words are numbered by the
benchmark's vocabulary (0: no benchmark word) and the shard's suffix array is built: the
word positions sorted by all benchmark words that follow, by prefix doubling.  Suffixes that no test window
can match, as fewer benchmark words follow than the shortest window has, are left out.  Every test
suffix is then looked up by binary search: the range of suffixes that begin with a test window
gives all its occurrences, and the test suffixes that a place falls between its longest verbatim match.
A document's hits are the union of its matches of at least one window.

The benchmark reaches the shards in blocks of bounded bytes, one broadcast and one pass
over the documents each; the documents are never shuffled.

Rules (parameters in brackets): words are A-Z lower-cased runs of digits, letters and
non-ASCII characters.  A window is ``window`` (13) consecutive item words; an item of fewer
words, but not none, is one window.  A document word inside any occurrence of a window is
hit.  A document is contaminated if it has hits and ``share`` (20) times the hits reach its
word count.

Defined cases: a null or empty text has no words, no hits and is clean; a null, empty or
wordless item has no windows; a null item id is ignored; repeated documents get a row each;
repeated item ids count once; an empty benchmark leaves every document clean.  Other
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ready, unused
from .words import LOWER, NON_ALNUM, slices

WINDOW = 13
SHARE = 20
#: Bytes of benchmark text in a block (one broadcast).
BLOCK_BYTES = 8 << 20
#: Bytes of document text in a shard (one suffix array).
SHARD_BYTES = 8 << 20


class Block:
    """Test suffixes of some benchmark items, ready for binary search."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        self.window = window
        piece = next(slices(pa.array(texts, pa.large_string()), 1 << 62), None)
        if piece is None:
            h, bounds = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        else:
            piece.split(NON_ALNUM)
            h, bounds = piece.hashes(LOWER), piece.bounds
        self.vocabulary, numbers = np.unique(h, return_inverse=True)
        self.words = numbers.astype(np.uint32) + np.uint32(1)
        counts = np.diff(bounds)
        item_of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - np.repeat(bounds[:-1], counts)
        #: words of the test suffix that starts at each item word
        self.left = np.repeat(counts, counts) - place
        starts = np.flatnonzero((self.left >= window) | (place == 0))
        self.item_of, self.place, self.item_ids = item_of, place, np.asarray(ids, dtype=object)
        low = _columns(self.words, starts, np.minimum(self.left[starts], window), window, 0)
        lengths = np.minimum(self.left[starts], window)
        #: distinct windows, sorted, and the items that hold each
        self.low, back = np.unique(low, return_inverse=True)
        first = np.zeros(len(self.low), np.int64)
        first[back] = starts
        self.lengths = np.zeros(len(self.low), np.int64)
        self.lengths[back] = lengths
        self.high = _columns(self.words, first, self.lengths, window, 0xFFFFFFFF)
        pairs = np.unique(np.stack([back, item_of[starts]], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.items_at = np.searchsorted(pairs[:, 0], np.arange(len(self.low) + 1))
        #: all test suffixes in order, and the words each shares with the next one
        if len(self.words):
            rank, levels = _ranks(self.words, self.left)
            self.sorted = np.argsort(rank, kind="stable")
            self.shared = _common(self.words, self.left, levels, self.sorted[:-1], self.sorted[1:])
        else:
            self.sorted = self.shared = np.zeros(0, np.int64)
        self.named: dict = {}
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def names(self, rows: np.ndarray) -> list[str]:
        return sorted({str(self.item_ids[x]) for x in rows})

    def holder(self, test: int, length: int) -> str:
        """The smallest id of the items that hold the first ``length`` words of a sorted test suffix."""
        if (test, length) not in self.named:
            lo = hi = test
            while lo and self.shared[lo - 1] >= length:
                lo -= 1
            while hi < len(self.shared) and self.shared[hi] >= length:
                hi += 1
            self.named[test, length] = self.names(np.unique(self.item_of[self.sorted[lo:hi + 1]]))[0]
        return self.named[test, length]

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1, or 0, of word hashes."""
        out = np.zeros(len(h), np.uint32)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == h[maybe], at + 1, 0)
        return out


def _columns(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int, fill: int) -> np.ndarray:
    """Byte strings that sort as the first ``lengths`` words from each start do,
    padded to ``depth`` words by ``fill``."""
    out = np.full((len(starts), depth), fill, ">u4")
    for d in range(depth):
        has = lengths > d
        out[has, d] = words[starts[has] + d]
    return out.view(f"S{4 * depth}").ravel()


def _ranks(words: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, list]:
    """Ranks of the suffixes of ``run`` words from each place (equal for equal ones), and those by the first k, 2k,
    4k, ... words: first by k words packed into one number, then, only where they tie, by twice as many a round."""
    n = len(words)
    bits = int(words.max(initial=0)).bit_length() or 1
    k = 4 if bits <= 15 else 2 if bits <= 31 else 1
    key = words.astype(np.uint64)
    for d in range(1, k):
        key = key << np.uint64(bits) | np.where(run > d, words[np.minimum(np.arange(n) + d, n - 1)], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size) + 1
    tied = order[(np.repeat(size, size) > 1) & (run[order] >= k)]
    levels, h = [(k, rank.astype(np.int32))], k
    while len(tied):
        more = np.where(run[tied] > h, rank[np.minimum(tied + h, n - 1)], 0)
        order = np.lexsort((more, rank[tied]))
        tied, more, old = tied[order], more[order], rank[tied[order]]
        group = np.searchsorted(old, old)
        new = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (more[1:] != more[:-1])]))
        size = np.diff(np.append(new, len(tied)))
        rank[tied] = old + np.repeat(new, size) - group
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        # those that end within the words compared are equal for good
        tied = tied[(np.repeat(size, size) > 1) & (more > 0)]
    return rank, levels


def _common(words: np.ndarray, run: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share: equal ranks by h words skip h of them, the longest first."""
    last = max(len(words) - 1, 0)
    most = np.minimum(run[a], run[b])
    length = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        same = (most - length >= h) & (rank[np.minimum(a + length, last)] == rank[np.minimum(b + length, last)])
        length[same] += h
    going = np.ones(len(a), bool)
    for _ in range(levels[0][0] - 1):
        going &= (length < most) & (words[np.minimum(a + length, last)] == words[np.minimum(b + length, last)])
        length[going] += 1
    return length


class Shard:
    """The suffix array of a slice of documents against one block: the places from which benchmark words follow,
    at least as many as the shortest window has, sorted by all benchmark words that follow."""

    def __init__(self, piece, block: Block):
        self.block, self.bounds = block, piece.bounds
        words = block.numbered(piece.hashes(LOWER))
        n = len(words)
        stop = words == 0
        ends = np.zeros(n + 1, bool)
        ends[self.bounds] = True
        ends[n] = True
        ends[:n] |= stop
        breaks = np.flatnonzero(ends)
        after = np.searchsorted(breaks, np.arange(n), "right")
        # benchmark words in a row from each place on, within the document, and of the whole row it is in
        run = np.where(stop, 0, breaks[after] - np.arange(n)) if n else np.zeros(0, np.int64)
        whole = breaks[after] - breaks[np.maximum(after - 1, 0)] if n else run
        self.at = np.flatnonzero(~stop & (whole >= block.shortest)) if block.shortest else np.zeros(0, np.int64)
        #: words of those rows, then the benchmark's
        self.n = len(self.at)
        self.words = np.concatenate([words[self.at], block.words])
        self.run = np.concatenate([run[self.at], block.left])
        self.order = np.zeros(0, np.int64)
        if not self.n:
            return
        self.rank, self.levels = _ranks(self.words, self.run)
        kept = np.flatnonzero(self.run[:self.n] >= block.shortest)
        self.order = kept[np.argsort(self.rank[kept], kind="stable")]
        self.known = self.rank[self.order]
        self.keys = _columns(self.words, self.order, np.minimum(self.run[self.order], block.window), block.window, 0)
        #: where every test suffix, in sorted order, falls among the sorted suffixes
        self.falls = np.searchsorted(self.known, self.rank[self.n + block.sorted], "right")

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted place, window) of every occurrence of every test window."""
        b = self.block
        if not len(self.order) or not len(b.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(self.keys, b.low, "left")
        hi = np.searchsorted(self.keys, b.high, "right")
        count = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return at, window

    def matches(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, sorted test suffix) of the longest match at sorted ``places``: one of the two test suffixes they
        fall between has it."""
        tests = len(self.falls)
        following = np.searchsorted(self.falls, places, "right")
        best, which = np.full(len(places), -1, np.int64), np.zeros(len(places), np.int64)
        for near in (following - 1, following):
            near = np.clip(near, 0, tests - 1)
            length = _common(self.words, self.run, self.levels, self.order[places], self.n + self.block.sorted[near])
            better = length > best
            best[better], which[better] = length[better], near[better]
        return best, which

    def longest(self) -> Iterator[tuple[int, int, int, int]]:
        """(position, item row, item place, words) of the longest match of every
        test suffix, at its neighbour among the sorted suffixes; matches shorter than the
        shortest window are left out."""
        b = self.block
        if not len(self.order) or not len(b.words):
            return
        # of equal suffixes the first in text order
        before = np.searchsorted(self.known, self.known[np.maximum(self.falls - 1, 0)])
        best, where = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
        for near in (before, self.falls):
            p = self.order[np.minimum(near, len(self.order) - 1)]
            length = _common(self.words, self.run, self.levels, p, self.n + b.sorted)
            better = length > best
            best[better], where[better] = length[better], p[better]
        for i in np.flatnonzero(best >= max(1, b.shortest)):
            s = b.sorted[i]
            yield int(self.at[where[i]]), int(b.item_of[s]), int(b.place[s]), int(best[i])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``, read one at a time."""
    items = (benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("body"))
             .where("item IS NOT NULL AND body IS NOT NULL"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k).toLocalIterator()
        ids, texts = [], []
        for r in rows:
            ids.append(r[0])
            texts.append(r[1])
        yield Block(ids, texts, window)


HITS = T.StructType([T.StructField("n_words", T.LongType()),
                     T.StructField("hit_spans", T.ArrayType(T.LongType())),
                     T.StructField("items", T.ArrayType(T.StringType())),
                     T.StructField("longest_words", T.LongType()),
                     T.StructField("longest_item", T.StringType()),
                     T.StructField("longest_at", T.LongType())])


def _found(piece, block: Block) -> Iterator[tuple]:
    """Per document of a slice: n_words, hit spans, items, words, item and place of its longest match (the first
    of equal length).  Spans are the union of the matches of a window's length or more."""
    shard = Shard(piece.split(NON_ALNUM), block)
    counts = np.diff(piece.bounds).tolist()
    at, window = shard.occurrences()
    places, back = np.unique(at, return_inverse=True)
    best, test = shard.matches(places) if len(places) else (at, at)
    # a match of less than a window is one with a whole short item
    best, long = best[back], best[back] >= block.window
    length = np.where(long, best, block.lengths[window])
    position = shard.at[shard.order[at]]
    test = test[back]
    rows = np.searchsorted(piece.bounds, position, "right") - 1
    order = np.lexsort((-length, position, rows))
    position, window, rows, length, long, test = (x[order] for x in (position, window, rows, length, long, test))
    cut = np.searchsorted(rows, np.arange(len(piece) + 1))
    for i in range(len(piece)):
        a, z = cut[i], cut[i + 1]
        if a == z:
            yield counts[i], [], [], 0, None, None
            continue
        seen = np.unique(np.concatenate([block.items[block.items_at[w]:block.items_at[w + 1]] for w in np.unique(window[a:z])]))
        top = a + int(np.argmax(length[a:z]))
        w = window[top]
        item = (block.holder(int(test[top]), int(length[top])) if long[top]
                else block.names(block.items[block.items_at[w]:block.items_at[w + 1]])[0])
        yield (counts[i], _union(position[a:z] - piece.bounds[i], length[a:z]), block.names(seen),
               int(length[top]), item, int(position[top] - piece.bounds[i]))


def _both(old: dict, new: tuple) -> tuple:
    """A document's findings in earlier blocks and in a new one."""
    longest = [(-n, at, item) for n, item, at in ((old["longest_words"], old["longest_item"], old["longest_at"]), new[3:]) if n]
    n, at, item = min(longest, default=(0, None, None))
    return new[0], _merge(old["hit_spans"], new[1]), sorted({*old["items"], *new[2]}), -n, item, at


def _pass(shared, text_col: str, first: bool):
    """One block against all documents: adds to each row the hit word spans
    (start, end, start, end, ...), the items found and the longest match."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]

    def work(batches):
        block = shared.value
        for batch in batches:
            found = [f for piece in slices(batch.column(batch.schema.get_field_index(text_col)), SHARD_BYTES) for f in _found(piece, block)]
            if not first:
                at = batch.schema.get_field_index("__hits")
                found = [_both(o, f) for o, f in zip(batch.column(at).to_pylist(), found)]
                columns = [c for k, c in enumerate(batch.columns) if k != at]
                names = [x for k, x in enumerate(batch.schema.names) if k != at]
            else:
                columns, names = batch.columns, batch.schema.names
            hits = pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], HITS.names)
            yield pa.RecordBatch.from_arrays([*columns, hits], [*names, "__hits"])
    return work


def _union(starts: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Union of intervals sorted by start, flat."""
    ends = np.maximum.accumulate(starts + lengths)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return np.stack([starts[new], ends[last]], 1).ravel().tolist()


def _merge(a: list[int], b: list[int]) -> list[int]:
    pairs = np.array(sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]), np.int64).reshape(-1, 2)
    return _union(pairs[:, 0], pairs[:, 1] - pairs[:, 0]) if len(pairs) else []


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, share: int = SHARE,
         block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, hit_spans (word places),
    items (ids as strings, sorted), contaminated, and the longest verbatim match: longest_words (0: none of a
    window's length), longest_item (the smallest id of the items that hold it) and longest_at (its first word, from 0)."""
    ready(docs.sparkSession)
    names = docs.columns
    # places instead of names: the input may hold any names, also repeated ones
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    first = True
    for block in blocks(benchmark, item_col, item_text_col, block_bytes, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        schema = T.StructType([*[f for f in df.schema.fields if f.name != "__hits"], T.StructField("__hits", HITS)])
        df = df.mapInArrow(_pass(shared, text, first), schema)
        first = False
    spans = F.col("__hits.hit_spans")
    n_hit = F.aggregate(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), F.lit(0).cast("long"),
                        lambda acc, i: acc + F.get(spans, i * 2 + 1) - F.get(spans, i * 2))
    n_hit = F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    n_words = F.col("__hits.n_words")
    verdict = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), spans.alias("hit_spans"),
                       F.col("__hits.items").alias("items"),
                       ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"),
                       *[F.col(f"__hits.{c}").alias(c) for c in ("longest_words", "longest_item", "longest_at")])
    return df.select(*[f"c{i}" for i in range(len(names))], verdict.alias("verdict")).toDF(*names, out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they were."""
    out = unused(docs, "__verdict")
    return mark(docs, benchmark, out=out, **options).where(~F.col(f"{out}.contaminated")).drop(out)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every test suffix in every shard that has one of the
    shortest window's length: item, item_word, doc, doc_word, n_words."""
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType()),
                           source.schema["doc"], T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])

    def finder(shared):
        def work(batches):
            block = shared.value
            for batch in batches:
                for piece in slices(batch.column(1), SHARD_BYTES):
                    found = list(Shard(piece.split(NON_ALNUM), block).longest())
                    rows = [int(np.searchsorted(piece.bounds, f[0], "right")) - 1 for f in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([str(block.item_ids[f[1]]) for f in found], pa.string()),
                        pa.array([f[2] for f in found], pa.int64()),
                        batch.column(0).take(pa.array([piece.first + r for r in rows], pa.int64())),
                        pa.array([int(f[0] - piece.bounds[r]) for f, r in zip(found, rows)], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64())], schema.names)
        return work

    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_bytes, window):
        part = source.mapInArrow(finder(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The per-document contract columns, from ``mark``."""
    m = mark(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), out="m")
    items = F.col("m.items")
    return m.select("doc_id", F.col("m.n_words").alias("n_words"), F.col("m.n_hit").alias("n_hit"),
                    F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
                    F.col("m.contaminated").alias("contaminated"),
                    *[F.col(f"m.{c}").alias(c) for c in ("longest_words", "longest_item", "longest_at")])
