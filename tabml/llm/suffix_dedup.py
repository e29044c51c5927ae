"""Repeated passages by sparse suffix arrays.

A passage is repeated if its ``min_words`` (50) consecutive words occur, verbatim, at two
places of the corpus.  Of the suffixes of a text (one per word) only those at minimiser
positions are kept: in every run of ``min_words`` words, the leftmost place whose first
``gram`` (10) words have the smallest hash.  Equal passages select equal places, so every
repeated passage holds a kept suffix in both its occurrences.

1. Kept suffixes go to the task of their gram; those whose gram is met once are dropped.
2. The texts with remaining suffixes emit them with the words they need: those to the right, up
   to the end of the last window they stand for, and those to the left, from the start of
   the first.
3. Each task sorts its suffixes by the words to the right, and by those to the left read
   backwards; the common prefixes of neighbours give, for any depth, the classes
   of suffixes that agree.  A match extends ``o`` words to the left and ``min_words - o`` to the
   right where both classes are equal; all ``o`` are tried, so none is missed
   because a closer neighbour stands between.
4. Spans are joined per document.  ``repeated`` covers every occurrence, ``cut`` all but the
   first one (smallest document id, then content, then place).

A gram met at over ``HOT`` places (a passage in a large part of all documents) is not gathered:
its suffixes send the hashes of the windows they stand for instead, each window once per batch
of a task (the batch's later occurrences are spans already), and equal windows meet in the
task of their hash.

Words are runs of non-white-space bytes.  The corpus is shuffled once as text (whole), and
what is repeated once more as word hashes.  No pairs are formed: work is a sort of the
suffixes, also for a passage in every document.

Defined cases: null and empty texts, and those of under ``min_words`` words, hold no passage;
rows with equal id and text are one document (they get the same spans, and do not count as
repeats of each other); null ids come last in the order of occurrence; passages repeated
within a document count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import BROADCAST_KEYS, ready, row_key, settled, shuffle_parts, stored, unused
from .words import SPACE, _powers, grams, mix, slices

MIN_WORDS = 50
GRAM = 10
#: Suffixes gathered in a task before they are sent on.
FLUSH = 400_000
#: Places of a gram above which its windows are compared by hash.
HOT = 1024


def minimisers(piece, min_words: int, gram: int):
    """Kept suffixes of a slice: (row, gram hash, word place, most, least), words
    hashed once.  A suffix stands for the windows that start ``least`` to ``most`` words before it."""
    piece.split(SPACE)
    h = piece.hashes()
    g = grams(h, gram)
    width = min_words - gram + 1
    n = len(h) - min_words + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return h, none, np.zeros(0, np.uint64), none, none, none
    low, at, reach = g, np.arange(len(g)), 1
    while 2 * reach <= width:
        less = low[reach:] < low[:-reach]
        low, at, reach = np.where(less, low[reach:], low[:-reach]), np.where(less, at[reach:], at[:-reach]), 2 * reach
    rest = width - reach
    less = low[rest:rest + n] < low[:n]
    at = np.where(less, at[rest:rest + n], at[:n])
    row = np.repeat(np.arange(len(piece)), np.diff(piece.bounds))[:n]
    start = np.flatnonzero(np.arange(n) + min_words <= piece.bounds[row + 1])
    if not len(start):
        return h, none, np.zeros(0, np.uint64), none, none, none
    place = at[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    p = place[first]
    return h, row[start[first]], g[p], p, p - start[first], p - start[last]


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray], widths: np.ndarray | None = None, wide: np.ndarray | None = None):
    """Rows of a batch as one binary per bucket and column."""
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    spans = list(zip(cut[:-1], cut[1:]))
    out = [pa.array(ids.astype(np.int32))]
    for x in columns.values():
        x = x[order]
        out.append(pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()))
    names = ["bucket", *columns]
    if wide is not None:
        ends = np.cumsum(widths)
        flat = wide[_ranges(ends[order] - widths[order], widths[order])]
        at = np.concatenate([[0], np.cumsum(widths[order])])
        out.append(pa.array([flat[at[a]:at[z]].tobytes() for a, z in spans], pa.binary()))
        names.append("words")
    return pa.RecordBatch.from_arrays(out, names)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of consecutive ranges."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def _bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Buckets of hashes; mixed anew, as minimisers are the small ones among all."""
    return ((mix(hashes + np.uint64(1)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in names]])


PLACES = T.StructType([T.StructField("key", T.LongType()), T.StructField("places", T.BinaryType())])
SPANS = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()),
                      T.StructField("repeated", T.BinaryType()), T.StructField("cut", T.BinaryType())])
JOINED = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()),
                       T.StructField("repeated", T.ArrayType(T.IntegerType())), T.StructField("cut", T.ArrayType(T.IntegerType()))])


def _retain(min_words: int, gram: int, parts: int):
    """Texts -> kept suffixes (gram, document, place) by gram."""
    def work(batches):
        held, count = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for piece in slices(batch.column(1)):
                _, row, g, p, _, _ = minimisers(piece, min_words, gram)
                held.append((g, keys[piece.first + row], (p - piece.bounds[row]).astype(np.int32)))
                count += len(g)
                if count >= FLUSH:
                    yield _sent(held, parts)
                    held, count = [], 0
        if count:
            yield _sent(held, parts)
    return settled(work)


def _sent(held, parts):
    g, key, place = (np.concatenate(x) for x in zip(*held))
    return _blobs(_bucket(g, parts), {"gram": g, "key": key, "place": place})


def _met(hot: int):
    """Suffixes whose gram is met at two places at least, by document; places of grams met at over
    ``hot`` ones below 0."""
    def work(batches):
        held = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32))
                for batch in batches for a, b, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        if not held:
            return
        g, key, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = order[np.lexsort((place[order], key[order], g[order]))]
        g, key, place = g[order], key[order], place[order]
        new = np.ones(len(g), bool)  # a repeated row is the same document
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        g, key, place = g[new], key[new], place[new]
        same = g[1:] == g[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(g) else np.zeros(0, bool)
        g, key, place = g[keep], key[keep], place[keep]
        _, of, count = np.unique(g, return_inverse=True, return_counts=True)
        place = np.where(count[of] > hot, ~place, place)  # below 0: a hot gram
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        names, first = np.unique(key, return_index=True)
        for i in range(0, len(names), 10_000):
            cut = [*first[i:i + 10_001].tolist()]
            if i + 10_000 >= len(names):
                cut.append(len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[i:i + 10_000]), pa.array([place[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())], ["key", "places"])
    return settled(work)


def windows(h: np.ndarray, starts: np.ndarray, min_words: int) -> np.ndarray:
    """Hash of the ``min_words`` words from each start on."""
    up, down = _powers(len(h) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:len(h)], dtype=np.uint64)])
    return mix((total[starts + min_words] - total[starts]) * down[starts])


def _extend(min_words: int, gram: int, parts: int):
    """Texts with places -> their suffixes with the words around, by gram; of hot grams the
    windows' hashes, by hash."""
    def work(batches):
        held, count, hot, heat = [], 0, [], 0
        for batch in batches:
            keys, docs = batch.column(0).to_numpy(), batch.column(1)
            known, doc = np.asarray(docs.is_valid()), docs.fill_null(0).to_numpy()
            lists = batch.column(3)
            for piece in slices(batch.column(2)):
                h, row, g, p, most, least = minimisers(piece, min_words, gram)
                place = p - piece.bounds[row]
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                keep, warm = np.zeros(len(row), bool), np.zeros(len(row), bool)
                for i in range(len(piece)):
                    a, z = cuts[i], cuts[i + 1]
                    if a < z:
                        wanted = np.concatenate([np.frombuffer(x, np.int32) for x in lists[piece.first + i].as_py()])
                        keep[a:z] = np.isin(place[a:z], wanted)
                        warm[a:z] = np.isin(place[a:z], ~wanted)
                if warm.any():
                    n = (most - least + 1)[warm]
                    start, of = _ranges((p - most)[warm], n), np.repeat(row[warm], n)
                    at = piece.first + of
                    hot.append((windows(h, start, min_words), keys[at], doc[at], known[at], (start - piece.bounds[of]).astype(np.int32)))
                    heat += len(start)
                    if heat >= FLUSH:
                        yield from _sent_windows(hot, min_words, parts)
                        hot, heat = [], 0
                row, g, p, most, least, place = (x[keep] for x in (row, g, p, most, least, place))
                short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                widths = most + min_words - least
                words = short[_ranges(p - most, widths)]
                at = piece.first + row
                held.append((g, keys[at], doc[at], known[at], place.astype(np.int32), most.astype(np.uint8), least.astype(np.uint8), widths, words))
                count += len(g)
                if count >= FLUSH // 4:
                    yield _packed(held, parts)
                    held, count = [], 0
        if count:
            yield _packed(held, parts)
        if heat:
            yield from _sent_windows(hot, min_words, parts)
    return settled(work)


def _full(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with all columns of the exchange, those it lacks null."""
    kinds = {"bucket": pa.int32(), "span_key": pa.int64(), "span_doc": pa.int64()}
    names = ["bucket", *EXTENDED, "span_key", "span_doc", "spans"]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) if n in batch.schema.names else
                                       pa.nulls(batch.num_rows, kinds.get(n, pa.binary())) for n in names], names)


def _packed(held, parts):
    g, key, doc, known, place, most, least, widths, words = (np.concatenate(x) for x in zip(*held))
    return _full(_blobs(_bucket(g, parts), {"key": key, "doc": doc, "known": known, "place": place, "most": most, "least": least}, widths, words))


def _sent_windows(hot, min_words, parts):
    """The first occurrence of every window in the batch, and the spans of the others."""
    h, key, doc, known, start = (np.concatenate(x) for x in zip(*hot))
    order = np.lexsort((start, key, doc, ~known, h))
    h, key, doc, known, start = (x[order] for x in (h, key, doc, known, start))
    new = np.ones(len(h), bool)  # a repeated row is the same document
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1])
    h, key, doc, known, start = (x[new] for x in (h, key, doc, known, start))
    first = np.concatenate([[True], h[1:] != h[:-1]])
    many = np.concatenate([h[1:] == h[:-1], [False]])[first]
    yield _full(_blobs(_bucket(h[first], parts), {"key": key[first], "doc": doc[first], "known": known[first], "place": start[first],
                                                  "most": many.astype(np.uint8), "words": h[first]}))
    names, docs, spans = _spans_by_key(key[~first], doc[~first], known[~first], start[~first], start[~first] + np.int32(min_words))
    if len(names):
        yield _full(pa.RecordBatch.from_arrays([pa.array((names.view(np.uint64) % np.uint64(parts)).astype(np.int32)), pa.array(names), docs,
                                                pa.array(spans, pa.binary())], ["bucket", "span_key", "span_doc", "spans"]))


def _spans_by_key(key, doc, known, start, end):
    """Keys, their documents and their spans as (start, end) pairs in a binary."""
    order = np.lexsort((start, key))
    names, first = np.unique(key[order], return_index=True)
    pairs = np.stack([start[order], end[order]], 1).astype(np.int32)
    cut = [*first.tolist(), len(order)]
    spans = [np.array(_merged(pairs[a:z]), np.int32).tobytes() for a, z in zip(cut[:-1], cut[1:])]
    return names, pa.array(doc[order[first]], mask=~known[order[first]]), spans


EXTENDED = ("key", "doc", "known", "place", "most", "least", "words")
_KINDS = (np.int64, np.int64, np.bool_, np.int32, np.uint8, np.uint8, np.uint32)
EXCHANGED = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in EXTENDED],
                          T.StructField("span_key", T.LongType()), T.StructField("span_doc", T.LongType()), T.StructField("spans", T.BinaryType())])


def _sorted_prefixes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the length of the prefix each shares with the one before."""
    n, width = matrix.shape
    keys = np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * width}").ravel()
    order = np.argsort(keys, kind="stable")
    common = np.zeros(n, np.int64)
    step = 1 << 16
    for i in range(1, n, step):
        a, b = matrix[order[i - 1:i - 1 + step]], matrix[order[i:i + step]]
        differ = a[:len(b)] != b
        common[i:i + step] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def matches(right: np.ndarray, left: np.ndarray, most: np.ndarray, least: np.ndarray, min_words: int):
    """For each suffix, in order of occurrence: the largest and smallest ``o`` whose window occurs
    elsewhere too, and the same for windows that occurred before (-1: none)."""
    n = len(most)
    by_right, common_right = _sorted_prefixes(right)
    by_left, common_left = _sorted_prefixes(left)
    out = np.full((4, n), -1, np.int64)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(most.max()) + 1 if n else 0):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) < 2:
            continue
        of_right[by_right] = np.cumsum(common_right < min_words - o)
        of_left[by_left] = np.cumsum(common_left < o) if o else 0
        key = of_right[rows] * (n + 1) + of_left[rows]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = rows[order[1:][same]]
        shared = np.concatenate([again, rows[order[:-1][same]]])
        for first, found in ((0, shared), (2, again)):
            out[first, found] = o
            unset = found[out[first + 1, found] < 0]
            out[first + 1, unset] = o
    return out


def _compare(min_words: int):
    """Suffixes and windows of a bucket -> spans of words by document."""
    def spans(names, docs, repeated, cut):
        for i in range(0, len(names), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[i:i + 10_000]), docs[i:i + 10_000], pa.array(repeated[i:i + 10_000], pa.binary()),
                                              pa.array(cut[i:i + 10_000], pa.binary())], SPANS.names)

    def work(batches):
        held, hot = [], []
        for batch in batches:
            done = batch.filter(batch.column(10).is_valid())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(8), done.column(9), done.column(10), done.column(10)], SPANS.names)
            for blob in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                if blob[5] is not None:
                    held.append([np.frombuffer(x, k) for x, k in zip(blob, _KINDS)])
                elif blob[0] is not None:
                    hot.append([np.frombuffer(x, k) for x, k in zip((*blob[:5], blob[6]), (*_KINDS[:5], np.uint64))])
        if hot:
            key, doc, known, start, many, h = (np.concatenate(x) for x in zip(*hot))
            hot.clear()
            order = np.lexsort((start, key, doc, ~known, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (key[order[1:]] != key[order[:-1]]) | (start[order[1:]] != start[order[:-1]])
            order = order[new]
            key, doc, known, start, many, h = (x[order] for x in (key, doc, known, start, many, h))
            again = np.concatenate([[False], h[1:] == h[:-1]])
            met = again | np.concatenate([h[1:] == h[:-1], [False]]) | (many > 0)
            for rows, both in ((met & ~again, False), (again, True)):
                names, docs, found = _spans_by_key(key[rows], doc[rows], known[rows], start[rows], start[rows] + np.int32(min_words))
                yield from spans(names, docs, found, found if both else [b""] * len(found))
        if not held:
            return
        key, doc, known, place, most, least, words = (np.concatenate(x) for x in zip(*held))
        held.clear()
        most, least = most.astype(np.int64), least.astype(np.int64)
        width = most + min_words - least
        start = np.cumsum(width) - width
        order = np.lexsort((place, key, doc, ~known))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
        order = order[new]
        key, doc, known, place, most, least, start = (x[order] for x in (key, doc, known, place, most, least, start))
        deep = int(most.max()) + 1
        right, left = np.zeros((len(order), min_words), np.uint32), np.zeros((len(order), deep), np.uint32)
        for d in range(min_words):
            has = min_words - least > d
            right[has, d] = words[start[has] + most[has] + d]
        for d in range(deep):
            has = most > d
            left[has, d] = words[start[has] + most[has] - 1 - d]
        o = matches(right, left, most, least, min_words)
        for a, both in ((0, False), (2, True)):
            rows = o[a] >= 0
            names, docs, found = _spans_by_key(key[rows], doc[rows], known[rows], (place - o[a])[rows], (place - o[a + 1])[rows] + min_words)
            yield from spans(names, docs, [b""] * len(found) if both else found, found if both else [b""] * len(found))
    return settled(work)


def _union(blobs: list[bytes]) -> list[int]:
    return _merged(np.concatenate([np.frombuffer(b, np.int32) for b in blobs]).reshape(-1, 2))


def _merged(pairs: np.ndarray) -> list[int]:
    """Union of (start, end) pairs, flat."""
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > ends[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(pairs) - 1]])
    return np.stack([pairs[first, 0], ends[last]], 1).ravel().tolist()


def _join_spans(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array([_union(x) for x in batch.column(k).to_pylist()], pa.list_(pa.int32())) for k in (2, 3)]],
            JOINED.names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document that holds a repeated passage: key (``row_key`` of id and text), doc (id),
    repeated and cut (flat lists of word spans: start, end, start, end, ...)."""
    ready(docs.sparkSession)
    if not 1 <= gram <= min_words <= 255:
        raise ValueError("1 <= gram <= min_words <= 255")
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body"))
    parts = shuffle_parts(source)
    places = (source.select("key", "body").mapInArrow(_retain(min_words, gram, parts), _schema("gram", "key", "place"))
              .repartitionById(parts, F.col("bucket")).mapInArrow(_met(hot), PLACES)
              .groupBy("key").agg(F.collect_list("places").alias("places")))
    return (source.join(places.hint("shuffle_hash"), "key")
            .mapInArrow(_extend(min_words, gram, parts), EXCHANGED)
            .repartitionById(parts, F.col("bucket")).mapInArrow(_compare(min_words), SPANS)
            .groupBy("key").agg(F.first("doc").alias("doc"), F.collect_list("repeated").alias("repeated"), F.collect_list("cut").alias("cut"))
            .mapInArrow(_join_spans, JOINED))


def _cut(batches):
    for batch in batches:
        texts, spans, out = batch.column(1), batch.column(2).to_pylist(), []
        for piece in slices(texts):
            piece.split(SPACE)
            for i in range(len(piece)):
                row = piece.first + i
                if not spans[row]:
                    out.append(texts[row].as_py())
                    continue
                a, z = piece.bounds[i], piece.bounds[i + 1]
                starts = np.append(piece.starts[a:z], piece.offsets[i + 1])
                data, at, kept = piece.buf, piece.offsets[i], []
                for s, e in zip(spans[row][::2], spans[row][1::2]):
                    kept.append(data[at:starts[s]].tobytes())
                    at = starts[e]
                kept.append(data[at:piece.offsets[i + 1]].tobytes())
                out.append(b"".join(kept).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "body"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts but for their first occurrence;
    a document of which nothing but white space is left goes."""
    mark, names = unused(docs, "__key"), docs.columns
    spans = stored(repeated_spans(docs, id_col, text_col, **options).where(F.size("cut") > 0)
                   .select(F.col("key").alias(mark), F.col("cut").alias("__cut")), "suffix-cut")
    at = names.index(text_col)
    # few documents are cut: a small table of their keys beside the texts, and only their texts move (all of them if there are many)
    keys, few = spans.select(mark), spans.count() <= BROADCAST_KEYS
    keyed = docs.withColumn(mark, row_key(id_col, text_col))
    whole = keyed.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), mark, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    packed = (keyed.join(F.broadcast(keys), mark, "left_semi") if few else keyed).select(
        mark, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("body", T.StringType())])
    done = packed.join(spans.hint("shuffle_hash"), mark).select("row", "body", "__cut").mapInArrow(_cut, schema)
    rest = done.where(F.col("body").rlike("[^\\x20\\x09-\\x0D]")).select(
        *[F.col("body").alias(c) if i == at else F.col(f"row.`{c}`").alias(c) for i, c in enumerate(names)])
    return whole.unionByName(rest)


def digest(docs: DataFrame) -> DataFrame:
    """Per document with a repeated passage: counts of repeated and cut words and their spans."""
    def text(c):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(c) - 1, F.lit(2)), lambda i: F.concat_ws("-", F.get(c, i), F.get(c, i + 1))), ",")

    def words(c):
        odd = F.aggregate(F.transform(c, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return odd

    s = repeated_spans(docs.select("doc_id", "text"))
    return s.select(F.col("doc").alias("doc_id"), words(F.col("repeated")).alias("n_repeated"), words(F.col("cut")).alias("n_cut"),
                    text(F.col("repeated")).alias("repeated_spans"),
                    F.when(F.size("cut") > 0, text(F.col("cut"))).otherwise("").alias("cut_spans"))
