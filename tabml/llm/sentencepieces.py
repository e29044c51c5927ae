"""Offset-preserving SentencePiece encoding and decoding.

1. *Normalisation* (``Normaliser``): at every place the longest prefix found in the model's compiled
   character map is replaced, or one character is kept; white space is escaped and the dummy
   prefix added as the model says.  Every byte of the result keeps the source byte it
   stems from.
2. *Segmentation* of the normalised text by the sentencepiece library, its own normaliser
   switched off.  Between two characters that stand side by side in no piece of the
   vocabulary no piece can reach across, so very long texts are segmented in stretches
   cut at such places, with the same result in bounded memory.
3. *Projection*: the pieces' ends in the normalised text go through the alignment, which gives
   each piece its span of source bytes.

Ids equal those of the library on the whole text.  Decoding joins the pieces, byte pieces as
UTF-8, without the dummy prefix.

Whole texts are encoded row by row inside Arrow batches; nothing is shuffled, and the model
(under 1 MB) is the only broadcast.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty
text; strings like ``<s>`` in a text are ordinary characters; invalid bytes decode to
U+FFFD, one each.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ready, settled

SPACE = "▁"
#: Characters that are segmented at once.
STRETCH = 1 << 17
#: Rows of a result batch.
ROWS = 500

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; bytes, or an int."""
    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            size, i = varint(i)
            value, i = data[i:i + size], i + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class Normaliser:
    """Text normalisation with source alignment, from a model's normaliser settings: the longest mapped prefixes of
    all places at once, over byte arrays.  A model without a map has no byte that begins a prefix."""

    def __init__(self, settings: bytes, symbols: list[bytes] = (), suffix: bool = False):
        known = dict(_fields(settings))
        mapped = known.get(2, b"")
        self.prefix = bool(known.get(3, 1))
        self.squeeze = bool(known.get(4, 1))
        self.escape = bool(known.get(5, 1))
        self.suffix = suffix
        size = int.from_bytes(mapped[:4], "little")
        #: the map's double array, and its targets, each ended by a zero
        self.units = np.frombuffer(mapped, "<u4", size // 4, 4).astype(np.int64) if size else np.zeros(1, np.int64)
        self.targets = np.frombuffer(mapped[4 + size:] + b"\0", np.uint8)
        self.ends = np.flatnonzero(self.targets == 0)
        first = np.arange(256)
        node = _offset(self.units[:1]) ^ first
        #: bytes that begin a mapped prefix
        self.heads = (first > 0) & (self.units[np.minimum(node, len(self.units) - 1)] & 0x800000FF == first) & (node < len(self.units))
        ordered = sorted(symbols, key=len, reverse=True)
        self.symbols = re.compile(b"(?=(" + b"|".join(map(re.escape, ordered)) + b"))") if ordered else None

    def longest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every place with a mapped prefix, the bytes of the longest one, and its target's place."""
        at = np.flatnonzero(self.heads[data])
        size, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        walking, node, depth = np.arange(len(at)), np.repeat(_offset(self.units[:1]), len(at)), 0
        while len(walking):
            byte = data[at[walking] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            on = (byte > 0) & (node < len(self.units)) & (unit & 0x800000FF == byte)
            walking, node, unit = walking[on], (node ^ _offset(unit))[on], unit[on]
            depth += 1
            leaf = unit >> 8 & 1 == 1
            size[walking[leaf]] = depth
            value[walking[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
            inside = at[walking] + depth < len(data)
            walking, node = walking[inside], node[inside]
        found = size > 0
        return at[found], size[found], value[found]

    def replaced(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parsed from the left, longest prefix first: the bytes after replacement, their source bytes, and where
        a replacement's bytes, or a byte of its own, begin."""
        at, size, value = self.longest(data)
        if self.symbols:  # a symbol stands for itself, whatever the map says
            own = [(m.start(), len(m.group(1))) for m in self.symbols.finditer(data.tobytes())]
            rest = ~np.isin(at, [p for p, _ in own])
            at = np.concatenate([at[rest], np.array([p for p, _ in own], np.int64)])
            size = np.concatenate([size[rest], np.array([n for _, n in own], np.int64)])
            value = np.concatenate([value[rest], np.full(len(own), -1)])
            order = np.argsort(at)
            at, size, value = at[order], size[order], value[order]
        if not len(at):
            return data, np.arange(len(data)), np.ones(len(data), bool)
        if (at[1:] < (at + size)[:-1]).any():  # prefixes that begin inside one already taken are none
            following, taken, i = np.searchsorted(at, at + size).tolist(), [], 0
            while i < len(at):
                taken.append(i)
                i = following[i]
            at, size, value = at[taken], size[taken], value[taken]
        at, size, value = at[value >= 0], size[value >= 0], value[value >= 0]
        count = np.ones(len(data), np.int64)
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        count[np.cumsum(edge[:-1]) > 0] = 0
        long = self.ends[np.searchsorted(self.ends, value)] - value
        count[at] = long
        source = np.repeat(np.arange(len(data)), count)
        out = data[source]
        start = (np.cumsum(count) - count)[at]
        begins = np.ones(len(out), bool)
        step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        here = np.repeat(start, long) + step
        out[here] = self.targets[np.repeat(value, long) + step]
        begins[here] = step == 0
        return out, source, begins

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes (and its end)."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        end = len(data)
        if not end:
            return "", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        out, source, begins = self.replaced(data)
        lead = 0
        if self.squeeze:
            blank = out == 32
            # spaces that a replacement begins with go if a space, or nothing, comes before it
            solid = np.cumsum(~blank)
            unit = np.maximum.accumulate(np.where(begins, np.arange(len(out)), 0))
            before = np.concatenate([[True], blank])[unit]
            dropped = blank & before & (solid == np.concatenate([[0], solid])[unit])
            single = begins & np.append(begins[1:], True) & blank
            n = int(np.argmin(np.append(single, False)))
            lead = int(source[n]) if n < len(out) else end
            if lead == end:
                return "", np.array([end])
            out, source = out[~dropped], source[~dropped]
        normal = out.tobytes().replace(b" ", mark)
        align = np.repeat(source, np.where(out == 32, len(mark), 1))
        if self.prefix and not self.suffix:
            normal, align = mark + normal, np.concatenate([np.full(len(mark), lead), align])
        if self.squeeze:
            kept = len(normal)
            while normal.endswith(mark, 0, kept):
                kept -= len(mark)
            if kept < len(normal):
                end = int(align[kept])
                normal, align = normal[:kept], align[:kept]
        if self.prefix and self.suffix:
            normal, align = normal + mark, np.concatenate([align, np.full(len(mark), end)])
        return normal.decode("utf-8"), np.append(align, end)


def _offset(units: np.ndarray) -> np.ndarray:
    """Where the children of a double array's units begin."""
    return units >> 10 << ((units & 0x200) >> 6)


class Model:
    """A model file's pieces, normaliser, segmentation and decoding."""

    def __init__(self, data: bytes):
        import sentencepiece

        pieces, settings, trainer = [], b"", b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode("utf-8"), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = value
            elif number == 3:
                settings = value
        train = dict(_fields(trainer))
        self.pieces, self.kinds = [p for p, _ in pieces], [k for _, k in pieces]
        whole = [p for p, k in pieces if k in (NORMAL, USER)]
        self.normalise = Normaliser(settings, [p.encode() for p, k in pieces if k == USER], bool(train.get(24, 0)))
        # the same model with its own normaliser off: later fields override earlier ones
        off = bytes([0x0A, 8]) + b"identity" + bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 1])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data + bytes([0x1A, len(off)]) + off)
        self.bytes_of = [int(p[3:5], 16) if k == BYTE else -1 for p, k in pieces]
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in pieces], np.int64)
        self.names = [str(i) for i in range(len(pieces))]
        unknown = train.get(44, " ⁇ ".encode()).decode("utf-8")
        self.surface = ["" if k == CONTROL else unknown if k == UNKNOWN else p.replace(SPACE, " ") for p, k in pieces]
        self.first_byte = {i for i, k in enumerate(self.kinds) if k == BYTE}
        self.inside = {a + b for p in whole for a, b in zip(p, p[1:])}

    def stretches(self, normal: str) -> list[str]:
        """Parts of about ``STRETCH`` characters, cut where no piece can reach across."""
        out, at = [], 0
        while len(normal) - at > STRETCH:
            end = at + STRETCH
            while end < len(normal) and normal[end - 1:end + 1] in self.inside:
                end += 1
            out.append(normal[at:end])
            at = end
        return [*out, normal[at:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source byte spans (starts, ends) of the pieces."""
        normal, align = self.normalise(text)
        ids, sizes = [], []
        for part in self.stretches(normal) if normal else []:
            found = np.array(self.library.encode(part, out_type=int), np.int32)
            length = self.sizes[found]
            if length.sum() != len(part.encode("utf-8")):  # unknown pieces cover what the model has no piece for
                spans = self.library.encode(part, out_type="immutable_proto").pieces
                length = np.diff([0, *[len(part[:p.end].encode("utf-8")) for p in spans]])
            ids.append(found)
            sizes.append(length)
        if not ids:
            return (np.zeros(0, np.int32),) * 3
        places = align[np.concatenate([[0], np.cumsum(np.concatenate(sizes))])].astype(np.int32)
        return np.concatenate(ids), places[:-1], places[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix."""
        surface = self.surface
        if self.first_byte.isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                b = self.bytes_of[i]
                if b >= 0:
                    held.append(b)
                    continue
                if held:
                    parts.append(_utf8(bytes(held)))
                    held.clear()
                parts.append(surface[i])
            parts.append(_utf8(bytes(held)))
            text = "".join(parts)
        n = self.normalise
        if n.prefix or n.squeeze:
            real = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if real is not None and self.kinds[real] != BYTE and self.pieces[real].startswith(SPACE):
                text = text[1:]
                if n.squeeze:
                    text = text.lstrip(" ")
        return text


def _utf8(data: bytes) -> str:
    """Valid characters as they are, every other byte as U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            try:
                out.append(data[i:i + size].decode("utf-8"))
                i += size
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(2)
def model_of(data: bytes) -> Model:
    return Model(data)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
           T.StructField("ends", T.ArrayType(T.IntegerType()))]


def encoded_batches(model: Model, batches, at: int):
    """Batches with three columns more: ids, starts, ends of column ``at``."""
    def lists(parts):
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts)))

    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            done = [model.encode(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[lists(x) for x in zip(*done)]],
                                             [*batch.schema.names, "ids", "starts", "ends"])


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with array columns ids, starts and ends (source bytes of every piece)."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    names, at = docs.columns, docs.columns.index(text_col)
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return df.mapInArrow(settled(lambda batches: encoded_batches(model_of(shared.value), batches, at)),
                         T.StructType([*df.schema.fields, *ENCODED])).toDF(*names, "ids", "starts", "ends")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the ids."""
    ready(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))
    names, at = encoded.columns, encoded.columns.index(ids_col)

    def work(batches):
        model = model_of(shared.value)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "d"])

    df = encoded.toDF(*[f"c{i}" for i in range(len(names))])
    return df.mapInArrow(settled(work), T.StructType([*df.schema.fields, T.StructField("d", T.StringType())])).toDF(*names, out)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
          T.StructField("decoded_sha256", T.StringType()), T.StructField("covered_bytes", T.LongType())]


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number and digest of the ids, the digest of their decoding, and the source bytes
    that the pieces' spans cover, all from the encoder's output batches in the task that made them."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))

    def work(batches):
        model = model_of(shared.value)
        names = model.names
        for batch in encoded_batches(model, batches, 1):
            rows = batch.column(2).to_pylist()
            starts, ends, edges = batch.column(3).flatten().to_numpy(), batch.column(4).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            covered = np.concatenate([[0], np.cumsum(ends - starts, dtype=np.int64)])[edges]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(",".join([names[i] for i in r]).encode()).hexdigest() for r in rows]),
                 pa.array([hashlib.sha256(model.decode(r).encode("utf-8")).hexdigest() for r in rows]),
                 pa.array(np.diff(covered))], ["id", *[f.name for f in DIGEST]])

    return source.mapInArrow(work, T.StructType([source.schema["id"], *DIGEST])).withColumnRenamed("id", id_col)
