"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is parsed greedily into the
longest phrases that occur in the language's labelled text: the automaton is followed until a letter
has no transition, which ends the phrase, and starts anew.  ``c`` phrases over a reference of
``N`` letters estimate the cross entropy as ``c * log2(N) / letters``; the language with the least
entropy wins (ties: smaller name), and the score is its weight among ``2 ** (-SHARPNESS * entropy)``.

Every letter of a reference is a symbol, so alphabets are of any size.  Letters are lower-cased, and any run of other characters is one separator.  All stretches of
all texts in a slice step through the automaton at once as NumPy arrays; whole texts are parsed, in
stretches of ``STRETCH`` letters.

Learning takes the whole texts of a bounded sample of rows: of every language the ``documents`` distinct labelled
texts with letters whose hash is smallest, however long they are and however many languages there are.  A language's
text is dealt into blocks of ``BLOCK`` characters, each with an automaton of its own that one task builds, so a
task's memory follows the block; a phrase ends where all blocks have ended it, so it is the longest of any block.
Blocks of one text overlap by ``OVERLAP`` characters.  Transitions are packed into one array (about 32 bytes a
letter), and the automata of all languages are one broadcast.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without labelled
text everything is; repeated documents get equal results; languages are any non-null labels.
Other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .frames import ready

DOCUMENTS = 48
STRETCH = 512
#: Characters of labelled text in an automaton, and those that it shares with the next one of the same text.
BLOCK = 1 << 19
OVERLAP = 256
SHARPNESS = 8.0
#: Characters parsed at once.
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(sys.maxunicode + 1)])


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with runs of non-letters as one space; the texts'
    bounds; and their numbers of letters."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = bounds[:-1][bounds[:-1] < np.diff(bounds).cumsum()]
    keep[starts] = True
    codes = np.where(letter, codes, 32)[keep]
    total = np.concatenate([[0], np.cumsum(keep)])
    count = np.concatenate([[0], np.cumsum(letter)])
    return codes, total[bounds], np.diff(count[bounds])


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a sequence: the transitions (symbol to state) of every state; state 0 is the root."""
    size = 2 * len(symbols) + 2
    moves: list[dict[int, int]] = [{}]
    link, length = [-1] * size, [0] * size
    last = 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link[twin], length[twin] = link[q], length[p] + 1
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def packed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """An automaton over symbols 1 to ``width - 1`` without its root: the state after each first symbol, and the
    transitions.  A state is called by a place: its transition by symbol s is the entry at place + s, if the high half
    of that is the state; the low half is the next one.  Symbol 0 leads from the start to a state that nothing follows."""
    rng = np.random.default_rng(1)
    degree = np.array([len(m) for m in moves])
    degree[0] = 0
    n = int(degree.sum())
    symbol = np.fromiter(chain.from_iterable(m.keys() for m in moves[1:]), np.int64, n)
    to = np.fromiter(chain.from_iterable(m.values() for m in moves[1:]), np.int64, n)
    begin = np.cumsum(degree) - degree
    size = 2 * n + len(moves) + 64
    place = np.full(len(moves), -1, np.int64)
    owner, named = np.full(size + width, -1, np.int64), np.full(size, -1, np.int64)
    # states of many transitions first, while there is room; place 0 (state 0) stays the one that nothing follows
    named[0] = 0
    place[0] = 0
    kinds = np.frexp(degree)[1]
    for kind in range(int(kinds.max()), -1, -1):
        waiting = np.flatnonzero((kinds == kind) & (place < 0))
        tries = 0
        while len(waiting):
            tries += 1
            if tries % 64 == 0:
                owner, named = (np.concatenate([x, np.full(size, -1, np.int64)]) for x in (owner, named))
                size *= 2
            at = rng.integers(1, size, len(waiting))
            k = degree[waiting]
            edge = np.repeat(begin[waiting] - np.cumsum(k) + k, k) + np.arange(k.sum())
            one = np.repeat(np.arange(len(waiting)), k)
            slot = at[one] + symbol[edge]
            fine = named[at] < 0
            fine[one[owner[slot] >= 0]] = False
            # where two ask for the same, the one that is written last may have it
            one, slot, asks = one[fine[one]], slot[fine[one]], np.flatnonzero(fine)
            named[at[asks]] = waiting[asks]
            owner[slot] = waiting[one]
            won = np.zeros(len(waiting), bool)
            won[asks] = named[at[asks]] == waiting[asks]
            won[one[owner[slot] != waiting[one]]] = False
            lost = asks[~won[asks]]
            mine = named[at[lost]] == waiting[lost]
            named[at[lost[mine]]] = -1
            beaten = ~won[one] & (owner[slot] == waiting[one])
            owner[slot[beaten]] = -1
            place[waiting[won]] = at[won]
            waiting = waiting[~won]
    table = np.full(len(owner), -1, np.int64)
    source = np.repeat(np.arange(len(moves)), degree)
    table[place[source] + symbol] = place[source] << 32 | place[to]
    first = np.zeros(width, np.int64)
    for s, state in moves[0].items():
        first[s] = place[state]
    return first, table


class Block:
    """A block of a language's text: its letters' symbols, its automaton and its length."""

    def __init__(self, text: str):
        codes, _, _ = letters_of([text])
        # symbol 0: letters that the block does not have; each one that it has is a symbol
        self.known, self.length = np.unique(codes), len(codes)
        # a letter that the block does not have is a phrase by itself: a state that nothing follows
        self.first, self.table = packed(automaton(self.symbols(codes).tolist()), len(self.known) + 1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return self.map().take(codes, mode="clip")

    def map(self) -> np.ndarray:
        """Symbol of every code point up to the highest known one, and 0 for those above."""
        out = np.zeros(int(self.known.max(initial=0)) + 2, np.int32)
        out[self.known] = np.arange(1, len(self.known) + 1)
        return out


class Reference:
    """One language: the blocks of its text (a text given whole is one)."""

    def __init__(self, name: str, blocks: list[Block] | str):
        self.name, self.blocks = name, [Block(blocks)] if isinstance(blocks, str) else blocks
        self.size = max(2, sum(b.length for b in self.blocks))


def phrases(grids: list[np.ndarray], live: np.ndarray, blocks: list[Block]) -> np.ndarray:
    """Phrases of each column of a grid (for each block, in its symbols; columns by falling length, ``live[t]`` of
    them are longer than ``t``)."""
    count = np.ones(grids[0].shape[1], np.int32)
    states = [b.first.take(g[0]) for b, g in zip(blocks, grids)]
    for t in range(1, len(live)):
        k = live[t]
        steps = []
        for b, grid, state in zip(blocks, grids, states):
            to = b.table.take(state[:k] + grid[t, :k])
            steps.append((to, to >> 32 != state[:k]))
        ended = steps[0][1]
        for _, other in steps[1:]:
            ended = ended & other
        count[:k] += ended
        for (to, stop), b, grid, state in zip(steps, blocks, grids, states):
            # a block that has ended waits in place 0, that nothing follows, until all have
            state[:k] = np.where(ended, b.first.take(grid[t, :k]), np.where(stop, 0, to & 0xFFFFFFFF))
    return count


def parse(codes: np.ndarray, bounds: np.ndarray, references: list[Reference], maps: list[list[np.ndarray]]) -> np.ndarray:
    """Phrases of each text under each language."""
    n = np.diff(bounds)
    pieces = -(-n // STRETCH)
    owner = np.repeat(np.arange(len(n)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(bounds[:-1], pieces) + place * STRETCH
    length = np.minimum(STRETCH, bounds[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    out = np.zeros((len(n), len(references)), np.int64)
    if not len(owner):
        return out
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(steps), "left")
    at = np.minimum(start[None, :] + np.arange(steps)[:, None], len(codes) - 1)
    for k, (r, of) in enumerate(zip(references, maps)):
        grids = [m.take(codes, mode="clip")[at] for m in of]
        out[:, k] = np.bincount(owner, phrases(grids, live, r.blocks), len(n)).astype(np.int64)
    return out


class Judge:
    def __init__(self, references: list[Reference]):
        self.references = references
        self.maps = [[b.map() for b in r.blocks] for r in references]
        self.bits = np.log2([r.size for r in references])

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names = [r.name for r in self.references]
        codes, bounds, letters = letters_of(texts)
        none = letters == 0
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy = parse(codes, bounds, self.references, self.maps) * self.bits / np.maximum(letters, 1)[:, None]
        best = entropy.argmin(1)
        weight = np.exp2(-SHARPNESS * (entropy - entropy.min(1, keepdims=True)))
        score = 1 / weight.sum(1)
        return [UNKNOWN if x else names[b] for x, b in zip(none, best)], np.where(none, 0.0, score)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where=None,
          documents: int = DOCUMENTS, block: int = BLOCK) -> list[Reference]:
    """Automata of the languages, sorted by name.  ``where``: a condition on the column ``id``."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), F.col(f"`{lang_col}`").alias("name")).where(
        "name IS NOT NULL AND body IS NOT NULL")
    if where is not None:
        known = known.where(where)
    ready(docs.sparkSession)
    known = known.where(F.col("body").rlike("\\p{L}")).withColumn("hash", F.xxhash64("body", "name"))
    sizes = known.groupBy("name").agg(F.count_distinct("hash").alias("n"))
    draw = F.pmod("hash", F.lit(1 << 32)) / float(1 << 32)
    # about four times as many as needed, so that hardly any language gets fewer; copies have equal draws
    drawn = known.join(F.broadcast(sizes), "name").withColumn("draw", draw).where(F.col("draw") < F.lit(4.0 * documents) / F.col("n"))
    distinct = drawn.groupBy("name", "draw", "body").agg(F.count("*"))
    first = distinct.selectExpr("name", "body", "row_number() OVER (PARTITION BY name ORDER BY draw, body) AS k").where(F.col("k") <= documents)

    size = F.length("body")
    pieces = first.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")))).select(
        "name", "k", "piece", F.substring("body", F.col("piece") * block + 1, F.lit(block + OVERLAP)).alias("body"))
    # whole texts fill a block up together; a longer one has blocks of its own
    before = F.sum(F.least(F.length("body"), F.lit(block))).over(Window.partitionBy("name").orderBy("k", "piece"))
    pieces = pieces.withColumn("block", F.floor((before - 1) / block))

    def build(rows: pa.Table) -> pa.Table:
        texts = rows.sort_by([("k", "ascending"), ("piece", "ascending")])["body"].to_pylist()
        return pa.table({"name": rows["name"][:1], "block": rows["block"][:1], "model": pa.array([pickle.dumps(Block(" ".join(texts)))], pa.binary())})

    found = pieces.groupBy("name", "block").applyInArrow(build, "name string, block long, model binary").collect()  # the blocks' automata
    blocks: dict[str, list[Block]] = {}
    for r in sorted(found, key=lambda r: (r.name, r.block)):
        blocks.setdefault(r.name, []).append(pickle.loads(r.model))
    return [Reference(name, of) for name, of in sorted(blocks.items())]


def detect(docs: DataFrame, references: list[Reference], text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(references)
    names, at = docs.columns, docs.columns.index(text_col)

    def work(batches):
        judge = Judge(shared.value)
        for batch in batches:
            texts, found, scores = batch.column(at), [], []
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            ends, i = np.cumsum(lengths, dtype=np.int64), 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
                a, b = judge([t or "" for t in texts.slice(i, j - i).to_pylist()])
                found += a
                scores.append(b)
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                                             [*batch.schema.names, "lang", "score"])

    df = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*df.schema.fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(work, schema).toDF(*names, out, score)


def held_out(id_col: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def digest(docs: DataFrame) -> DataFrame:
    """The per-document contract columns."""
    references = learn(docs.select("doc_id", "text", "lang"), where=~held_out("id"))
    found = detect(docs.select("doc_id", "text"), references)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
