"""Sharding, chat formatting, nearest neighbours, queries and the pipeline."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabml.llm import chat, nearest, quality, sharding, subword
from tabml.llm.queries import ORACLE, QUERIES
from llm_helpers import frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_keep_copies_together(spark, law):
    texts = [None, None, ""] + ["hot"] * 120 + [f"t{i % 40} " + "y" * (i % 40) for i in range(160)] + [f"u{i} " + "x" * (i % 70) for i in range(400)]
    rows = sharding.shard_documents(frame(spark, texts, [*range(len(texts) - 1), None]), law=law, shards=8).collect()
    assert len(rows) == len(texts)
    places, sizes, slots = Counter(), Counter(), defaultdict(list)
    groups = defaultdict(Counter)
    for r in rows:
        t = texts[r.doc_id if r.doc_id is not None else -1]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == law
        places[r.shard] += 1
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[t][r.shard] += 1
    assert set(places) <= set(range(8))
    for s, v in slots.items():
        assert sorted(v) == list(range(len(v)))
    if law == "rows":
        assert max(places.values()) - min(places.values()) <= 1
        assert len(groups["hot"]) <= math.ceil(120 / (len(texts) / 8)) + 2
    else:
        even = sum(sizes.values()) / 8
        assert all(abs(s - even) <= 2 * 80 for s in sizes.values())
    copies = [c for t, c in groups.items() if t and t.startswith("t")]
    assert sum(len(c) > 1 for c in copies) <= 10


def test_shard_edge_cases(spark):
    assert sharding.digest(frame(spark, [])).collect() == []
    rows = sharding.digest(frame(spark, ["a", "a", "b"], [1, 1, 2])).collect()
    assert len(rows) == 3 and max(Counter(r.shard for r in rows).values()) == 1 and {r.slot for r in rows} == {0}
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, ["a"]), law="else")


def spoken(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = "a & b &amp; &lt; <s> [TEXT] </s> &#91; é😀\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "system", None), (1, 3, "assistant", "x"), (2, 5, "assistant", ""), (2, 5, "assistant", ""),
            (3, 0, None, "q"), (None, 0, "user", "n"), (4, 0, "[TEXT]<role>", "t"), *[(5, i, "user", f"m{i}") for i in range(70)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("extra"))
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    by = defaultdict(list)
    for c, _, r, t in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        by[c].append((r or "", t or ""))
    assert set(got) == set(by)
    for c, messages in by.items():
        loss = "".join(t for r, t in messages if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(messages), spoken(messages))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r.conv_id for r in chat.digest(df.where("false")).collect()] == [-7]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c", None),
            (1, 5, 2, "user", "d", 9.0), (1, 6, 99, "user", "orphan", 0.5), (1, 7, 7, "user", "self", 9.0), (2, 1, None, "user", "z", 1.0)]
    df = spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double").fillna({"score": 0.0})
    best = chat.best_paths(df, paths=2)
    got = defaultdict(list)
    for r in best.orderBy("tree", "rank", "step").collect():
        got[(r.conv, r["rank"])].append(r["text"])
    assert dict(got) == {(1, 1): ["q", "a", "d"], (1, 2): ["q", "b", "c"], (2, 1): ["z"]}


def test_reply_trees_with_repeats_and_cycles(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c", 5.0)]
    rows = rows * 3 + [(1, 4, 3, "user", "d", 9.0), (1, 10, 12, "user", "x", 9.0), (1, 11, 10, "user", "y", 9.0), (1, 12, 11, "user", "z", 9.0),
                       (1, 13, 12, "user", "below", 9.0), (2, 1, 2, "user", "u", 1.0), (2, 2, 1, "user", "v", 1.0), (3, 1, 1, "user", "w", 1.0), (3, 2, 1, "user", "w2", 1.0)]
    df = spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double")
    paths = chat.best_paths(df, paths=4)
    got = [(r.conv, r["rank"], [m["text"] for m in r.messages]) for r in chat.read_back(chat.format_paths(paths)).orderBy("conv", "rank").collect()]
    assert got == [(1, 1, ["q", "b", "c"]), (1, 2, ["q", "a"])]


def brute_nearest(ids, v, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        others = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = others[np.lexsort((ids[others], -s[others]))][:k], s
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_recall_and_scores(spark, clustered, monkeypatch):
    monkeypatch.setattr(nearest, "GROUP_ROWS", 300)
    monkeypatch.setattr(nearest, "GROUP_QUERIES", 20)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    if clustered:
        v[:500] = rng.standard_normal(24) * 3 + 0.1 * rng.standard_normal((500, 24))
    v = v.astype(np.float32).astype(np.float64)
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.digest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    want = brute_nearest(ids, v, 20)
    assert set(got) == set(want)
    for q, (near, s) in want.items():
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in got[q])
        assert [x[2] for x in got[q]] == sorted((x[2] for x in got[q]), reverse=True)
        hits += len({x[1] for x in got[q]} & set(ids[near].tolist()))
    assert hits / (20 * len(want)) >= 0.95


def test_tied_neighbours_are_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    # groups of copies, and different vectors of equal scores
    v = np.concatenate([rng.standard_normal((10, 12)), rng.integers(-1, 2, (10, 12)) + np.eye(12)[:10] * 4]).repeat(60, axis=0)
    v = v[rng.permutation(len(v))].astype(np.float32).astype(np.float64)
    ids = np.concatenate([np.arange(len(v) - 60), np.full(60, 40)])
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    got = defaultdict(list)
    for r in nearest.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in got:
        own = np.array(min(x for i, x in rows if i == q))
        others = np.flatnonzero(ids != q)
        s = np.einsum("ij,ij->i", v[others], np.broadcast_to(own, (len(others), 12)))
        assert got[q] == ids[others[np.lexsort((ids[others], -s))][:20]].tolist(), q
    assert len(got) == len({i for i in ids.tolist() if i % 20 == 0})


def test_scan_keeps_the_smallest_ids_of_many_tied_vectors(monkeypatch):
    monkeypatch.setattr(nearest, "EPSILON", 99.0)
    rng = np.random.default_rng(8)
    v = np.unique(rng.choice([-1.0, 1.0], (3000, 12)), axis=0)
    n = len(v)
    ids = rng.permutation(n)
    index = nearest.Index(v, {0: n}, float(nearest.log_norms(v).max()), 20)
    a, b, score = nearest.scan(index, v, np.zeros(n, np.int64), np.stack([ids, ids], 1), np.ones(n, bool), v[:40], ids[:40], np.ones((40, 1), bool), np.zeros(1, np.int64), 20)
    for q in range(40):
        s = v @ v[q]
        s[q] = -np.inf
        assert set(b[a == q].tolist()) == set(np.lexsort((ids, -s))[:20].tolist())


@pytest.mark.parametrize("large", [1e4, 1e200])
def test_neighbours_of_heavy_tailed_norms(spark, monkeypatch, large):
    monkeypatch.setattr(nearest, "GROUP_ROWS", 300)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((1500, 24)) * np.exp(rng.standard_normal((1500, 1)))
    # three vectors of large norm, which half of the queries do not point to
    v[[101, 702, 1203]] = np.abs(v[[101, 702, 1203]]) * large * [[1.0], [0.5], [0.01]]
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.digest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - v[r.query_id] @ v[r.vec_id]) <= 1e-9 * np.abs(v[r.query_id] * v[r.vec_id]).sum()
    want = brute_nearest(ids, v, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(near.tolist())) for q, (near, _) in want.items()) / (20 * len(want)) >= 0.95


def test_neighbour_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
            (8, [float("inf"), 0.0]), (20, [2.0, 0.0]), (20, [3.0, 0.0]), (40, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.digest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 3.0), (0, 2, 20, 2.0), (0, 3, 1, 1.0), (0, 4, 2, 1.0), (0, 5, 2, 1.0),
                   (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 2, 2.0)]
    assert nearest.digest(df.where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()[list(got.columns)]
    key = lambda d: sorted(map(tuple, d.astype(str).values.tolist()))
    assert len(got) and key(got) == key(want)


def test_every_query_returns_its_whole_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_sharding", "op4_sentencepiece", "op5_language"):
        assert QUERIES[name](spark, SF).count() == n


def test_pipeline_stages_take_effect(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOW", subword.Training(per_class=200, epochs=4))
    names = ["quality", "ngram_join", "suffix_dedup", "decontamination", "sentencepiece"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen = Counter()
    rows = docs.collect()
    for r in rows:
        w = word.findall(r.text)
        seen.update({tuple(w[i:i + 50]) for i in range(len(w) - 49)})
        assert r.n_chars == len(r.text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in last)
