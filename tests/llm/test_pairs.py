"""n-gram join, suffix dedup and decontamination against brute force."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabml.llm import components, decontaminate, ngram_join, suffix_dedup, words
from llm_helpers import DOCS, LOWER, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_links(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    root, degree = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i), degree[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_join_equals_brute_force(spark, corpus, k, num, den):
    got = ngram_join.ngram_jaccard_join(frame(spark, corpus), words=k, num=num, den=den).collect()
    assert sorted((r.doc, r.n_shingles, r.component_id, r.n_links) for r in got) == [
        (i, *x) for i, x in enumerate(brute_links(corpus, k, num, den))]


def test_join_by_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_WEIGHT", 900)
    monkeypatch.setattr(ngram_join, "SET_WEIGHT", 10)
    monkeypatch.setattr(ngram_join, "CELLS", 64)
    got = ngram_join.digest(frame(spark, corpus)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [
        (i, *x) for i, x in enumerate(brute_links(corpus, 4, 85, 100))]


def test_linked_sets_always_meet():
    rng = np.random.default_rng(1)
    for num in (85, 80):
        rule = ngram_join.Rule(4, num, 100)
        for _ in range(400):
            n = int(rng.integers(1, 300))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = a.copy()
            for _ in range(int(rng.integers(0, n // 4 + 2))):
                b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64))
            both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            a, b = np.sort(a), np.unique(b)
            if 100 * both >= num * every and both < every:
                sent, row = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rule)
                assert set(sent[row == 0]) & set(sent[row == 1])


def test_join_edge_cases(spark):
    assert ngram_join.digest(frame(spark, [])).collect() == []
    rows = ngram_join.digest(frame(spark, ["a b", "a b", "a b", None, "", None], [7, 7, None, 9, 10, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in rows) == [
        (-1, 0, -1, 0), (-1, 1, 7, 2), (7, 1, 7, 2), (7, 1, 7, 2), (9, 0, 9, 0), (10, 0, 10, 0)]
    clash = frame(spark, ["a b", "a b", "c"]).withColumnsRenamed({"lang": "key", "source": "set"})
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    twice = ngram_join.keep_one(frame(spark, ["a b", "a b", "", ""], [1, 1, 2, 2])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 2, 2]


def test_keep_one_keeps_the_smallest_of_each_component(spark, corpus):
    kept = {r.doc_id for r in ngram_join.keep_one(frame(spark, corpus)).collect()}
    found = brute_links(corpus, 5, 80, 100)
    assert kept == {i for i, x in enumerate(found) if x[1] == i}


def test_components_of_chains(spark):
    n = 600
    edges = [(i, i + 1) for i in range(n)] + [(5000 + (i * 7) % 101, 5000 + ((i + 1) * 7) % 101) for i in range(101)] + [(9, 9), (9000, 9000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{5000 + i: 5000 for i in range(101)}, 9000: 9000}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), "t").collect() == []


def brute_repeats(rows, size=50):
    met = defaultdict(list)
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            met[tuple(w[i:i + size])].append((d, i))
    repeated, cut = defaultdict(set), defaultdict(set)
    for places in met.values():
        for n, (d, i) in enumerate(places if len(places) > 1 else []):
            repeated[d].update(range(i, i + size))
            if n:
                cut[d].update(range(i, i + size))
    return repeated, cut


def words_of(spans):
    return {x for a, z in zip(spans[::2], spans[1::2]) for x in range(a, z)}


@pytest.mark.parametrize("size,gram,hot", [(50, 10, 1024), (12, 3, 1024), (5, 5, 1024), (50, 10, 2), (12, 3, 3), (5, 5, 1)])
def test_repeats_equal_brute_force(spark, corpus, size, gram, hot):
    got = suffix_dedup.repeated_spans(frame(spark, corpus), min_words=size, gram=gram, hot=hot).collect()
    repeated, cut = brute_repeats(list(enumerate(corpus)), size)
    assert {r.doc: words_of(r.repeated) for r in got} == dict(repeated)
    assert {r.doc: words_of(r.cut) for r in got if r.cut} == dict(cut)


def test_cut_keeps_first_occurrences_and_the_rest(spark, corpus):
    docs = frame(spark, corpus)
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs).collect()}
    _, cut = brute_repeats(list(enumerate(corpus)))
    for i, t in enumerate(corpus):
        if not cut.get(i):
            assert got[i] == t
        else:
            left = [w for k, w in enumerate(WORD.findall(t)) if k not in cut[i]]
            assert WORD.findall(got.get(i, "")) == left
            assert (i in got) == bool(left)


def test_repeats_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    assert suffix_dedup.digest(frame(spark, [])).collect() == []
    assert suffix_dedup.digest(frame(spark, [None, "", "a b", long])).collect() == []
    assert suffix_dedup.digest(frame(spark, [long, long], [3, 3])).collect() == []
    rows = {r.doc_id: (r.n_repeated, r.n_cut, r.repeated_spans, r.cut_spans) for r in
            suffix_dedup.digest(frame(spark, [long, "x " + long, long], [5, 2, None])).collect()}
    assert rows == {2: (60, 0, "1-61", ""), 5: (60, 60, "0-60", "0-60"), None: (60, 60, "0-60", "0-60")}
    clash = frame(spark, [long, "é " + long + " end"]).withColumnsRenamed({"lang": "row", "source": "key"})
    kept = suffix_dedup.cut_repeats(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, long), (1, "é end")]


def test_contamination_equals_brute_force(spark):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    a = " ".join(f"a{i}" for i in range(30))
    items = [(1, a), (2, "Short ITEM here"), (3, None), (4, "..."), (5, a[:80]), (6, "é " * 20), (2, "short item here"), (None, a)]
    docs = ["x " * 100 + a + " y" * 50, a[:45], "a SHORT item, here? yes", None, "", "é " * 40, "clean text", ("f " * 400) + "short item here", a, a]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words.findall((t or "").translate(LOWER))
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k:k + 13])].add(str(i))
    for size in (decontaminate.BLOCK_BYTES, 40):
        docs_df = frame(spark, docs).withColumnsRenamed({"lang": "n_words", "source": "__hits"})
        marked = decontaminate.mark(docs_df, bench, block_bytes=size)
        assert marked.columns == [*docs_df.columns, "contamination"]
        got = {r.doc_id: r.contamination for r in marked.collect()}
        for i, t in enumerate(docs):
            w = words.findall((t or "").translate(LOWER))
            hit, found = set(), set()
            for size_w in {len(x) for x in windows}:
                for k in range(len(w) - size_w + 1):
                    x = tuple(w[k:k + size_w])
                    if x in windows:
                        hit.update(range(k, k + size_w))
                        found |= windows[x]
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found)), i
            assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
            longest = (0, None, None)
            for item, t2 in items:
                other = words.findall((t2 or "").translate(LOWER)) if item is not None else []
                for p in range(len(w)):
                    for q in range(len(other)):
                        n = 0
                        while p + n < len(w) and q + n < len(other) and w[p + n] == other[q + n]:
                            n += 1
                        if n and n >= min(13, len(other)):
                            longest = min(longest, (-n, p, str(item)))
            assert (-got[i].longest_words, got[i].longest_at, got[i].longest_item) == longest, i
    digest = {r.doc_id: r for r in decontaminate.digest(frame(spark, docs), bench).collect()}
    assert digest[6].items_sha256 == hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(frame(spark, docs), none).count() == len(docs)
    assert decontaminate.digest(frame(spark, []), bench).collect() == []


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20)))], "item_id long, text string")
    doc = "x y " + " ".join(f"A{i}," for i in range(2, 18)) + " z"
    best = decontaminate.longest_matches(frame(spark, [doc, "q"], [8, 9]), bench).orderBy("item_word").first()
    assert (best["item"], best.item_word, best.doc, best.doc_word, best.n_words) == ("1", 2, 8, 2, 16)


def test_longest_matches_of_shared_passages(spark):
    rng = random.Random(9)
    words = [f"b{i}" for i in range(12)]
    item = [rng.choice(words) for _ in range(60)]
    docs = [["q", *item[5:18], words[i % 12], *rng.choices(words, k=20)] for i in range(12)]
    docs += [["z", *item[5:45], "z"], [*item[5:30], "q", *item[:20]], item[40:] * 2, *([rng.choice(words) for _ in range(80)] for _ in range(5))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[30:44]))], "item_id long, text string")
    got = {(r["item"], r.item_word): r for r in decontaminate.longest_matches(frame(spark, [" ".join(d) for d in docs]).coalesce(1), bench).collect()}
    for name, text in (("1", item), ("2", item[30:44])):
        for s in range(len(text)):
            best = 0
            for d in docs:
                for p in range(len(d)):
                    n = 0
                    while s + n < len(text) and p + n < len(d) and text[s + n] == d[p + n]:
                        n += 1
                    best = max(best, n)
            if best < 13:
                assert (name, s) not in got
            else:
                r = got[name, s]
                assert r.n_words == best and docs[r.doc][r.doc_word:r.doc_word + best] == text[s:s + best]


def test_matches_of_random_texts_equal_brute_force():
    """Few words, so that suffixes tie for long: spans and longest matches, window of 4, items shorter than it."""
    rng = random.Random(4)
    for case in range(60):
        vocabulary = [f"v{i}" for i in range(rng.choice([1, 2, 5]))]
        items = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 25]))] for _ in range(4)]
        docs = [[rng.choice([*vocabulary, "q"]) for _ in range(rng.choice([0, 2, 30]))] for _ in range(5)]
        docs += [["q", *rng.choice(items), "q", *rng.choice(items)]]
        block = decontaminate.Block(list(range(4)), [" ".join(x) for x in items], 4)
        piece = next(words.slices(pa.array([" ".join(d) for d in docs]), 1 << 20))
        for d, got in zip(docs, decontaminate._found(piece, block)):
            hit, found, longest = set(), set(), (0, None, None)
            for i, x in enumerate(items):
                for p in range(len(d)):
                    for q in range(len(x)):
                        n = 0
                        while p + n < len(d) and q + n < len(x) and d[p + n] == x[q + n]:
                            n += 1
                        if n >= min(4, len(x)):
                            hit.update(range(p, p + n))
                            found.add(str(i))
                            longest = min(longest, (-n, p, str(i)))
            spans = {w for a, z in zip(got[1][::2], got[1][1::2]) for w in range(a, z)}
            assert (got[0], spans, got[2], (-got[3], got[5], got[4])) == (len(d), hit, sorted(found), longest), (case, d, items)


def shuffle_files(spark):
    import os
    return {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
            for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """Steps of the pipeline come one after the other; their shuffle files must not pile up."""
    from tabml.llm.frames import stored
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    out = stored(spark.range(10_000).withColumn("k", F.col("id") % 7).repartition(4, "id").groupBy("k").count(), "cleaned")
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == was
    assert out.agg(F.sum("count")).first()[0] == 10_000


def test_only_the_texts_that_are_cut_move(spark):
    """Few documents hold a passage again: the others stay where they are, whole and in their number."""
    rng = random.Random(8)
    passage = " ".join(prose(rng, 60))
    texts = [f"{' '.join(prose(rng, 12, 9000))} {passage if i % 10 == 0 else ''} {i}" for i in range(60)]
    out = suffix_dedup.cut_repeats(frame(spark, texts))
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == 60 and all(got[i] == t for i, t in enumerate(texts) if i == 0 or i % 10)
    assert all(passage not in got[i] and got[i].startswith(texts[i][:20]) for i in range(10, 60, 10)) and passage in got[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole, cut = plan.split("LeftAnti")[1], plan.split("LeftSemi")[1]
    assert "broadcast" in whole.split("\n")[0] and "broadcast" in cut.split("\n")[0], plan
