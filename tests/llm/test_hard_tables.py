"""Clashing column names, repeated ids and very long or unspaced texts, for operators that meet them in the pipeline."""
import random
import string

import numpy as np
from pyspark.sql import functions as F

from tabml.llm import decontaminate, language, ngram_join, quality, sharding, subword, toxicity
from llm_helpers import frame, prose


def clashing(spark, texts, *names):
    return frame(spark, texts).withColumns({n: F.lit("own") for n in names})


def labelled(spark, n):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_stages_take_tables_with_their_own_column_names(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOW", subword.Training(per_class=20, epochs=3))
    texts = [" ".join(["good words in a row here"] * 3) if i % 2 else "%%% junk ### " * 4 for i in range(40)] + [None, ""]
    docs = clashing(spark, texts, "__quality", "__QUALITY_", "__verdict", "__key", "score", "Key")
    kept = quality.keep_good(docs, labelled(spark, 40))
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"own"}
    scored = quality.quality_scores(docs, labelled(spark, 40))
    assert [c for c in scored.columns if c.lower() == "score"] == ["score"] and scored.schema["score"].dataType.simpleString() == "double"
    bench = spark.createDataFrame([(1, "good words in a row here good words in a row here good")], "item_id long, text string")
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [*range(0, 40, 2), 40, 41]
    once = ngram_join.keep_one(docs)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [0, 1, 40, 41]


def test_keep_one_of_repeated_rows_and_hot_groups(spark):
    rng = random.Random(6)
    base = prose(rng, 60)
    near = [" ".join([*base[:k], "x", *base[k + 1:]]) for k in (0, 0, 1, 59)]
    texts = [*near, " ".join(base), " ".join(base), "other text of a few words", "other text of a few words", None, None, ""]
    ids = [5, 5, 6, 7, 3, 3, 9, 2, 10, 10, 11]
    kept = ngram_join.keep_one(frame(spark, texts, ids)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 10, 10, 11]


def test_an_id_in_many_documents_is_learned_from_once(spark):
    docs = frame(spark, ["b text", "a text", "c text", None] * 50 + ["other"], [1] * 200 + [2])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    real = subword._fit
    subword._fit = lambda features, how: seen.append(1) or real(features, how)
    try:
        again = subword.fit(docs, labels, "quality", quality.FEATURES, subword.Training(per_class=5, epochs=2))
    finally:
        subword._fit = real
    once = subword.fit(frame(spark, ["a text", "other"], [1, 2]), labels, "quality", quality.FEATURES, subword.Training(per_class=5, epochs=2))
    assert seen and np.array_equal(again[0], once[0]) and again[1] == once[1]


def test_an_insult_tells_in_a_text_without_spaces(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HOW", subword.Training(per_class=300, epochs=2, sharp=6, prior=1e-3, below=2))
    rng = random.Random(2)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 9))) for _ in range(300)]

    def text(toxic, gap):
        w = [rng.choice(words) for _ in range(400)]
        if toxic:
            w[rng.randrange(400)] = "zqxinsultqz"
        return gap.join(w)

    texts = [text(i % 2, " ") for i in range(400)] + [text(i % 2, "") for i in range(100)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    caught = sum(scores[i] >= 0.5 for i in range(401, 500, 2))
    false = sum(scores[i] >= 0.5 for i in range(400, 500, 2))
    assert caught >= 45 and false <= 5, (caught, false)


def test_bags_of_long_passages_are_cut():
    features = toxicity.FEATURES
    piece = next(iter(subword.slices(subword.pa.array(["a b c", "", "é" * 5000, "x" * 128, "w " * 40]))))
    piece.split(subword.SPACE)
    edges, first = features.bags(piece)
    assert len(first) == 6 and edges[0] == 0 and edges[-1] == piece.offsets[-1] and (np.diff(edges) >= 0).all()
    assert (edges[first] == piece.offsets).all() and (np.diff(edges) <= 2 * subword.PASSAGE_BYTES).all()
    assert np.diff(first).tolist() == [1, 1, -(-10_000 // subword.PASSAGE_BYTES), 1, 5]
    ids, lengths = features.sample("é" * 5000)
    assert lengths.sum() == len(ids) and len(lengths) == -(-10_000 // subword.PASSAGE_BYTES)


def test_phrases_are_the_longest_over_all_blocks():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcde ") for _ in range(200)) for _ in range(3)]
    ref = language.Reference("x", [language.Block(t) for t in texts])
    judge = language.Judge([ref])
    known = ["".join(map(chr, language.letters_of([t])[0])) for t in texts]
    probes = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(20)]
    codes, bounds, _ = language.letters_of(probes)
    got = language.parse(codes, bounds, [ref], judge.maps)[:, 0]
    for k in range(len(probes)):
        letters, count, i = "".join(map(chr, codes[bounds[k]:bounds[k + 1]])), 0, 0
        while i < len(letters):
            size = 1
            while i + size < len(letters) and any(letters[i:i + size + 1] in t for t in known):
                size += 1
            i, count = i + size, count + 1
        assert got[k] == count


def test_very_long_labelled_texts_are_learned_in_blocks(spark):
    rng = random.Random(12)
    small = [frame(spark, [" ".join(prose(rng, 30)) for _ in range(6)])]
    long = "".join(rng.choice("abcdefgh ") for _ in range(50_000))
    docs = small[0].unionByName(frame(spark, [long, "été " * 2000, None, "123"], [20, 21, 22, 23])).withColumn("lang", F.lit("xx"))
    ref, = language.learn(docs, block=4000)
    sizes = [b.length for b in ref.blocks]
    assert len(sizes) >= 12 and max(sizes) <= 2 * 4000 + 3 * language.OVERLAP
    whole, = language.learn(docs)
    assert len(whole.blocks) == 1 and whole.size <= ref.size <= whole.size * 1.15
    found = language.detect(docs, [ref]).collect()
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id >= 20} == {20: "xx", 21: "xx", 22: "und", 23: "und"}


def test_a_hot_group_is_ranked_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 10)
    texts = ["hot"] * 400 + [f"t{i}" for i in range(200)] + ["pair", "pair"]
    rows = sharding.shard_documents(frame(spark, texts), shards=4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert len(rows) == 602 and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
