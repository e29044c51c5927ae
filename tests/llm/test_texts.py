"""Tokenizer, language, quality and toxicity operators."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabml.llm import language, quality, sentencepieces, subword, toxicity
from tabml.llm.queries import PIECES
from llm_helpers import frame, prose
from paths import SF_SMALL

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MODEL = sentencepieces.model_of(sentencepieces.load(PIECES))
ODD = ["a", " ", "  ", "\n", "\t", "▁", "é", "漢字", "😀", "</s>", "<s>", "[INST]", "the", " the", "\0", "ﬁ", "1234", "<0x41>", "⁇", "é"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(ODD), max_size=15).map("".join)))
def test_encoding_and_decoding_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode("utf-8")
    ids, starts, ends = MODEL.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert MODEL.decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
    if text:
        assert starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=9))
def test_decoding_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_stretches_do_not_change_the_ids(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(300)) for _ in range(20)]
    monkeypatch.setattr(sentencepieces, "STRETCH", 4)
    for t in texts:
        assert MODEL.encode(t)[0].tolist() == LIBRARY.encode(t)


def charsmap(rules: dict[str, str]) -> bytes:
    """A compiled character map: a double array with the rules' prefixes, and their targets."""
    targets, places = b"", {}
    for source, target in rules.items():
        places[source.encode()] = len(targets)
        targets += target.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()
    todo = [(0, b"")]
    while todo:
        node, prefix = todo.pop()
        nexts = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in places
        base = 1
        while base in bases or any((base ^ c) in used for c in [*nexts, *([0] if leaf else [])]) or node ^ base >= 1 << 21:
            base += 1
        bases.add(base)
        units[node] = units[node] | ((node ^ base) << 10) | (leaf << 8)
        for c in [*nexts, *([0] if leaf else [])]:
            used.add(base ^ c)
        if leaf:
            units[base] = places[prefix] | 0x80000000
        for c in nexts:
            units[base ^ c] = c
            todo.append((base ^ c, prefix + bytes([c])))
    size = -(-(max(units) + 1) // 256) * 256
    trie = np.array([units.get(i, 1 << 31) for i in range(size)], np.uint32).tobytes()
    return len(trie).to_bytes(4, "little") + trie + targets


def settings_of(mapped: bytes, prefix: bool, squeeze: bool) -> bytes:
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    return b"\x12" + varint(len(mapped)) + mapped + bytes([0x18, prefix, 0x20, squeeze])


def test_longest_prefix_normalisation_keeps_source_places():
    n = sentencepieces.Normaliser(settings_of(charsmap({"A": "a", "ﬁ": "fi", "AB": "x", "é": "é", "\t": " ", "Z": ""}), True, True))
    text, align = n("  ABAﬁ é\t  Zq ")
    assert text == "▁xafi▁é▁q"
    source = "  ABAﬁ é\t  Zq ".encode()
    spans = [(source[align[i]:align[i + 1]]) for i in range(len(text.encode()))]
    assert align[3] == 2 and align[4] == 4 and align[5] == 5 and align[6] == 5
    assert b"".join(spans).strip() == source.strip()
    assert n("   ")[0] == "" and n("")[0] == ""
    plain = sentencepieces.Normaliser(settings_of(b"", True, False))
    assert plain(" a ")[0] == "▁▁a▁" and plain(" a ")[1].tolist() == [0, 0, 0, 0, 0, 0, 1, 2, 2, 2, 3]


RULES = {**{chr(65 + i): chr(97 + i) for i in range(26)}, "ﬁ": "fi", "AB": "x", "ABCD": "y ", "é": "e", "\t": " ", "\n": " ", "…": "...",
         "Z": "", "¼": " 1/4 ", "the": "THE", "ther": "r", "　": " ", ".": "  .", "e\u0301": "é"}


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_a_mapped_model_equals_the_library_on_a_whole_table(spark, squeeze, prefix):
    """The model with a character map and symbols of the user's, over all documents and odd texts."""
    settings = settings_of(charsmap(RULES), prefix, squeeze)
    size, n = b"", len(settings)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    data = sentencepieces.load(PIECES) + b"\x1a" + size + bytes([n]) + settings
    for symbol in ("Aéq", "the thing", "ABﬁ", "…q"):
        symbol = symbol.encode()
        piece = b"\x0a" + bytes([len(symbol)]) + symbol + b"\x15\0\0\0\0\x18\x04"
        data += b"\x0a" + bytes([len(piece)]) + piece
    model, library = sentencepieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(6)
    odd = ["Aéq", "ABﬁ", "…q", "ABCD", "AB", "A", "the", "ther", "the thing", "ﬁ", "é", "e\u0301", "Z", " ", "  ", "\t", ".", "¼", "…", "　", "▁", "q", "漢", "\0"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    for t in texts:
        ids, starts, ends = model.encode(t or "")
        assert ids.tolist() == library.encode(t or ""), t
        assert (starts[1:] == ends[:-1]).all() and (starts <= ends).all() and (not len(ids) or ends[-1] <= len(t.encode()))


def test_encode_edge_cases(spark):
    texts = [None, "", " ", "é <s> x", "a " * 70_000, "same", "same"]
    docs = frame(spark, texts).withColumnsRenamed({"lang": "c0", "source": "starts_"})
    out = sentencepieces.decode(sentencepieces.encode(docs, PIECES), PIECES)
    assert out.columns == [*docs.columns, "ids", "starts", "ends", "decoded"]
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == LIBRARY.encode(t or "") and rows[i].decoded == LIBRARY.decode(rows[i]["ids"]) == (t or "")
    d = {r.doc_id: r for r in sentencepieces.digest(docs, PIECES).collect()}
    assert d[3].ids_sha256 == hashlib.sha256(",".join(map(str, LIBRARY.encode("é <s> x"))).encode()).hexdigest()
    assert d[3].decoded_sha256 == hashlib.sha256("é <s> x".encode()).hexdigest() and d[3].covered_bytes == len("é <s> x".encode())
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert sentencepieces.digest(frame(spark, []), PIECES).collect() == []


def languages(rng, n=240):
    stems = {"aa": ["ba", "bo", "ri"], "bb": ["schu", "ung", "ver"], "cc": ["ñó", "qué", "ción"]}
    rows = []
    for i in range(n):
        lang = sorted(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_language_of_held_out_texts(spark):
    rows = languages(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, _, lang in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    rows = [*languages(random.Random(2)), (900, None, "aa"), (901, "", None), (902, "12 !? \n", "bb"), (903, "schuung" * 20_000, None), (904, "漢字", None), (None, "babo ribo", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "aa"]
    assert [got[i].score for i in (900, 901, 902)] == [0, 0, 0] and got[904].lang_pred in ("aa", "bb", "cc") and got[None].held_out is False
    assert language.digest(docs.where("doc_id < 0")).collect() == []
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang").where("doc_id < 5")
    assert {r.lang_pred for r in language.digest(unlabelled).collect()} == {"und"}


def test_phrases_equal_a_plain_greedy_parse():
    rng = random.Random(8)
    text = "".join(rng.choice("abcd ") for _ in range(300))
    ref = language.Reference("x", text)
    codes, _, _ = language.letters_of([text])
    known = "".join(map(chr, codes))
    probe = "".join(rng.choice("abcde ") for _ in range(400))
    judge = language.Judge([ref])
    codes, bounds, _ = language.letters_of([probe])
    got = language.parse(codes, bounds, [ref], judge.maps)[0, 0]
    letters, count, i = "".join(map(chr, codes)), 0, 0
    while i < len(letters):
        size = 1
        while i + size < len(letters) and letters[i:i + size + 1] in known:
            size += 1
        i, count = i + size, count + 1
    assert got == count


def test_languages_are_learned_from_whole_distinct_texts(spark):
    header = "0123 " * 400 + "licence granted to whom it may concern " * 60
    rows = [(i, header + text, lang) for i, text, lang in languages(random.Random(4))]
    rows += [(1000 + i, "ba " * 50, "aa") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = {r.name: r for r in language.learn(docs, documents=500)}
    for name, ref in refs.items():
        texts = {text for _, text, lang in rows if lang == name}
        assert ref.size == len(language.letters_of([" ".join(texts)])[0])
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, _, lang in held)
    # copies count once among the few that are taken
    assert min(r.size for r in language.learn(docs, documents=20)) > 20 * 2000


def test_large_alphabets_are_whole():
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(3000)]
    words = {name: ["".join(rng.choices(han, k=4)) for _ in range(600)] for name in ("xx", "yy")}
    refs = [language.Reference(name, " ".join(words[name])) for name in ("xx", "yy")]
    judge = language.Judge(refs)
    text = " ".join(words["yy"][100:140])
    codes, bounds, _ = language.letters_of([text])
    assert language.parse(codes, bounds, refs, judge.maps)[0, 1] == 1
    texts = ["".join(rng.sample(words[name], 20)) for name in ("xx", "yy") * 20]
    found, score = judge(texts)
    assert found == ["xx", "yy"] * 20 and score.min() > 0.9


def labelled(spark, rng, n=500):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120))
        bad, rude = i % 4 == 0, i % 5 == 1
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rude:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return (spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "word " * 30_000), (9003, "so you idi0tt"), (None, "w1")], "doc_id long, text string"),
            spark.createDataFrame([*labels, (1, 1, 1), (9100, 1, 0), (None, 0, 1), (3, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("module,column,threshold", [(quality, 1, 0.7), (toxicity, 2, 0.5)])
def test_classifiers(spark, module, column, threshold, monkeypatch):
    monkeypatch.setattr(module, "HOW", subword.Training(per_class=150, epochs=4, sharp=4 if module is toxicity else 0))
    docs, labels = labelled(spark, random.Random(4))
    got = {r.doc_id: r for r in module.digest(docs, labels).collect()}
    truth = {r[0]: r[column] for r in labels.collect() if r[0] is not None and r[0] < 500 and r[column] in (0, 1) and r[0] != 1}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got.values())
    assert got[9000].score == got[9001].score
    if module is toxicity:
        assert got[9003].predicted == 1
    none = module.digest(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert module.digest(docs.where("false"), labels).collect() == []


def test_keep_good_passes_other_columns(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOW", subword.Training(per_class=150, epochs=4))
    docs, labels = labelled(spark, random.Random(4))
    docs = docs.selectExpr("doc_id", "text", "'x' as score", "1 as c0")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 300 < kept.count() < 450


def test_logits_are_means_over_bags():
    rng = np.random.default_rng(0)
    for features in (quality.FEATURES, toxicity.FEATURES):
        table = rng.standard_normal(1 << features.bits).astype(np.float32)
        texts = ["one two two", "", None, "é" * 40, " ".join(f"w{i}" for i in range(50)), "  a  ", "x " * 400]
        got = features.logits(pa.array(texts), table)
        for t, z in zip(texts, got):
            ids, counts = features.sample(t)
            if features.passage:
                ends = np.cumsum(counts)
                parts = [table[ids[e - c:e]].sum() / max(c + features.pad, 1) for e, c in zip(ends, counts)]
                want = max(parts, default=0.0)
            else:
                want = (table[ids] @ counts) / counts.sum() if len(ids) else 0.0
            assert z == pytest.approx(want, abs=1e-4)
