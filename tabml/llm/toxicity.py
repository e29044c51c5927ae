"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Vectors of hashed words and character n-grams are trained together with the softmax in NumPy
(``subword``); texts are lower-cased (A-Z).  A misspelling that was never seen shares most
of its n-grams, hence vectors, with the word it comes from.  Vectors are averaged over passages of 8
words, and the document's score is that of its highest passage: one insult in a long text
would be lost in the mean over all of it.  Every mean has 100 empty features more, so a passage of few
words, or of one word over and over, weighs little.  A passage of more than 128 bytes, as texts without white space
have them, is cut into even pieces of 64 bytes at most.

Learning uses at most ``Training.per_class`` labelled documents of each class (a documented
bound; those with the smallest hash of the id) and their whole texts; scoring covers whole texts of all.
The sample is balanced, so the score is the probability of label 1 at equal class shares.

Defined cases: a null or empty text has no features and gets the bias' score; without
labels every score is 0.5; labels other than 0 and 1 and null ids are not learned from; an id
labelled twice counts as label 0, and one in several documents is learned from once, with its smallest text;
repeated documents get equal scores; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subword import Subwords, Training, fit, score

FEATURES = Subwords(lower=True, passage=8, once=True, pad=100)
HOW = Training(per_class=2500, epochs=2, sharp=6, prior=1e-3, below=2)
THRESHOLD = 0.5


def held_out(id_col: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                    text_col: str = "text", out: str = "score", train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with the toxicity score in column ``out`` (in place of one that they have).  ``train_docs``: the
    documents that labels belong to, if other than ``docs``."""
    source = docs if train_docs is None else train_docs
    model = fit(source, labels, label_col, FEATURES, HOW, id_col, text_col, learn=~held_out("id"))
    return score(docs, model, FEATURES, text_col, out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The per-document contract columns."""
    s = toxicity_scores(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
