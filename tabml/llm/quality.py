"""Quality classifier: supervised subword embeddings.

Hashed vectors of words and character n-grams, averaged per document, under a softmax, trained by
stochastic gradient descent in NumPy (``subword``).  Case and punctuation are kept, and a word
that is met again within three words is a feature: they tell prose from junk.

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

from .frames import unused
from .subword import Subwords, Training, fit, score

FEATURES = Subwords(lower=False, repeats=3)
HOW = Training(per_class=2500)
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", out: str = "score", train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with the quality score in column ``out`` (in place of one that they have).  ``train_docs``: the
    documents that labels belong to, if other than ``docs``."""
    source = docs if train_docs is None else train_docs
    model = fit(source, labels, label_col, FEATURES, HOW, id_col, text_col, learn=~held_out("id"))
    return score(docs, model, FEATURES, text_col, out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without those scored under ``threshold``."""
    out = unused(docs, "__quality")
    return quality_scores(docs, labels, out=out, **options).where(F.col(out) >= threshold).drop(out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The per-document contract columns."""
    s = quality_scores(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
