"""The flagship flow: prepare -> fit -> evaluate on the ``doc_stats`` view."""

from __future__ import annotations

from tabml.operators import metrics as M
from tabml.plans import views as V
from tabml.plans.recipe import Recipe, prepare
from tabml.plans.train import evaluate, fit_model


_PREPARED: dict = {}


def prepared(spark, sf_dir, target: str = "quality"):
    """``doc_stats`` prepared for ``target``, once per session and input: the prepared parts are
    written tables, and the model queries share them."""
    where = (spark.sparkContext.applicationId, sf_dir, target)
    if where not in _PREPARED:
        df = V.doc_stats(spark, sf_dir)
        _PREPARED[where] = prepare(df if target == "quality" else df.drop("n_words"), target=target, key="doc_id")
    return _PREPARED[where]


def flagship_fit(spark, sf_dir, model: str = "Random Forest", recipe: Recipe | None = None):
    df = V.doc_stats(spark, sf_dir)
    fr = prepare(df, target="quality", recipe=recipe or Recipe.auto(), key="doc_id")
    model_fit = fit_model(fr, model)
    return fr, model_fit, evaluate(fr, model_fit)


def flagship(spark, sf_dir):
    """Classification report of the auto-mode random forest on the test part."""
    fr, _, res = flagship_fit(spark, sf_dir)
    names = {str(float(i)): str(c) for i, c in enumerate(fr.label_map.classes)}
    return M.classification_report(res["predictions"], class_names=names)
