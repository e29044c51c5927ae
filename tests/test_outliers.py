"""Scores of an isolation forest: every row's path is walked to its leaf."""
import time

import numpy as np
import pandas as pd

from tabml.operators import outliers as O


def forest(X, trees):
    rng = np.random.default_rng(1)
    nodes = pd.concat([O._grow(pd.DataFrame(X[rng.integers(0, len(X), 256)], columns=list("abc")).assign(tree=t), list("abc"), 8, 42) for t in range(trees)])
    arr = {k: np.full((trees, int(nodes["node"].max()) + 1), -1 if k != "threshold" else 0.0, dtype=float if k == "threshold" else np.int64)
           for k in ("feature", "threshold", "left", "right", "size")}
    for k in arr:
        arr[k][nodes["tree"].to_numpy(), nodes["node"].to_numpy()] = nodes[k].to_numpy()
    return arr


def walked(x, f):
    """Mean length of the paths of one row."""
    total = 0.0
    for t in range(len(f["feature"])):
        node, depth = 0, 0
        while f["feature"][t, node] >= 0:
            left = x[f["feature"][t, node]] < f["threshold"][t, node]
            node, depth = f["left" if left else "right"][t, node], depth + 1
        total += depth + O.avg_path(np.array([f["size"][t, node]]))[0]
    return total / len(f["feature"])


def test_scores_equal_walked_paths_and_take_little_time():
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(0, 1, (20000, 3)), 1)
    X[0] = np.nan
    f = forest(X, 100)
    got = O.score_batch(X, f, 256)
    c = O.avg_path(np.array([256]))[0]
    assert np.allclose([got[i] for i in range(0, 200, 10)], [2.0 ** (-walked(X[i], f) / c) for i in range(0, 200, 10)])
    t0 = time.thread_time()
    O.score_batch(X, f, 256)
    spent, t0 = time.thread_time() - t0, time.thread_time()
    for _ in range(100):  # one gather a level and tree, for scale
        for _ in range(8):
            X[np.arange(len(X)), 1] < X[np.arange(len(X)), 2]
    assert spent < 4.0 * (time.thread_time() - t0)
