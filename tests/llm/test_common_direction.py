"""Recall of op2 where all vectors share a direction, as text embeddings do, at many windows of rows."""

import numpy as np

from leafloom.llm.embed_dedup import WIDER, WINDOW, near_duplicate_vectors


def test_common_direction(spark):
    rnd, n, pairs, dim = np.random.default_rng(9), 8000, 750, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    common = unit(rnd.standard_normal(dim))
    x = unit(np.sqrt(0.9) * common + np.sqrt(0.1) * unit(rnd.standard_normal((n, dim))))
    assert n > 10 * WIDER * WINDOW and 0.88 < float((x[:500] @ x[500:1000].T).mean()) < 0.92
    off = rnd.standard_normal((pairs, dim))
    off = unit(off - (off * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x[n - pairs :] = 0.9505 * x[:pairs] + np.sqrt(1 - 0.9505**2) * off
    want = np.zeros(n, np.int64)
    for at in range(0, n, 1000):
        want[at : at + 1000] = (x[at : at + 1000] @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[k] for k in range(n)])
    assert (found <= want).all() and found.sum() / want.sum() > 0.99
