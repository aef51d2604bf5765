import numpy as np
from pyspark.sql import functions as F

from leafloom.llm import ann


def test_recall_with_a_third_equal(spark):
    rnd, n = np.random.default_rng(2), 6000
    x = rnd.standard_normal((n, 64))
    x[rnd.permutation(n)[: n // 3]] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = {True: [], False: []}
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit[bool((x[q] == x[0]).all())].append(len(got[q] & set(np.lexsort((np.arange(n), d))[:10].tolist())) / 10)
    print("recall", np.mean(hit[True]), np.mean(hit[False]))
    assert np.mean(hit[True]) == 1 and np.mean(hit[False]) >= 0.9
