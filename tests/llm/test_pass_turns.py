"""op2's plan keeps its bound of misses at any size, and passes made in turns give what they give at once."""

import math

import numpy as np
import pytest

from leafloom.llm import embed_dedup as E


@pytest.mark.parametrize("rows", [10**3, 10**5, 10**6, 10**8, 10**9])
@pytest.mark.parametrize("background", [0.0, 0.8, 0.9])
def test_the_bound_holds_at_any_size(rows, background):
    agree = E.agreement(E.THRESHOLD, 1 - background)
    passes, window = E.plan_passes(rows, agree)
    meet = max(agree, 0.5) ** E.leading_bits(rows, window)
    assert passes * math.log1p(-meet) <= math.log(E.MISS) * 0.999
    assert [p for t in E.turns(passes) for p in t] == list(range(passes)) and all(len(t) <= E.PASSES_AT_ONCE for t in E.turns(passes))


def test_turns_give_the_same(spark, monkeypatch):
    rnd, n, dim = np.random.default_rng(4), 1500, 16
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rnd.standard_normal((n, dim)))
    x[1000:] = unit(x[:500] + 0.05 * rnd.standard_normal((500, dim)))
    x[1200:1400] = unit(x[1199] + 0.04 * rnd.standard_normal((200, dim)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    once = sorted(map(tuple, E.near_duplicate_vectors(df).collect()))
    passes = E.plan_passes(n, E.agreement(E.THRESHOLD, 1.0))[0]
    monkeypatch.setattr(E, "plan_passes", lambda rows, agree, window: (passes, window))
    monkeypatch.setattr(E, "PASSES_AT_ONCE", max(2, passes // 3))
    assert len(E.turns(passes)) > 2
    assert sorted(map(tuple, E.near_duplicate_vectors(df).collect())) == once
    assert sum(r[1] for r in once) == int((x @ x.T >= E.THRESHOLD).sum()) - n
