import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.llm import runs as R


def brute(w, exponent=2):
    """Every maximal stretch by its smallest period, straight from the definition."""
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= exponent * q and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def is_lyndon(w):
    return all(w < w[k:] for k in range(1, len(w)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 4))
def test_runs_and_lyndon_words(t, times):
    t = t * times
    for e in (2, 3, 4):
        assert R.runs(t, e) == brute(t, e)
    words, ext, _ = R.lyndon(t)
    for i, k in enumerate(words):
        assert is_lyndon(t[i : i + k]) and not any(is_lyndon(t[i : i + m]) for m in range(k + 1, len(t) - i + 1))
        j = i + k
        assert t[i : i + ext[i]] == t[j : j + ext[i]] and (j + ext[i] == len(t) or t[i + ext[i]] != t[j + ext[i]])


def hard(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    thue = [bin(i).count("1") & 1 for i in range(n)]
    return {"equal": [0] * n, "pairs": [0, 1] * (n // 2), "fibonacci": b[:n], "thue": thue, "falling": list(range(n, 0, -1)), "nested": ([0] * 63 + [1]) * (n // 64), "ruler": [(i & -i).bit_length() for i in range(1, n + 1)], "blocks": [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]]}


@pytest.mark.parametrize("name", sorted(hard(64)))
def test_matches_grow_with_the_length(name):
    for sign in (1, -1):
        few, many = (R.lyndon([sign * x for x in hard(n)[name]])[2] for n in (4_096, 65_536))
        assert many <= 3 * 65_536 and many <= 17 * max(few, 4_096)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12).map(lambda x: x * 5) | st.lists(st.integers(0, 30), max_size=30), max_size=6))
def test_stretches_hold_every_run(docs):
    starts = np.cumsum([0] + [len(d) for d in docs])[:-1].astype(np.int64)
    codes = np.array([x for d in docs for x in d], np.int64)
    held = R.stretches(codes, starts) if docs else []
    for d, at in zip(docs, starts.tolist()):
        for s, length, _ in brute(d, R.EXPONENT):
            if length >= R.LENGTH:
                assert any(a <= at + s and at + s + length <= b for a, b in held)
    assert all(not a < s < b for a, b in held for s in starts.tolist())


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = [r for r in brute(words, 4) if r[1] >= 6]
    drop = {i for s, length, q in own for i in range(s + q, s + length)}
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, sha("".join("%d,%d,%d\n" % r for r in own)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_on_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in R.op12_lyndon_word_runs(spark, sf).collect()}
    # the plain version takes quadratic time: it is asked for every document that it can do
    short = [r for r in rows if len((r.text or "").split()) <= 1_500]
    assert len(got) == len({r.doc_id for r in rows}) and len(short) > 150
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: expected(*r) for r in short}
    assert sum(g[1] > 0 for g in got.values()) > 5


def test_edges(spark):
    rnd = random.Random(2)
    texts = [None, "", " \t\n", "a", "ha " * 6, "ha " * 5, "x\x1cy " * 8, "a b\xa0c " * 4 + "é É " * 9, "ab ab ab ab AB AB", "\x0b".join("pq" * 9), " ".join(rnd.choice("ab") for _ in range(300)), "one two three " * 4_000]
    ids = [None, None, 3, 4, 4, *range(1, 8)]
    rows = [(d, t, "s", 1) for d, t in zip(ids, texts)] * 2
    for plant in (False, True):
        got = R.word_runs(spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int"), plant=plant).collect()
        want = [expected(d, t, plant) for d, t, *_ in rows if t is None or len(t) < 5_000]
        assert len(got) == len(rows) and {repr(tuple(g)) for g in got} >= set(map(repr, want))
    big = R.word_runs(spark.createDataFrame([(9, "one two three " * 4_000)], "doc_id long, text string")).first()
    assert tuple(big)[:6] == (9, 1, 0, 12_000, 3, 4_000_000)


def test_empty_table(spark):
    assert R.word_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
