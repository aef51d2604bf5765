import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafloom.llm import simhash as S
from leafloom.llm.components import connected_components
from leafloom.llm.embed_dedup import link_counts, near_duplicate_vectors, op2_embedding_near_dedup


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(500 + k, 501 + k) for k in range(60)] + [(700, 700 + k) for k in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(1000, links)
    assert got == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


TEXTS = [None, "", "  \n", "One", "one two", "ONE TWO", "É é x y z", "a b c d e f g h", "a b c d e f g h", "a  b\tc d\ne f g h", "the cat " * 50, "x" * 5000]


def test_fingerprint():
    assert [S.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


def test_spark_hash_agrees(spark):
    df = spark.createDataFrame([("héllo wörld x",)], "s string")
    assert df.select(F.xxhash64("s")).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("héllo wörld x".encode(), seed=42)


@pytest.mark.parametrize("seed", range(3))
def test_trie(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 2**64, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    links = [(i, j) for i in range(len(keys)) for j in range(i) if np.bitwise_count(keys[i] ^ keys[j]) <= 3]
    assert S.trie_components(keys, np.array([0, len(keys)]), chunk=500).tolist() == union(len(keys), links)


@pytest.mark.parametrize("rows,root_rows", [(100, 2048), (10**9, 2048), (100, 4)])
def test_join_finds_all(spark, monkeypatch, rows, root_rows):
    """Any choice of blocks, and roots dealt out in chunks, give the same components."""
    monkeypatch.setattr(S, "ROOT_ROWS", root_rows)
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    place = {f: k for k, f in enumerate(signed)}
    got = union(len(fps), [(place[r.a], place[r.b]) for r in S.near_links(df, rows).collect()])
    assert got == union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])


def test_groups(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b c d e f g h"), (3, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.simhash_groups(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = sorted((i if i is not None else -1, min(x[0] for x, c in zip(rows, comp) if c == comp[k] and x[0] is not None)) for k, (i, _) in enumerate(rows))
    assert sorted((r.id if r.id is not None else -1, r.component_id) for r in got) == want
    kept = [r.doc_id for r in S.keep_one(df.withColumn("fp", F.lit("clash"))).collect()]
    assert sorted(kept) == sorted({c for _, c in want})
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_query4(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    comp = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op4_simhash_near_dedup(spark, sf).collect()} == {r.doc_id: (f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp)}


# ---------------------------------------------------------------- vectors


def brute(vectors, threshold=0.95):
    x = {k: np.array(v, dtype=float) for k, v in vectors.items() if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(x)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= threshold]
    place = {k: n for n, k in enumerate(sorted(vectors))}
    comp = union(len(place), [(place[a], place[b]) for a, b in links])
    return {k: (sum(k in p for p in links), sorted(vectors)[comp[place[k]]]) for k in vectors}


def clustered(seed, dim=16):
    rnd = np.random.default_rng(seed)
    out = []
    for size, spread in ((1, 0), (40, 0.02), (60, 0.08), (3, 0.05), (30, 0.12), (200, 1.0)):
        c = rnd.standard_normal(dim)
        out += [(c + spread * rnd.standard_normal(dim) * (np.linalg.norm(c) / 4)).tolist() for _ in range(size)]
    return out


def test_vectors(spark):
    vectors = dict(enumerate([*clustered(1), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.001], [2.0] * 16, [3.0] * 16]))
    rows = [(k, v, "x") for k, v in vectors.items()] + [(0, vectors[0], "again"), (None, [1.0] * 16, "no id")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").repartition(3)
    got = near_duplicate_vectors(df.drop("n_links")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute(vectors)
    assert len(got) == len(vectors) + 1 and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_counts_over_tiles(spark):
    x = np.array(clustered(2)[1:134])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "component long, vec_id long, v array<double>")
    want = ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()
    assert [r.n_links for r in link_counts(df, tile=20).orderBy("vec_id").collect()] == want


def test_query2(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.vec_id: (r.n_links, r.component_id) for r in op2_embedding_near_dedup(spark, sf).collect()} == brute(vectors)
