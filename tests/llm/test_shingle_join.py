import random

import pytest

from leafloom.llm import shingle_join as J

from .test_near_dups import union

pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute(rows):
    sets = [plain_set(t) for _, t in rows]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    return sorted({min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)})


def changed(rnd, words, times):
    words = list(words)
    for at in rnd.sample(range(len(words)), times):
        words[at] = f"new{rnd.randint(0, 10**9)}"
    return words


def near_copies(seed):
    """Bases with copies on both sides of the threshold, a line that most texts share, and texts without five words."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    line = fresh(12)
    texts = ["", None, " \n", "one two", "One  TWO", "one three"]
    for size in (40, 90, 200, 600):
        base = fresh(size)
        texts += [" ".join(changed(rnd, base, times) + (line if k % 2 else [])) for k, times in enumerate([0, 1, size // 60, size // 50, size // 40, size // 30, size // 20] * 3)]
    base = fresh(300)  # copies alike to the base, but not to each other
    texts += [" ".join(changed(rnd, base, 5)) for _ in range(40)] + [" ".join(base)]
    texts += [" ".join(fresh(rnd.randint(3, 30)) + line) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("window", [1, 8])
def test_groups_by_similarity(spark, window, monkeypatch):
    monkeypatch.setattr(J, "WINDOW", window)
    rows = near_copies(window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = J.similar_groups(df, window=window).collect()
    least = {}
    for r in groups:
        least[r.component] = min(least.get(r.component, r.id), r.id)
    assert sorted(least.values()) == kept_by_brute(rows)
    assert J.similar_groups(df.limit(0)).count() == 0


def test_stage_finds_near_copies(spark, sf):
    """Judged by Jaccard similarity, not by fingerprint bits."""
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, sf).collect()) == kept_by_brute(rows)


def test_grown_components(spark):
    from leafloom.llm.components import connected_components, grown

    first = spark.createDataFrame([(2, 1), (4, 3), (9, 8)], "a long, b long")
    more = spark.createDataFrame([(4, 2), (2, 4), (7, 6), (9, 7), (5, 5), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in grown(connected_components(first), more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6}


def test_dense_group_meets_few_pairs(spark, monkeypatch):
    """The windows' pairs follow the number of texts, not its square: each text meets much the same others under every shingle."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = list(enumerate(" ".join(changed(rnd, base, 4)) for _ in range(120)))
    met, verified = [], J._verified
    monkeypatch.setattr(J, "_verified", lambda pairs, *more: met.append(pairs.count()) or verified(pairs, *more))
    groups = J.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert groups.select("component").distinct().count() == len(kept_by_brute(rows))
    assert met[1] < 2 * J.WINDOW * len(rows)  # the second call has what the windows found
