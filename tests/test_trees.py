import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafloom.operators import claims, tree, zoom

COLUMNS = [c.split()[0] for c in tree.NODE_SCHEMA.split(", ")]


def doc(seed, sections, most):
    r = random.Random(seed)
    return "\n\n".join(f"# Part {k}\n\n" + " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(30, most))) + "." for k in range(sections))


def as_tree(text):
    df = pd.DataFrame(tree.rows_of(tree.build_tree(text)), columns=COLUMNS).astype(object)
    return zoom.Tree.of_frame(df)


def test_closed_form_is_the_loop():
    for n in range(1, 200):
        loop, left = [], n
        while left:
            take = left if left <= 6 else 3
            loop.append(take)
            left -= take
        groups = tree.grouped([tree.Node(str(k), "", 0, (0, 0)) for k in range(n)])
        assert [len(g) for g in groups] == loop


@pytest.mark.parametrize("seed", range(6))
def test_tree_shape(seed):
    root = tree.build_tree(doc(seed, seed + 1, 900))
    for n in root.walk():
        assert n.is_leaf == (not n.children) and len(n.children) != 1
        for c in n.children:
            assert c.parent is n and n.span[0] <= c.span[0] <= c.span[1] <= n.span[1] and c.depth == n.depth + 1
        assert set(n.cites) <= {x.id for x in n.leaves()} and 0 <= n.importance <= 1


@pytest.mark.parametrize("words,depth", [(150, 2), (1500, 5), (20000, 7)])
def test_depth_bounds(words, depth):
    assert max(n.depth for n in tree.build_tree(" ".join(f"w{k}" for k in range(words))).walk()) <= depth


def test_tiny_document_is_a_leaf():
    root = tree.build_tree("just a few words")
    assert root.is_leaf and root.importance == 1.0


@pytest.mark.parametrize("seed", range(6))
def test_zoom_invariants(seed):
    t = as_tree(doc(seed, 4, 1200))
    tokens = zoom.expansion_sequence(t)
    page, words = zoom.Page(t), []
    for token in tokens:
        page.apply(token)
        words.append(page.words)
    assert len(set(tokens)) == len(tokens) and words == sorted(set(words))
    assert all(t.of[n]["is_leaf"] for n in page.on)
    kept = set(tokens[: len(tokens) // 2])
    mid, again = zoom.Page(t), zoom.Page(t)
    for token in tokens[: len(tokens) // 2]:
        mid.apply(token)
    opened = {a for n in mid.on for a in t.above(n)}
    keep = opened | {zoom.PROSE + n for n in mid.prose & mid.on}
    anchor = min(mid.on, key=lambda n: -t.of[n]["doc_pos"])
    for token in zoom.expansion_sequence(t, anchor, keep)[: len(keep)]:
        again.apply(token)
    assert again.on == mid.on and kept


def test_relational_forms_follow_the_sequence(spark):
    df = spark.createDataFrame([(k, doc(k, 3, 900)) for k in range(3)], "doc_id long, text string")
    nodes = tree.build_trees(df).cache()
    up, steps = tree.closure(nodes), zoom.zoom_steps(nodes)
    opened = zoom.opening_steps(steps, up)
    reveal = zoom.reveal_steps(nodes, opened, up)
    for k in (0, 2, 5, 10_000):
        got = {}
        for r in zoom.frontier_at(nodes, opened, reveal, F.lit(k)).select("tree_id", "node_id").collect():
            got.setdefault(r.tree_id, set()).add(r.node_id)
        for i in range(3):
            t = as_tree(doc(i, 3, 900))
            page = zoom.Page(t)
            for token in zoom.expansion_sequence(t)[:k]:
                page.apply(token)
            assert got[i] == page.on
    assert tree.closure(tree.with_ancestors(nodes)).exceptAll(up).count() == 0 == up.exceptAll(tree.closure(tree.with_ancestors(nodes))).count()
    total = {r.tree_id: r.source_words for r in zoom.words_in_source(nodes, up).join(nodes.where("parent is null").select("tree_id", "node_id"), ["tree_id", "node_id"]).collect()}
    assert total == {r.tree_id: r.w for r in nodes.where("is_leaf").groupBy("tree_id").agg(F.sum("words").cast("double").alias("w")).collect()}
    rects = zoom.treemap(nodes, zoom.words_in_source(nodes, up), tree.sections(nodes), 1200, 800).toPandas()
    assert ((rects.x >= 0) & (rects.x + rects.w <= 1200.01) & (rects.y + rects.h <= 800.01)).all()


def test_strips_keep_area_and_order():
    cells = zoom.strips([5, 1, 3, 2, 8], 0, 0, 300, 200, 0)
    assert sum(w * h for *_, w, h in cells) == pytest.approx(300 * 200)
    assert [(round(y, 6), round(x, 6)) for x, y, _, _ in cells] == sorted((round(y, 6), round(x, 6)) for x, y, _, _ in cells)


def test_claims(spark):
    leaves = spark.createDataFrame([("t", "l1", "Submit the report by Friday 14 November 2025 at 5 pm. Ann to write the summary by 3 May."), ("t", "l2", "The budget is 1,500 dollars.")], "tree_id string, leaf_id string, text string")
    facts = spark.createDataFrame([("t", 1, "1,500 dollars", "The budget is 1500 dollars", ["l2", "zz"]), ("t", 2, "2,000 dollars", "The budget is 2000 dollars", ["l2"]), ("t", 3, "1,500", "the budget", [])], "tree_id string, claim_id int, big string, detail string, cites array<string>")
    assert [(r.claim_id, r.cites) for r in claims.key_facts(facts, leaves).collect()] == [(1, ["l2"])]
    due = spark.createDataFrame([("t", 1, "11-14", "17:00", "Report due", ["l1"]), ("t", 2, "2025-11-15", None, "Report due", ["l1"])], "tree_id string, claim_id int, iso string, time string, label string, cites array<string>")
    assert [(r.iso, r.time, r.year_inferred) for r in claims.deadlines(due, leaves, F.lit("2025-01-01").cast("date")).collect()] == [("2025-11-14", "17:00", False)]
    items = spark.createDataFrame([("t", 1, 0, "Budget", "The budget is 1,500 dollars", ["l2"]), ("t", 2, 1, "Due", "Submit the report by Friday", ["l1"]), ("t", 3, 2, "budget", "again", ["l2"]), ("t", 4, 3, "Length", "not stated", [])], "tree_id string, claim_id int, pos int, label string, value string, cites array<string>")
    assert [r.label for r in claims.essentials(items, leaves).orderBy("place").collect()] == ["Due", "Budget", "Length"]
    acts = claims.extract_actions(leaves).collect()
    assert [(a.who, a.what, a.due) for a in acts] == [("Ann", "write the summary", "3 May")]


def test_anchor_counts_are_those_of_single_offsets(spark):
    rng = random.Random(3)
    page, asked = [], []
    for t in range(40):
        at = 0
        for k in range(rng.randrange(9)):
            at = max(0, at + rng.randrange(-4, 12))
            page.append((t, f"n{k}", k, at, at + rng.randrange(20)))
        asked += [(t, i, rng.randrange(-20, 120)) for i in range(60)] + [(t, 60, None)]
    n = spark.createDataFrame(page, "tree_id long, node_id string, doc_pos int, span_start int, span_end int")
    o = spark.createDataFrame(asked, "tree_id long, offset_id long, offset long")
    want = zoom.anchors_at(n, o, 16).groupBy("tree_id", "anchor").agg(F.count("*").alias("n"), F.sum("offset").alias("s"))
    got = zoom.anchor_counts(n, o.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.coalesce("offset", F.lit(10**6)))).alias("l")), F.expr("transform(l, x -> nullif(x, 1000000))"))
    assert sorted(map(str, got.collect())) == sorted(str(r).replace(", n=", ", offsets=").replace(", s=", ", offset_sum=") for r in want.collect())


def test_frames_are_bounded():
    sizes = [len(f) for f in tree.frames(((k, k) for k in range(7)), ["a", "b"], 3)]
    assert sizes == [3, 3, 1] and list(tree.frames(iter(()), ["a"])) == []
