"""tree_zoom_checks builds each tree once, and what it reads from a node's own row is what the joins tell."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import chunking
from leafloom.operators import tree, zoom
from leafloom.plans import catalog


def test_trees_are_built_once(spark, sf):
    """Before: four builds in the plan beside the one that is written, because steps were read four times."""
    plan = catalog.queries()["tree_zoom_checks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "PythonMapInArrow" not in plan


def doc(seed):
    r = random.Random(seed)
    return "\n\n".join(f"# Part {k}\n\n" + " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(10, 900))) + "." for k in range(r.randint(1, 5)))


def test_steps_beside_nodes(spark):
    docs = spark.createDataFrame([(k, doc(k)) for k in range(12)] + [(99, None), (100, "tiny")], "doc_id long, text string")
    nodes, steps = tree.build_trees(docs), zoom.document_steps(docs)
    told = zoom.document_nodes(docs, ("node_id", "parent", "is_leaf", "ancestors"))
    assert told.drop("prose_steps", "expand_steps").exceptAll(nodes.select("tree_id", "node_id", "parent", "is_leaf", "ancestors")).isEmpty() and told.count() == nodes.count()
    forms = [told.select("tree_id", F.explode(c).alias("step"), "node_id", F.lit(form).alias("form")) for c, form in (("prose_steps", "prose"), ("expand_steps", "expand"))]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(forms[0].unionByName(forms[1])) == rows(steps.select("tree_id", "step", "node_id", "form"))
    up = tree.closure(nodes)
    opened = zoom.opening_steps(steps, up)
    assert rows(zoom.opened_by(told)) == rows(opened)
    assert rows(zoom.reveal_steps(nodes, opened)) == rows(zoom.reveal_steps(nodes, opened, up))


WORDS = ["The", "word", "dr.", "e.g.", "3.", "a.", "end.", "End!", "so,", "then;", "“quoted.”", "(x)", "漢字", "。", "か、", "「", "」", "，", "naïve", "ﾀﾞ", "　", "\x1c", "\x85", "”", "x.'", "ok?)", "é"]


def plain_cuts(text, limit):
    """Every unit's mark first, then the ends of pieces, as (start, end)."""
    found = list(chunking._UNIT.finditer(text))
    after = [*(m[0][0] for m in found[1:]), " "]
    marks, size, at, out = [chunking.cut_mark(m[0], a) for m, a in zip(found, after)], [not chunking._NO_WORD.fullmatch(m[0]) for m in found], 0, []
    while at < len(found):
        to = at + 1
        while to < len(found) and sum(size[at : to + 1]) <= limit:
            to += 1
        if to < len(found):
            to = next((k for mark in (2, 1) for k in range(to, at, -1) if marks[k - 1] == mark), to)
        out.append((found[at].start(), found[to - 1].end()))
        at = to
    return out


@pytest.mark.parametrize("seed", range(150))
def test_cuts_told_backwards(seed):
    r = random.Random(seed)
    some = r.sample(WORDS, r.randint(2, len(WORDS)))
    text = "".join(r.choice(some) + r.choice([" ", " ", "", "\n"]) for _ in range(200)).strip()
    starts, ends, words = chunking.unit_spans(text)
    assert [*zip(starts.tolist(), ends.tolist())] == [m.span() for m in chunking._UNIT.finditer(text)]
    assert (words[1:] > words[:-1]).tolist() == [not chunking._NO_WORD.fullmatch(m[0]) for m in chunking._UNIT.finditer(text)]
    got = [(b.start, b.end) for b in chunking.cut_long(chunking.Block(text, 0, len(text), "prose"), 7)]
    assert got == (plain_cuts(text, 7) if chunking.word_count(text) > 7 else [(0, len(text))])
    assert chunking.is_tiny(text) == (chunking.word_count(text) <= chunking.TINY_WORDS)
