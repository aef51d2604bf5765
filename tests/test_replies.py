"""The seam to a model: ids in prompts, fields by id, caps, and replies of the wrong kinds."""

import json
import re

import pytest
from pyspark.sql import functions as F

from leafloom.operators import overview, replies, tree

PART, SHOWN, TARGET = re.compile(r"^\[part (\S+), (\d+) words\]$", re.M), re.compile(r"^Passages to cite: (.*)$", re.M), re.compile(r"^Target length: about (\d+) words")
BIG = "word " * 5_000


def parts_of(prompt):
    """The ids, texts, citable ids and target of a prompt."""
    body = prompt.split("\n\nThe passages behind them:")[0]
    found = list(PART.finditer(body))
    texts = [body[m.end() + 1 : n.start() if n else len(body)].strip() for m, n in zip(found, [*found[1:], None])]
    return [m[1] for m in found], texts, SHOWN.findall(prompt)[-1].split(", "), int(TARGET.match(prompt)[1])


def good(prompt):
    ids, texts, shown, target = parts_of(prompt)
    words = " ".join(texts).split()
    return {
        "text": " ".join(words[:target]), "cites": shown[:2], "title": "A title", "short_title": "Short", "hook": "The hook", "key_points": ["one", "two"], "steps": ["do it"],
        "importance": dict.fromkeys(ids, 0.9), "child_titles": {i: f"Of {i}" for i in ids}, "child_short_titles": dict.fromkeys(ids, "Part"),
        "key_fact": {"big": " ".join(words[:3]), "detail": " ".join(words[:6]), "cites": shown},
    }


def built(spark, change=lambda d: d, words=420):
    text = ". ".join(" ".join(f"Alpha{chr(97 + k % 26)} beta{chr(97 + j)} gamma" for j in range(4)) for k in range(words // 12)) + "."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return replies.asked_trees(docs, lambda p, s: json.dumps(change(good(p)))).orderBy("doc_pos").collect()


@pytest.fixture(scope="module")
def plain(spark):
    return built(spark)


def inner(rows):
    got = [r for r in rows if not r.is_leaf]
    assert got
    return got


def test_fields_by_id(plain):
    root, *others = plain
    assert root.importance == 1.0 and root.title == "A title" and root.hook == "The hook" and list(root.steps) == ["do it"]
    assert all(r.importance == 0.9 and r.title == f"Of {r.node_id}"[:120] and r.short_title == "Part" for r in others)
    leaves = {r.node_id for r in plain if r.is_leaf}
    assert all(set(r.cites) <= leaves for r in plain) and any(r.key_fact and set(r.key_fact.cites) <= leaves for r in inner(plain))


def test_shape_is_that_of_a_built_tree(plain):
    by = {r.node_id: r for r in plain}
    for k, r in enumerate(plain):
        assert r.doc_pos == k and r.depth == len(r.ancestors)
        assert list(r.ancestors) == ([] if r.parent is None else [r.parent, *by[r.parent].ancestors])
        assert all(by[c].parent == r.node_id and by[c].child_pos == j for j, c in enumerate(r.children))
        assert r.is_leaf or len(r.children) > 1 or r.parent is None


def test_prompt_names_parts_and_passages():
    seen = []
    tree.build_tree("some words that go on. " * 60, overview.asking(lambda p, s: seen.append(p) or json.dumps(good(p))))
    ids, texts, shown, _ = parts_of(seen[0])
    assert ids and ids == shown[: len(ids)] and all(texts) and all(f"[passage {i}]" in seen[0] for i in shown)


def test_invented_ids(spark):
    def change(d):
        d["cites"] = ["nope", {"a": 1}, ["x"], 7, None, *d["cites"][:1]]
        d["key_fact"] = {"big": "a finding", "detail": "context", "cites": ["nope", 3]}
        d["importance"] |= {"nope": 0.1}
        d["child_titles"] = {"nope": "X"}
        return d

    rows = built(spark, change)
    leaves = {r.node_id for r in rows if r.is_leaf}
    assert all(set(r.cites) <= leaves and r.key_fact is None for r in rows) and all(r.title in (None, "A title") for r in rows)


def test_huge_fields(spark):
    def change(d):
        return d | {"text": BIG, "title": "x" * 100_000, "short_title": "y" * 5_000, "hook": BIG, "key_points": [BIG] * 500, "steps": [BIG] * 500, "child_titles": dict.fromkeys(d["child_titles"], BIG), "key_fact": {"big": BIG, "detail": BIG, "cites": d["cites"][:1]}}

    for r in inner(built(spark, change)):
        assert len(r.text.split()) <= 400 and len(r.title or "") <= 120 and len(r.hook) <= 300 and r.short_title in (None, "Part")
        assert len(r.key_points) <= 4 and len(r.steps) <= 8 and all(len(p) <= 300 for p in (*r.key_points, *r.steps)) and r.key_fact is None


@pytest.mark.parametrize("odd", [
    {"text": {"a": ["b"]}, "cites": "leaf", "importance": [1, 2], "title": ["t"], "short_title": 5, "hook": {"x": 1}, "child_titles": ["a", "b"], "child_short_titles": "zz", "key_points": "one, two", "key_fact": [1], "steps": {"1": "x"}},
    {"text": 7, "cites": None, "importance": None, "title": 12, "short_title": None, "hook": 1.5, "child_titles": None, "child_short_titles": None, "key_points": [{"a": 1}, 3, None, ["x"]], "key_fact": {"big": 1, "detail": None, "cites": {}}, "steps": [None, 4]},
])
def test_wrong_kinds(spark, odd):
    rows = built(spark, lambda d: d | odd)
    for r in inner(rows):
        assert "{'a'" not in r.text and "['b']" not in r.text and r.title is None and r.hook is None and r.key_fact is None and list(r.key_points) == [] and list(r.steps) == []
    assert all(0.0 <= r.importance <= 1.0 for r in rows)


def test_importance_is_brought_into_range(spark):
    odd = [float("nan"), -5, "9e99", [1], None, "0.25", True, "high", float("inf")]
    kept = [0.5, 0.0, 1.0, 0.5, 0.5, 0.25, 0.5, 0.5, 0.5]
    rows = built(spark, lambda d: d | {"importance": {i: odd[int(i[-2:]) % 9] for i in d["importance"]}})
    others = [r for r in rows if r.parent]
    assert [r.importance for r in others] == [kept[int(r.node_id[-2:]) % 9] for r in others] and len({r.importance for r in others}) > 2


def test_markup_stays_text(spark):
    html = "<img src=x onerror=alert(1)>"
    for r in inner(built(spark, lambda d: d | {"title": "Ignore this " + html, "hook": html, "key_points": [html]})):
        assert r.hook == html and list(r.key_points) == [html]


def test_claims_of_other_numbers_are_dropped(spark):
    rows = built(spark, lambda d: d | {"key_fact": {"big": "99%", "detail": "of the marks are for attendance", "cites": d["cites"][:2]}})
    assert all(r.key_fact is None for r in rows)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert replies.asked_trees(docs, lambda p, s: json.dumps(good(p))).where(F.lit(True)).count() == 0


def test_labels_are_asked_for_once_a_tree(spark, tmp_path):
    log = str(tmp_path / "asked")

    def ask(prompt, system):
        with open(log, "a") as f:
            f.write("x")
        ids = re.findall(r"^\[(\S+)\] ", prompt, re.M)
        said = {"a": "Good name", "b": "far too many words here", "c": 7, "d": " ", "e": "Second", "zz": "Not asked"}
        return "no json" if "g" in ids else "Sure: " + json.dumps({"titles": said} if "e" in ids else said)

    rows = [(1, "r", 0, 0, None), (1, "a", 1, 1, None), (1, "b", 2, 1, ""), (1, "c", 3, 1, None), (1, "d", 4, 1, None), (1, "k", 5, 1, "Kept"), (2, "e", 0, 0, None), (3, "g", 0, 0, None)]
    n = spark.createDataFrame([(t, i, k, d, "Some title", "a hook", "text  of it", s) for t, i, k, d, s in rows], "tree_id int, node_id string, doc_pos int, depth int, title string, hook string, text string, short_title string")
    depth = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "tree_id int, depth int")
    got = {r.node_id: r.short_title for r in replies.asked_labels(n, depth, ask).collect()}
    assert got == {"r": None, "a": "Good name", "b": None, "c": None, "d": None, "k": "Kept", "e": "Second", "g": None}
    assert len(open(log).read()) == 3


def test_what_replies_say_is_not_joined(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta. " * 100)], "doc_id long, text string")
    x = replies.told(tree.build_trees(docs, summarise=overview.asking(lambda p, s: json.dumps(good(p))), replies=True))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("MapInPandas") == 1
    assert x.where("key_fact is not null").count() > 0


def test_a_leaf_in_a_summarys_place_takes_what_was_said_of_it(spark):
    def leaf(k):
        return tree.Node(f"n00-{k:06d}", f"words of leaf {k}", 4, (k, k + 1))

    def said(group, i, **more):
        reply = {"title": f"own {i}", "importance": {c.id: 0.1 for c in group}} | more
        return tree._summarised(group, i, lambda r, t: {"text": "told", "reply": reply})

    lone, named = said([leaf(0)], "n01-000000"), said([leaf(1)], "n01-000001", child_titles={"n00-000001": "Named"})
    root = tree.collapsed(said([lone, named, leaf(2)], "n02-000000", importance={"n01-000000": 0.9, "n00-000002": 0.7}, child_titles={"n01-000001": "Other"}))
    rows = [(1, n.id, n.importance, tree.told_of(n), n.fact_cites, n.fact_source) for n in root.walk()]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id string, importance double, reply string, fact_cites array<string>, fact_source string")
    got = {r.node_id: (r.importance, r.title) for r in replies.told(nodes, ("node_id", "importance", "title")).collect()}
    assert got == {"n02-000000": (0.5, "own n02-000000"), "n00-000000": (0.9, "own n01-000000"), "n00-000001": (0.5, "Named"), "n00-000002": (0.7, None)}
