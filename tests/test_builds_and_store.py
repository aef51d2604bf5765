import json
import time

import pytest
from pyspark.sql import functions as F

from leafloom.operators import builds, tree
from leafloom.sources import store


def test_builds_give_their_results(spark):
    got = builds.build_together(spark, {n: (lambda n=n: spark.range(n).count()) for n in (3, 5)})
    assert got == {3: 3, 5: 5}


def test_the_first_failure_stops_the_others(spark):
    docs = spark.range(8).selectExpr("id AS doc_id", "repeat('some words that go on. ', 60) AS text").repartition(2)

    def failing(texts, target):
        raise ValueError("no model")

    def slow(texts, target):
        time.sleep(15)
        return tree.extractive(texts, target)

    make = lambda summarise: lambda: tree.build_trees(docs, summarise=summarise).count()
    began = time.time()
    with pytest.raises(builds.BuildFailed, match="bad"):
        builds.build_together(spark, {"slow": make(slow), "bad": make(failing), "late": make(slow)}, at_once=2)
    assert time.time() - began < 30
    assert spark.range(3).count() == 3  # later jobs are not touched


def nodes(spark, lone):
    """A root over a leaf and, with lone, a summary of one leaf."""
    rows = [("r", None, False, 0), ("a", "r", not lone, 1), ("b", "r", True, 3)] + ([("c", "a", True, 2)] if lone else [])
    flat = spark.createDataFrame([(i, p, leaf, k) for i, p, leaf, k in rows], "node_id string, parent string, is_leaf boolean, doc_pos int")
    return flat.select("doc_pos", "node_id", "parent", "is_leaf", F.concat(F.lit("T"), "node_id").alias("title"), F.lit(0.5).alias("importance"))


def test_two_builds_and_a_damaged_file(spark, tmp_path):
    path = str(tmp_path)
    head = lambda *rows: spark.createDataFrame(rows, "tree_id string, saved_at string, title string").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    put = lambda trees, lone, build: store.save(store.nested(nodes(spark, lone).crossJoin(trees.select("tree_id")), trees), path, build)
    put(head(("x", "2024-01-01", "old x"), ("y", "2024-01-02", "old y")), True, "v1")
    put(head(("x", "2024-02-01", "x")), False, "v2")
    put(head(("x", "2024-03-01", "x again")), False, "v2")
    (tmp_path / "build=v1" / "bad.json").write_text('{"tree_id": "z", \n{"tree_id": "w"}\n' + json.dumps({"tree_id": None, "nodes": []}) + "\n")
    every = store.read_all(spark, path)
    assert sorted((r.tree_id or "", r.problem or "") for r in every.collect()) == [("", "no JSON of a tree"), ("", "no tree id"), ("w", "no nodes"), ("x", ""), ("x", ""), ("x", ""), ("y", "")]
    got = store.read_first(spark, path, ["v2", "v1"])
    assert {r.tree_id: (r.build, r.title) for r in got.collect()} == {"x": ("v2", "x again"), "y": ("v1", "old y")}
    assert [r.tree_id for r in store.recent(got, 1).collect()] == ["x"]
    flat = store.nodes_of(got, F.col("build") == "v1")
    assert sorted((r.tree_id, r.node_id, r.parent or "", r.depth, r.title) for r in flat.collect()) == [
        ("x", "a", "r", 1, "Ta"), ("x", "b", "r", 1, "Tb"), ("x", "r", "", 0, "Tr"), ("y", "b", "r", 1, "Tb"), ("y", "c", "r", 1, "Tc"), ("y", "r", "", 0, "Tr"),
    ]
    assert store.nodes_of(got).count() == 6 and store.read_first(spark, path, ["v1"]).count() == 2


def test_markers_are_compacted(spark, tmp_path):
    path = str(tmp_path / "notes")
    at = lambda k: F.lit(f"2025-01-01 00:00:0{k}").cast("timestamp")
    begin = lambda *ids: spark.createDataFrame([(i, "T", f"text {i}", None, "m") for i in ids], "tree_id string, title string, source_text string, objective string, model string")
    ended = lambda *ids: spark.createDataFrame([(i,) for i in ids], "tree_id string")
    assert store.begun(spark, path).count() == 0 and store.compact(spark, path) == 0
    store.note(begin("a", "b", "c"), path, at(1))
    store.note(ended("a"), path, at(2), gone=True)
    store.note(begin("d"), path, at(3))
    store.note(ended("c"), path, at(1), gone=True)
    (tmp_path / "notes" / "unfinished").mkdir()
    before = sorted(map(tuple, store.begun(spark, path).collect()))
    assert [r[0] for r in before] == ["b", "d"]
    assert store.compact(spark, path) == 4 and sorted(map(tuple, store.begun(spark, path).collect())) == before
    assert len([p for p in (tmp_path / "notes").iterdir() if (p / "_SUCCESS").exists()]) == 1
    store.note(ended("d"), path, at(4), gone=True)
    store.note(begin("a"), path, at(5))
    assert [r.tree_id for r in store.begun(spark, path).orderBy("tree_id").collect()] == ["a", "b"]
