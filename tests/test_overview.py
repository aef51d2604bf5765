"""Pages, blocks, overviews, prompts, reports, markers and replay on small hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from leafloom.functions import pages as P
from leafloom.operators import overview as O
from leafloom.operators import tree
from leafloom.sources import sinks
from leafloom.streaming import live

HTML = """<!doctype html><html><head><title>The&nbsp;Tab</title><meta property="og:title" content="Tea &amp; Co"></head><body>
<nav><ul><li>Home</li></ul></nav><article><h2>One
 two</h2><p>First <b>bold</b> word.<br>Next</p><ul><li>a</li><li>b</li></ul><div class="ad">buy</div><script>x < y</script><p>1 &lt; 2</p></article><footer>end</footer></body></html>"""


def test_page_markdown(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "plain text"), (5, "<p>open <title>T</title>")], "k int, html string")
    got = {r.k: (r.m, r.t) for r in df.select("k", P.html_markdown(F.col("html")).alias("m"), P.html_title(F.col("html")).alias("t")).collect()}
    assert got[1] == ("## One two\n\nFirst bold word.\nNext\n\n- a\n- b\n\n1 < 2", "Tea & Co")
    assert got[2] == got[3] == ("", None)
    assert got[4] == ("plain text", None)
    assert got[5][1] == "T"


def test_blocks(spark):
    text = "# Title\ntext one\ntext two\n\n- a\n* b\n1. c\n2) d\n\n  \n## \n\nlast"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n\n"), (4, "- x\r\n\r\n- y")], "doc_id int, text string")
    got = {}
    for r in P.markdown_blocks(df).orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r["items"]))
    assert got[1] == [("h", 1, ["Title"]), ("p", None, ["text one text two"]), ("ul", None, ["a", "b"]), ("ol", None, ["c", "d"]), ("h", 2, [""]), ("p", None, ["last"])]
    assert got[4] == [("ul", None, ["x"]), ("ul", None, ["y"])]
    assert set(got) == {1, 4}


def test_job_hints_edges(spark):
    rows = [(1, 1, "Notes of 3 March."), (1, 2, "Deadline: 4 May 2025, 12 am"), (2, 1, ""), (2, 2, None), (3, 1, "Hand in 1,500-word essays on June 5th, 2024 at 9:05pm now please do")]
    got = {r.tree_id: r for r in O.job_hints(spark.createDataFrame(rows, "tree_id int, leaf_id int, text string")).collect()}
    assert (got[1].due_iso, got[1].due_time, got[1].due_leaf, got[1].size_basis) == ("2025-05-04", "00:00", 2, "Notes of 3 March.")
    assert (got[2].start_text, got[2].size_basis, got[2].due_iso) == (None, None, None)
    assert (got[3].size_basis, got[3].due_iso, got[3].due_time) == ("a 1,500 words limit", "2024-06-05", "21:05")
    assert got[3].start_text == "Hand in 1,500-word essays on June 5th, 2024"


def test_asking_again():
    seen = []

    def model(replies):
        it = iter(replies)

        def ask(prompt, system):
            seen.append(prompt)
            return next(it)

        return O.asking(ask)

    good = json.dumps({"text": "one two three"})
    assert model(["no json", f"```json\n{good}\n```"])(["a b"], 3)["text"] == "one two three"
    assert "valid JSON" in seen[-1]
    assert model([good, json.dumps({"text": " "})])(["a b"], 30)["text"] == "one two three"
    assert "come closer to 30 (+27)" in seen[-1]
    assert model([good, "rubbish"])(["a b"], 30)["text"] == "one two three"
    with pytest.raises(O.ReplyError):
        model(["x", None])(["a b"], 3)
    root = tree.build_tree("word " * 400, O.asking(lambda p, s: json.dumps({"text": "all of it", "cites": "no list", "key_points": None})))
    assert root.text == "all of it" and root.key_points == [] and json.loads(root.reply)["said"] == {"key_points": None}


def test_prompts(spark):
    row = spark.range(1).select(
        O.provisional_prompt(F.lit("T"), F.lit("no heads")).alias("a"), O.provisional_prompt(F.lit(None).cast("string"), F.lit("# h\n  ## i\nx")).alias("b"), O.with_focus(F.lit("S"), F.lit("learn"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert row.a == "Title: T\n\nno heads"
    assert row.b == "Title: \n\n# h ## i x\n\nHeadings:\n# h\n## i"
    assert row.c.startswith("S\n\nReader's goal: learn\n") and row.c.endswith(O.FOCUS_TAIL)


def test_markers(spark, tmp_path):
    path = str(tmp_path / "marks")
    build = lambda i, src="s": spark.createDataFrame([(i, "t", src, None, "m")], "tree_id string, title string, source_text string, objective string, model string")
    at = lambda k: F.lit(f"2025-01-01 00:00:0{k}").cast("timestamp")
    sinks.save_markers(build("a"), path, at(1))
    sinks.save_markers(build("b"), path, at(1))
    sinks.save_markers(build("c", None), path, at(1))
    sinks.delete_markers(spark.createDataFrame([("a",), ("../x",), ("none",)], "tree_id string"), path, at(2))
    assert [r.tree_id for r in sinks.read_markers(spark, path).collect()] == ["b"]
    sinks.save_markers(build("a", "again"), path, at(3))
    assert {r.tree_id: r.source_text for r in sinks.read_markers(spark, path).collect()} == {"a": "again", "b": "s"}
    with pytest.raises(ValueError):
        sinks.save_markers(build("../x"), path, at(4))


def test_figures_and_json(spark):
    got = spark.createDataFrame([(1.25,), (2.0,), (0.04,), (None,)], "x double").select(sinks._figure(F.col("x")).alias("f")).collect()
    assert [r.f for r in got] == ["1.3", "2", "0", "-"]
    d = spark.createDataFrame([(1, "B1", "y"), (1, "A1", "x")], "u int, phase string, doc_label string")
    p = spark.createDataFrame([(1, "A1", 2)], "u int, phase string, documents int")
    m = spark.createDataFrame([(2, "z")], "u int, metric string")
    row = sinks.report_json(d, p, m, ["u"]).first()
    said = json.loads(row.json)
    assert [x["phase"] for x in said["documents"]] == ["A1", "B1"] and said["phases"] == [{"phase": "A1", "documents": 2}] and "pattern" not in said
    with pytest.raises(ValueError):
        sinks.report_json(d, p, m, [])


def test_replay(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "seq long, what string"
    spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], schema).write.json(path)
    assert [r.what for r in live.progress_history(spark, path, schema).collect()] == ["a", "b", "c"]
    assert [r.what for r in live.progress_history(spark, path, schema, after=1).collect()] == ["c"]
    q = live.append_to(live.progress_stream(spark, path, schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
