import json

from pyspark.sql import functions as F

from leafloom.functions.maths import formulas, split_maths
from leafloom.operators import reader, tree, zoom
from leafloom.sources.page_layout import gutter_of, layout_markdown, read_layouts, real_table

from .test_trees import doc


def test_formulas():
    src = lambda t: [f[1] for f in formulas(t)]
    assert src("area $\\pi r^2$ and $5 or $10") == ["\\pi r^2"]
    assert src("US$x$ and $5$ and $x $ and $y$2") == []
    assert src("$$\na = b\n$$ then `$x$` and \\$x$ ok") == ["a = b"]
    assert src("```\n$x$\n```\n$y$") == ["y"]
    assert src("") == [] and src(None) == []


def words(text, x, top, size=10.0):
    out = []
    for w in text.split():
        out.append({"text": w, "x0": x, "x1": x + 5 * len(w), "top": top, "bottom": top + size, "size": size})
        x += 5 * len(w) + 4
    return out


def test_layout(spark):
    pages = []
    for k in range(4):
        w = words("Annual report", 50, 20) + words(f"Page {k + 1}", 300, 780)
        if k == 0:
            w += words("Big Heading", 50, 100, 20.0)
        for row in range(12):
            w += words("left words run on here", 50, 140 + 12 * row) + words("right words go on there", 330, 140 + 12 * row)
        pages.append({"width": 600.0, "height": 800.0, "words": w, "tables": []})
    assert gutter_of(pages[0]["words"], 600.0) is not None
    text = layout_markdown(pages)
    assert text.startswith("Annual") or text.startswith("# Big Heading")
    assert "Page 2" not in text and "# Big Heading" in text and text.index("left words") < text.index("right words")
    got = read_layouts(spark.createDataFrame([(1, json.dumps(pages)), (2, None)], "doc_id long, pages string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: text, 2: None}


def test_tables():
    assert real_table([["a", "b"], ["c|d", "e"]]) == [["a", "b"], ["c\\|d", "e"]]
    assert real_table([["a", None], [None, None]]) is None and real_table([["a", "b"]]) is None


def test_highlights(spark):
    nodes = spark.createDataFrame([("t", "n", "see $a+b$ here")], "tree_id string, node_id string, text string").withColumn("maths", split_maths(F.col("text")))
    rows = [("t", "n", "h1", 0, 6, "#fff"), ("t", "n", "h2", 8, 99, "#ffffff"), ("t", "n", "bad id!", 0, 2, "#fff"), ("t", "n", "h3", 50, 60, "#fff"), ("t", "n", "h4", 3, 3, "#fff"), ("t", "n", "h5", 0, 2, "red")]
    h = spark.createDataFrame(rows, "tree_id string, node_id string, id string, start int, end int, colour string")
    got = [(r.id, r.start, r.end) for r in reader.anchored_highlights(h, nodes).orderBy("place").collect()]
    assert got == [("h2", 9, 14), ("h1", 0, 4)]


def test_sections_tiles_and_tokens(spark):
    nodes = tree.build_trees(spark.createDataFrame([(1, doc(3, 4, 1200))], "doc_id long, text string")).cache()
    up, steps, secs = tree.closure(nodes), zoom.zoom_steps(nodes), tree.sections(nodes)
    opened = zoom.opening_steps(steps, up)
    reveal = zoom.reveal_steps(nodes, opened, up)
    page = zoom.frontier_at(nodes, opened, reveal, F.lit(4))
    of = reader.section_of(nodes, secs, up)
    assert of.where("section_id is null").count() == nodes.where(f"depth < {nodes.join(secs, ['tree_id', 'node_id']).first().depth}").count()
    runs = reader.page_runs(page, of)
    assert runs.agg(F.max("run")).first()[0] == page.join(of, ["tree_id", "node_id"]).select("section_id").distinct().count()
    tokens = {r.token for r in reader.page_tokens(page, steps.where("step <= 4 and form = 'prose'"), up).collect()}
    again = zoom.Tree.of_frame(nodes.toPandas())
    shown = zoom.Page(again)
    for t in zoom.expansion_sequence(again, keep=tokens)[: len(tokens)]:
        shown.apply(t)
    assert shown.on == {r.node_id for r in page.collect()}
    rects = zoom.treemap(nodes, zoom.words_in_source(nodes, up), secs, 1600, 1200)
    kinds = {r.kind for r in reader.tiles(rects, nodes, page, up).collect()}
    assert kinds <= {"sec-frame", "sec-solid", "leaf", "frame", "solid"} and kinds
    rail = reader.rail(nodes.join(secs, ["tree_id", "node_id"]), page.withColumn("skim", ~F.col("is_leaf"))).orderBy("up_next_no").collect()
    assert rail[0].up_next is None and len(rail) == secs.count()
    hits = zoom.search(nodes, "w1").join(nodes.select("tree_id", "node_id", "is_leaf"), ["tree_id", "node_id"])
    assert reader.reveal_hits(hits, reveal, steps, opened).where("k is null").count() == 0
