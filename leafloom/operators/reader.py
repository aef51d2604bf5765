"""What the reader keeps and shows beside the text: highlights, positions, sections on the page, the next section, map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zoom import PROSE


def valid_highlights(h: DataFrame) -> DataFrame:
    """h: id, node_id, start, end, colour."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = F.col("id").rlike(r"^[A-Za-z0-9_-]{1,40}$") & F.col("node_id").isNotNull() & finite("start") & finite("end") & (F.col("end") > F.col("start")) & F.col("colour").rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")
    return h.where(F.coalesce(ok, F.lit(False)))


def valid_positions(p: DataFrame) -> DataFrame:
    """p: z, anchor_node_id, anchor_offset; an offset may be missing but not be no number."""
    ok = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf")) & (F.col("anchor_offset").isNull() | (~F.isnan("anchor_offset") & (F.abs("anchor_offset") < float("inf"))))
    return p.where(F.coalesce(ok, F.lit(False)))


def anchored_highlights(highlights: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid highlights that begin inside their node's text, cut at its end, last first: the order to apply them in.

    nodes: tree_id, node_id, text and, from split_maths(), maths; an end inside a formula moves to its nearer side.
    """
    x = valid_highlights(highlights).join(nodes.select("tree_id", "node_id", F.length("text").alias("_n"), "maths"), ["tree_id", "node_id"])

    def snapped(c: Column) -> Column:
        hit = F.get(F.filter("maths", lambda m: (m["start"] < c) & (c < m["end"])), F.lit(0))
        return F.when(hit.isNull(), c).when(c - hit["start"] < hit["end"] - c, hit["start"]).otherwise(hit["end"])

    x = x.where((F.col("start") < F.col("_n")) & (F.col("start") >= 0)).withColumns({"start": snapped(F.col("start")), "end": F.least(snapped(F.col("end")), F.col("_n"))}).where("end > start")
    w = Window.partitionBy("tree_id", "node_id").orderBy(F.desc("start"), F.desc("end"), "id")
    return x.withColumn("place", F.row_number().over(w)).drop("_n", "maths")


def page_tokens(page: DataFrame, prose: DataFrame, up: DataFrame) -> DataFrame:
    """(tree_id, token) that keep a page as it is: all ancestors of what is on it, and the paragraphs among it."""
    on = page.select("tree_id", "node_id", "parent")
    above = up.where("distance > 0").join(on, ["tree_id", "node_id"], "left_semi").select("tree_id", F.col("ancestor").alias("token"))
    shown = prose.join(on.where("parent is not null"), ["tree_id", "node_id"], "left_semi").select("tree_id", F.concat(F.lit(PROSE), "node_id").alias("token"))
    return above.unionByName(shown).distinct()


def section_of(nodes: DataFrame, section_ids: DataFrame, up: DataFrame) -> DataFrame:
    """(tree_id, node_id, section_id, section_no): the nearest ancestor (or itself) that is a section; null above them."""
    s = section_ids.select("tree_id", F.col("node_id").alias("ancestor"), "section_no")
    near = up.join(s, ["tree_id", "ancestor"]).groupBy("tree_id", "node_id").agg(F.min_by(F.struct("ancestor", "section_no"), "distance").alias("s"))
    return nodes.select("tree_id", "node_id").join(near, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.col("s.ancestor").alias("section_id"), F.col("s.section_no").alias("section_no"))


def page_runs(page: DataFrame, sections: DataFrame) -> DataFrame:
    """page with section_id and run: neighbours of one section in document order make a run."""
    w = Window.partitionBy("tree_id").orderBy("doc_pos")
    x = page.join(sections, ["tree_id", "node_id"], "left").withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("section_id").eqNullSafe(F.lag("section_id").over(w))).cast("int")))
    return x.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rail(section_nodes: DataFrame, page: DataFrame) -> DataFrame:
    """(tree_id, node_id, points, up_next, up_next_no): a section's points unless it shows them on the page itself, and the section after it.

    section_nodes: tree_id, node_id, section_no, title, key_points. page: tree_id, node_id, skim.
    """
    w = Window.partitionBy("tree_id").orderBy("section_no")
    shown = page.where("skim").select("tree_id", "node_id", F.lit(True).alias("_shown"))
    x = section_nodes.withColumns({"up_next": F.lead("title").over(w), "up_next_no": F.lead("section_no").over(w)}).join(shown, ["tree_id", "node_id"], "left")
    return x.select("tree_id", "node_id", F.when(F.col("_shown").isNull(), F.col("key_points")).alias("points"), "up_next", "up_next_no")


def tiles(rects: DataFrame, nodes: DataFrame, page: DataFrame, up: DataFrame) -> DataFrame:
    """rects of the map that are drawn, with their kind: a tile is open if something below it is on the page and its children have room."""
    opened = up.where("distance > 0").join(page.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi").select("tree_id", F.col("ancestor").alias("node_id")).distinct().withColumn("_open", F.lit(True))
    room = rects.join(nodes.select("tree_id", "node_id", "parent"), ["tree_id", "node_id"]).select("tree_id", F.col("parent").alias("node_id")).distinct().withColumn("_room", F.lit(True))
    x = rects.join(nodes.select("tree_id", "node_id", "is_leaf"), ["tree_id", "node_id"]).join(opened, ["tree_id", "node_id"], "left").join(room, ["tree_id", "node_id"], "left")
    x = x.withColumn("expanded", F.coalesce(F.col("_open") & F.col("_room"), F.lit(False)))
    closed = x.where("not expanded").select("tree_id", F.col("node_id").alias("ancestor")).join(up.where("distance > 0"), ["tree_id", "ancestor"]).select("tree_id", "node_id").distinct()
    kind = F.when((F.col("level") == 0) & F.col("expanded"), "sec-frame").when(F.col("level") == 0, "sec-solid").when(F.col("is_leaf"), "leaf").when(F.col("expanded"), "frame").otherwise("solid")
    return x.withColumn("kind", kind).drop("_open", "_room", "expanded").join(closed, ["tree_id", "node_id"], "left_anti")


def reveal_hits(hits: DataFrame, reveal: DataFrame, steps: DataFrame, opened: DataFrame) -> DataFrame:
    """hits (tree_id, node_id, field, is_leaf) with k: the step that shows them, in paragraph form where the hit is in the text of a summary and the node is then still on the page."""
    para = steps.where("form = 'prose'").select("tree_id", "node_id", F.col("step").alias("_prose"))
    x = hits.join(reveal, ["tree_id", "node_id"], "left").join(para, ["tree_id", "node_id"], "left").join(opened, ["tree_id", "node_id"], "left")
    want = F.greatest("k", "_prose")
    needs = (F.col("field") == "text") & ~F.col("is_leaf") & F.col("_prose").isNotNull() & (F.col("opened_at").isNull() | (F.col("opened_at") > want))
    return x.withColumn("k", F.when(needs, want).otherwise(F.col("k"))).drop("_prose", "opened_at")
