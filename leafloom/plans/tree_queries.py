"""Queries over documents' passages and summary trees, each with its SQL twin over the tree that SQL builds."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions import units
from leafloom.operators import reader, replies, tree, zoom
from leafloom.sources.shared import written

from .tree_sql import LEAVES, SECTIONS, UP, with_nodes

#: What is looked for, where the anchor lies, how many words an overview shows, minutes that a reader has.
SOUGHT, PLACE, BUDGET, OFFSETS, MINUTES = "the on", 1000, 400, 1000, (0.5, 2.0, 4.0)


def _skim(n: str) -> str:
    w = lambda c: f"len(regexp_extract_all({c}, '[^ \\t\\n\\r\\f\\v]+'))"
    return f"CASE WHEN {n}.is_leaf OR {n}.parent IS NULL OR len({n}.points) = 0 THEN {n}.words ELSE {w(n + '.title')} + list_sum([{w('x')} FOR x IN {n}.points]) END"


TREE_SQL = {
    "leaf_split": f"WITH RECURSIVE {LEAVES} SELECT doc_id, CAST(leaf_no AS INTEGER) AS leaf_no, CAST(words AS INTEGER) AS words, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, atomic, md5(text) AS text_md5 FROM leaves",
    "doc_trees": with_nodes("SELECT doc_id AS tree_id, count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, CAST(max(depth) AS INTEGER) AS max_depth, CAST(max(words) FILTER (parent IS NULL) AS INTEGER) AS root_words FROM nodes GROUP BY doc_id"),
    "tree_nodes": with_nodes("SELECT doc_id AS tree_id, node_id, parent, CAST(depth AS INTEGER) AS depth, is_leaf, CAST(words AS INTEGER) AS words, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, md5(text) AS text_md5, title, array_to_string(points, '|') AS points FROM nodes"),
    "tree_sections": with_nodes("SELECT doc_id AS tree_id, node_id, CAST(section_no AS INTEGER) AS section_no FROM sections", SECTIONS),
    "tree_search": with_nodes(
        f"""SELECT doc_id AS tree_id, node_id, field, CAST((length(low) - length(replace(low, '{SOUGHT}', ''))) // {len(SOUGHT)} AS INTEGER) AS hits FROM (
  SELECT doc_id, node_id, unnest(['title', 'points', 'text']) AS field, lower(unnest([coalesce(title, ''), array_to_string(points, chr(10)), text])) AS low FROM nodes WHERE is_leaf OR parent IS NOT NULL) WHERE contains(low, '{SOUGHT}')"""
    ),
    "tree_closure": with_nodes("SELECT doc_id AS tree_id, count(*) AS pairs, sum(distance)::BIGINT AS distances, count(*) FILTER (distance > 0 AND parent IS NULL) AS under_root FROM up u JOIN (SELECT doc_id AS d, node_id AS a, parent FROM nodes) n ON u.doc_id = n.d AND u.ancestor = n.a GROUP BY doc_id", UP),
    "tree_words_in_source": with_nodes(
        """SELECT doc_id AS tree_id, node_id, w AS source_words, CASE WHEN parent IS NOT NULL THEN greatest(w, 0.06 * sum(w) OVER (PARTITION BY doc_id, parent), 0.001) END AS weight
  FROM (SELECT n.doc_id, n.node_id, n.parent, CASE WHEN l.w > 0 THEN CAST(l.w AS DOUBLE) ELSE greatest(0.0, (n.span_end - n.span_start) / 6.0) END AS w FROM nodes n LEFT JOIN (SELECT u.doc_id, u.ancestor, sum(l.words) AS w FROM up u JOIN nodes l ON u.doc_id = l.doc_id AND u.node_id = l.node_id WHERE l.is_leaf GROUP BY ALL) l ON l.doc_id = n.doc_id AND l.ancestor = n.node_id) n""", UP
    ),
    "tree_provenance": with_nodes(
        """SELECT n.doc_id AS tree_id, n.node_id, CAST(min(l.pos) + 1 AS INTEGER) AS first_leaf, CAST(max(l.pos) + 1 AS INTEGER) AS last_leaf FROM (
  SELECT u.doc_id, u.ancestor AS node_id, u.node_id AS leaf, coalesce(sum(length(l.text)) OVER (PARTITION BY u.doc_id, u.ancestor ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM up u JOIN nodes l ON u.doc_id = l.doc_id AND u.node_id = l.node_id WHERE l.is_leaf AND u.distance > 0) n JOIN nodes l ON l.doc_id = n.doc_id AND l.node_id = n.leaf WHERE before < 6000 GROUP BY n.doc_id, n.node_id""", UP
    ),
    "tree_frontier": with_nodes(
        f"""SELECT n.doc_id AS tree_id, count(*) AS on_page, CAST(sum({_skim('n')}) AS BIGINT) AS skim_words, md5(string_agg(n.node_id, ' ' ORDER BY n.node_id)) AS page_md5 FROM nodes n WHERE n.depth = least(2, (SELECT max(depth) FROM nodes m WHERE m.doc_id = n.doc_id)) GROUP BY n.doc_id"""
    ),
    "tree_anchor": with_nodes(
        f"""SELECT doc_id AS tree_id, arg_min(node_id, struct_pack(a := NOT holds, b := CASE WHEN holds THEN CAST(span_end - span_start AS DOUBLE) ELSE abs((span_start + span_end) / 2.0 - {PLACE}) END, c := span_start, d := depth)) AS anchor
  FROM (SELECT *, span_start <= {PLACE} AND {PLACE} < span_end AS holds FROM nodes WHERE is_leaf) GROUP BY doc_id"""
    ),
    "tree_section_of": with_nodes(
        """SELECT n.doc_id AS tree_id, n.node_id, s.node_id AS section_id, CAST(s.section_no AS INTEGER) AS section_no FROM nodes n LEFT JOIN (SELECT u.doc_id, u.node_id AS below, s.node_id, s.section_no FROM up u JOIN sections s ON s.doc_id = u.doc_id AND s.node_id = u.ancestor) s
  ON s.doc_id = n.doc_id AND s.below = n.node_id""", UP, SECTIONS
    ),
    "tree_rail": with_nodes("SELECT s.doc_id AS tree_id, s.node_id, array_to_string(n.points, '|') AS points, lead(n.title) OVER w AS up_next, CAST(lead(s.section_no) OVER w AS INTEGER) AS up_next_no FROM sections s JOIN nodes n ON s.doc_id = n.doc_id AND s.node_id = n.node_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.section_no)", SECTIONS),
    "tree_source_prefix": with_nodes(
        f"""SELECT doc_id AS tree_id, count(*) AS leaves, CAST(sum(words) AS BIGINT) AS words FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM nodes WHERE is_leaf) WHERE upto <= {BUDGET} OR upto = words GROUP BY doc_id"""
    ),
    "tree_page_tokens": with_nodes(
        "SELECT doc_id AS tree_id, count(*) AS tokens, md5(string_agg(node_id, ' ' ORDER BY node_id)) AS tokens_md5 FROM nodes n WHERE depth < least(2, (SELECT max(depth) FROM nodes m WHERE m.doc_id = n.doc_id)) GROUP BY doc_id"
    ),
    "tree_anchors": with_nodes(
        f"""SELECT tree_id, anchor, count(*) AS offsets, CAST(sum(at_) AS BIGINT) AS offset_sum FROM (
  SELECT o.doc_id AS tree_id, at_, i, arg_min(node_id, struct_pack(a := NOT (span_start <= at_ AND at_ < span_end), b := CASE WHEN span_start <= at_ AND at_ < span_end THEN CAST(span_end - span_start AS DOUBLE) ELSE abs((span_start + span_end) / 2.0 - at_) END, c := span_start, d := pos)) AS anchor
  FROM (SELECT doc_id, i, ((length(text) + 100) * i) // {OFFSETS} AS at_ FROM documents, range({OFFSETS}) t(i)) o JOIN nodes n ON n.doc_id = o.doc_id AND n.is_leaf GROUP BY o.doc_id, at_, i) GROUP BY tree_id, anchor"""
    ),
    "tree_initial_z": with_nodes(
        f"""SELECT d.doc_id AS tree_id, m AS minutes, CASE WHEN d.n / {units.WORDS_PER_MINUTE}.0 <= m THEN 1.0 ELSE p.k / greatest(1, p.total) END AS z
  FROM docs d CROSS JOIN (SELECT unnest([{", ".join(f"{m}::DOUBLE" for m in MINUTES)}]) AS m) t
  JOIN (SELECT doc_id, m, arg_min(k, struct_pack(a := abs(w / {units.WORDS_PER_MINUTE}.0 - m), b := k)) AS k, max(k) AS total FROM pages_, (SELECT unnest([{", ".join(f"{m}::DOUBLE" for m in MINUTES)}]) AS m) GROUP BY doc_id, m) p USING (doc_id, m)""",
        "opens_ AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY depth, pos) AS step FROM nodes WHERE NOT is_leaf)",
        f"""pages_ AS (SELECT k.doc_id, k.k, CASE WHEN k.k = 0 THEN max(r.hook_words) ELSE sum({_skim('n')}) END AS w
  FROM (SELECT doc_id, 0 AS k FROM docs UNION ALL SELECT doc_id, step FROM opens_) k JOIN nodes r ON r.doc_id = k.doc_id AND r.parent IS NULL
  JOIN (SELECT n.*, own.step AS opened, coalesce(up.step, 0) AS came FROM nodes n LEFT JOIN opens_ own ON own.doc_id = n.doc_id AND own.node_id = n.node_id LEFT JOIN opens_ up ON up.doc_id = n.doc_id AND up.node_id = n.parent) n
  ON n.doc_id = k.doc_id AND n.came <= k.k AND (n.opened IS NULL OR n.opened > k.k) GROUP BY k.doc_id, k.k)""",
    ),
    "tree_zoom_checks": with_nodes(
        """SELECT doc_id AS tree_id, true AS tokens_differ, true AS paragraph_before_children, count(*) FILTER (NOT is_leaf) AS opened, count(*) FILTER (is_leaf) AS last_page FROM nodes GROUP BY doc_id"""
    ),
}


def _built(docs: DataFrame) -> DataFrame:
    return tree.build_trees(docs.select("doc_id", "text"))


def _nodes(docs: DataFrame) -> DataFrame:
    """Every tree, built once and written: the queries below read its nodes several times."""
    return written(_built(docs), "nodes")


def tree_nodes(docs):
    """Every node of every document's tree."""
    return _built(docs).select("tree_id", "node_id", "parent", "depth", "is_leaf", "words", "span_start", "span_end", F.md5("text").alias("text_md5"), "title", F.array_join("key_points", "|").alias("points"))


def tree_closure(docs):
    """Pairs of ancestors and nodes of each tree."""
    n = _nodes(docs)
    root = n.select("tree_id", F.col("node_id").alias("ancestor"), "parent")
    return tree.closure(n).join(root, ["tree_id", "ancestor"]).groupBy("tree_id").agg(F.count("*").alias("pairs"), F.sum("distance").alias("distances"), F.count_if((F.col("distance") > 0) & F.col("parent").isNull()).alias("under_root"))


def tree_words_in_source(docs):
    """Words of the passages below each node, and its weight among its siblings."""
    n = _nodes(docs)
    source = zoom.words_in_source(n, tree.closure(n))
    weights = zoom.treemap_weights(n, source).select("tree_id", "node_id", F.when(F.col("parent").isNotNull(), F.col("weight")).alias("weight"))
    return source.join(weights, ["tree_id", "node_id"])


def tree_provenance(docs):
    """First and last passage that each summary cites."""
    n = _nodes(docs)
    return zoom.provenance(n, zoom.leaf_ranks(n))


def _opened(n: DataFrame, levels: int = 2) -> DataFrame:
    """What to open so that the page shows the nodes `levels` below the root, or the leaves of shallower trees."""
    deepest = n.groupBy("tree_id").agg(F.least(F.lit(levels), F.max("depth")).alias("_d"))
    return n.join(deepest, "tree_id").where("depth < _d").select("tree_id", "node_id")


def tree_frontier(docs):
    """The page two levels below each root: how many nodes, their words in short form."""
    n = _nodes(docs)
    page = zoom.frontier_of(n, _opened(n), tree.closure(n))
    return page.groupBy("tree_id").agg(F.count("*").alias("on_page"), F.sum(zoom.skim_words(page)).alias("skim_words"), F.md5(F.array_join(F.array_sort(F.collect_list("node_id")), " ")).alias("page_md5"))


def tree_anchor(docs):
    """The passage at, or nearest to, character PLACE."""
    return zoom.anchor_for(_built(docs).where("is_leaf"), F.lit(PLACE))


def tree_anchors(docs):
    """The passages that a thousand offsets of each document lie in, or nearest to, and how many each has."""
    whole = docs.select(F.col("doc_id").alias("tree_id"), F.length("text").cast("long").alias("n"))
    at = F.expr(f"transform(sequence(0L, {OFFSETS - 1}L), i -> ((n + 100) * i) div {OFFSETS})")
    return zoom.anchor_counts(_built(docs).where("is_leaf"), whole, at)


def tree_initial_z(docs):
    """Where the dial starts for readers with half a minute, two and four, where summaries open level by level."""
    n = _nodes(docs)
    up = tree.closure(n)
    told = F.row_number().over(Window.partitionBy("tree_id").orderBy("depth", "doc_pos"))
    steps = n.where("not is_leaf").select("tree_id", told.alias("step"), F.col("node_id").alias("token"), "node_id", F.lit("expand").alias("form"))
    opened = zoom.opening_steps(steps, up)
    words = zoom.page_words(n, steps, opened, zoom.reveal_steps(n, opened, up))
    whole = docs.select(F.col("doc_id").alias("tree_id"), units.word_count(F.col("text")).alias("words"))
    return zoom.dial_for_minutes(words, whole, list(MINUTES), lambda c: c / units.WORDS_PER_MINUTE)


def _chains(docs):
    """A stored tree of an older kind made of each document: a line of summaries with one child each, a thousand for every fiftieth document."""
    d, i = F.col("doc_id"), F.col("i")
    size = F.when(d % 50 == 0, 1000).otherwise(d % 7)
    line = docs.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), size.cast("int"))).alias("i"), size.alias("n"))
    node = lambda df, name, parent, leaf, importance, title: df.select(F.col("doc_id").alias("tree_id"), name.alias("node_id"), parent.alias("parent"), F.lit(leaf).alias("is_leaf"), importance.alias("importance"), title.alias("title"), F.lit(None).cast("string").alias("short_title"))
    last = F.concat(F.lit("a"), size.cast("string"))
    none = F.lit(None).cast("string")
    rows = node(docs, F.lit("r"), none, False, F.lit(1.0), F.lit("root"))
    rows = rows.unionAll(node(line, F.concat(F.lit("a"), i.cast("string")), F.when(i == 0, "r").otherwise(F.concat(F.lit("a"), (i - 1).cast("string"))), False, (i % 10) / 10, F.concat(F.lit("T"), i.cast("string"))))
    rows = rows.unionAll(node(docs, F.lit("x"), last, True, F.lit(0.5), F.when(d % 5 == 0, F.col("lang"))))
    rows = rows.unionAll(node(docs.where(d % 2 == 0), F.lit("y"), last, True, F.lit(0.25), none))
    return rows.unionAll(node(docs.where(d % 3 > 0), F.lit("b"), F.lit("r"), True, F.lit(0.75), none))


def tree_chains(docs):
    """Stored trees without their pass-through levels."""
    return tree.collapsed_stored(written(_chains(docs), "chains")).drop("short_title")


TREE_SQL["tree_chains"] = """WITH RECURSIVE s AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 0 THEN 1000 ELSE doc_id % 7 END AS n FROM documents),
v AS (SELECT doc_id, 'r' AS node, NULL AS parent, false AS leaf, 1.0::DOUBLE AS importance, 'root' AS title FROM s
  UNION ALL SELECT doc_id, 'a' || i, CASE WHEN i = 0 THEN 'r' ELSE 'a' || (i - 1) END, false, (i % 10) / 10.0, 'T' || i FROM (SELECT doc_id, unnest(range(0, n + 1)) AS i FROM s)
  UNION ALL SELECT doc_id, 'x', 'a' || n, true, 0.5, CASE WHEN doc_id % 5 = 0 THEN lang END FROM s UNION ALL SELECT doc_id, 'y', 'a' || n, true, 0.25, NULL FROM s WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'b', 'r', true, 0.75, NULL FROM s WHERE doc_id % 3 > 0),
k AS (SELECT doc_id, parent, count(*) AS kids FROM v WHERE parent IS NOT NULL GROUP BY ALL),
a AS (SELECT v.*, coalesce(NOT leaf AND kids = 1, false) AS absorbed FROM v LEFT JOIN k ON k.doc_id = v.doc_id AND k.parent = v.parent),
t(doc_id, node, top) AS (SELECT doc_id, node, node FROM a WHERE NOT absorbed AND NOT leaf UNION ALL SELECT c.doc_id, c.node, t.top FROM t JOIN a c ON c.doc_id = t.doc_id AND c.parent = t.node WHERE c.absorbed),
m AS (SELECT a.doc_id, a.node, t.top AS parent, a.leaf, a.importance, a.title FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.node = a.parent WHERE NOT absorbed),
one AS (SELECT doc_id, parent AS node, min(node) AS heir FROM m WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) = 1 AND bool_and(leaf)),
shed AS (SELECT m.*, one.heir FROM m JOIN one ON one.doc_id = m.doc_id AND one.node = m.node WHERE m.parent IS NOT NULL),
f AS (SELECT m.doc_id, m.node, CASE WHEN s.node IS NULL THEN m.parent ELSE s.parent END AS parent, m.leaf, coalesce(s.importance, m.importance) AS importance, CASE WHEN s.node IS NULL THEN m.title ELSE coalesce(m.title, s.title) END AS title
  FROM m LEFT JOIN shed s ON s.doc_id = m.doc_id AND s.heir = m.node WHERE NOT EXISTS (SELECT 1 FROM shed q WHERE q.doc_id = m.doc_id AND q.node = m.node)),
g(doc_id, node, depth) AS (SELECT doc_id, node, 0 FROM f WHERE parent IS NULL UNION ALL SELECT f.doc_id, f.node, g.depth + 1 FROM g JOIN f ON f.doc_id = g.doc_id AND f.parent = g.node)
SELECT f.doc_id AS tree_id, f.node AS node_id, f.parent, f.leaf AS is_leaf, f.importance, f.title, g.depth FROM f JOIN g ON g.doc_id = f.doc_id AND g.node = f.node"""


_PARTS = re.compile(r"^\[part (\S+), \d+ words\]$", re.M)


def _model(prompt: str, system: str) -> str:
    """A model for tree_told: it tells what it is given, rates parts by their number in four ways of which two are no share, and cites as it likes."""
    body, shown = prompt.split("\n\nThe passages behind them:")[0], prompt.rsplit("Passages to cite: ", 1)[1].split(", ")
    found = list(_PARTS.finditer(body))
    words = " ".join(body[m.end() + 1 : n.start() if n else len(body)] for m, n in zip(found, [*found[1:], None])).split()
    ids, target = [m[1] for m in found], int(prompt.split(" ", 4)[3])
    number = lambda i: int(i.rsplit("-", 1)[1])
    plain = len(words) >= 6 and all(w.isascii() and w.isalpha() for w in words[:6])
    return json.dumps({
        "text": " ".join(words[:target]), "title": target if target % 3 == 0 else " ".join(words[:5]), "key_points": ["one", 2, "three", None, " ", "four", "five", "six"], "steps": {"1": "x"} if target % 2 else ["read it"],
        "importance": {"other": 1, **{i: (0.25, "0.75", -3, ["high"])[number(i) % 4] for i in ids}}, "child_titles": {"other": "x", **{i: f"Part {i}" for i in ids}}, "child_short_titles": [1],
        "key_fact": {"big": " ".join(words[:3]), "detail": " ".join(words[:6]), "cites": shown if plain else ["nowhere", 3]},
    })


def tree_told(docs):
    """Trees whose summaries a model tells: what is kept of replies that are partly of the wrong kind."""
    n = replies.asked_trees(docs.select("doc_id", "text"), _model, fields=("node_id", "parent", "depth", "is_leaf", "words", "importance", "title", "key_points"))
    return n.select("tree_id", "node_id", "parent", "depth", "is_leaf", "words", "importance", "title", F.array_join("key_points", "|").alias("points"), F.size("steps").alias("n_steps"), F.col("key_fact").isNotNull().alias("has_fact"))


TREE_SQL["tree_told"] = with_nodes(
    """SELECT doc_id AS tree_id, node_id, parent, CAST(depth AS INTEGER) AS depth, is_leaf, CAST(words AS INTEGER) AS words, CAST(CASE WHEN parent IS NULL THEN 1.0 ELSE [0.25, 0.75, 0.0, 0.5][CAST(pos % 4 + 1 AS INTEGER)] END AS DOUBLE) AS importance,
  CASE WHEN parent IS NOT NULL THEN 'Part ' || node_id WHEN NOT is_leaf AND target % 3 > 0 THEN nullif(title, '') END AS title, CASE WHEN is_leaf THEN '' ELSE 'one|three|four|five' END AS points, CASE WHEN is_leaf OR target % 2 = 1 THEN 0 ELSE 1 END AS n_steps,
  NOT is_leaf AND len(six) = 6 AND len([w FOR w IN six IF NOT regexp_full_match(w, '[A-Za-z]+')]) = 0 AS has_fact FROM nodes"""
)


def tree_section_of(docs):
    """The section that each node lies in."""
    n = _nodes(docs)
    return reader.section_of(n, tree.sections(n), tree.closure(n))


def tree_rail(docs):
    """Points of each section and the title of the next."""
    n = _nodes(docs)
    s = n.join(tree.sections(n), ["tree_id", "node_id"])
    none = n.limit(0).select("tree_id", "node_id", F.lit(True).alias("skim"))
    return reader.rail(s, none).withColumn("points", F.array_join("points", "|"))


def tree_source_prefix(docs):
    """Passages that an overview of BUDGET words shows."""
    shown = tree.source_prefix(_built(docs).where("is_leaf"), BUDGET)
    return shown.groupBy("tree_id").agg(F.count("*").alias("leaves"), F.sum("words").alias("words"))


def tree_page_tokens(docs):
    """Tokens that keep the page two levels below each root."""
    n = _nodes(docs)
    up = tree.closure(n)
    tokens = reader.page_tokens(zoom.frontier_of(n, _opened(n), up), n.limit(0).select("tree_id", "node_id"), up)
    return tokens.groupBy("tree_id").agg(F.count("*").alias("tokens"), F.md5(F.array_join(F.array_sort(F.collect_list("token")), " ")).alias("tokens_md5"))


def tree_zoom_checks(docs):
    """What holds for the order in which each tree opens: no token twice, a paragraph before its children, all summaries opened, passages last."""
    n = written(zoom.document_nodes(docs.select("doc_id", "text"), ("node_id", "parent", "is_leaf", "ancestors")), "told-nodes")
    once = (F.size("prose_steps") <= 1) & (F.size("expand_steps") <= 1)
    ahead = F.coalesce(F.array_min("prose_steps") < F.array_min("expand_steps"), F.lit(True))
    told = n.groupBy("tree_id").agg(F.bool_and(once).alias("tokens_differ"), F.bool_and(ahead).alias("paragraph_before_children"))
    opened = written(zoom.opened_by(n), "opened")
    last = zoom.frontier_at(n, opened, zoom.reveal_steps(n, opened), F.lit(2**31 - 1)).groupBy("tree_id").agg(F.count_if("is_leaf").alias("last_page"))
    own = opened.groupBy("tree_id").agg(F.count("*").alias("opened"))
    out = told.join(own, "tree_id", "left").join(last, "tree_id", "left")
    return out.select("tree_id", "tokens_differ", "paragraph_before_children", F.coalesce("opened", F.lit(0)).cast("long").alias("opened"), F.coalesce("last_page", F.lit(0)).cast("long").alias("last_page"))


QUERIES = (
    tree_nodes, tree_closure, tree_words_in_source, tree_provenance, tree_frontier, tree_anchor, tree_anchors, tree_initial_z, tree_chains, tree_told, tree_section_of, tree_rail, tree_source_prefix, tree_page_tokens, tree_zoom_checks,
)
