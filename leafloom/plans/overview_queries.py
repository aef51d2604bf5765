"""Queries over pages, their blocks, hints and overviews of jobs, and prompts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import pages as P
from leafloom.functions import units
from leafloom.operators import overview as O
from leafloom.operators import tree, zoom

from .tree_queries import _opened
from .tree_sql import UP, strip, with_nodes, words

MONTHS = "January February March April May June July August September October November December".split()


def _q(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _nl(t: str) -> str:
    return " || chr(10) || ".join(_q(x) for x in t.split("\n"))


def iso(c: str) -> str:
    """SQL of the first date in a text: with its year where one is written."""
    alt = "|".join(MONTHS)
    a, b = rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({alt})(?:\s+([0-9]{{4}}))?", rf"\b({alt})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?\s+([0-9]{{4}}))?"
    part = lambda rx, d, m: f"CASE WHEN regexp_extract({c}, '{rx}', 3) <> '' THEN regexp_extract({c}, '{rx}', 3) || '-' ELSE '' END || lpad(CAST(list_position([{', '.join(map(_q, MONTHS))}], regexp_extract({c}, '{rx}', {m})) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({c}, '{rx}', {d}), 2, '0')"
    return f"CASE WHEN regexp_matches({c}, '{a}') THEN {part(a, 1, 2)} WHEN regexp_matches({c}, '{b}') THEN {part(b, 2, 1)} END"


# ---------------------------------------------------------------- pages


def page_markdown(pages):
    """Title and markdown of every page's content."""
    m = P.html_markdown(F.col("html"))
    return pages.select("page_id", P.html_title(F.col("html")).alias("title"), m.alias("m")).select("page_id", "title", F.md5("m").alias("markdown_md5"), units.word_count(F.col("m")).alias("words"))


def page_blocks(pages):
    """Blocks of every page's markdown."""
    b = P.markdown_blocks(pages.select("page_id", P.html_markdown(F.col("html")).alias("text")), "page_id")
    return b.select("page_id", "block_no", "kind", "level", F.md5(F.array_join("items", "|")).alias("items_md5"))


def conv_blocks(conversations):
    """Turns as lines of markdown: headings, bullets, numbers, and plain ones."""
    t, k = F.coalesce("text", F.lit("")), F.col("turn") % 6
    line = F.when(k == 0, F.concat(F.lit("## "), t)).when(k < 3, F.concat(F.lit(" - "), t)).when(k == 3, F.concat(F.lit("1) "), t)).when(k == 4, F.concat(F.lit("2. "), t)).otherwise(F.concat(t, F.lit("\n\n"), t))
    x = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))
    return P.markdown_blocks(x, "conv_id").select("conv_id", "block_no", "kind", "level", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("items_md5"))


def _sub(c: str, pairs) -> str:
    for rx, put in pairs:
        c = f"regexp_replace({c}, {_q(rx)}, {_nl(put)}, 'g')"
    return c


def _entities(c: str) -> str:
    for name, put in P.ENTITIES.items():
        c = f"replace({c}, {_q(name)}, {_q(put)})"
    return c


_PAGE = _sub("coalesce(html, '')", ((P.DROPPED, " "),))
_PARTS = ", ".join(rf"nullif(regexp_extract(page, '(?is)<{t}\b[^>]*>(.*)</{t}\s*>', 1), '')" for t in P.CONTENT)
_MARKDOWN = f"md AS (SELECT page_id, html, {strip(_sub(_entities(_sub('part', P.MARKUP)), P.SQUEEZED))} AS m FROM (SELECT *, coalesce({_PARTS}, page) AS part FROM (SELECT page_id, html, {_PAGE} AS page FROM pages)))"
_TITLE = ", ".join("nullif(" + strip(_sub(_entities(f"regexp_replace(regexp_extract(coalesce(html, ''), {_q(rx)}, 1), '<[^>]*>', '', 'g')"), ((r"[\r\n\t  ]+", " "),))) + ", '')" for rx in P._NAMED)


def _blocks(key: str, source: str) -> str:
    """SQL of the blocks of source(key, text)."""
    kind = f"CASE WHEN {strip('line')} = '' THEN '' WHEN regexp_matches(line, '{P.HEADING}') THEN 'h' WHEN regexp_matches(line, '{P.BULLET}') THEN 'ul' WHEN regexp_matches(line, '{P.NUMBER}') THEN 'ol' ELSE 'p' END"
    return f"""ln AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM {source}), kd AS (SELECT *, {kind} AS kind FROM ln),
nw AS (SELECT *, CASE WHEN kind <> '' AND (kind = 'h' OR lag(kind) OVER w IS DISTINCT FROM kind) THEN 1 ELSE 0 END AS n FROM kd WINDOW w AS (PARTITION BY {key} ORDER BY at_)),
nb AS (SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS block_no,
  CASE kind WHEN 'h' THEN regexp_extract(line, '{P.HEADING}', 2) WHEN 'p' THEN {strip('line')} ELSE regexp_replace(line, '{P.BULLET}|{P.NUMBER}', '') END AS said FROM nw),
blocks AS (SELECT {key}, CAST(block_no AS INTEGER) AS block_no, kind, CASE WHEN kind = 'h' THEN CAST(max(length(regexp_extract(line, '{P.HEADING}', 1))) AS INTEGER) END AS level, CASE WHEN kind = 'p' THEN 1 ELSE CAST(count(*) AS INTEGER) END AS n,
  md5(CASE WHEN kind = 'p' THEN string_agg(said, ' ' ORDER BY at_) ELSE string_agg(said, '|' ORDER BY at_) END) AS items_md5 FROM nb WHERE kind <> '' GROUP BY {key}, block_no, kind)"""


# ---------------------------------------------------------------- hints, overviews, prompts


def job_hints(orders):
    """Orders as passages of their customers' briefs: the size, the date and the time that they name."""
    k = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "d MMMM yyyy")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Write 1,"), F.lpad((k % 900).cast("string"), 3, "0"), F.lit(" words on it.")))
        .when(k % 5 == 1, F.concat(F.lit("It is due on "), date, F.lit(" at "), (k % 12 + 1).cast("string"), F.when(k % 2 == 0, ":30 pm").otherwise(" AM"), F.lit(".")))
        .when(k % 5 == 2, F.concat(F.lit("We met on "), F.date_format("o_orderdate", "MMMM d"), F.lit(" to talk of it.")))
        .otherwise(F.concat(F.lit("Nothing is said in passage "), k.cast("string"), F.lit(" of these notes.")))
    )
    return O.job_hints(orders.select(F.col("o_custkey").alias("tree_id"), k.alias("leaf_id"), text.alias("text")))


_CLOCK = O._CLOCK
_HINTS = f"""WITH p AS (SELECT o_custkey AS tree_id, o_orderkey AS leaf_id, CASE k WHEN 0 THEN 'Write 1,' || lpad(CAST(o_orderkey % 900 AS VARCHAR), 3, '0') || ' words on it.'
  WHEN 1 THEN 'It is due on ' || strftime(d, '%-d %B %Y') || ' at ' || (o_orderkey % 12 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN ':30 pm' ELSE ' AM' END || '.' WHEN 2 THEN 'We met on ' || strftime(d, '%B %-d') || ' to talk of it.'
  ELSE 'Nothing is said in passage ' || o_orderkey || ' of these notes.' END AS t FROM (SELECT *, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)),
x AS (SELECT *, regexp_extract(t, '{O._SIZE}', 1) AS size, {iso('t')} AS iso, regexp_matches(t, '{O._DUE}') AS due, CAST(nullif(regexp_extract(t, '{_CLOCK}', 1), '') AS INTEGER) % 12 + CASE WHEN lower(regexp_extract(t, '{_CLOCK}', 3)) = 'pm' THEN 12 ELSE 0 END AS h,
  CASE WHEN regexp_extract(t, '{_CLOCK}', 2) = '' THEN '00' ELSE regexp_extract(t, '{_CLOCK}', 2) END AS mm FROM p),
g AS (SELECT tree_id, min(leaf_id) AS one, arg_min(t, leaf_id) AS t1, min(leaf_id) FILTER (size <> '') AS sized, arg_min(size, leaf_id) FILTER (size <> '') AS size,
  arg_min(struct_pack(leaf_id, iso, h, mm), struct_pack(a := NOT due, b := leaf_id)) FILTER (iso IS NOT NULL) AS d FROM x GROUP BY tree_id)
SELECT tree_id, array_to_string({words('t1')}[1:8], ' ') AS start_text, one AS start_leaf, CASE WHEN sized IS NOT NULL THEN 'a ' || size || ' words limit' ELSE array_to_string({words('t1')}[1:5], ' ') END AS size_basis, coalesce(sized, one) AS size_leaf,
  d.iso AS due_iso, lpad(CAST(d.h AS VARCHAR), 2, '0') || ':' || d.mm AS due_time, d.leaf_id AS due_leaf FROM g"""

_GENRES, _GOALS = ("assignment", "meeting", "paper", None), ("plan", "learn", None)


def _pick(values, k):
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def overviews(orders):
    """Customers' briefs put together from their orders, as checked claims."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = orders.select(c.alias("tree_id"), k.alias("claim_id"), k.alias("place"), F.lit("c").alias("cite"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    x = x.withColumns({"cites": F.array("cite"), "name": F.concat(F.lit("L"), "place")})
    some = lambda m: x.where(F.col("claim_id") % 4 == m)
    trees = x.select("tree_id").distinct().select("tree_id", F.lit("It costs 12 dollars.").alias("source_text"), _pick(_GENRES, F.col("tree_id")).alias("genre"), _pick(_GOALS, F.col("tree_id")).alias("objective"))
    t = F.col("tree_id")
    raw = trees.select("tree_id", F.when(t % 7 == 0, " ").otherwise(F.concat(F.lit(" Brief no. "), t)).alias("doc_title"), F.when(t % 2 == 0, "Order Note.").otherwise("Letter").alias("doc_kind"), F.when(t % 3 == 0, "It costs 12 dollars in all").when(t % 3 == 1, "It costs 13 dollars").alias("what_it_is"), F.lit("News article").alias("genre"))
    got = O.assembled(
        raw, trees, some(0).select("tree_id", "place", F.col("name").alias("label"), F.col("iso").alias("value"), "cites"), some(1).select("tree_id", "claim_id", F.col("name").alias("text"), "cites"),
        some(2).select("tree_id", "claim_id", F.col("name").alias("text"), F.col("iso").alias("basis"), "cites"), some(3).select("tree_id", "claim_id", "iso", F.lit("17:00").alias("time"), F.col("name").alias("label"), "cites"),
        some(3).select("tree_id", "place", F.col("name").alias("who"), F.lit("pay").alias("what"), F.lit(None).cast("string").alias("due"), F.col("iso").alias("due_iso"), "cites"),
    )
    o = lambda n: F.col(f"overview.{n}")
    return got.select(
        "tree_id", "genre", o("doc_title").alias("title"), o("doc_kind").alias("kind"), o("what_it_is").alias("what"), F.array_join(F.transform(o("essentials"), lambda e: F.concat(e["label"], F.lit("="), e["value"])), ",").alias("essentials"),
        o("start_here")["text"].alias("start_text"), o("size_of_job")["basis"].alias("size_basis"), o("deadline")["label"].alias("deadline"), F.array_join(F.transform(o("actions"), lambda a: a["who"]), ",").alias("actions"),
    )


_OVERVIEWS = """WITH x AS (SELECT o_custkey AS t, o_orderkey AS k, 'L' || o_orderkey AS name, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS iso FROM orders),
g AS (SELECT t, string_agg(name || '=' || iso, ',' ORDER BY k) FILTER (k % 4 = 0) AS e, arg_min(name, k) FILTER (k % 4 = 1) AS s, arg_min(iso, k) FILTER (k % 4 = 2) AS z, arg_min(name, k) FILTER (k % 4 = 3) AS d, string_agg(name, ',' ORDER BY k) FILTER (k % 4 = 3) AS a FROM x GROUP BY t),
n AS (SELECT *, coalesce(['assignment', 'meeting', 'paper', NULL][t % 4 + 1], 'news') AS genre, t % 4 < 2 OR t % 3 = 0 AS task FROM g WHERE t % 7 > 0)
SELECT t AS tree_id, genre, 'Brief no. ' || t AS title, CASE WHEN t % 2 = 0 THEN 'Order Note' ELSE 'Letter' END AS kind, CASE WHEN t % 3 = 0 THEN 'It costs 12 dollars in all' WHEN t % 2 = 0 THEN 'This is an order Note.' ELSE 'This is a letter.' END AS what, coalesce(e, '') AS essentials,
  CASE WHEN task THEN s END AS start_text, CASE WHEN task THEN z END AS size_basis, CASE WHEN task THEN d END AS deadline, CASE WHEN genre = 'meeting' THEN coalesce(a, '') ELSE '' END AS actions FROM n"""


def prompts(documents):
    """What a summariser is asked first of each document, and its instructions with the focus of a genre and goal."""
    k = F.col("doc_id")
    first = O.provisional_prompt(F.concat(F.lit("Document "), k), F.concat(F.lit("# Part one\n"), F.coalesce("text", F.lit(""))))
    focus = O.with_focus(F.lit("Summarise."), _pick((*O.GOAL_FOCUS, None, "none"), k), _pick((*O.GENRE_FOCUS, "other"), k))
    return documents.select("doc_id", F.md5(first).alias("first_md5"), F.md5(focus).alias("focus_md5"))


def _case(blocks, n: str, more: int) -> str:
    whens = " ".join(f"WHEN {i} THEN chr(10) || chr(10) || {_nl(v + O.FOCUS_TAIL)}" for i, v in enumerate(blocks.values()))
    return f"CASE {n} % {len(blocks) + more} {whens} ELSE '' END"


def column_plans(orders):
    """Whether two columns fit pages as wide as orders are dear."""
    p = P.column_plan(F.floor("o_totalprice") % 2000, (F.col("o_orderkey") % 12).cast("double"), F.lit(32.0), F.lit(20.0), F.lit(700.0))
    return orders.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.*")


def tree_prose(documents):
    """The page two levels below each root as prose."""
    n = tree.build_trees(documents.select("doc_id", "text"))
    return zoom.prose_of(zoom.frontier_of(n, _opened(n), tree.closure(n))).select("tree_id", F.md5("prose").alias("prose_md5"))


OVERVIEW_SQL = {
    "page_markdown": f"WITH {_MARKDOWN} SELECT page_id, coalesce({_TITLE}) AS title, md5(m) AS markdown_md5, CAST(len({words('m')}) AS INTEGER) AS words FROM md",
    "page_blocks": f"WITH {_MARKDOWN}, src AS (SELECT page_id, m AS text FROM md), {_blocks('page_id', 'src')} SELECT page_id, block_no, kind, level, items_md5 FROM blocks",
    "conv_blocks": f"""WITH src AS (SELECT conv_id, string_agg(CASE WHEN turn % 6 = 0 THEN '## ' || t WHEN turn % 6 < 3 THEN ' - ' || t WHEN turn % 6 = 3 THEN '1) ' || t WHEN turn % 6 = 4 THEN '2. ' || t ELSE t || chr(10) || chr(10) || t END, chr(10) ORDER BY turn) AS text
  FROM (SELECT *, coalesce(text, '') AS t FROM conversations) GROUP BY conv_id), {_blocks('conv_id', 'src')} SELECT conv_id, block_no, kind, level, n, items_md5 FROM blocks""",
    "job_hints": _HINTS,
    "overviews": _OVERVIEWS,
    "prompts": rf"""WITH x AS (SELECT doc_id, '# Part one' || chr(10) || coalesce(text, '') AS t FROM documents), h AS (SELECT *, [l FOR l IN [{strip('z')} FOR z IN string_split(t, chr(10))] IF starts_with(l, '#')][1:30] AS heads FROM x)
SELECT doc_id, md5('Title: Document ' || doc_id || chr(10) || chr(10) || array_to_string({words('t')}[1:3000], ' ') || chr(10) || chr(10) || 'Headings:' || chr(10) || array_to_string(heads, chr(10))) AS first_md5,
  md5('Summarise.' || {_case(O.GENRE_FOCUS, 'doc_id', 1)} || {_case(O.GOAL_FOCUS, 'doc_id', 2)}) AS focus_md5 FROM h""",
    "column_plans": f"""WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 2000 AS w, CAST(o_orderkey % 12 AS DOUBLE) AS c FROM orders),
y AS (SELECT *, CASE WHEN c > 0 THEN greatest(0, (least((w - 32.0) / 2, 700) - 20) / c) ELSE 99 END AS cpl_two, CASE WHEN c > 0 THEN greatest(0, (least(w, 700) - 20) / c) ELSE 99 END AS cpl_one FROM x)
SELECT o_orderkey, cpl_two >= {P.MIN_CPL} AS two, CASE WHEN cpl_two >= {P.MIN_CPL} THEN cpl_two ELSE cpl_one END AS cpl, cpl_two, cpl_one FROM y""",
    "tree_prose": with_nodes("SELECT doc_id AS tree_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY span_start)) AS prose_md5 FROM nodes n WHERE depth = least(2, (SELECT max(depth) FROM nodes m WHERE m.doc_id = n.doc_id)) GROUP BY doc_id"),
}
OVER = (("pages", (page_markdown, page_blocks)), ("conversations", (conv_blocks,)), ("orders", (job_hints, overviews, column_plans)), ("documents", (prompts, tree_prose)))
