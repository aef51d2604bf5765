"""Queries over the hosts of pages, the corpus search and the state of builds, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import address
from leafloom.operators import builds, search, tree
from leafloom.sources.shared import shared_folder

from .tree_sql import with_nodes

#: Addresses made for each page, by its number modulo their count; `#` stands for the number in hex.
SIX = ("2001:db8::#", "fe80::#", "2606:4700::#", "::ffff:10.0.0.7", "fc00:#::1", "2001:20::#", "64:ff9b:1:#::", "2a00:1450:4001:#::200e")


def link_checks(pages: DataFrame) -> DataFrame:
    """For each page one made address of version 4 and one of version 6: whether they are public, and why a link with that host is refused."""
    k = F.col("page_id").cast("long")
    n = (k * 2654435761) % 4294967296
    four = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    six = F.replace(F.get(F.array(*map(F.lit, SIX)), (k % len(SIX)).cast("int")), F.lit("#"), F.lower(F.hex(k % 65536)))
    x = pages.select("page_id", "url", four.alias("four"), six.alias("six"))
    return x.select(
        "page_id", "four", "six", address.is_public_address(F.col("four")).alias("four_public"), address.is_public_address(F.col("six")).alias("six_public"),
        address.link_problem(F.concat(F.lit("http://["), "six", F.lit("]:8080/x")), F.lit(None).cast("array<string>")).alias("literal_problem"),
        address.link_problem(F.col("url"), F.array("four", "six")).alias("named_problem"),
    )


def _closed_sql(n: str) -> str:
    spans = [address._ends(x) for x in address.CLOSED if ":" not in x]
    open_ = [address._ends(x) for x in address.OPEN_WITHIN if ":" not in x]
    tell = lambda held: " OR ".join(f"{n} BETWEEN {a - address._MAPPED} AND {b - 1 - address._MAPPED}" for a, b in held)
    return f"(NOT ({tell(spans)}) OR {tell(open_)})"


_SIX_PUBLIC = (False, False, True, False, False, True, False, True)
LINK_SQL = f"""WITH p AS (SELECT page_id, url, (CAST(page_id AS HUGEINT) * 2654435761) % 4294967296 AS n FROM pages),
a AS (SELECT *, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS four, replace([{", ".join(f"'{x}'" for x in SIX)}][CAST(page_id % {len(SIX)} + 1 AS INTEGER)], '#', lower(printf('%X', CAST(page_id % 65536 AS INTEGER)))) AS six,
  {_closed_sql("n")} AS four_public, [{", ".join(str(x).lower() for x in _SIX_PUBLIC)}][CAST(page_id % {len(SIX)} + 1 AS INTEGER)] AS six_public FROM p)
SELECT page_id, four, six, four_public, six_public, CASE WHEN NOT six_public THEN 'private' END AS literal_problem,
  CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = '' THEN 'host' WHEN NOT (four_public AND six_public) THEN 'private' END AS named_problem FROM a"""


#: Looked up in the index: inside one word, over two words, over three.
SOUGHT = ("hand", "the on", "n and t")


def corpus_search(docs: DataFrame) -> DataFrame:
    """Three searches over an index of all trees and of overviews (a document's first 200 characters): where and how often each is found."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    nodes = tree.build_trees(docs.select("doc_id", "text"), fields=("node_id", "parent", "is_leaf", "text", "title", "hook", "key_points"))
    search.write_index(search.entries(nodes, docs.select(F.col("doc_id").alias("tree_id"), F.substring("text", 1, 200).alias("text"))), path)
    return search.find_all(search.read_index(spark, path), SOUGHT)


_LOW = r"lower(trim(regexp_replace(value, '\s+', ' ', 'g')))"
SEARCH_SQL = with_nodes(
    f"""SELECT query, doc_id AS tree_id, node_id, field, CAST((length(low) - length(replace(low, query, ''))) // length(query) AS INTEGER) AS hits FROM (
  SELECT doc_id, node_id, field, {_LOW} AS low FROM (
    SELECT doc_id, node_id, unnest(['title', 'point', 'text']) AS field, unnest([coalesce(title, ''), CASE WHEN is_leaf THEN '' ELSE array_to_string(points, ' ') END, text]) AS value FROM nodes WHERE is_leaf OR parent IS NOT NULL
    UNION ALL SELECT doc_id, NULL, 'overview', substr(text, 1, 200) FROM documents)), (SELECT unnest([{", ".join(f"'{q}'" for q in SOUGHT)}]) AS query) WHERE contains(low, query)"""
)


def build_actions(docs: DataFrame) -> DataFrame:
    """What is to be done about each document's tree, where trees, runs and markers are told by its id, language and length."""
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    x = docs.select(F.concat(F.lit("t"), d.cast("string")).alias("tree_id"), "doc_id", "lang", "n_chars")
    trees = x.where(d % 3 == 0).select("tree_id", F.when(d % 2 == 0, "now").otherwise("old").alias("build"), F.lit("T").alias("title"), F.when(d % 5 == 0, "bad").otherwise("m1").alias("model"), F.when(F.col("lang") == "en", "learn").otherwise(F.col("lang")).alias("objective"), (F.col("n_chars") % 3).alias("missing_titles"))
    older = trees.where("build = 'now'").withColumn("build", F.lit("old"))
    runs = x.where(d % 7 == 0).select("tree_id", F.when(d % 14 == 0, "error").otherwise("building").alias("status"))
    marks = x.where(d % 4 == 0).select("tree_id", none.alias("title"), F.lit("m2").alias("model"), F.lit("plan").alias("objective"), F.when(d % 8 == 0, "text").alias("source_text"))
    return builds.next_actions(x.select("tree_id"), trees.unionByName(older), runs, marks, "now", "m0", ("bad",))


BUILDS_SQL = """WITH x AS (SELECT *, doc_id % 3 = 0 AS has, doc_id % 2 = 0 AS now_, doc_id % 8 = 0 AS marked FROM (SELECT DISTINCT doc_id, lang, n_chars FROM documents)),
s AS (SELECT *, CASE WHEN doc_id % 14 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'building' WHEN has AND now_ AND n_chars % 3 > 0 THEN 'unlabelled' WHEN has AND now_ THEN 'done' WHEN has THEN 'stale' WHEN marked THEN 'interrupted' ELSE 'absent' END AS state FROM x)
SELECT 't' || doc_id AS tree_id, state, CASE state WHEN 'error' THEN 'retry' WHEN 'unlabelled' THEN 'backfill' WHEN 'stale' THEN 'rebuild' WHEN 'interrupted' THEN 'resume' WHEN 'absent' THEN 'build' END AS action,
  marked AND has AND now_ AND doc_id % 7 > 0 AS clear_marker, CASE WHEN has THEN 'T' ELSE 'Untitled' END AS title, CASE WHEN has AND doc_id % 5 = 0 THEN 'm0' WHEN has THEN 'm1' WHEN marked THEN 'm2' ELSE 'm0' END AS model,
  CASE WHEN has THEN CASE WHEN lang = 'en' THEN 'learn' END WHEN marked THEN 'plan' END AS objective FROM s"""
