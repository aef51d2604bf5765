"""Mixing sources to target weights by hierarchical budgets over a domain - language - source tree.

Every node shares its budget among its children by weight. A child can't take more than its subtree holds (tokens times the
epochs allowed); what it leaves goes to its siblings by their weights, and only what a whole family can't hold is left to the
level above, because a family is never given more than it can hold. Leaves read their documents in an order seeded anew for
each epoch and keep the prefix that fits their budget. All of it is integer arithmetic in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table

LEVELS = ("domain", "lang", "source")
#: Production parameters of the query: weights not named are 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 1}
BUDGET_PERCENT, EPOCHS, SEED = 50, 2, "mix-1"
#: Leaves whose budgets are broadcast; of more leaves the hot ones are dealt out by SALTS.
BROADCAST_LEAVES, SALTS = 100_000, 64
#: Hex digits of the order key that cut a leaf's epoch into parts; prefix sums go over parts first, then within each.
PART_DIGITS = 3

_BIG = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The number at the end of a source's name, modulo 4; 0 without one."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4)


def word_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def weight_of(c: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(c) == name, F.lit(w)).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children: parent keys, child, parent_budget, w (integer weight), cap. Adds budget: parent_budget dealt by weight, no child over its cap."""
    same = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = same.orderBy(F.col("_r").asc_nulls_last(), child)
    at_least = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast(_BIG)
    r = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double"))
    x = children.withColumn("_r", r).withColumn("_upto", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    x = x.withColumn("_w", F.sum("w").over(at_least))
    x = x.withColumn("_full", (F.col("w") > 0) & ((big("parent_budget") - big("_upto")) * big("w") >= big("cap") * big("_w")))
    x = x.withColumn("_held", F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(same), F.lit(0))).withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(same), F.lit(0)))
    part = F.when(F.col("_open") > 0, F.expr("(cast(parent_budget - _held as decimal(38,0)) * w) div _open")).otherwise(F.lit(0))
    return x.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part).cast("long")).drop("_r", "_upto", "_w", "_full", "_held", "_open")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int = BUDGET_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """leaves: LEVELS and tokens. (LEVELS, tokens, budget): the whole budget is `percent` of all tokens."""
    now = leaves.withColumn("cap", F.col("tokens") * epochs)
    root = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {percent}) div 100").alias("parent_budget"))
    above: list[str] = []
    for level in LEVELS:
        kids = now.groupBy(*above, level).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights.get(level, {})).cast("long"))
        kids = kids.join(root, above) if above else kids.join(F.broadcast(root))  # the root is one row
        above = [*above, level]
        root = share_out(kids, above[:-1], level).select(*above, F.col("budget").alias("parent_budget"))
    return leaves.join(root.withColumnRenamed("parent_budget", "budget"), list(LEVELS))


def _with_leaf(rows: DataFrame, passes: DataFrame, levels: list[str], leaves: int) -> DataFrame:
    """rows with the passes of their leaf. A leaf may hold a third of all rows, so its rows are never sent to one task."""
    if leaves <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(passes), levels)
    salted = passes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("doc_id", "text_md5"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", own).join(salted, [*levels, "_salt"]).drop("_salt")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, text_md5, LEVELS, epoch, n_tokens, prefix_tokens): the documents kept, once for each epoch that takes them.

    Tokens are words between ASCII white space. Null text is empty; a document without tokens goes along where its leaf takes
    any, and a leaf without tokens takes none. Null lang or source is ''. Repeated rows are documents of their own. Order keys
    that tie go by text. Texts of any length are counted whole; columns of docs other than doc_id, text, lang and source are
    not used, whatever their names. An empty table gives none.
    """
    prepare(docs.sparkSession)
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    source = F.coalesce(F.col("source"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), domain_of(source).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), word_tokens(text).alias("n_tokens")
    ), "mix-rows")  # texts are read and counted once
    levels = list(LEVELS)
    leaves = materialize(leaf_budgets(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), weights, percent, epochs), "mix-leaves")
    passes = leaves.select(*levels, "tokens", "budget", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    room = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("budget") - F.col("epoch") * F.col("tokens")))
    passes = passes.select(*levels, "epoch", room.alias("room")).where("room > 0")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5")))
    dealt = _with_leaf(rows, passes, levels, leaves.count()).withColumn("key", key).withColumn("part", F.substring("key", 1, PART_DIGITS))
    leaf = [*levels, "epoch"]
    parts = dealt.groupBy(*leaf, "part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(*leaf, "part", (F.sum("n").over(Window.partitionBy(*leaf).orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy(*leaf, "part").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = dealt.withColumn("_own", F.sum("n_tokens").over(own)).join(parts, [*leaf, "part"])
    upto = upto.withColumn("prefix_tokens", F.col("_own") + F.col("before"))
    return upto.where("prefix_tokens <= room").select("doc_id", "text_md5", *levels, "epoch", "n_tokens", "prefix_tokens")


def op10_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _level_sql(name: str, above: str, keys: list[str], child: str, weight: str) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"k.{c} = p.{c}" for c in keys) or "true"
    cols = ", ".join([*keys, child])
    return f"""
{name}_k AS (SELECT k.*, p.budget AS parent_budget, {weight} AS w FROM (SELECT {cols}, sum(cap) AS cap FROM leaves GROUP BY {cols}) k JOIN {above} p ON {on}),
{name}_a AS (SELECT *, sum(cap) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {child} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS upto,
  sum(w) OVER ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}_k),
{name}_b AS (SELECT *, (parent_budget - upto) * w >= cap * ws AS held FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum(CASE WHEN held THEN cap END) OVER ({part}), 0) AS taken, coalesce(sum(CASE WHEN NOT held THEN w END) OVER ({part}), 0) AS openw FROM {name}_b),
{name} AS (SELECT {cols}, CAST(CASE WHEN held THEN cap WHEN openw > 0 THEN (parent_budget - taken) * w // openw ELSE 0 END AS BIGINT) AS budget FROM {name}_c)"""


def _weight_sql(c: str, weights: dict[str, int]) -> str:
    return f"CASE k.{c} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.items()) + " ELSE 1 END"


OP10_SQL = f"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'domain' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4 AS VARCHAR) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS BIGINT) AS cap FROM docs GROUP BY ALL),
root AS (SELECT CAST(coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100 AS BIGINT) AS budget FROM leaves),
{_level_sql("l1", "root", [], "domain", _weight_sql("domain", DOMAIN_WEIGHTS))},
{_level_sql("l2", "l1", ["domain"], "lang", _weight_sql("lang", LANG_WEIGHTS))},
{_level_sql("l3", "l2", ["domain", "lang"], "source", "1")},
passes AS (SELECT v.domain, v.lang, v.source, CAST(e.range AS INTEGER) AS epoch, greatest(0, least(v.tokens, b.budget - e.range * v.tokens)) AS room
  FROM leaves v JOIN l3 b ON v.domain = b.domain AND v.lang = b.lang AND v.source = b.source, range({EPOCHS}) e),
dealt AS (SELECT d.*, p.epoch, p.room, md5('{SEED}|' || p.epoch || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.text_md5) AS key
  FROM docs d JOIN passes p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source WHERE p.room > 0),
summed AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key, doc_id, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS prefix_tokens FROM dealt)
SELECT doc_id, text_md5, domain, lang, source, epoch, n_tokens, prefix_tokens FROM summed WHERE prefix_tokens <= room
"""
