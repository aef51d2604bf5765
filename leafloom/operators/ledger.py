"""A ledger of findings that rest on assumptions, each of which holds more or less for an objective.

Tables: assumptions (id, text, axis, holds map<objective, status>), objectives (id), findings (id, assumptions array, implications
array<struct<text, features array, effect>>, evidence struct<grade>, ...), features (id). Status ranks Y < C < ? < N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = ("Y", "C", "?", "N")
GRADES = ("S", "M", "W", "MYTH")
REQUIRED = ("id", "report", "claim", "evidence", "assumptions", "implications", "confidence")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), status).cast("int") - 1


def status_of(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, RANKS)), r)


#: Objectives of a ledger: columns of its matrix, named by people.
MOST_OBJECTIVES = 1_000


def _by_objective(rows: DataFrame, objectives: DataFrame) -> DataFrame:
    """rows once for each objective (column `objective`). There may be MOST_OBJECTIVES; more are refused, as every row is repeated."""
    ids = [r[0] for r in objectives.select("id").distinct().limit(MOST_OBJECTIVES + 1).collect()]
    if len(ids) > MOST_OBJECTIVES:
        raise ValueError(f"more than {MOST_OBJECTIVES} objectives")
    return rows.withColumn("objective", F.explode(F.array(*map(F.lit, sorted(ids))).cast("array<string>")))


def holds(assumptions: DataFrame, objectives: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(assumption, objective, status): `?` where an assumption says nothing. overrides: (assumption, objective, status) for what-if runs."""
    x = _by_objective(assumptions.select(F.col("id").alias("assumption"), "holds"), objectives)
    x = x.select("assumption", "objective", F.coalesce(F.element_at("holds", F.col("objective")), F.lit("?")).alias("status"))
    if overrides is None:
        return x
    o = overrides.select("assumption", "objective", F.col("status").alias("_o"))
    return x.join(o, ["assumption", "objective"], "left").select("assumption", "objective", F.coalesce("_o", "status").alias("status"))


def finding_status(findings: DataFrame, objectives: DataFrame, held: DataFrame) -> DataFrame:
    """(finding, objective, status, blockers): the worst status of its known assumptions, Y without any."""
    rests = findings.select(F.col("id").alias("finding"), F.posexplode("assumptions").alias("pos", "assumption")).join(held, "assumption")
    worst = rests.groupBy("finding", "objective").agg(
        F.max(rank(F.col("status"))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("status") != "Y", F.struct("pos", F.concat("assumption", F.lit("="), "status").alias("b"))))).alias("b")
    )
    every = _by_objective(findings.select(F.col("id").alias("finding")), objectives)
    return every.join(worst, ["finding", "objective"], "left").select("finding", "objective", status_of(F.coalesce("r", F.lit(0))).alias("status"), F.coalesce(F.transform("b", lambda x: x["b"]), F.array().cast("array<string>")).alias("blockers"))


def feature_status(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """(feature, objective, status, supporting, opposed_by): the best status of findings that do not oppose it (`-` without any), and opposing ones that apply (Y or C)."""
    imp = findings.select(F.col("id").alias("finding"), F.explode("implications").alias("i")).select("finding", "i.effect", F.explode("i.features").alias("feature"))
    x = imp.join(statuses.select("finding", "objective", "status"), "finding").withColumn("against", F.coalesce(F.col("effect") == "opposes", F.lit(False)))
    best = F.min(F.when(~F.col("against"), rank(F.col("status"))))
    return x.groupBy("feature", "objective").agg(
        F.coalesce(status_of(best), F.lit("-")).alias("status"), F.count_if(~F.col("against")).alias("supporting"),
        F.array_sort(F.collect_list(F.when(F.col("against") & F.col("status").isin("Y", "C"), F.col("finding")))).alias("opposed_by"),
    )


def matrix(held: DataFrame, objectives: list[str]) -> DataFrame:
    return held.groupBy("assumption").pivot("objective", objectives).agg(F.first("status"))


def feature_matrix(features: DataFrame, by_feature: DataFrame, objectives: list[str]) -> DataFrame:
    """Features by objectives; `!` marks an opposing finding that applies, `-` no evidence."""
    cell = F.concat("status", F.when(F.size("opposed_by") > 0, "!").otherwise(""))
    wide = by_feature.withColumn("cell", cell).groupBy("feature").pivot("objective", objectives).agg(F.first("cell"))
    return features.select(F.col("id").alias("feature")).join(wide, "feature", "left").na.fill("-")


def research_queue(statuses: DataFrame) -> DataFrame:
    """(objective, assumption, findings): unknown assumptions of findings whose worst status is `?`, by how many they block."""
    x = statuses.where("status = '?'").select("objective", "finding", F.explode("blockers").alias("b")).where(F.col("b").endswith("=?"))
    x = x.select("objective", "finding", F.expr("substring(b, 1, length(b) - 2)").alias("assumption"))
    return x.groupBy("objective", "assumption").agg(F.count("*").alias("findings"))


def impact(findings: DataFrame, assumptions: DataFrame, statuses: DataFrame, objective: str) -> DataFrame:
    """(section, item, told, findings, names) for one objective: how many findings have each status, the unknown assumptions that block
    findings (most first by `findings`), findings that do not apply with what fails, and each feature's status with what opposes it."""
    at = statuses.where(F.col("objective") == objective)
    names = F.array_sort(F.collect_list("finding"))
    counted = at.groupBy("status").agg(F.count("*").alias("findings"))
    every = at.sparkSession.createDataFrame([(r,) for r in RANKS], "status string").join(counted, "status", "left")
    none = F.array().cast("array<string>")
    counts = every.select(F.lit("status").alias("section"), F.col("status").alias("item"), F.lit(None).cast("string").alias("told"), F.coalesce("findings", F.lit(0)).alias("findings"), none.alias("names"))
    b = at.select("finding", "status", F.explode("blockers").alias("b")).select("finding", "status", F.expr("substring(b, 1, length(b) - 2)").alias("assumption"), F.right("b", F.lit(1)).alias("why"))
    blocked = b.where("status = '?' and why = '?'").groupBy("assumption").agg(F.count("*").alias("findings"), names.alias("names"))
    queue = blocked.join(assumptions.select(F.col("id").alias("assumption"), "text"), "assumption", "left").select(F.lit("queue").alias("section"), F.col("assumption").alias("item"), F.col("text").alias("told"), "findings", "names")
    fails = at.where("status = 'N'").select(F.lit("fails").alias("section"), F.col("finding").alias("item"), F.array_join(F.filter("blockers", lambda x: x.endswith("=N")), ", ").alias("told"), F.lit(1).cast("long").alias("findings"), none.alias("names"))
    f = feature_status(findings, at).select(F.lit("feature").alias("section"), F.col("feature").alias("item"), F.col("status").alias("told"), F.col("supporting").alias("findings"), F.col("opposed_by").alias("names"))
    return counts.unionByName(queue).unionByName(fails).unionByName(f)


def finding_view(findings: DataFrame, statuses: DataFrame, finding: str) -> DataFrame:
    """(finding, objective, status, blockers, json) of one finding: a row for each objective, none where the id is unknown."""
    one = findings.where(F.col("id") == finding).select(F.col("id").alias("finding"), F.to_json(F.struct(*findings.columns)).alias("json"))
    return one.join(statuses.where(F.col("finding") == finding), "finding").select("finding", "objective", "status", "blockers", "json")


def open_cells(assumptions: DataFrame, findings: DataFrame) -> DataFrame:
    """(assumption, objective, findings): every `?` written down, and how many findings rest on the assumption."""
    cells = assumptions.select(F.col("id").alias("assumption"), F.explode("holds").alias("objective", "status")).where("status = '?'")
    n = findings.select(F.col("id").alias("finding"), F.explode(F.array_distinct("assumptions")).alias("assumption")).groupBy("assumption").agg(F.count("*").alias("findings"))
    return cells.join(n, "assumption", "left").select("assumption", "objective", F.coalesce("findings", F.lit(0)).alias("findings"))


def validate(findings: DataFrame, assumptions: DataFrame, features: DataFrame) -> DataFrame:
    """(finding, problem): missing fields, bad grades, unknown assumptions and features, repeated ids."""
    gaps = findings.select(F.col("id").alias("finding"), F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED])).alias("problem")).where("problem is not null")
    grade = findings.where(~F.coalesce(F.col("evidence.grade").isin(*GRADES), F.lit(False))).select(F.col("id").alias("finding"), F.concat(F.lit("bad grade "), F.coalesce("evidence.grade", F.lit("null"))).alias("problem"))
    a = findings.select(F.col("id").alias("finding"), F.explode("assumptions").alias("k")).join(assumptions.select(F.col("id").alias("k")), "k", "left_anti").select("finding", F.concat(F.lit("unknown assumption "), "k").alias("problem"))
    f = findings.select(F.col("id").alias("finding"), F.explode("implications").alias("i")).select("finding", F.explode("i.features").alias("k")).join(features.select(F.col("id").alias("k")), "k", "left_anti").select("finding", F.concat(F.lit("unknown feature "), "k").alias("problem"))
    twice = findings.groupBy(F.col("id").alias("finding")).count().where("count > 1").select("finding", F.concat(F.lit("repeated id x"), F.col("count").cast("string")).alias("problem"))
    return gaps.unionByName(grade).unionByName(a).unionByName(f).unionByName(twice)


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of a markdown table, one for each row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
