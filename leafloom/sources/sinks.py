"""Where results go: trees by version, event logs, build markers, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.text import BUILD_VERSION, safe_id
from leafloom.operators.events import REPORT_COLUMNS


def save_trees(nodes: DataFrame, path: str, version: str = BUILD_VERSION) -> None:
    """Nodes under a folder for the build's parameters, so that other parameters never meet them."""
    nodes.withColumn("build", F.lit(version)).write.mode("append").partitionBy("build").parquet(path)


def stamped(events: DataFrame, now: Column) -> DataFrame:
    """Events as they are stored: with the server's time unless they bring their own."""
    return events.withColumn("ts", F.coalesce("ts", now)) if "ts" in events.columns else events.withColumn("ts", now)


def append_events(events: DataFrame, path: str, now: Column) -> None:
    stamped(events, now).write.mode("append").json(path)


def write_report(documents: DataFrame, path: str) -> None:
    """The report's fixed columns as CSV, nulls as nothing."""
    documents.select(*REPORT_COLUMNS).orderBy("phase", "doc_label").write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def _figure(c: Column, mean: bool = True) -> Column:
    """A figure of at least zero with one decimal, halves up, and none where it is 0; `-` for null.

    A mean that lies on a half comes out a last bit above or below it, by the order in which its values met: it counts as the half. A median
    does not hang on an order and is rounded as it stands, so that one of 44.449999999999996 is 44.4.
    """
    tens = c.cast("double") * 10
    tenths = F.round(F.round(tens, 6) if mean else tens).cast("long")
    return F.coalesce(F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), tenths % 10)).otherwise("")), F.lit("-"))


def report_lines(phases: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, phase, text): what a report says of each phase, a line for each figure that there is."""
    f, n = lambda c: _figure(F.col(c), mean=c.endswith("_mean")), F.col
    yes_no = lambda c, told: F.when(n(f"{c}_yes") + n(f"{c}_no") > 0, F.concat(F.lit(f"    {told}: yes "), n(f"{c}_yes"), F.lit(", no "), n(f"{c}_no")))
    lines = [
        F.concat("phase", F.lit("  condition "), "condition", F.lit("  "), "documents", F.lit(" document(s), "), "sessions", F.lit(" session(s)")),
        F.concat(F.lit("    Minutes to know what to do: median "), f("minutes_to_know_median"), F.lit(" (n="), "minutes_to_know_n", F.lit(")")),
        F.concat(F.lit("    Checklist score (0 to 5): mean "), f("checklist_score_mean"), F.lit(" (n="), "checklist_score_n", F.lit(")")),
        F.concat(F.lit("    Effort (0 to 100): mean "), f("tlx_raw_mean"), F.lit(" (n="), "tlx_raw_n", F.lit(")")),
        F.when(n("minutes_to_first_action_n") > 0, F.concat(F.lit("    Minutes to the first action: median "), f("minutes_to_first_action_median"))),
        yes_no("started_within_24h", "Started within 24 hours"), yes_no("missed_later", "Missed something"), yes_no("did_it_help", "Did it help"),
    ]
    return phases.select(*by, "phase", F.concat_ws("\n", *lines).alias("text"))


def report_json(documents: DataFrame, phases: DataFrame, pattern: DataFrame, by: list[str]) -> DataFrame:
    """(by, json): a whole report as one JSON text for each reader; by must name at least one column, so that no report grows with the log."""
    if not by:
        raise ValueError("name the columns that tell readers apart")

    def packed(df: DataFrame, name: str, order: str) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in by])
        return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, row.alias("_r")))), lambda s: s["_r"]).alias(name))

    x = packed(documents.withColumn("_o", F.concat_ws(" ", "phase", "doc_label")), "documents", "_o").join(packed(phases, "phases", "phase"), list(by), "left").join(packed(pattern, "pattern", "metric"), list(by), "left")
    return x.select(*by, F.to_json(F.struct("documents", "phases", "pattern")).alias("json"))


# ---------------------------------------------------------------- build markers: a log of notes, of which the last of each tree counts

MARKER = "tree_id string, title string, source_text string, objective string, model string, at timestamp, gone boolean"


def save_markers(builds: DataFrame, path: str, now: Column) -> None:
    """Notes that builds (tree_id, title, source_text, objective, model) have begun; ids that are not safe are refused."""
    bad = builds.where(~safe_id(F.col("tree_id"))).limit(1).count()
    if bad:
        raise ValueError("invalid tree id")
    builds.select("tree_id", "title", "source_text", "objective", "model", now.cast("timestamp").alias("at"), F.lit(False).alias("gone")).write.mode("append").parquet(path)


def delete_markers(trees: DataFrame, path: str, now: Column) -> None:
    """Builds that are done or have failed; ids without a marker are none of our business."""
    none = F.lit(None).cast("string")
    trees.where(safe_id(F.col("tree_id"))).select("tree_id", *[none.alias(c) for c in ("title", "source_text", "objective", "model")], now.cast("timestamp").alias("at"), F.lit(True).alias("gone")).write.mode("append").parquet(path)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Builds that have begun and not ended: the latest note of each tree (an end wins a tie), if it holds a source text."""
    last = spark.read.schema(MARKER).parquet(path).groupBy("tree_id").agg(F.max_by(F.struct("title", "source_text", "objective", "model", "at", "gone"), F.struct("at", "gone")).alias("m"))
    return last.select("tree_id", "m.*").where("not gone and source_text is not null").drop("gone")


def work_queue(wanted: DataFrame, finished: DataFrame, markers: DataFrame) -> DataFrame:
    """(tree_id, action) of builds to start or resume: wanted ones that are not finished; those with a marker were interrupted."""
    todo = wanted.select("tree_id").distinct().join(finished.select("tree_id"), "tree_id", "left_anti")
    return todo.join(markers.select("tree_id", F.lit(1).alias("_m")).distinct(), "tree_id", "left").select("tree_id", F.when(F.col("_m") == 1, "resume").otherwise("build").alias("action"))


def missing_short_titles(nodes: DataFrame, section_depth: DataFrame, limit: int = 400) -> DataFrame:
    """Nodes from the section level down without a short title, at most `limit` of a tree, in document order."""
    from pyspark.sql import Window

    w = Window.partitionBy("tree_id").orderBy("doc_pos")
    x = nodes.join(section_depth.withColumnRenamed("depth", "_d"), "tree_id").where((F.col("depth") >= F.col("_d")) & F.coalesce(F.col("short_title") == "", F.lit(True)))
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("tree_id", "node_id")
