"""A store of finished trees by build, read as one table whatever build wrote them, and its log of begun builds.

A tree is a line of JSON in the folder of its build. Builds differ in their fields: all are read with the fields of today, those that an older
build did not write being null. Lines that cannot be read are rows with a problem, never lost and never in the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions.text import BUILD_VERSION
from leafloom.operators.tree import collapsed_stored

from .sinks import MARKER

NODE = "node_id string, parent string, is_leaf boolean, text string, words int, span_start int, span_end int, importance double, title string, short_title string, hook string, key_points array<string>, cites array<string>"
TREE = f"tree_id string, title string, model string, objective string, saved_at timestamp, nodes array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in NODE.split(', '))}>>"
_DAMAGED = "_damaged"


def save(trees: DataFrame, path: str, build: str = BUILD_VERSION) -> None:
    """trees (the columns of TREE or some of them) into the folder of a build; a tree saved again is one more line, and the latest counts."""
    trees.write.mode("append").json(f"{path}/build={build}")


def nested(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """trees (tree_id and more) with their nodes (tree_id, doc_pos, columns of NODE or some of them) as an array in document order."""
    own = [c for c in nodes.columns if c not in ("tree_id", "doc_pos")]
    held = nodes.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("doc_pos", F.struct(*own).alias("n")))).alias("_n"))  # a tree is bounded by its document
    return trees.join(held.select("tree_id", F.transform("_n", lambda x: x["n"]).alias("nodes")), "tree_id")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every saved tree and every damaged line: TREE, build, file and problem (null, or what is wrong)."""
    lines = spark.read.schema(f"{TREE}, build string, {_DAMAGED} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _DAMAGED).option("basePath", path).json(path)
    problem = F.when(F.col(_DAMAGED).isNotNull(), "no JSON of a tree").when(F.col("tree_id").isNull(), "no tree id").when(F.coalesce(F.size("nodes"), F.lit(0)) < 1, "no nodes")
    return lines.withColumns({"problem": problem, "file": F.col("_metadata.file_path")}).drop(_DAMAGED)


def read_first(spark: SparkSession, path: str, builds: list[str]) -> DataFrame:
    """The readable trees of these builds, one for each id: of the build that comes first, there the one saved last."""
    order = F.array_position(F.array(*map(F.lit, builds)), F.col("build"))
    good = read_all(spark, path).where(F.col("problem").isNull() & (order > 0))
    w = Window.partitionBy("tree_id").orderBy(order, F.desc_nulls_last("saved_at"), F.desc("title"))
    return good.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "problem", "file")


def nodes_of(trees: DataFrame, legacy: Column | None = None) -> DataFrame:
    """(tree_id, doc_pos, NODE, depth) of stored trees. Those that `legacy` picks, by columns of trees, lose the levels that builds of their time left in."""
    flag = F.lit(True) if legacy is None else F.coalesce(legacy, F.lit(False))
    flat = trees.select("tree_id", flag.alias("_legacy"), F.posexplode("nodes").alias("doc_pos", "n")).select("tree_id", "_legacy", "doc_pos", "n.*")
    return collapsed_stored(flat.where("_legacy").drop("_legacy")).unionByName(collapsed_stored(flat.where("not _legacy").drop("_legacy"), absorb=False))


def recent(trees: DataFrame, limit: int = 20) -> DataFrame:
    """The trees saved last, newest first."""
    return trees.orderBy(F.desc_nulls_last("saved_at"), "tree_id").limit(limit)


# ---------------------------------------------------------------- the log of begun builds


def _notes(spark: SparkSession, path: str):
    """(folders of notes, file system): every save and every compaction is a folder of its own, complete once it has its _SUCCESS."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    return [p for p in found if files.exists(Path(p, "_SUCCESS"))], files


def note(builds: DataFrame, path: str, now: Column, gone: bool = False) -> None:
    """One more folder of notes: builds (tree_id and, if they begin, title, source_text, objective, model) that begin or are gone."""
    none = F.lit(None).cast("string")
    cols = [F.col(c) if c in builds.columns else none.alias(c) for c in ("title", "source_text", "objective", "model")]
    builds.select("tree_id", *cols, now.cast("timestamp").alias("at"), F.lit(gone).alias("gone")).write.parquet(f"{path}/{uuid.uuid4().hex}")


def _latest(notes: DataFrame) -> DataFrame:
    return notes.groupBy("tree_id").agg(F.max_by(F.struct("title", "source_text", "objective", "model", "at", "gone"), F.struct("at", "gone")).alias("m")).select("tree_id", "m.*")


def begun(spark: SparkSession, path: str) -> DataFrame:
    """Builds that have begun and not ended, with what they began with: the last note of each tree (an end wins a tie)."""
    folders, _ = _notes(spark, path)
    if not folders:
        return spark.createDataFrame([], MARKER).drop("gone")
    return _latest(spark.read.schema(MARKER).parquet(*[p.toString() for p in folders])).where("not gone and source_text is not null").drop("gone")


def compact(spark: SparkSession, path: str) -> int:
    """Writes the last note of every tree that has begun into one folder and then drops the folders it stands for; gives how many those were.

    A reader sees the old folders, or old and new ones (the same notes twice, which changes nothing), or the new one. Ends are kept while a
    folder that may hold their beginning is not dropped, so a compaction that stops halfway brings no build back.
    """
    folders, files = _notes(spark, path)
    if len(folders) < 2:
        return 0
    last = _latest(spark.read.schema(MARKER).parquet(*[p.toString() for p in folders]))
    last.select("tree_id", "title", "source_text", "objective", "model", "at", "gone").where("not gone").write.parquet(f"{path}/{uuid.uuid4().hex}")
    # beginnings go before ends: whatever is still there, the ends of what was dropped are not missed
    kept = {p.toString(): spark.read.schema(MARKER).parquet(p.toString()).where("gone").isEmpty() for p in folders}
    for p in sorted(folders, key=lambda p: not kept[p.toString()]):
        files.delete(p, True)
    return len(folders)
