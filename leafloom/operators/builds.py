"""What is to be done about each tree, and builds that end together: the first that fails stops the others."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.classify import GOALS

#: What a state asks for. `backfill`: short titles are missing; `clear`: a marker outlived its build.
ACTIONS = {"building": None, "error": "retry", "done": None, "unlabelled": "backfill", "stale": "rebuild", "interrupted": "resume", "absent": "build"}


def next_actions(wanted: DataFrame, trees: DataFrame, runs: DataFrame, markers: DataFrame, build: str, default_model: str, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(tree_id, state, action, clear_marker, title, model, objective): a row for each tree that any of the tables names.

    wanted (tree_id). trees (tree_id, build, title, model, objective, missing_titles): stored ones, of this build or older ones. runs (tree_id,
    status building or error). markers (tree_id, title, model, objective, source_text): builds that began. A run counts first, then a
    tree of this build, then one of an older build (`stale`), then a marker with a text (`interrupted`). A build takes up the title, model and
    goal that its tree or marker has, but for blocked models and goals that are none.
    """
    here = trees.groupBy("tree_id").agg(F.max_by(F.struct("build", "title", "model", "objective", "missing_titles"), F.struct(F.col("build") == build, "build")).alias("t"))
    run = runs.groupBy("tree_id").agg(F.max(F.col("status") == "building").alias("_running"))
    mark = markers.where("source_text is not null").groupBy("tree_id").agg(F.max(F.struct("title", "model", "objective")).alias("m"))
    x = wanted.select("tree_id").unionByName(here.select("tree_id")).unionByName(run.select("tree_id")).unionByName(mark.select("tree_id")).distinct()
    x = x.join(here, "tree_id", "left").join(run, "tree_id", "left").join(mark, "tree_id", "left")
    current = F.coalesce(F.col("t.build") == build, F.lit(False))
    state = F.when(F.col("_running"), "building").when(~F.col("_running"), "error").when(current & (F.col("t.missing_titles") > 0), "unlabelled").when(current, "done")
    state = state.when(F.col("t").isNotNull(), "stale").when(F.col("m").isNotNull(), "interrupted").otherwise("absent")
    action = F.create_map(*[F.lit(v) for k, a in ACTIONS.items() if a for v in (k, a)])
    of = lambda name: F.when(F.col("t").isNotNull(), F.col(f"t.{name}")).otherwise(F.col(f"m.{name}"))
    model = F.when(F.coalesce(of("model"), F.lit("")).isin("", *blocked), default_model).otherwise(of("model"))
    title: Column = F.when(F.coalesce(of("title"), F.lit("")) == "", "Untitled").otherwise(of("title"))
    goal = F.when(of("objective").isin(*GOALS), of("objective"))
    out = x.select("tree_id", state.alias("state"), (F.col("m").isNotNull() & current & F.col("_running").isNull()).alias("clear_marker"), title.alias("title"), model.alias("model"), goal.alias("objective"))
    return out.select("tree_id", "state", F.element_at(action, F.col("state")).alias("action"), "clear_marker", "title", "model", "objective")


class BuildFailed(RuntimeError):
    """One of the builds failed; the others were stopped."""


def build_together(spark: SparkSession, builds: dict[str, Callable[[], object]], at_once: int = 8) -> dict[str, object]:
    """Runs the builds (functions that start Spark jobs) side by side under one job tag and gives their results by name.

    As soon as one fails, the jobs of all others are interrupted by that tag and none that waits is begun; BuildFailed names the first.
    """
    context, tag = spark.sparkContext, f"build-{uuid.uuid4().hex}"

    def tagged(make: Callable[[], object]) -> object:
        context.addJobTag(tag)
        try:
            return make()
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        running = {pool.submit(inheritable_thread_target(spark)(tagged), make): name for name, make in builds.items()}
        done, waiting = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if f.exception() is not None), None)
        if failed is not None:
            for f in waiting:
                f.cancel()
            while not all(f.done() for f in waiting):  # a build may begin another job between two interrupts
                context.cancelJobsWithTag(tag)
                wait(waiting, timeout=0.5)
            raise BuildFailed(f"{running[failed]}: {failed.exception()}") from failed.exception()
    return {name: f.result() for f, name in running.items()}
