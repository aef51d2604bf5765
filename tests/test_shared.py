from leafloom.sources.shared import written


def test_joins_of_written_tables_are_not_broadcast(spark):
    """Files that squeeze well look small to a plan: their rows must not go through the driver."""
    x = written(spark.range(1000).selectExpr("id", "id % 7 AS k"), "x")
    plan = x.groupBy("k").count().join(x, "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
