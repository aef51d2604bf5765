"""Tables written once to the folder that driver and executors share, where a plan would else make the same rows several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bounds of what Python workers get at once: texts are long, and a batch makes many times its own size of passages.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bounded_batches(spark: SparkSession) -> SparkSession:
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Only where all runs on one machine may it be unset, as in tests."""
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="leafloom-")
        spark.conf.set("spark.checkpoint.dir", kept)
    return kept.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again from there: what follows reads it as often as it likes, and it goes with the application.

    Joins of it are merge joins, as it may be large: a plan knows it by the bytes of its files only, which keys that repeat are squeezed to a
    hundredth of, and would send millions of rows through the driver to broadcast them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
