"""What the training-data operators share: table access, the shared folder, cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Texts may be long: batches for Python are bounded by rows and bytes, so a worker's memory does not follow the partition's size.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and lets Python workers import this package: from the driver's checkout where it is there, else as shipped."""
    context = spark.sparkContext
    env = context.environment
    if _ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    if not context.master.startswith("local") and not getattr(context, "_leafloom_shipped", False):
        name = f"{tempfile.mkdtemp()}/leafloom.zip"  # the driver serves it to the executors
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(Path(_ROOT, "leafloom").rglob("*.py")):
                z.write(f, str(f.relative_to(_ROOT)))
        context.addPyFile(name)
        context._leafloom_shipped = True
    for name, value in ARROW.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only where all runs on one machine may it be unset (tests)."""
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if not kept:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        kept = tempfile.mkdtemp(prefix="leafloom-")
        spark.conf.set("spark.checkpoint.dir", kept)
    return kept.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, p = _hadoop(spark, path)
    files.deleteOnExit(p)  # what nothing drops earlier goes when the application ends
    out = spark.read.schema(df.schema).parquet(path)
    out._leafloom_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_materialized(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more, and lets Spark drop finished shuffles."""
    spark, path = df.sparkSession, getattr(df, "_leafloom_path", None)
    if path:
        files, p = _hadoop(spark, path)
        files.delete(p, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them; ask for that after a large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
