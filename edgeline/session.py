"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task holds at a time, where few rows unfold into many.
TASK_ROWS = 2_000_000

# AQE coalesces small shuffles and splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "edgeline", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Where nothing is set, which is
    the case in tests, it is a folder below the warehouse, which executors share.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        current = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        context.setCheckpointDir(current)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for one written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/edgeline-{uuid.uuid4().hex}/{name}"


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number, or more for a larger table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once and read it back.

    For a stage that several later steps read: they share one computation, the
    lineage is cut at a file that survives lost executors, and unlike a
    checkpoint the reader still prunes columns and knows the table's size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
