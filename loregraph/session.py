"""Session, table access and the few physical-plan helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast, after it has been counted.
BROADCAST_ROWS = 100_000


def get_spark(app: str = "loregraph", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested with; on a cluster, pass your own session instead."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(cores or 8),
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local one is made only where none is named and all executors run in this process; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loregraph-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if a count, which stops after ``max_rows`` + 1 rows, proves it small; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` on at least two partitions a core, for work in Python that follows; more partitions than that stay as they are.

    For frames read from files or a checkpoint: to tell the partitions of one with a shuffle would run it.
    """
    wanted = 2 * parallelism(df.sparkSession)
    return df.repartition(wanted, *cols) if df._jdf.queryExecution().toRdd().getNumPartitions() < wanted else df


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
