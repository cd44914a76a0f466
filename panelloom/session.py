"""Session settings, shared scratch space and the size-checked broadcast join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 200_000


def build_session(app: str = "panelloom", cpus: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint folder exists (tests on one machine) a temporary
    one is made.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if current is None:
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="panelloom-"))
        current = sc.getCheckpointDir()
    return configured or current


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint; later readers see one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back, columns apart, for many passes.

    Rebalanced once: a small table is one file and one task a pass, a large one even files.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle_measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """Settle a frame and return aggregates of what was written.

    An observation would save the second, tiny job, but once a session has observed
    anything, Spark's binary classifiers can no longer be shipped to tasks.
    """
    settled = settle(df)
    return settled, settled.agg(*metrics).first().asDict()


def side(small: DataFrame) -> DataFrame:
    """Settle per-group statistics and mark them for broadcast if they are few.

    The rows are counted first. Beyond the bound the frame is left unmarked and Spark
    shuffles the join, splitting hot groups by its adaptive skew join (the statistics
    are unique per key).
    """
    small, found = settle_measured(small, F.count(F.lit(1)).alias("n"))
    return F.broadcast(small) if found["n"] <= BROADCAST_ROWS else small


def attach(df: DataFrame, small: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join per-group statistics onto rows without shuffling the rows; see ``side``."""
    return attach_side(df, side(small), by, how)


def attach_side(df: DataFrame, ready: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    if by:
        return df.join(ready, list(by), how)
    # One-row statistics of the whole frame: a constant key makes it an equi-join.
    one = F.broadcast(ready.withColumn("_all", F.lit(1)))
    return df.withColumn("_all", F.lit(1)).join(one, "_all", how).drop("_all")


def hold(df: DataFrame) -> DataFrame:
    """Keep a frame that several actions of one operator read; see ``release``."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release(df: DataFrame) -> None:
    df.unpersist(blocking=False)
