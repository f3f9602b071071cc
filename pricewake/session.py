"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricewake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pricewake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


# Scratch folders of this application that still stand, oldest first.
_standing: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _standing.append(path)
    return path


def scratch_mark() -> int:
    """Where the list of scratch folders stands now, for ``release``."""
    return len(_standing)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete the scratch folders made since ``mark``; only for results that are all used up."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _standing[mark:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    del _standing[mark:]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several steps read, and read it back.

    Cuts the lineage, so neither the steps nor lost executors compute it again,
    and gives the planner its true size when it looks for sides to broadcast.
    The folder stands until ``release`` or the one who owns the shared folder removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
