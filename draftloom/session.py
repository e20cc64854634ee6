"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot partitions even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Rows of numbers in memory to their bytes in a file. Without it, tables that are small in files alone are broadcast through the driver.
FILE_GROWTH = "spark.sql.sources.fileCompressionFactor", "10.0"


def tune(spark: SparkSession, growth: bool = False) -> SparkSession:
    """Apply the run-time SQL settings the operators count on; with ``growth``, files of numbers count as large as they are in memory."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if growth:
        spark.conf.set(*FILE_GROWTH)
    else:
        spark.conf.unset(FILE_GROWTH[0])
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("draftloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    It must be one that all executors share. Only a local session that names none (a test)
    gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="draftloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows as a table in the shared folder and reading it back.

    Unlike a checkpointed plan, whose size estimate keeps multiplying through the joins of
    a loop, the written table tells the planner its true size each round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/draftloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that an operator writes itself."""
    return f"{checkpoint_folder(spark)}/draftloom-{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`checkpoint` or an operator wrote, once nothing reads it any more."""
    if not path.rsplit("/", 1)[-1].startswith("draftloom-"):
        raise ValueError(f"not an intermediate table: {path}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint_path(df: DataFrame) -> tuple[DataFrame, str]:
    """:func:`checkpoint`, with the path for :func:`discard`."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
