"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, as ``--py-files`` would.

    Spark's driver serves the archive to the executors, which need not share a folder with it.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="draftloom-"), "draftloom"), "zip", root, "draftloom"))
        _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Whole documents travel to Python in batches; keep those small enough for very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def words(text: str | Column) -> Column:
    """Number of words (runs without ASCII white space) as a column; null text has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def own(name: str) -> str:
    """A column name that no caller's table has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"
