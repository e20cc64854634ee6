"""Rows that were exploded into cells do not go through the driver."""

from pyspark.sql import functions as F

from draftloom.operators.spatial import box_join
from draftloom.session import FILE_GROWTH, tune

BOX = ("x0", "y0", "x1", "y1")


def _boxes(spark, path):
    rows = spark.range(300).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 40.0).alias("x0"), (F.col("id") * 30.0).alias("y0"))
    rows.withColumn("x1", F.col("x0") + 50).withColumn("y1", F.col("y0") + 50).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_cells_are_not_broadcast(spark, tmp_path):
    a = _boxes(spark, tmp_path / "a")
    pairs = box_join(a, a, ["k"], BOX, BOX, 5.0, margin=20.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in a.select("k", "id", *BOX).collect()]
    brute = sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and all(p[i] - 20 <= q[i + 2] and q[i] <= p[i + 2] + 20 for i in (2, 3)))
    assert sorted(map(tuple, pairs.select("a_id", "b_id").collect())) == brute


def test_core_queries_count_files_as_large_as_in_memory(spark):
    import __spark_entry__ as entry

    def seen(growth):
        return entry._tuned(lambda session, folder: session.conf.get(FILE_GROWTH[0]), growth)(spark, "")

    try:
        assert (float(seen(True)), float(seen(False))) == (float(FILE_GROWTH[1]), 1.0)
    finally:
        tune(spark)
