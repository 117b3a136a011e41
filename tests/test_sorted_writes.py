"""What a task that sorts its rows is given."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from docweave.sinks import tables


def test_one_partition_value_is_split_for_the_sort(spark, tmp_path, monkeypatch):
    """A value that all rows hold goes to several tasks, each of bounded size; the session's own size is as before."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("all").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    monkeypatch.setattr(tables, "SORTED_BYTES", "200KB")
    tables.write_table(rows, str(tmp_path / "sorted"), partition_by=["part"], sort_by=["text"])
    assert len(glob.glob(f"{tmp_path}/sorted/part=all/*.parquet")) > 4
    assert spark.conf.get(name) == before
    got = spark.read.parquet(str(tmp_path / "sorted"))
    assert got.count() == got.distinct().count() == 20_000
