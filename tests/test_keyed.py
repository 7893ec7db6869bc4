"""Lookups of many keys, and batches without rows."""

from pyspark.sql import functions as F

from docquarry.sources import keyed


def test_many_keys_open_files_without_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MANY_KEYS", 20)
    table = keyed.KeyedTable(str(tmp_path / "k"), "id", "id string, n long", 2)
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    table.append(rows.unionByName(rows), 0)
    table.append(rows.limit(0), 1)
    assert table.runs(spark, 2) == ["L0-0"]
    absent = spark.range(1000, 1200).select(F.col("id").cast("string").alias("id"))
    assert table.lookup(absent.unionByName(rows.select("id")), 2).count() == 200
    assert table.lookup(rows.select("id").where("n < 3"), 2).count() == 6
    many = absent.withColumn("bucket", table._bucket())
    assert len(table.files_for(many, ["L0-0"])) == 2
