"""Hosts in one layout: a host is read from its own files, without a folder each."""

import os

from pyspark.sql import functions as F

from forgeatlas.sources import host_layout


def test_hosts_are_read_from_their_files(spark, tmp_path):
    path = str(tmp_path / "hosts")
    rows = spark.range(30_000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot.example").when(F.col("id") % 1000 == 7, None)
        .otherwise(F.concat(F.lit("h"), (F.col("id") % 9000).cast("string"))).alias("repodomain"),
    ).repartition(5)
    host_layout.write_hosts(rows, path, rows_per_file=1500)
    names = [n for n in os.listdir(f"{path}/rows") if n.endswith(".parquet")]
    assert 20 <= len(names) < 60 and not any(os.path.isdir(f"{path}/rows/{n}") for n in os.listdir(f"{path}/rows"))
    manifest = host_layout.host_files(spark, path)
    assert manifest.agg(F.sum("n")).first()[0] == rows.filter("repodomain IS NOT NULL").count()
    for host in ("hot.example", "h1", "h8999"):
        found = host_layout.read_host(spark, path, host)
        wanted = rows.filter(F.col("repodomain") == host)
        assert sorted(r.row_id for r in found.collect()) == sorted(r.row_id for r in wanted.collect())
        opened = {os.path.basename(f) for f in found.inputFiles()}
        assert opened == {r["file"] for r in manifest.filter(F.col("repodomain") == host).collect()}
        assert len(opened) > 5 if host == "hot.example" else len(opened) <= 2
    assert host_layout.read_host(spark, path, "nobody").count() == 0
    host_layout.write_hosts(rows.limit(0), path)
    assert host_layout.host_files(spark, path).count() == 0
