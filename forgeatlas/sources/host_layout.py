"""All hosts in one clustered layout with a manifest (A7 without a folder per host).

Rows are range-partitioned and sorted by host and row, so the rows of a host lie in one file or
in files that follow each other; a host with a third of all rows fills many files, and many
small hosts share one. The manifest, made from the files as they were written, says which files
hold a host. Reading one host opens these files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_hosts(df: DataFrame, path: str, *, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Rows with a host, below ``path/rows``, and their manifest, below ``path/manifest``."""
    rows = df.filter(F.col("repodomain").isNotNull())
    parts = max(1, -(-rows.count() // rows_per_file))
    ordered = rows.repartitionByRange(parts, "repodomain", "row_id").sortWithinPartitions("repodomain", "row_id")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    manifest = written.groupBy(
        "repodomain", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row_id"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def host_files(spark: SparkSession, path: str) -> DataFrame:
    """``repodomain, file, bytes, n, first_row_id``: one row per host and file."""
    return spark.read.parquet(f"{path}/manifest")


def read_host(spark: SparkSession, path: str, host: str) -> DataFrame:
    """The rows of one host. The names of its files are looked up; no other file is listed or
    opened. A host without rows gives no rows."""
    names = [r["file"] for r in host_files(spark, path).filter(F.col("repodomain") == host).select("file").collect()]
    if not names:
        return spark.read.parquet(f"{path}/rows").limit(0)
    return spark.read.parquet(*(f"{path}/rows/{name}" for name in names)).filter(F.col("repodomain") == host)
