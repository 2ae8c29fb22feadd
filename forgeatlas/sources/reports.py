"""Sinks: per-host tables and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.operators.hosts import MIN_ROWS, report_lines, with_bucket
from forgeatlas.operators.rdf import rejected_rows, row_documents, turtle_documents

ROWS_PER_FILE = 1_000_000


def write_per_host(df: DataFrame, path: str, *, min_rows: int = MIN_ROWS, fmt: str = "parquet",
                   rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per host with at least ``min_rows`` rows, the others pooled.

    The number of files of a bucket follows from its rows, so a host with a third
    of all rows is written by many tasks and a small one gives a single file. The
    host column itself is not stored in the buckets.
    """
    rows = with_bucket(df, min_rows)
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("bucket_rows") / F.lit(rows_per_file)))
    spread = rows.withColumn("_part", part).repartition("bucket", "_part")
    ordered = spread.sortWithinPartitions("bucket", "row_id")
    writer = (
        ordered.drop("_part", "bucket_rows", "repodomain")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .option("maxRecordsPerFile", rows_per_file)
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_host_report(df: DataFrame, path: str) -> None:
    """Header, then ``host: n`` by count; the parts in name order are the report."""
    lines = report_lines(df).orderBy(F.desc_nulls_first("n"), "first_row_id")
    lines.select("line").write.mode("overwrite").text(path)


def write_listing(lines: DataFrame, path: str) -> None:
    """Appends the listing of test files, see ``files.listing_lines``."""
    lines.orderBy("repourl", "part", "line").select("line").write.mode("append").text(path)


def write_errors(failures: DataFrame, path: str) -> None:
    """Appends URL and message of every failed repository."""
    block = F.format_string(
        "Repository URL: %s\nError Message: %s\n", F.col("repourl"), F.col("error_message")
    )
    failures.select(block.alias("value")).write.mode("append").text(path)


def write_documents(df: DataFrame, path: str, base: str, *, turtle: bool = False,
                    rejected: str | None = None) -> None:
    """The RDF documents of all rows, a statement per line or (``turtle``) with the
    statements of a row under one subject. The numbers of the rows that cannot be written
    are stored at ``rejected``."""
    documents = turtle_documents if turtle else row_documents
    documents(df, base).select("value").write.mode("overwrite").text(path)
    if rejected is not None:
        rejected_rows(df).write.mode("overwrite").parquet(rejected)
