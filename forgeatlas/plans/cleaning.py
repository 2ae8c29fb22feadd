"""Registry pipeline: ragged rows -> filled -> cleaned -> tables and reports (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.operators.hosts import top_hosts
from forgeatlas.operators.order import fill_by_row_id
from forgeatlas.operators.registry import clean_registry
from forgeatlas.schemas import REGISTRY_CLEAN, REGISTRY_COLUMNS, REGISTRY_RAW
from forgeatlas.sources.reports import write_host_report, write_per_host
from forgeatlas.sources.tables import write_snapshot
from forgeatlas.sources.tsv import read_registry


def clean_rows(raw: DataFrame) -> DataFrame:
    """F1 and all flags for rows that carry a ``row_id``.

    The fill and the first pass of the duplicate search share one partitioning
    by blocks of row ids, so the rows are shuffled twice in total.
    """
    filled = fill_by_row_id(raw, REGISTRY_COLUMNS[:2])
    return clean_registry(filled).select(*REGISTRY_CLEAN.names)


def repositories_per_host(raw: DataFrame) -> DataFrame:
    """The headline report: hosts by number of repositories."""
    return top_hosts(clean_rows(raw)).select(
        F.col("repodomain").alias("host"), F.col("n").alias("repositories")
    )


def run_cleaning(spark: SparkSession, tsv: str, folder: str, fmt: str = "parquet") -> DataFrame:
    """The whole pipeline from a TSV file to the stored tables; returns the clean table.

    Both tables are stored as parquet, and each step reads the stored table before
    it, so the text is parsed and the rows are cleaned once. ``fmt`` is the format
    of the per-host tables and of the additional exports.
    """
    write_snapshot(read_registry(spark, tsv), f"{folder}/original")
    original = spark.read.schema(REGISTRY_RAW).parquet(f"{folder}/original")
    write_snapshot(clean_registry(original).select(*REGISTRY_CLEAN.names), f"{folder}/clean")
    clean = spark.read.schema(REGISTRY_CLEAN).parquet(f"{folder}/clean")
    if fmt != "parquet":
        write_snapshot(original, f"{folder}/original_{fmt}", fmt)
        write_snapshot(clean, f"{folder}/clean_{fmt}", fmt)
    write_per_host(clean, f"{folder}/by_host", fmt=fmt)
    write_host_report(clean, f"{folder}/domain_counts")
    return clean
