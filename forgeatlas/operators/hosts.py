"""Counts per hosting platform and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.functions.text import sanitise_name
from forgeatlas.operators.lookup import frequent_keys, lookup
from forgeatlas.session import cut_lineage

# Thresholds, pool name and the first line of the report.
MIN_ROWS = 10
BIG_HOST_GT = 10
OTHER = "other_domains"
REPORT_HEADER = "Count of repositories for each domain:"
# End of fixed values.


def host_counts(df: DataFrame) -> DataFrame:
    """Rows per host and the first row it occurs in; the missing host counts 0.

    ``count(column)`` combines on the map side, so the many rows without a host
    reach the shuffle as one partial row per task.
    """
    return df.groupBy("repodomain").agg(
        F.count("repodomain").alias("n"), F.min("row_id").alias("first_row_id")
    )


def known_host_counts(df: DataFrame) -> DataFrame:
    """E2 without the missing host.

    It is dropped after the aggregation and by its count: a condition on the host
    would be pushed down and have every URL parsed twice.
    """
    return host_counts(df).filter(F.col("n") > 0)


def host_split(df: DataFrame, big_host_gt: int = BIG_HOST_GT) -> DataFrame:
    """Known hosts with their counts and on which side of the threshold they are."""
    return known_host_counts(df).withColumn("is_big", F.col("n") > big_host_gt)


def small_host_total(df: DataFrame, big_host_gt: int = BIG_HOST_GT) -> DataFrame:
    """Rows of all small hosts together, 0 when there is none."""
    return host_split(df, big_host_gt).agg(
        F.coalesce(F.sum(F.when(~F.col("is_big"), F.col("n"))), F.lit(0)).alias("small_total")
    )


def small_host_rows(df: DataFrame, big_host_gt: int = BIG_HOST_GT) -> DataFrame:
    """Rows whose host is small. The frequent hosts, which have no match here, are
    kept apart by the lookup and do not meet in one task."""
    counts = cut_lineage(known_host_counts(df).select("repodomain", "n"))
    small = counts.filter(F.col("n") <= big_host_gt)
    hot = frequent_keys(counts, "repodomain")
    found = lookup(df, small, "repodomain", spread="row_id", hot=hot)
    return found.filter(F.col("n").isNotNull()).select(*df.columns)


def distinct_hosts(df: DataFrame) -> DataFrame:
    """E14."""
    return df.select("repodomain").distinct()


def top_hosts(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hosts by count, ties by first appearance."""
    ordered = known_host_counts(df).orderBy(F.desc("n"), "first_row_id")
    return ordered.limit(limit) if limit else ordered


def report_lines(df: DataFrame) -> DataFrame:
    """``(n, first_row_id, line)``; the header line carries the null count.

    The order of the report is ``n`` descending, then ``first_row_id``; the
    header sorts first because its ``n`` is null and nulls come first.
    """
    counts = host_counts(df)
    line = F.format_string("%s: %d", F.coalesce("repodomain", F.lit("None")), F.col("n"))
    body = counts.select("n", "first_row_id", line.alias("line"))
    header = df.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("long").alias("first_row_id"),
        F.lit(REPORT_HEADER).alias("line"),
    )
    return header.unionByName(body)


def with_bucket(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows with a host, plus ``bucket`` (own name or the pool) and ``bucket_rows``.

    Rows without a host belong to no bucket; see :func:`null_host_rows`. The
    counts, one row per host, are stored and read three times.
    """
    counts = cut_lineage(known_host_counts(df).select("repodomain", "n"))
    own = counts.filter(F.col("n") >= min_rows)
    pooled = counts.filter(F.col("n") < min_rows).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    rows = lookup(
        df.filter(F.col("repodomain").isNotNull()),
        own,
        "repodomain",
        spread="row_id",
        hot=frequent_keys(counts, "repodomain"),
    )
    name = F.when(F.col("n").isNotNull(), sanitise_name(F.col("repodomain"))).otherwise(OTHER)
    return rows.select(
        *df.columns, name.alias("bucket"), F.coalesce("n", pooled).alias("bucket_rows")
    )


def null_host_rows(df: DataFrame) -> DataFrame:
    """Rows that reach no host table."""
    return df.filter(F.col("repodomain").isNull())
