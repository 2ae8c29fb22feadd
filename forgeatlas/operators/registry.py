"""Cleaning of the registry: flags, hosts and base URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeatlas.functions import urls
from forgeatlas.operators.order import flag_repeats
from forgeatlas.schemas import REGISTRY_COLUMNS, require_columns


def _require_url(df: DataFrame) -> None:
    if "repourl" not in df.columns:
        raise ValueError("DataFrame must contain a 'repourl' column.")


def mark_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """F2 over the registry columns; nulls compare equal."""
    return flag_repeats(df, columns or [c for c in REGISTRY_COLUMNS if c in df.columns])


def mark_null_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a missing value; duplicates are never marked."""
    require_columns(df, ["duplicate_flag"])
    checked = columns or [c for c in REGISTRY_COLUMNS if c in df.columns]
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in checked))
    return df.withColumn("null_value_flag", ~F.col("duplicate_flag") & missing)


def convert_http_to_https(df: DataFrame) -> DataFrame:
    """B2 on the ``repourl`` column."""
    _require_url(df)
    return df.withColumn("repourl", urls.upgrade_scheme(F.col("repourl")))


def extract_and_flag_domains(df: DataFrame) -> DataFrame:
    """Host of non-duplicates; every row without a host is unsupported."""
    _require_url(df)
    found = F.when(~F.col("duplicate_flag"), urls.host_or_empty(urls.parsable(F.col("repourl"))))
    supported = F.col("_host") != ""
    return df.select(
        "*",
        found.alias("_host"),
        F.when(supported, F.col("_host")).alias("repodomain"),
        F.coalesce(~supported, F.lit(True)).alias("unsupported_url_scheme"),
    ).drop("_host")


def mark_incomplete_urls(df: DataFrame) -> DataFrame:
    """Duplicates, unsupported rows and URLs with too few parts."""
    _require_url(df)
    return df.withColumn(
        "incomplete_url_flag",
        F.col("duplicate_flag")
        | F.col("unsupported_url_scheme")
        | ~urls.is_complete(F.col("repourl")),
    )


def get_base_repo_url(df: DataFrame) -> DataFrame:
    """C4: base URL and its failure flag on rows without any flag, null elsewhere."""
    _require_url(df)
    eligible = ~(
        F.col("duplicate_flag") | F.col("unsupported_url_scheme") | F.col("incomplete_url_flag")
    )
    return with_base_url(df, eligible)


def with_base_url(df: DataFrame, eligible: Column) -> DataFrame:
    """B7 on the rows that are ``eligible``. Each step is a column of its own, so that no
    pattern is evaluated twice for a row."""
    url, clean, path = F.col("repourl"), F.col("_clean"), F.col("_path")
    direct = F.col("_direct")
    too_short = ~direct & ~path.contains("/")
    kept = F.when(direct, path).otherwise(F.substring_index(path, "/", 2))
    built = F.concat(urls.scheme(clean), F.lit("://"), F.col("_netloc"), F.lit("/"), kept)
    # Later items of the select list refer to earlier ones.
    return df.select(
        "*",
        F.when(eligible, F.coalesce(urls.parsable(url), F.lit(""))).alias("_clean"),
        urls.netloc(clean).alias("_netloc"),
        urls.path(clean).alias("_path"),
        urls.is_direct(F.col("_netloc")).alias("_direct"),
        ((clean == "") | too_short).alias("base_repo_url_flag"),
        F.when(~F.col("base_repo_url_flag"), built).alias("base_repo_url"),
    ).drop("_clean", "_netloc", "_path", "_direct")


def clean_registry(df: DataFrame, *, canonicalise_first: bool = False) -> DataFrame:
    """All cleaning steps in their order; the row count is preserved.

    Duplicates are looked for before ``http`` becomes ``https``, so two rows that
    differ in the scheme only both stay, unless ``canonicalise_first`` is set.
    """
    _require_url(df)
    df = df.withColumn("repourl", urls.trim_url(F.col("repourl")))
    if canonicalise_first:
        df = convert_http_to_https(df)
    df = mark_null_values(mark_duplicates(df))
    df = convert_http_to_https(df)
    return get_base_repo_url(mark_incomplete_urls(extract_and_flag_domains(df)))


def quality_profile(df: DataFrame) -> DataFrame:
    """One row of counters, in one pass."""
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if("duplicate_flag").alias("duplicates"),
        F.count_if("null_value_flag").alias("null_rows"),
        F.count_if(F.col("unsupported_url_scheme") & ~F.col("duplicate_flag")).alias(
            "unsupported"
        ),
        F.count_if("incomplete_url_flag").alias("incomplete"),
        F.count_if("base_repo_url_flag").alias("base_url_failures"),
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Per column its type, number of rows and number of non-null values.

    One aggregation over the table; the one-row result is turned into rows.
    """
    kinds = dict(df.dtypes)
    counted = df.agg(
        F.count("*").alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)
    )
    lines = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("column_type"),
                F.col("_rows").alias("row_count"),
                F.col(f"`{c}`").alias("non_null"),
            )
            for c in df.columns
        )
    )
    return counted.select(F.inline(lines))
