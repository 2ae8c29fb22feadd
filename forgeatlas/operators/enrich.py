"""Registry enrichment: what to process, results written back, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeatlas.functions import urls
from forgeatlas.operators.lookup import lookup
from forgeatlas.operators.runners import rule_columns

NOT_COUNTED = -1


def _flag(name: str, columns: list[str]) -> Column:
    """A flag column; a missing column or value is false."""
    return F.coalesce(F.col(name), F.lit(False)) if name in columns else F.lit(False)


def init_result_columns(df: DataFrame, rules=None) -> DataFrame:
    """Result columns with their "not computed" values."""
    empty = F.lit(None).cast("string")
    columns = {
        "clone_status": empty,
        "testfilecountlocal": F.lit(NOT_COUNTED).cast("long"),
        "last_commit_hash": empty,
    }
    columns |= {name: F.lit(0).cast("long") for name in rule_columns(rules)}
    return df.withColumns(columns)


def processable(df: DataFrame) -> DataFrame:
    """Rows whose repository can be fetched. Rows with nulls are not excluded."""
    flags = ("duplicate_flag", "unsupported_url_scheme", "incomplete_url_flag", "base_repo_url_flag")
    keep = F.coalesce(F.col("repourl"), F.lit("")) != ""
    for name in flags:
        keep = keep & ~_flag(name, df.columns)
    return df.filter(keep)


def with_repo_key(df: DataFrame) -> DataFrame:
    """B11 for processable rows only; other rows have no key."""
    flagged = F.lit(False)
    for name in (
        "duplicate_flag", "unsupported_url_scheme", "incomplete_url_flag", "base_repo_url_flag"
    ):
        flagged = flagged | _flag(name, df.columns)
    key = urls.repo_key(F.col("repodomain"), F.col("repourl"))
    return df.withColumn("repo_key", F.when(~flagged, key))


def key_collisions(df: DataFrame) -> DataFrame:
    """Keys shared by several URLs: these share one checked-out tree."""
    per_url = df.filter(F.col("repo_key").isNotNull()).groupBy("repo_key", "repourl").agg(
        F.count("*").alias("rows")
    )
    return (
        per_url.groupBy("repo_key")
        .agg(F.count("*").alias("urls"), F.sum("rows").alias("rows"))
        .filter(F.col("urls") > 1)
    )


def is_complete_row() -> Column:
    return (F.col("testfilecountlocal") != NOT_COUNTED) & F.col("last_commit_hash").isNotNull()


def completed_keys(results: DataFrame) -> DataFrame:
    """Keys with a finished result; partial aggregation removes repeats early."""
    return results.filter(is_complete_row()).select("repo_key").distinct()


def pending(df: DataFrame, results: DataFrame) -> DataFrame:
    """D3: processable rows whose repository key has no finished result."""
    done = completed_keys(results).withColumn("_done", F.lit(True))
    return lookup(df, done, "repo_key", spread="row_id").filter(F.col("_done").isNull()).drop(
        "_done"
    )


def match_tree(df: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows whose repository key has a checked-out tree (``repos``: unique ``repo_key``)."""
    present = repos.select("repo_key").distinct().withColumn("_present", F.lit(True))
    return lookup(df, present, "repo_key", spread="row_id").filter(F.col("_present")).drop(
        "_present"
    )


def write_back(df: DataFrame, results: DataFrame, rules=None) -> DataFrame:
    """Per-repository results added to every registry row with that key.

    Rows without a result keep the "not computed" values of B19.
    """
    found = [c for c in results.columns if c != "repo_key"]
    base = df.drop(*found)
    joined = lookup(base, results, "repo_key", spread="row_id")
    defaults = {"testfilecountlocal": NOT_COUNTED} | {name: 0 for name in rule_columns(rules)}
    return joined.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(defaults[c]).cast("long"))
            for c in found
            if c in defaults
        }
    )


def progress(df: DataFrame, column: str = "testfilecountlocal") -> DataFrame:
    """Total, complete and left rows."""
    done = F.col(column) != NOT_COUNTED
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("complete"),
        F.count_if(~done).alias("left_to_do"),
    )


# Explanation texts.
TEXT_DUPLICATE = "Row is marked as a duplicate of another entry."
TEXT_NULL = "Row contains null values."
TEXT_UNSUPPORTED = "Domain could not be extracted due to unsupported or malformed URL."
TEXT_INCOMPLETE = "URL is incomplete; missing %d parts (expects protocol, domain, and path)."
TEXT_BASE_FAILED = "Unable to extract base repository URL."
TEXT_CLONE_FAILED = "Repository clone failed."
TEXT_CLONE_UNKNOWN = "Clone status unknown."
TEXT_NOT_COUNTED = "Test files could not be counted."
TEXT_NO_HASH = "Last commit hash could not be retrieved."
TEXT_SEPARATOR = " | "
TEXT_NONE = "No issues detected."
# End of fixed values.


def add_explanations(df: DataFrame) -> DataFrame:
    """One text per row; columns that are absent count as not set."""

    def value(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    status = value("clone_status", "string")
    url_parts = F.size(F.split(urls.strip_trailing_slash(value("repourl", "string")), "/", -1))
    missing = F.lit(urls.EXPECTED_URL_PARTS) - url_parts
    reason = (
        F.when(_flag("duplicate_flag", df.columns), TEXT_DUPLICATE)
        .when(_flag("null_value_flag", df.columns), TEXT_NULL)
        .when(_flag("unsupported_url_scheme", df.columns), TEXT_UNSUPPORTED)
        .when(
            _flag("incomplete_url_flag", df.columns),
            F.when(missing > 0, F.format_string(TEXT_INCOMPLETE, missing)),
        )
        .when(_flag("base_repo_url_flag", df.columns), TEXT_BASE_FAILED)
        .when(status == "failed", TEXT_CLONE_FAILED)
        .when(status.isNull(), TEXT_CLONE_UNKNOWN)
    )
    cloned = status == "successful"
    counted = F.coalesce(value("testfilecountlocal", "long"), F.lit(NOT_COUNTED))
    no_count = F.when(cloned & (counted == NOT_COUNTED), TEXT_NOT_COUNTED)
    no_hash = F.when(cloned & value("last_commit_hash", "string").isNull(), TEXT_NO_HASH)
    text = F.concat_ws(TEXT_SEPARATOR, reason, no_count, no_hash)
    return df.withColumn("explanation", F.coalesce(F.nullif(text, F.lit("")), F.lit(TEXT_NONE)))
