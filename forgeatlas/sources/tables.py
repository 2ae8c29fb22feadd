"""Stored tables: CSV and parquet snapshots, the language table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forgeatlas.operators.languages import language_rows
from forgeatlas.schemas import GUESSED_LANGUAGES


def read_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, *, multi_line: bool = False
) -> DataFrame:
    """A4/A5: CSV with header. A declared schema saves the extra pass of inference; a
    missing path raises, a table without rows keeps the declared schema. Files whose
    fields hold line breaks need ``multi_line`` and cannot be split."""
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces the stored table."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored parquet table; a table that does not exist yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_languages(labelled: DataFrame, path: str, *, now=None, hostname: str | None = None,
                     jdbc: dict | None = None) -> None:
    """All rows in one bulk append; ids continue after the highest one stored.

    ``jdbc`` holds the options of a database table to append to instead.
    """
    spark = labelled.sparkSession
    if jdbc:
        rows = language_rows(labelled, now=now, hostname=hostname).drop("id")
        rows.write.format("jdbc").options(**jdbc).mode("append").save()
        return
    stored = read_table(spark, path, GUESSED_LANGUAGES)
    first = stored.agg(F.coalesce(F.max("id") + 1, F.lit(1))).scalar()
    language_rows(labelled, now=now, hostname=hostname, first_id=first).write.mode(
        "append"
    ).parquet(path)


def processed_paths(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of the language table; only that column is read."""
    return read_table(spark, path, GUESSED_LANGUAGES).select("file_path").distinct()
