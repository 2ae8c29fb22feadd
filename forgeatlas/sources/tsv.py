"""Scans of the tab-separated registry (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.functions.text import strip
from forgeatlas.operators.order import fill_forward
from forgeatlas.schemas import REGISTRY_COLUMNS

_KEYS = REGISTRY_COLUMNS[:2]
# A quoted field of a table; separators inside it do not count.
_QUOTED = r'(?<=^|\t)"(?:[^"\\]|\\.)*"(?=\t|$)'


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: ``(file, split start, position)`` is the file order,
    also when a large file is read as many splits. A split is one block of rows."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.split(strip(F.col("value")), "\t", -1).alias("_fields"),
    )


def _place(lines: DataFrame) -> DataFrame:
    """Full rows keep all three fields; a single field is the URL of a continuation row."""
    width = F.size("_fields")
    full, single = width == 3, width == 1
    message = F.concat(F.lit("Unexpected number of columns: "), width.cast("string"))
    url = (
        F.when(full, F.get("_fields", F.lit(2)))
        .when(single, F.get("_fields", F.lit(0)))
        .otherwise(F.raise_error(message))
    )
    placed = {c: F.when(full, F.get("_fields", F.lit(i))) for i, c in enumerate(_KEYS)}
    return lines.withColumns({**placed, REGISTRY_COLUMNS[2]: url})


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """A3: continuation rows have nulls in the first two columns; not filled yet."""
    return _place(scan_lines(spark, path)).select("_file", "_start", "_at", *REGISTRY_COLUMNS)


def _fill(rows: DataFrame, continuous: bool, units: list[list[str]]) -> DataFrame:
    return fill_forward(
        rows,
        units,
        group=["_file"],
        block="_start",
        order="_at",
        position="row_id",
        chain="fill" if continuous else "rows",
    ).select("row_id", *REGISTRY_COLUMNS)


def read_registry(spark: SparkSession, path: str, *, continuous: bool = False) -> DataFrame:
    """A1: filled registry with a dense ``row_id`` in file order.

    For one file ``row_id`` is the line number. With several files ``row_id``
    goes on from one file to the next in path order; each file is filled on its
    own, unless ``continuous`` says that they are the parts of one table.
    """
    return _fill(raw_rows(spark, path), continuous, [_KEYS])


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that :func:`read_registry` stops at, with their number of fields."""
    width = F.size("_fields")
    return scan_lines(spark, path).filter(~width.isin(1, 3)).select(
        F.col("_file").alias("file"),
        width.alias("fields"),
        F.concat_ws("\t", "_fields").alias("line"),
    )


def read_rectangular(
    spark: SparkSession, path: str, columns: int = 3, *, continuous: bool = False
) -> DataFrame:
    """A2: a table of 1 or 3 columns without header; the first two are filled, each on its own.

    Short rows end in nulls, blank lines are skipped, a row with more fields is
    an error. The CSV reader is not used because it also drops rows of tabs only.
    """
    if columns not in (1, 3):
        raise ValueError("Unexpected number of columns in the file.")
    names = REGISTRY_COLUMNS if columns == 3 else REGISTRY_COLUMNS[2:]
    schema = ", ".join(f"{c} string" for c in names)
    parsed = (
        spark.read.text(path)
        .filter(F.col("value") != "")
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
            F.from_csv("value", schema, {"sep": "\t"}).alias("_row"),
            F.size(F.split(F.regexp_replace("value", _QUOTED, ""), "\t")).alias("_width"),
        )
    )
    message = F.lit("Unexpected number of columns in the file.")
    url = F.when(F.col("_width") > columns, F.raise_error(message)).otherwise(
        F.col("_row")[REGISTRY_COLUMNS[2]]
    )
    missing = F.lit(None).cast("string")
    keys = {c: F.col("_row")[c] if columns == 3 else missing for c in _KEYS}
    return _fill(
        parsed.withColumns({**keys, REGISTRY_COLUMNS[2]: url}), continuous, [[k] for k in _KEYS]
    )
