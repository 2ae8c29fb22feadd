"""Shared steps of the operators: picking columns, stored tables, bounded Python batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.session import scratch_path

# Longest stretch of text that one vectorised step holds, in code points.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only key and text, under names of our own: other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: what is behind is not computed again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def slices(
    texts: Iterable[str | None], limit: int = SLICE_CHARS, most: int | None = None
) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (document number, text) with about ``limit`` code points in all, and at most
    ``most`` texts. A longer text comes in several pieces; null counts as empty."""
    where: list[int] = []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), limit):
            piece = text[at : at + limit]
            if held and (size + len(piece) > limit or len(held) == most):
                yield where, held
                where, held, size = [], [], 0
            where.append(k)
            held.append(piece)
            size += len(piece)
    if held:
        yield where, held
