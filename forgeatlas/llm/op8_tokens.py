"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Every token has a span of characters; it is joined with
the sections (spans of the same text, or fields that are joined to one text) and counted for
one of them. A token that crosses a boundary goes, by ``rule``, to the section of its first
character (``"start"``), of its last character (``"end"``), or to the one that holds most of
its characters (``"most"``; the earlier one if equal). Every token is counted exactly once:
sections are given by their starts and reach to the next start or the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm import bpe
from forgeatlas.llm.common import table
from forgeatlas.llm.op1_bpe import tokenizer_path

RULES = ("start", "end", "most")


def token_spans(text: str, packed: bytes, coder: bpe.ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of every token. A token of a part of a character's bytes
    spans that character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    size = byte_sizes(coder)[np.frombuffer(packed, "<u4")]
    stop = np.cumsum(size)
    return char[stop - size], char[stop - 1]


def byte_sizes(coder: bpe.ByteBpe) -> np.ndarray:
    if not hasattr(coder, "sizes"):
        coder.sizes = np.array([len(b) for b in coder.bytes_of], np.int64)
    return coder.sizes


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Number of tokens per section; ``starts`` is sorted and begins with 0."""
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "start":
        return np.bincount(a, minlength=len(starts))
    b = np.searchsorted(starts, last, "right") - 1
    if rule == "end":
        return np.bincount(b, minlength=len(starts))
    crossing = np.flatnonzero(a != b)
    for t in crossing.tolist():
        sections = np.arange(a[t], b[t] + 1)
        stops = np.minimum(np.r_[starts[sections[1:]], last[t] + 1], last[t] + 1)
        a[t] = sections[np.argmax(stops - np.maximum(starts[sections], first[t]))]
    return np.bincount(a, minlength=len(starts))


def section_tokens(
    docs: DataFrame,
    tokenizer: str,
    *,
    rule: str = "start",
    id_col: str = "doc_id",
    text_col: str = "text",
    starts_col: str | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, section_starts, section_tokens`` of every row.

    The sections of a row start at the positions of the array ``starts_col`` (sorted and
    made distinct; position 0 is added; positions outside the text are ignored), by default
    at every line. A null or empty text has one section with no token; a null array is
    empty; repeated rows and null keys come back as they are; an empty table gives an empty
    table; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *([F.col(f"`{starts_col}`").cast("array<bigint>").alias("starts")] if starts_col else []),
    )

    def sections(text: str, given: list | None) -> np.ndarray:
        if starts_col is None:
            cuts = np.cumsum([0, *(len(line) + 1 for line in text.split("\n"))])
        else:
            cuts = np.unique(np.array([0, *(x for x in given or [] if x is not None)], np.int64))
        return cuts[(cuts == 0) | ((cuts > 0) & (cuts < len(text)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                totals, all_starts, all_counts = [], [], []
                given = part.column(2).to_pylist() if starts_col else [None] * part.num_rows
                for text, own in zip(part.column(1).to_pylist(), given, strict=True):
                    text = text or ""
                    packed = coder.encode(text)
                    starts = sections(text, own)
                    counts = np.zeros(len(starts), np.int64)
                    if packed:
                        counts = attribute(*token_spans(text, packed, coder), starts, rule)
                    totals.append(len(packed) // 4)
                    all_starts.append(starts.astype(np.int64))
                    all_counts.append(counts.astype(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()), pa.array(all_starts, longs), pa.array(all_counts, longs)],
                    names=["doc_id", "n_tokens", "section_starts", "section_tokens"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, section_starts array<bigint>, section_tokens array<bigint>"
    )


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
