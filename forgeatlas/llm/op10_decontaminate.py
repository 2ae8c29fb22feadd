"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is reduced to single spaces. An
item of n characters may occur with k = n // ``CHARS_PER_ERROR`` edits. It is cut into k + 1
pieces: an occurrence with k edits leaves one piece untouched, so searching all pieces (one
automaton for all items) finds every occurrence. Each hit gives a place where the item would
begin; the text around it is verified with the bit-parallel edit distance of Myers.

An item of fewer than ``MIN_CHARS`` characters has no edits to spend; it is found where it
stands as whole words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forgeatlas.llm.common import fresh, pick, store, table

CHARS_PER_ERROR = 20
# A shorter item allows no edit and counts only between word borders.
MIN_CHARS = 20
# A set of items is searched in blocks of at most so many items and so many characters,
# which bounds what is sent to every task.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 2 << 20
# Blocks that a worker process keeps built; a plan asks for no more than that.
KEPT_BLOCKS = 4
# Texts are searched in stretches of so many characters, which overlap by the longest match.
STRETCH = 1 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    return length // CHARS_PER_ERROR


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their offsets."""
    edges = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Bit masks of one item for Myers' algorithm."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for k, char in enumerate(item):
            self.masks[char] = self.masks.get(char, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """Smallest edit distance between the item and a substring of ``text``, and the first
        end at which it is reached."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best, end = score, 0
        get = self.masks.get
        for at, char in enumerate(text):
            equal = get(char, 0)
            vertical = equal | minus
            diagonal = ((((equal & plus) + plus) ^ plus) | equal) & full
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical
            if score < best:
                best, end = score, at + 1
        return best, end


def _alone(text: str, start: int, stop: int) -> bool:
    """Whether no word goes on before or behind."""
    joined = (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (
        stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum()
    )
    return not joined


@dataclass
class Items:
    """Searchable form of a block of items; built once per task."""

    ids: list
    texts: list[str]

    def __post_init__(self):
        self.patterns = [Pattern(t) for t in self.texts]
        self.budgets = [budget(len(t)) for t in self.texts]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            for offset, piece in cut(text, self.budgets[k]):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, of in places.items():
            self.automaton.add_word(piece, (len(piece), of))
        if places:
            self.automaton.make_automaton()
        self.reach = 2 * max(map(len, self.texts), default=0)
        self.empty = not places

    def search(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Item number to (distance, end in the normalised text) of its best occurrence."""
        found: dict[int, tuple[int, int]] = {}
        text = normalise(text)
        if self.empty:
            return found
        for at in range(0, max(len(text), 1), STRETCH):
            part = text[max(0, at - self.reach) : at + STRETCH]
            shift = max(0, at - self.reach)
            tried = set()
            for end, (size, of) in self.automaton.iter(part):
                for k, offset in of:
                    if k in found and found[k][0] == 0:
                        continue
                    errors = self.budgets[k]
                    if not errors and not _alone(part, end + 1 - size, end + 1):
                        continue
                    # Hits of one occurrence begin within ``errors`` of each other.
                    start = end + 1 - size - offset
                    cell = (k, start // (errors + 1))
                    if cell in tried:
                        continue
                    tried.add(cell)
                    low = max(0, cell[1] * (errors + 1) - errors)
                    window = part[low : (cell[1] + 1) * (errors + 1) + self.patterns[k].size + errors]
                    distance, stop = self.patterns[k].best(window)
                    if distance <= errors and (k not in found or distance < found[k][0]):
                        found[k] = (distance, shift + low + stop)
        return found


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Blocks of normalised items, read in order. Items without a character are left out;
    repeated items are all kept."""
    ids, texts, size = [], [], 0
    rows = pick(items, id_col, text_col).orderBy("doc_id", "text")
    for row in rows.toLocalIterator():
        text = normalise(row["text"])
        if not text:
            continue
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(text) > BLOCK_CHARS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["doc_id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


_BUILT: dict[str, Items] = {}


class Shared:
    """A broadcast block of items; its searchable form is built once per worker process."""

    def __init__(self, spark: SparkSession, block: tuple[list, list[str]]):
        self.key = uuid.uuid4().hex
        self.block = spark.sparkContext.broadcast(block)

    def items(self) -> Items:
        if self.key not in _BUILT:
            while len(_BUILT) >= KEPT_BLOCKS:
                del _BUILT[next(iter(_BUILT))]
            _BUILT[self.key] = Items(*self.block.value)
        return _BUILT[self.key]


def matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, distance, stop``: for every row of ``docs`` and every item that
    occurs in it within its budget the smallest distance, and where that occurrence ends in
    the normalised text.

    Null and empty texts and items match nothing; repeated rows and items match on their
    own; null keys are given back; empty tables give an empty table; other columns are not
    looked at. Texts are searched whole, once per block of items, and are not shuffled.
    """
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col)
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id_col].dataType)

    def searcher(shared: Shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.items()
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for at in range(0, batch.num_rows, 256):
                    keys, texts = (batch.column(k).slice(at, 256).to_pylist() for k in range(2))
                    for key, text in zip(keys, texts, strict=True):
                        for k, (distance, stop) in known.search(text).items():
                            for column, value in zip(out, (key, known.ids[k], distance, stop), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], batch.column(0).type),
                        pa.array(out[1], item_type),
                        pa.array(out[2], pa.int32()),
                        pa.array(out[3], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "distance", "stop"],
                )

        return run

    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, stop long"
    result = spark.createDataFrame([], schema)
    for block in blocks(items, item_id_col, item_text_col):
        result = result.unionByName(rows.mapInArrow(searcher(Shared(spark, block)), schema))
    return result


def contaminated(shared: list[Shared], text: Column) -> Column:
    """Whether a text contains an item of some blocks; see :func:`matches`."""

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        known = [block.items() for block in shared]
        return pd.Series([any(items.search(t) for items in known) for t in texts], dtype=bool)

    return test(text)


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Rows with a null
    text stay. Beyond ``KEPT_BLOCKS`` blocks of items the rows left are stored before the next
    blocks are searched, so that every block is built once per worker."""
    name = fresh(docs, "_leak")
    shared = [Shared(docs.sparkSession, block) for block in blocks(items, "item_id", "text")]
    for at in range(0, len(shared), KEPT_BLOCKS):
        if at:
            docs = store(docs, "clean-so-far")
        flag = contaminated(shared[at : at + KEPT_BLOCKS], F.col(f"`{text_col}`"))
        docs = docs.withColumn(name, flag).filter(~F.col(name)).drop(name)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
