"""Alignment of two tokenizers over whole texts.

Both tokenizers cut the same bytes, so a tokenization is a sorted list of end offsets. The
shorter list drives: each of its ends is found in the longer one by doubling steps from a
known place, then halving (*galloping*; all ends of a chunk climb in step). Ends that both
lists have cut the tokens into groups. The ranks of a token's own start and end in the other
list are the range of tokens that it overlaps, so links are counted, and listed, from rank
differences alone.

How often an id pair is linked in the corpus is needed for every link, and the table of pairs
grows with the corpus. So texts are worked on in chunks of bounded size: a chunk asks for each
of its different pairs once, the pairs are summed up over all chunks, and the answers meet
their chunk again. Texts are tokenized once, nothing is broadcast but one row per id of the
second tokenizer, and no task holds more than a chunk. A text that is longer than a chunk is
cut where neither tokenizer can have a token across, and its parts are added up at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm import bpe, token_ids
from forgeatlas.llm.common import pick, store, table
from forgeatlas.llm.op1_bpe import tokenizer_path

PIECES = "piece_bpe_32k.model"
# A chunk holds about so many tokens of both kinds, and at most so many documents.
CHUNK_TOKENS, CHUNK_DOCS = 1 << 22, 1 << 16
# Every so many ends one is searched from the start of the list, the others from there.
STRIDE = 64
# Tokens whose decimal ids are joined at once.
JOIN_TOKENS = 1 << 18
_B_BITS = 32


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


# Galloping ---------------------------------------------------------------------


def _climb(ends: np.ndarray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place at or after ``start`` whose end is not below the value."""
    low, last = start.copy(), len(ends) - 1
    high = np.minimum(low, last)
    going, step = np.flatnonzero(ends[high] < values), 1
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(low[going] + step, last)
        going = going[ends[high[going]] < values[going]]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = ends[middle] < values[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def gallop(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of ``shorter`` the rank of the first end of ``longer`` that is not below
    it, and whether the two are equal. Both lists are sorted and have the same last end."""
    if not len(shorter):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    anchors = _climb(longer, shorter[::STRIDE], np.zeros(-(-len(shorter) // STRIDE), np.int64))
    rank = _climb(longer, shorter, np.repeat(anchors, STRIDE)[: len(shorter)])
    return rank, longer[rank] == shorter


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, a_closes, b_closes)``: token numbers of every overlapping pair, in order, and
    which tokens of each list end a group."""
    swap = len(ends_a) > len(ends_b)
    shorter, longer = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank, common = gallop(shorter, longer)
    closes = np.zeros(len(longer), bool)
    closes[rank[common]] = True
    # A token's first partner follows the last one of its predecessor, or is that one if it reaches over.
    first = np.r_[0, rank[:-1] + common[:-1]].astype(np.int64) if len(rank) else rank
    many = rank - first + 1
    own = np.repeat(np.arange(len(shorter)), many)
    other = np.arange(len(own)) + np.repeat(first - (np.cumsum(many) - many), many)
    return (other, own, closes, common) if swap else (own, other, common, closes)


# Tokenizing --------------------------------------------------------------------


class Pair:
    """Both tokenizers of a worker process, with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = token_ids.load(path_a)
        self.size_a = np.fromiter(map(len, self.a.words.bytes_of), np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(k) else name.replace("▁", " ").encode()
            for k, name in enumerate(names)
        ]
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64)
        # Where no entry has a space behind another character, no token reaches over a single space.
        self.cuts = not any(" " in name.decode("utf-8", "replace").lstrip(" ") for name in self.bytes_b)
        many = max(len(self.size_a), len(self.size_b))
        self.many = many
        self.decimal = [f"{k}{mark}" for mark in ",|;" for k in range(many)]

    def encode(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a whole text by both, in parts that end in common; none if the bytes of one
        of them are not a space and the text."""
        parts = []
        for part in bpe.chunks(text) if self.cuts and text else [text] if text else []:
            # The first part gets a space in front, every other one begins with its own.
            body = part[1:] if parts else part
            a = self.a.encode(" " + body, special=False)
            b = np.array(self.b.encode(body, num_threads=1), np.int64)
            wanted = (" " + body).encode()
            joined = b"".join(map(self.bytes_b.__getitem__, b.tolist()))
            if joined != wanted or self.size_a[a].sum() != len(wanted):
                return []
            parts.append((a.astype(np.int64), b))
        return parts

    def written(self, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> np.ndarray:
        """Codes (places in ``decimal``) of the groups in order: first the ids of A, then of B."""
        before_a, before_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        edge_a = np.r_[np.flatnonzero(closes_a) + 1, len(a)]
        edge_b = np.r_[0, np.flatnonzero(closes_b) + 1]
        codes = np.empty(len(a) + len(b), np.int32)
        codes[np.arange(len(a)) + edge_b[before_a]] = a + self.many * closes_a
        codes[np.arange(len(b)) + edge_a[before_b]] = b + 2 * self.many * closes_b
        return codes


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


# Chunks ------------------------------------------------------------------------

_DOC_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_CHUNK_DDL = (
    "chunk long, rows array<long>, ended array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, shas array<string>, pairs array<long>, times array<long>, fan binary, doc binary, n binary"
)


class _Chunk:
    """Texts of one chunk; the digest of a text that is not finished goes on in the next."""

    def __init__(self, pair: Pair):
        self.pair, self.open = pair, None
        self.clear()

    def clear(self) -> None:
        self.parts_a, self.parts_b, self.of = [], [], []
        self.keys, self.rows, self.ended, self.shas, self.size = [], [], [], [], 0

    def add(self, key, row: int, parts: list[tuple[np.ndarray, np.ndarray]], limit: int) -> Iterator[None]:
        """Takes a document; yields where the chunk is full and has to be written."""
        self._begin(key, row)
        for k, (a, b) in enumerate(parts):
            if k and self.size >= limit:
                yield
                self._begin(key, row)
            self.parts_a.append(a)
            self.parts_b.append(b)
            self.of.append(len(self.keys) - 1)
            self.size += len(a) + len(b)
        self.ended[-1] = True
        if self.size >= limit or len(self.keys) >= CHUNK_DOCS:
            yield

    def _begin(self, key, row: int) -> None:
        self.keys.append(key)
        self.rows.append(row)
        self.ended.append(False)

    def _digests(self, codes: np.ndarray, edges: np.ndarray) -> list[str | None]:
        """Hexadecimal digests of the documents that end here; '' without tokens."""
        out, decimal = [], self.pair.decimal
        for k, ended in enumerate(self.ended):
            first, stop = int(edges[k]), int(edges[k + 1])
            state = self.open
            self.open = None
            for at in range(first, stop, JOIN_TOKENS):
                text = "".join(map(decimal.__getitem__, codes[at : min(stop, at + JOIN_TOKENS)].tolist()))
                # The mark behind a group is written when another group follows.
                if state is None:
                    state, late = hashlib.sha256(), ""
                else:
                    state, late = state
                state.update((late + text[:-1]).encode())
                state = (state, text[-1])
            if not ended:
                self.open = state
            out.append(None if not ended else state[0].hexdigest() if state else "")
        return out

    def record(self, number: int, key_type: pa.DataType) -> pa.RecordBatch:
        docs = len(self.keys)
        none = [np.zeros(0, np.int64)]
        a, b = (np.concatenate(parts or none) for parts in (self.parts_a, self.parts_b))
        ends_a, ends_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        at_a, at_b, closes_a, closes_b = overlaps(ends_a, ends_b)
        of = np.array(self.of, np.int64)
        doc_a, doc_b = (
            np.repeat(of, np.fromiter(map(len, parts), np.int64, len(parts))) for parts in (self.parts_a, self.parts_b)
        )
        counts = [
            np.bincount(x, minlength=docs).astype(np.int64)
            for x in (doc_a, doc_b, doc_a[closes_a], doc_a[at_a])
        ]
        codes = self.pair.written(a, b, closes_a, closes_b)
        shas = self._digests(codes, np.r_[0, np.cumsum(counts[0] + counts[1])])
        del codes, ends_a, ends_b, closes_a, closes_b
        # Sorted by pair; documents stay in order within a pair.
        pair = (a[at_a] << _B_BITS) | b[at_b]
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc_a[at_a[order]]
        del order, at_a, at_b
        new_pair = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
        new_entry = new_pair | np.r_[True, doc[1:] != doc[:-1]] if len(pair) else new_pair
        entry = np.flatnonzero(new_entry)
        n = np.diff(np.r_[entry, len(pair)])
        first = np.flatnonzero(new_pair)
        # One byte holds a count; a larger one is spread over several entries.
        rep = -(-n // 255)
        spread = np.full(int(rep.sum()), 255, np.uint8)
        spread[np.cumsum(rep) - 1] = n - 255 * (rep - 1)
        starts = np.flatnonzero(new_pair[entry])
        fan = np.add.reduceat(rep, starts) if len(starts) else rep
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t))
        fields = [
            ("chunk", pa.array([number], pa.int64())), ("keys", lists(self.keys, key_type)),
            ("rows", lists(self.rows, pa.int64())), ("ended", lists(self.ended, pa.bool_())),
            *((name, lists(c, pa.int64())) for name, c in zip(_DOC_COUNTS, counts, strict=True)),
            ("shas", lists(shas, pa.string())), ("pairs", lists(pair[first], pa.int64())),
            ("times", lists(np.diff(np.r_[first, len(pair)]), pa.int64())),
            ("fan", pa.array([fan.astype("<u4").tobytes()], pa.binary())),
            ("doc", pa.array([np.repeat(doc[entry], rep).astype("<u2").tobytes()], pa.binary())),
            ("n", pa.array([spread.tobytes()], pa.binary())),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays([f[1] for f in fields], names=[f[0] for f in fields])


def _chunks(rows: DataFrame, path_a: str, path_b: str, limit: int) -> DataFrame:
    """One row per chunk: its documents, its different pairs, and for each pair the documents
    that have it."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        chunk, task = _Chunk(pair), TaskContext.get().partitionId() << 32
        made = seen = 0
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for _ in chunk.add(key.as_py(), task | seen, pair.encode(text.as_py()), limit):
                    yield chunk.record(task | made, key_type)
                    made += 1
                seen += 1
        if chunk.keys:
            yield chunk.record(task | made, key_type)

    return rows.mapInArrow(run, _CHUNK_DDL.replace("chunk long,", f"chunk long, keys array<{kind}>,", 1))


def align(
    docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of
    every row. Pairs: ``a_id, b_id, total, best``, how many links of all documents hold the two
    ids, and whether no other A id is linked more often with that B id. A text that is null,
    empty, or not given back byte for byte by both tokenizers has no tokens: zeros, and an
    empty digest. Repeated rows and null keys count on their own; ties are all best; an empty
    table gives empty tables; other columns are not looked at. A text of any length is aligned
    whole.
    """
    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = store(_chunks(rows, path_a, path_b, chunk_tokens), "aligned-chunks")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        F.col("chunk").alias("asker"), F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    totals = store(asked.groupBy("pair").agg(F.sum("times").alias("total")), "pair-totals")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    # At most one row per entry of B's vocabulary.
    most = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    scored = totals.withColumn("b", b_id).join(F.broadcast(most), "b").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best")
    )
    answers = asked.select("asker", "pair").join(scored, "pair")

    def answer(found: pa.Table, chunk: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(found["pair"]))
        total, best = np.asarray(found["total"])[order], np.asarray(found["best"])[order].astype(bool)
        held = {c: chunk[c][0] for c in chunk.column_names}
        fan, doc, n = (np.frombuffer(held[c].as_py(), t) for c, t in (("fan", "<u4"), ("doc", "<u2"), ("n", np.uint8)))
        if len(fan) != len(total):
            raise ValueError("a chunk did not get an answer for each of its pairs")
        keys, times = held["keys"].values, n.astype(np.int64)
        sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc, times * np.repeat(best, fan))
        np.add.at(sums[1], doc, times * np.repeat(total, fan))
        columns = [held["rows"].values, held["ended"].values, keys, *(held[c].values for c in _DOC_COUNTS)]
        names = ["row", "ended", "doc_id", *_DOC_COUNTS, "n_best", "count_sum", "groups_sha256"]
        return pa.table([*columns, *map(pa.array, sums), held["shas"].values], names=names)

    counts = [*_DOC_COUNTS, "n_best", "count_sum"]
    schema = f"row long, ended boolean, doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string"
    held = ["chunk", "keys", "rows", "ended", *_DOC_COUNTS, "shas", "fan", "doc", "n"]
    parts = answers.groupBy("asker").cogroup(chunks.select(held).groupBy("chunk")).applyInArrow(answer, schema)
    # Only a text that is cut has several rows; the digest stands in its last.
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in counts),
        F.max("groups_sha256").alias("groups_sha256"),
    )
    pairs = scored.select(F.shiftright("pair", _B_BITS).alias("a_id"), b_id.alias("b_id"), "total", "best")
    return whole.select("doc_id", *counts, "groups_sha256"), pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())[0]
