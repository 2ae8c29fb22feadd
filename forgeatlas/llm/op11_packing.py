"""Packing by power-of-two decomposition.

The ids of a document (with an end id) are cut into pieces whose lengths are powers of two:
as many of the longest length as fit, then one piece for every binary digit of what is left,
longest first. Every piece is a sequence of its own. It is as long as its bucket, so nothing
is padded, no sequence holds ids of two documents, and a batch is drawn from one bucket.

No document depends on another one, so rows stay where they are: one pass, no shuffle. A
sequence is numbered by task, bucket and place in the bucket of this task; the numbers are
unique, and a task that runs again gives the same ones for the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm import token_ids
from forgeatlas.llm.common import pick, table
from forgeatlas.llm.op1_bpe import tokenizer_path

MAX_LENGTH = 2048
END_ID = 1
# Ids that one Arrow batch of pieces holds, about.
BATCH_IDS = 1 << 20
# Ids that one file of a bucket holds, about.
FILE_IDS = 1 << 26
_PLACE_BITS = 35


def decompose(totals: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with the given numbers of ids: ``(document number, start in the
    document, length)``, in order. ``longest`` is a power of two."""
    totals = np.asarray(totals, np.int64)
    top = longest.bit_length() - 1
    lengths = np.int64(1) << np.arange(top, -1, -1, dtype=np.int64)
    many = np.empty((len(totals), top + 1), np.int64)
    many[:, 0] = totals >> top
    many[:, 1:] = (totals[:, None] & lengths[None, 1:]) != 0
    length = np.repeat(np.tile(lengths, len(totals)), many.ravel())
    doc = np.repeat(np.arange(len(totals)), many.sum(axis=1))
    ends = np.cumsum(length)
    return doc, ends - length - (np.cumsum(totals) - totals)[doc], length


def _pieces(keys: pa.Array, ids: list[np.ndarray], places: np.ndarray, task: int, longest: int) -> Iterator[pa.RecordBatch]:
    totals = np.fromiter(map(len, ids), np.int64, len(ids))
    data = np.concatenate(ids).astype("<u4")
    doc, start, length = decompose(totals, longest)
    stop = np.cumsum(length)
    bucket = np.frexp(length.astype(np.float64))[1] - 1
    # The place of a piece among the pieces of its bucket, counted on over the whole task.
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=len(places))
    place = np.empty(len(bucket), np.int64)
    place[order] = np.arange(len(bucket)) - np.repeat(np.cumsum(count) - count, count)
    place += places[bucket]
    places += count
    if places.max() >> (_PLACE_BITS - 6):
        raise ValueError("too many sequences in one task")
    number = (np.int64(task) << _PLACE_BITS) | (bucket.astype(np.int64) << (_PLACE_BITS - 6)) | place
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(stop, stop[at] - length[at] + BATCH_IDS, "right")))
        cut = slice(at, end)
        first = int(stop[at] - length[at])
        edges = np.r_[0, stop[cut] - first].astype(np.int32) * 4
        held = pa.py_buffer(data[first : int(stop[end - 1])].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(doc[cut])),
                pa.array(start[cut]),
                pa.array(length[cut]),
                pa.array(totals[doc[cut]]),
                pa.array(number[cut]),
                pa.array(np.zeros(end - at, np.int64)),
                pa.array(bucket[cut].astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(edges.tobytes()), held]),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids"],
        )
        at = end


def pack(
    docs: DataFrame, tokenizer: str, *, max_length: int = MAX_LENGTH, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids``, a row for each
    piece of each whole text.

    ``start`` counts the ids of the document before the piece, ``length`` is two to the power
    ``bucket``, ``offset`` (the place in the sequence) is always 0, and ``ids`` are packed as
    little-endian unsigned 32-bit integers. A null or empty text is the end id alone. Repeated
    rows and null keys are packed like any other row, each on its own; an empty table gives an
    empty table; other columns are not looked at. A very long text is encoded in stretches and
    given back in several batches.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = token_ids.load(tokenizer), TaskContext.get().partitionId()
        places = np.zeros(max_length.bit_length(), np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held: list[np.ndarray] = []
            size = first = 0
            for k in range(batch.num_rows):
                held.append(np.r_[coder.encode(texts[k].as_py()), end])
                size += len(held[-1])
                if size >= BATCH_IDS:
                    yield from _pieces(keys.slice(first, len(held)), held, places, task, max_length)
                    held, size, first = [], 0, k + 1
            if held:
                yield from _pieces(keys.slice(first, len(held)), held, places, task, max_length)

    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"
    )
    return rows.mapInArrow(run, schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences with a folder per bucket, in files of about ``FILE_IDS`` ids.

    Buckets are of very different size (most ids lie in the longest), so a bucket is dealt to
    as many tasks as its ids need; the sizes are one row per bucket. ``packed`` is computed
    twice unless it is stored."""
    sizes = packed.groupBy("bucket").agg(F.sum("length").alias("ids")).collect()  # at most one row per bucket
    files = {r["bucket"]: max(1, -(-r["ids"] // FILE_IDS)) for r in sizes}
    parts = F.create_map(*(F.lit(x) for pair in files.items() for x in pair)) if files else None
    if parts is None:
        packed.write.partitionBy("bucket").parquet(path)
        return
    part = F.pmod(F.xxhash64("sequence_id"), parts[F.col("bucket")])
    dealt = packed.repartition(sum(files.values()), "bucket", part)
    dealt.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length; only the files of its bucket are opened."""
    return spark.read.parquet(path).filter(F.col("bucket") == length.bit_length() - 1)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
