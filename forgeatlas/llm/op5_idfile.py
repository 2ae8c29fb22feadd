"""Token-id files: documents in key order, ids compressed by :mod:`.idcoder`.

A file is a row with one binary value (a *segment*), so Spark's own writer commits it, a lost
task writes it again, and any store that Spark can use will do. Layout of a segment, all
numbers little-endian: ``FIDS``, version, number of documents, number of ids, length of the
id blocks (four unsigned 64-bit integers after the magic); number of ids of each document
(unsigned 64-bit); the id blocks. Beside it the row holds its place in the order
(``file_no, seg_no``), its number of ids, and the keys of its documents, so that offsets can
be found without reading a segment. A segment holds whole documents and about
``SEGMENT_IDS`` ids.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeatlas.llm import idcoder
from forgeatlas.llm.bpe import KEPT_WORDS, byte_letters, chunks
from forgeatlas.llm.common import pick, store, table
from forgeatlas.llm.op1_bpe import tokenizer_path
from forgeatlas.llm.words import word_starts
from forgeatlas.session import scratch_path

END_ID = 2
SEGMENT_IDS = 1 << 23
# Bytes of text whose words are cut and numbered together, about.
STRETCH_BYTES = 1 << 22
# Ids that one Arrow batch of documents read back holds, about.
BATCH_IDS = 1 << 20
MAGIC, VERSION = b"FIDS", 2
_HEAD = struct.Struct("<4sQQQQ")


class LibraryEncoder:
    """The tokenizers library, asked once for every different word.

    A byte-level tokenizer cuts a text into words and encodes every word on its own. The words
    of many texts are cut at once (:mod:`.words`) and numbered by Arrow; the library's model
    is called for those that were not met before (a bounded number of them is kept), and the
    ids of the texts are gathered by number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept = _Words(self.library.model)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of one text."""
        return b"".join(ids.tobytes() for _, ids in self.encode_many(pa.array([text], pa.string())))

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in order: numbers of ids per text, and all ids. Every
        text is followed by ``end_id``, if one is given."""
        data, offsets = _bytes_of(texts)
        end = np.array([] if end_id is None else [end_id], "<u4")
        alone = np.diff(offsets) > STRETCH_BYTES
        for token in self.special:
            alone |= self._with(token.encode(), data, offsets)
        at = 0
        while at < len(alone):
            if alone[at]:
                ids = np.concatenate([*self._alone(data[offsets[at] : offsets[at + 1]].tobytes().decode()), end])
                yield np.array([len(ids)], np.int64), ids
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH_BYTES, "right")) - 1)
            stop = min([stop, len(alone), *(at + np.flatnonzero(alone[at:stop])[:1]).tolist()])
            yield self._stretch(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], end)
            at = stop

    @staticmethod
    def _with(token: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold the string of a special token."""
        found = np.zeros(len(offsets) - 1, bool)
        raw, at = data.tobytes(), -1
        while (at := raw.find(token, at + 1)) >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(token) <= offsets[k + 1]:  # not across two texts
                found[k] = True
                at = int(offsets[k + 1]) - 1
        return found

    def _alone(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text with special tokens, or of a long one in stretches."""
        if any(token in text for token in self.special):
            yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            return
        for chunk in chunks(text):
            raw = np.frombuffer(chunk.encode(), np.uint8)
            yield self._stretch(raw, np.array([0, len(raw)]), np.zeros(0, "<u4"))[1]

    def _stretch(self, data: np.ndarray, offsets: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = word_starts(data, offsets)
        edges = np.append(starts, len(data))
        buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        number = words.indices.to_numpy()
        packed = self.kept.all(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        known = np.concatenate([np.frombuffer(b"".join(packed), "<u4"), end])
        # The end id is one more word, behind the words of each text.
        length = np.append(length, len(end))
        last = np.searchsorted(starts, offsets[1:])
        number = np.insert(number, last, len(packed))
        each = length.take(number)
        stops = np.cumsum(each)
        place = np.repeat((np.cumsum(length) - length).take(number) - (stops - each), each)
        place += np.arange(len(place))
        return np.diff(stops.take(last + np.arange(len(last))), prepend=0), known.take(place)


class _Words:
    """Packed ids of words by the library's model. Two generations are kept: when the younger
    one is full, it takes the place of the older one, so memory stays bounded and words that
    are still met stay."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def all(self, words: list[bytes]) -> list[bytes]:
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, words))
        for k in [k for k, value in enumerate(found) if value is None]:
            word = words[k]
            found[k] = value = self.old.get(word) or self._ask(word)
            if len(word) <= 64:
                self.young[word] = value
        return found

    def _ask(self, word: bytes) -> bytes:
        found = self.tokenize(word.decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in found]).tobytes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, and where each begins (null: empty); an error if they are no UTF-8."""
    texts.validate(full=True)
    texts = texts.fill_null("").cast(pa.large_binary())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, 8 * texts.offset) if where else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=2)
def load(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(counts: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents with the given numbers of ids."""
    blocks = idcoder.encode(ids)
    head = _HEAD.pack(MAGIC, VERSION, len(counts), len(ids), len(blocks))
    return head + np.array(counts, "<u8").tobytes() + blocks


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids per document, and all ids."""
    magic, version, documents, number, length = _HEAD.unpack_from(segment)
    if magic != MAGIC or version not in (1, VERSION):
        raise ValueError("not a segment of this format")
    at = _HEAD.size + 8 * documents
    counts = np.frombuffer(segment, "<u8", documents, _HEAD.size)
    decode = idcoder.decode if version == VERSION else idcoder.decode_first
    ids = decode(segment[at : at + length])
    if len(ids) != number or counts.sum() != number:
        raise ValueError("segment is incomplete")
    return counts, ids


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, add ``end_id`` and write the ids in ascending key order.

    A null text counts as empty (only the end id); null keys come first; rows with equal keys
    go by text; an empty table writes an empty set of files; other columns are not looked at.
    """
    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file_no, seg_no = load(tokenizer), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, counts, held, size, seg_no
            segment = pack(np.concatenate(counts), np.concatenate(held))
            own = pa.concat_arrays(keys)
            values = [
                pa.array([file_no], pa.int32()), pa.array([seg_no], pa.int32()), pa.array([size], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([segment], pa.binary()),
            ]
            keys, counts, held, size, seg_no = [], [], [], 0, seg_no + 1
            return pa.RecordBatch.from_arrays(values, names=["file_no", "seg_no", "n_ids", "keys", "segment"])

        for batch in batches:
            row = 0
            for many, ids in coder.encode_many(batch.column(1), end_id):
                while len(many):
                    stops = np.cumsum(many)
                    # Up to the text that fills the segment.
                    some = min(len(many), int(np.searchsorted(stops, SEGMENT_IDS - size)) + 1)
                    keys.append(batch.column(0).slice(row, some))
                    counts.append(many[:some])
                    held.append(ids[: stops[some - 1]])
                    size += int(stops[some - 1])
                    many, ids, row = many[some:], ids[stops[some - 1] :], row + some
                    if size >= SEGMENT_IDS:
                        yield flush()
        if keys:
            yield flush()

    schema = f"file_no int, seg_no int, n_ids long, keys array<{kind}>, segment binary"
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``ids`` are packed as
    little-endian unsigned 32-bit integers, ``start`` counts the ids of all documents before
    it."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = batch.column(2).slice(k, 1).flatten()
                counts, ids = unpack(batch.column(3)[k].as_py())
                stops = np.cumsum(counts.astype(np.int64))
                starts = stops - counts.astype(np.int64)
                at = 0
                while at < len(keys):
                    end = min(at + 512, max(at + 1, int(np.searchsorted(stops, starts[at] + BATCH_IDS, "right"))))
                    packed = ids[starts[at] : stops[end - 1]]
                    edges = (np.append(starts[at:end], stops[end - 1]) - starts[at]).astype(np.int32) * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[k].as_py()] * (end - at), pa.int32()),
                            pa.array([batch.column(1)[k].as_py()] * (end - at), pa.int32()),
                            keys.slice(at, end - at),
                            pa.array(starts[at:end]),
                            pa.array(stops[at:end] - starts[at:end]),
                            pa.Array.from_buffers(
                                pa.binary(), end - at, [None, pa.py_buffer(edges), pa.py_buffer(packed)]
                            ),
                        ],
                        names=["file_no", "seg_no", "doc_id", "inside", "n_tokens", "ids"],
                    )
                    at = end

    schema = f"file_no int, seg_no int, doc_id {kind}, inside long, n_tokens long, ids binary"
    read = files.select("file_no", "seg_no", "keys", "segment").mapInArrow(run, schema)
    # One row per segment, then one per file: the last window sees as many rows as files.
    sizes = files.select("file_no", "seg_no", "n_ids")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("file_no").orderBy("seg_no").rowsBetween(W.unboundedPreceding, -1)
    of_file = sizes.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select(
        "file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start")
    )
    offsets = sizes.join(of_file, "file_no").select(
        "file_no", "seg_no", (F.col("file_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("offset")
    )
    # Stored, so that Spark knows the size and does not shuffle the ids for some small rows.
    return read.join(store(offsets, "offsets"), ["file_no", "seg_no"]).select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )


def op5_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "idfile")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
