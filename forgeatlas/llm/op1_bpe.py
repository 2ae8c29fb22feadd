"""BPE encoding and decoding of whole texts (contiguous rank array, see :mod:`.bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm import bpe
from forgeatlas.llm.common import pick, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encode_decode(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the ids of every whole text, packed as
    little-endian unsigned 32-bit integers, and the text decoded from these ids.

    Rows stay where they are; no row depends on another. A null text counts as empty (no
    ids, empty text); repeated rows and null keys come back as they are; an empty table
    gives an empty table; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                ids = [coder.encode(t) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, 256),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([coder.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
