"""Quality classifier by supervised subword embeddings.

Features of a text are its words and its character n-grams, hashed into a table of learned
vectors. The vectors are averaged over the text and a linear layer with softmax gives the
class. Table and layer are trained by stochastic gradient descent in numpy, one document at
a time. Since the layer is linear, every vector is folded into one number after training
(its contribution to the difference of the two classes), and a score is the logistic of an
average of these numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.common import crc_bucket, pick, slices, table

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
WIDTH = 8
# Bound of the training sample: so many labelled documents per class at most. A document
# comes as at most BUCKETS pairs of bucket and count, however long it is.
SAMPLE_PER_CLASS = 800
EPOCHS = 12
RATE = 4.0
SEED = 11
ACCEPT = 0.7
_SPACE = (9, 10, 11, 12, 13, 32)
_MIX = np.uint32(2654435761)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.ones(64, np.uint32)
    for k in range(1, 64):
        out[k] = out[k - 1] * np.uint32(16777619)
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX) >> np.uint32(16)


def features(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, and the number of the text of each.

    Words are runs of solid characters. A word equal to the one before it has a feature of
    its own instead of its hash, so repetition is visible to an average of vectors."""
    framed = [f"\n{t}\n" for t in held]
    size = np.fromiter(map(len, framed), np.int64, len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(framed), dtype=np.int32), size)
    buckets, rows = [], []
    with np.errstate(over="ignore"):
        gram = points.copy()
        for n in range(2, max(GRAMS) + 1):
            gram = gram[:-1] * np.uint32(0x01000193) + points[n - 1 :]
            if n in GRAMS and len(gram):
                same = row[n - 1 :] == row[: len(gram)]
                buckets.append(_bucket(gram[same] + np.uint32(n)))
                rows.append(row[: len(gram)][same])
        solid = np.ones(len(points), bool)
        for c in _SPACE:
            solid &= points != c
        start = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
        if len(start):
            at = np.zeros(len(points), np.int64)
            at[start[0] :] = np.arange(start[0], len(points)) - np.repeat(start, np.diff(np.r_[start, len(points)]))
            letters = np.where(solid, points * _powers()[at & 63], np.uint32(0)).astype(np.uint32)
            word = np.add.reduceat(letters, start, dtype=np.uint32)
            owner = row[start]
            again = np.r_[False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])]
            buckets.append(np.where(again, np.uint32(0), _bucket(word ^ np.uint32(0x9E3779B9))))
            rows.append(owner)
    return np.concatenate(buckets), np.concatenate(rows)


def bags(texts: Iterable[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and counts of whole texts."""
    out: dict[int, np.ndarray] = {}
    for where, held in slices(texts):
        bucket, row = features(held)
        for k, doc in enumerate(where):
            out[doc] = out.get(doc, 0) + np.bincount(bucket[row == k], minlength=BUCKETS)
    return [(kept, counts[kept]) for counts in out.values() for kept in [np.flatnonzero(counts)]]


def train(sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Stochastic gradient descent over the sample; the contribution of every bucket, and the
    bias at the end."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer = np.zeros((WIDTH, 2))
    bias = np.zeros(2)
    bags_ = [(b, c / c.sum()) for b, c in sample]
    steps, step = EPOCHS * len(bags_), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags_)):
            bucket, share = bags_[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[bucket]
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[k]] -= 1
            pull = layer @ chance
            layer -= rate * np.outer(mean, chance)
            bias -= 0.01 * rate * chance
            # Each vector of the average moves along the gradient, by its share, scaled to
            # the number of features as if they were visited one by one.
            vectors[bucket] -= rate * share[:, None] * np.sqrt(len(bucket)) * pull
    return np.r_[vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]].astype(np.float32)


def score(texts: Iterable[str | None], count: int, weights: np.ndarray) -> np.ndarray:
    """Chance of class 1 for whole texts; 0.5 for a text without features."""
    total, number = np.zeros(count), np.zeros(count)
    for where, held in slices(texts):
        bucket, row = features(held)
        np.add.at(total, where, np.bincount(row, weights[bucket], len(held)))
        np.add.at(number, where, np.bincount(row, minlength=len(held)))
    some = number > 2
    logit = np.where(some, total / np.maximum(number, 1) + weights[BUCKETS], 0.0)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights from documents (``doc_id, text``) and labels (``doc_id, quality``); None if a
    class is missing. Several labels of a document: the smallest counts. Several texts of a
    key: the smallest is learned, so the sample stays bounded whatever rows repeat.

    At most ``SAMPLE_PER_CLASS`` documents per class are taken, by a hash of their key. Their
    bags of features are made on the executors; training is one pass over a bounded sample."""
    labels = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    chosen = None
    for value in (0, 1):
        part = labels.filter(F.col("quality") == value).orderBy("draw", "doc_id").limit(SAMPLE_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * SAMPLE_PER_CLASS rows of two numbers.
    taken = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min(F.col("quality").cast("int")).alias("quality")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, texts, quality = (batch.column(k).slice(at, 64) for k in range(3))
                made = bags(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        quality,
                        pa.array([b.astype("<u4").tobytes() for b, _ in made], pa.binary()),
                        pa.array([np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes() for _, c in made], pa.binary()),
                    ],
                    names=["doc_id", "quality", "bucket", "number"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = taken.mapInArrow(pack, f"doc_id {kind}, quality int, bucket binary, number binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bucket"]), bytes(r["number"])))
    rows = [r for r in rows if len(r["bucket"])]
    if len({r["quality"] for r in rows}) < 2:
        return None
    sample = [(np.frombuffer(bytes(r["bucket"]), "<u4"), np.frombuffer(bytes(r["number"]), "<u4")) for r in rows]
    return train(sample, np.array([r["quality"] for r in rows]))


def quality(text: Column, weights: np.ndarray | None) -> Column:
    """Score column; 0.5 where nothing was learned."""

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(score(texts.tolist(), len(texts), weights))

    return rate(text)


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``. Null and empty texts score 0.5; repeated
    rows and null keys come back as they are (a null key is never learned from); an empty
    table gives an empty table; other columns are not looked at."""
    rows = pick(docs, id_col, text_col)
    weights = learn(rows, labels)
    return rows.select("doc_id", quality(F.col("text"), weights).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = classify(table(spark, sf_dir, "documents"), labels.filter(crc_bucket(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return scored.select(
        "doc_id", held_out, "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
