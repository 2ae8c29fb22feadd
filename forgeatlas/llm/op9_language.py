"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from the vectors of its
letters, shifted by two, one and no places; the trigrams of a text are bundled into its
vector; the vectors of the learned texts of a language are bundled into its prototype. A
text gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.common import crc_bucket, pick, slices, store, table

DIMENSIONS = 1024
LETTERS = 64
SEED = 7
# Bound of the learned sample: so many different texts per language are expected.
SAMPLE_PER_LANGUAGE = 1500
# Languages that a text is compared with at once.
LANGUAGES_AT_ONCE = 1024
UNKNOWN = "und"
# Texts whose trigram counts are held at once, a row of a matrix each.
TEXTS_AT_ONCE = 256
# A text of JUDGED_LETTERS or more is like no learned language if its best cosine is below
# MIN_SCORE, the noise of 1024 random signs. Shorter texts are never judged by their score.
MIN_SCORE, JUDGED_LETTERS = 0.05, 60


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter, 1 to 26 for a to z, and one of the
    codes from 27 on for other letters."""
    codes = np.zeros(0x110000, np.uint8)
    codes[97:123] = np.arange(1, 27)
    others = np.array([c for c in range(128, 0x110000) if chr(c).isalpha()], np.uint64)
    codes[others] = 27 + (others * np.uint64(2654435761) >> np.uint64(9)) % np.uint64(LETTERS - 27)
    return codes


@lru_cache(maxsize=1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signs = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIMENSIONS)).astype(np.int8) * 2 - 1
    return np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs


def text_vectors(texts: Iterable[str | None], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors of ``count`` whole texts, and their numbers of letters."""
    out = np.zeros((count, DIMENSIONS), np.float32)
    letters = np.zeros(count, np.int64)
    first, second, third = letter_vectors()
    for where, held in slices(texts, most=TEXTS_AT_ONCE):
        framed = [f"\n{t.lower()}\n" for t in held]
        size = np.fromiter(map(len, framed), np.int64, len(framed))
        points = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4")
        code = letter_codes()[points]
        row = np.repeat(np.arange(len(framed)), size)
        # Runs without a letter shrink to one place, but never over the end of a text.
        keep = np.r_[True, (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])]
        code, row = code[keep].astype(np.int32), row[keep]
        np.add.at(letters, where, np.bincount(row, code != 0, len(framed)).astype(np.int64))
        same = row[2:] == row[:-2]
        gram = ((code[:-2] << 12) | (code[1:-1] << 6) | code[2:])[same]
        row = row[2:][same]
        here = np.zeros(LETTERS**3, bool)
        here[gram] = True
        grams = np.flatnonzero(here)
        place = np.zeros(LETTERS**3, np.int32)
        place[grams] = np.arange(len(grams))
        # Trigram vectors are made for a stretch of the grams at a time.
        rows, place = row, place[gram]
        counts = np.bincount(rows * len(grams) + place, minlength=len(framed) * len(grams)) if len(grams) else np.zeros(0)
        counts = counts.reshape(len(framed), len(grams)).astype(np.float32)
        total = np.zeros((len(framed), DIMENSIONS), np.float32)
        for at in range(0, len(grams), 8192):
            g = grams[at : at + 8192]
            bound = first[g >> 12] * second[(g >> 6) & 63] * third[g & 63]
            total += counts[:, at : at + 8192] @ bound.astype(np.float32)
        np.add.at(out, where, total)
    return out, letters


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes (one unit vector per language) from rows ``text, lang``.

    About ``SAMPLE_PER_LANGUAGE`` different texts of each language are taken by a hash of the
    text; smaller languages are taken whole. Copies count once, so a text that fills a third
    of a language neither shapes its prototype nor fills a task. The vectors are bundled on
    the executors; a vector per language and task comes to the driver."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    counts = store(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "languages")
    steps = 1 << 20
    share = 1 + F.lit(steps * SAMPLE_PER_LANGUAGE) / F.greatest("texts", F.lit(1))
    taken = rows.join(counts, "lang").filter(F.pmod(F.col("h"), F.lit(steps)) < F.floor(F.least(F.lit(steps), share)))
    sample = taken.dropDuplicates(["h", "lang"]).repartition(16, "h")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts, langs = (batch.column(k).slice(at, 512).to_pylist() for k in range(2))
                for lang, vector in zip(langs, _unit(text_vectors(texts, len(texts))[0]), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["lang", "bundle"],
            )

    total: dict[str, np.ndarray] = {}
    for part in sample.select("text", "lang").mapInArrow(bundle, "lang string, bundle binary").collect():
        total[part["lang"]] = total.get(part["lang"], 0) + np.frombuffer(bytes(part["bundle"]), np.float64)
    if not total:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    names = sorted(total)
    return names, _unit(np.stack([total[n] for n in names])).astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)


def language(text: Column, names: list[str], prototypes: np.ndarray) -> Column:
    """``struct<lang_pred, score, letters>`` of whole texts; ``und`` with score 0 if the text is
    null or has no letter (or nothing was learned). Equal cosines: first name in order."""

    @F.pandas_udf("lang_pred string, score double, letters long")
    def predict(texts: pd.Series) -> pd.DataFrame:
        vectors, letters = text_vectors(texts.tolist(), len(texts))
        found = np.full(len(texts), UNKNOWN, object)
        score = np.zeros(len(texts))
        known = np.flatnonzero(letters)
        if len(names) and len(known):
            unit = _unit(vectors[known])
            best, high = np.zeros(len(known), np.int64), np.full(len(known), -np.inf)
            for at in range(0, len(names), LANGUAGES_AT_ONCE):
                cosine = unit @ prototypes[at : at + LANGUAGES_AT_ONCE].T
                top = cosine.argmax(axis=1)
                value = cosine[np.arange(len(known)), top]
                better = value > high  # an equal one further on does not count
                best[better], high[better] = top[better] + at, value[better]
            found[known] = np.array(names, object)[best]
            score[known] = np.clip(high, 0, 1)
        return pd.DataFrame({"lang_pred": found, "score": score, "letters": letters})

    return predict(text)


def accepted(found: Column, names: list[str]) -> Column:
    """Whether a document stays, from what :func:`language` returned: it has a letter, and is
    not a long text that is unlike all that was learned. Where nothing was learned only
    letterless texts are rejected."""
    unlike = (found["letters"] >= JUDGED_LETTERS) & (found["score"] < MIN_SCORE)
    return (found["letters"] > 0) & ~(F.lit(bool(names)) & unlike)


def identify(
    docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``, learned from ``text, lang`` of
    ``labelled``. Repeated rows and null keys come back as they are; an empty table gives an
    empty table; without labelled rows every text is ``und``; other columns are not looked
    at."""
    model = learn(labelled)
    rows = pick(docs, id_col, text_col)
    return rows.select("doc_id", language(F.col("text"), *model).alias("l")).select(
        "doc_id", "l.lang_pred", "l.score"
    )


def learned_rows(docs: DataFrame) -> DataFrame:
    """Rows that a language may be learned from: crc32 of the key modulo 3 is not 1."""
    return docs.filter(crc_bucket(F.col("doc_id"), 3) != 1).select("text", "lang")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    found = identify(docs, learned_rows(docs))
    return found.select("doc_id", held_out, "lang_pred", "score")
