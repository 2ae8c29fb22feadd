"""Language labels learned from content (J1): a smoothed model of byte n-grams.

Files that carry a label teach the model: for every language the counts of its byte 1-, 2- and
3-grams, of its file suffixes and of frequent file names become weights (rounded logarithms,
in thousandths, so that sums are exact). A file gets the language with the largest sum.

Counting is combined inside each task and then grouped by language and gram. The model is a
stored table. Files are scored where they lie with a packed copy of it, as long as its rows
and cells are within stated bounds, which are counted first; beyond them the grams of a file
are joined to the table. Both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.functions.text import suffix
from forgeatlas.operators.languages import UNKNOWN, language_by_rules
from forgeatlas.session import scratch_path

ORDERS = (1, 2, 3)
# Bytes of a content that one numpy step takes, and grams that a task holds before counting.
STEP_BYTES, HELD_GRAMS = 1 << 18, 1 << 22
# A file name is a feature if at least so many labelled files have it.
NAME_FILES = 5
# Bounds of a model that is packed: rows, and gram-language cells.
PACK_ROWS, PACK_CELLS = 8_000_000, 16_000_000


@dataclass(frozen=True)
class LanguageModel:
    """``languages``: ``language, prior, gram_default, suffix_default, name_default``.
    ``grams``: ``gram, language, weight``. ``words``: ``kind, key, language, weight``."""

    languages: DataFrame
    grams: DataFrame
    words: DataFrame

    def save(self, path: str) -> LanguageModel:
        parts = {"languages": self.languages, "grams": self.grams, "words": self.words}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}")
        return load_model(self.languages.sparkSession, path)


def load_model(spark: SparkSession, path: str) -> LanguageModel:
    return LanguageModel(*(spark.read.parquet(f"{path}/{name}") for name in ("languages", "grams", "words")))


def _codes(content: bytes) -> Iterator[np.ndarray]:
    """Codes of all grams of a content, piece by piece: the order above, the bytes below."""
    data = np.frombuffer(content, np.uint8).astype(np.int32)
    for at in range(0, len(data), STEP_BYTES):
        for order in ORDERS:
            part = data[at : at + STEP_BYTES + order - 1]
            many = len(part) - order + 1
            if many > 0:
                code = np.full(many, order << 24, np.int32)
                for k in range(order):
                    code |= part[k : k + many] << (8 * (order - 1 - k))
                yield code


def count_grams(files: DataFrame, *by: str) -> DataFrame:
    """``*by, gram, n``: grams of ``content`` per group of files, combined inside each task."""
    kinds = [f"{c} {files.schema[c].dataType.simpleString()}" for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        types, size = None, 0

        def counted() -> Iterator[pa.RecordBatch]:
            for key, codes in held.items():
                gram, n = np.unique(np.concatenate(codes), return_counts=True)
                columns = [pa.array([v] * len(gram), t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gram), pa.array(n)], names=[*by, "gram", "n"])
            held.clear()

        for batch in batches:
            types = types or [c.type for c in batch.columns[:-1]]
            for k in range(batch.num_rows):
                key = tuple(c[k].as_py() for c in batch.columns[:-1])
                content = batch.columns[-1][k].as_py()
                for code in _codes((content or "").encode()):
                    held.setdefault(key, []).append(code)
                    size += len(code)
                if size >= HELD_GRAMS:
                    yield from counted()
                    size = 0
        yield from counted()

    counted = files.select(*by, "content").mapInArrow(run, ", ".join([*kinds, "gram int", "n long"]))
    return counted.groupBy(*by, "gram").agg(F.sum("n").alias("n"))


def _weight(count: Column, total: Column, kinds: Column) -> Column:
    """Thousandths of the logarithm of a share with one more of each kind."""
    return F.round(F.log((count + 1) / (total + kinds)) * 1000).cast("long")


def fit(labelled: DataFrame, path: str | None = None) -> LanguageModel:
    """Learn from rows ``language, name, content``; the model is stored below ``path`` (or in
    the shared folder).

    Rows without language or content are left out. A gram of ``c`` among ``n`` of a language
    weighs ``ln((c + 1) / (n + v))`` with ``v`` different grams in all; suffixes and names
    likewise among the files of a language.
    """
    spark = labelled.sparkSession
    path = path or scratch_path(spark, "language-model")
    rows = labelled.filter("language IS NOT NULL AND content IS NOT NULL")
    counts = f"{path}/counts"
    count_grams(rows, "language").write.mode("overwrite").parquet(f"{counts}/grams")
    named = rows.select("language", F.coalesce("name", F.lit("")).alias("name"))
    pairs = F.explode(F.array(
        F.struct(F.lit("suffix").alias("kind"), F.lower(suffix(F.col("name"))).alias("key")),
        F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")),
    )).alias("f")
    named.select("language", pairs).groupBy("language", "f.kind", "f.key").agg(
        F.count("*").alias("n")
    ).write.mode("overwrite").parquet(f"{counts}/words")
    grams, words = (spark.read.parquet(f"{counts}/{name}") for name in ("grams", "words"))
    of_key = words.groupBy("kind", "key").agg(F.sum("n").alias("files"))
    kept = of_key.filter((F.col("kind") == "suffix") | (F.col("files") >= NAME_FILES)).select("kind", "key")
    words = words.join(kept, ["kind", "key"], "left_semi")
    # Four numbers: how many different grams, suffixes and names, and how many files.
    variety = grams.agg(F.count_distinct("gram")).first()[0]
    suffixes, names = kept.agg(
        F.count_if(F.col("kind") == "suffix"), F.count_if(F.col("kind") == "name")
    ).first()
    files = rows.groupBy("language").agg(F.count("*").alias("files"))
    sizes = files.join(grams.groupBy("language").agg(F.sum("n").alias("grams")), "language", "left")
    sizes.fillna(0, ["grams"]).write.mode("overwrite").parquet(f"{counts}/sizes")
    sizes = spark.read.parquet(f"{counts}/sizes")
    all_files = sizes.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    none = F.lit(0)
    languages = sizes.select(
        "language", F.round(F.log(F.col("files") / F.lit(all_files)) * 1000).cast("long").alias("prior"),
        _weight(none, F.col("grams"), F.lit(variety)).alias("gram_default"),
        _weight(none, F.col("files"), F.lit(suffixes)).alias("suffix_default"),
        _weight(none, F.col("files"), F.lit(names)).alias("name_default"),
    )
    gram_weights = grams.join(sizes.select("language", "grams"), "language").select(
        "gram", "language", _weight(F.col("n"), F.col("grams"), F.lit(variety)).alias("weight")
    )
    kinds_of = F.when(F.col("kind") == "suffix", F.lit(suffixes)).otherwise(F.lit(names))
    word_weights = words.join(sizes.select("language", "files"), "language").select(
        "kind", "key", "language", _weight(F.col("n"), F.col("files"), kinds_of).alias("weight")
    )
    return LanguageModel(languages, gram_weights, word_weights).save(path)


# Scoring -----------------------------------------------------------------------


class _Packed:
    """The model as arrays: a row of weights per gram, the last row for unknown ones."""

    def __init__(self, languages: pd.DataFrame, grams: pa.Table, words: pd.DataFrame):
        languages = languages.sort_values("language").reset_index(drop=True)
        self.names = languages["language"].tolist()
        place = {name: k for k, name in enumerate(self.names)}
        self.prior = languages["prior"].to_numpy(np.int64)
        codes, row = np.unique(np.asarray(grams["gram"]), return_inverse=True)
        self.codes = codes
        self.weights = np.tile(languages["gram_default"].to_numpy(np.int64), (len(codes) + 1, 1)).astype(np.int32)
        column = np.array([place[x] for x in grams["language"].to_pylist()], np.int64)
        self.weights[row, column] = np.asarray(grams["weight"])
        self.words = {
            (kind, None): languages[f"{kind}_default"].to_numpy(np.int64) for kind in ("suffix", "name")
        }
        for kind, key, name, weight in words[["kind", "key", "language", "weight"]].itertuples(index=False):
            if (kind, key) not in self.words:
                self.words[kind, key] = self.words[kind, None].copy()
            self.words[kind, key][place[name]] = weight
        self.rows = None

    def score(self, name: str | None, ending: str, content: str) -> np.ndarray:
        if self.rows is None:  # built once per worker process: the row of every code
            self.rows = np.full((max(ORDERS) + 1) << 24, len(self.codes), np.int32)
            self.rows[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        total = self.prior.copy()
        for kind, key in (("suffix", ending), ("name", name or "")):
            total += self.words.get((kind, key), self.words[kind, None])
        for code in _codes(content.encode()):
            found = self.rows[code]
            for at in range(0, len(found), 1 << 15):
                total += self.weights[found[at : at + (1 << 15)]].sum(axis=0, dtype=np.int64)
        return total


_BUILT: dict[str, _Packed] = {}


def _small(model: LanguageModel) -> bool:
    """Whether the model is within the bounds of a packed one; counted before it is read."""
    grams = model.grams.agg(F.count("*").alias("rows"), F.approx_count_distinct("gram").alias("grams")).first()
    languages, words = model.languages.count(), model.words.count()
    return grams["rows"] + words <= PACK_ROWS and languages * grams["grams"] <= PACK_CELLS


def _by_packed(files: DataFrame, model: LanguageModel) -> DataFrame:
    packed = _Packed(model.languages.toPandas(), model.grams.toArrow(), model.words.toPandas())
    shared = files.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("language string, score long")
    def best(names: pd.Series, endings: pd.Series, contents: pd.Series) -> pd.DataFrame:
        known = shared.value
        found, scores = [], []
        for name, ending, content in zip(names, endings, contents, strict=True):
            if content is None or not known.names:
                found.append(None)
                scores.append(None)
                continue
            total = known.score(name, ending, content)
            at = int(total.argmax())
            found.append(known.names[at])
            scores.append(int(total[at]))
        return pd.DataFrame({"language": found, "score": pd.array(scores, "Int64")})

    ending = F.coalesce(F.lower(suffix(F.col("name"))), F.lit(""))
    return files.withColumn("_learned", best(F.col("name"), ending, F.col("content")))


def _by_join(files: DataFrame, model: LanguageModel, key: str) -> DataFrame:
    """The same sums with the model as a joined table, for one of any size."""
    known = files.filter(F.col("content").isNotNull())
    counts = count_grams(known.select(key, "content"), key)
    gap = F.sum(F.col("n") * (F.col("weight") - F.col("gram_default")))
    defaults = model.languages
    in_model = counts.join(model.grams, "gram").join(defaults.select("language", "gram_default"), "language")
    gained = in_model.groupBy(key, "language").agg(gap.alias("gained"))
    name = F.coalesce("name", F.lit(""))
    words = known.select(key, name.alias("name"), F.coalesce(F.lower(suffix(name)), F.lit("")).alias("suffix"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("many"))
    columns = ["language", "prior", "gram_default", "suffix_default", "name_default"]
    # A row per language: every file is held against each of them.
    each = [F.struct(*(F.lit(r[c]).alias(c) for c in columns)) for r in defaults.select(columns).collect()]
    if not each:
        nothing = F.lit(None).cast("struct<language:string,score:bigint>")
        return files.withColumn("_learned", nothing)
    every = words.join(totals, key, "left").select("*", F.explode(F.array(*each)).alias("d"))
    every = every.select(*words.columns, "many", "d.*")
    scored = every.join(gained, [key, "language"], "left")
    for kind in ("suffix", "name"):
        weights = model.words.filter(F.col("kind") == kind).select(
            F.col("key").alias(kind), "language", F.col("weight").alias(f"{kind}_weight")
        )
        scored = scored.join(weights, [kind, "language"], "left")
    zero = F.lit(0).cast("long")
    score = (
        F.col("prior") + F.coalesce("many", zero) * F.col("gram_default") + F.coalesce("gained", zero)
        + F.coalesce("suffix_weight", "suffix_default") + F.coalesce("name_weight", "name_default")
    )
    # Largest sum, then first name: the least of (negated sum, name).
    first = F.min(F.struct((-score).alias("negated"), "language"))
    best = scored.groupBy(F.col(key).alias("_key")).agg(first.alias("best")).select(
        "_key", F.struct(F.col("best.language").alias("language"), (-F.col("best.negated")).alias("score")).alias("_learned")
    )
    return files.join(best, files[key] == best["_key"], "left").drop("_key")


def label_by_content(
    files: DataFrame, model: LanguageModel, *, key: str = "file_path", packed: bool | None = None
) -> DataFrame:
    """Adds ``language`` and ``score`` to files with ``name`` and ``content``.

    Ties go to the first language by name. A file without content, and every file of a model
    that has learned nothing, has neither. ``packed`` forces one of the two ways; by itself
    the size of the model decides. ``key`` is unique; only the joined way needs it.
    """
    if packed is None:
        packed = _small(model)
    found = _by_packed(files, model) if packed else _by_join(files, model, key)
    return found.withColumns({"language": F.col("_learned.language"), "score": F.col("_learned.score")}).drop("_learned")


def label_with_learned(files: DataFrame, model: LanguageModel, *, key: str = "file_path") -> DataFrame:
    """Labels by rule where a rule tells the language, else by the learned model."""
    ruled = F.nullif(language_by_rules(F.col("name"), F.col("content")), F.lit(UNKNOWN))
    labelled = label_by_content(files, model, key=key)
    return labelled.withColumn("guessed_language", F.coalesce(ruled, "language", F.lit(UNKNOWN))).drop("language", "score")


def self_labelled(files: DataFrame) -> DataFrame:
    """``language, name, content`` of the files whose language a rule tells: what the others
    can be learned from."""
    ruled = F.nullif(language_by_rules(F.col("name"), F.col("content")), F.lit(UNKNOWN))
    return files.select(ruled.alias("language"), "name", "content").filter("language IS NOT NULL")
