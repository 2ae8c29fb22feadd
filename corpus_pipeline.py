"""From raw documents to token ids: language, near duplicates, contamination, secrets, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm import op1_bpe, op3_secrets, op4_simhash, op9_language, op10_decontaminate
from forgeatlas.llm.common import fresh, store, table

#: SQL can't express hashing with a seed, learned profiles, or tokenizing.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that language ID rejects: null, without a letter, or long and unlike all
    that was learned."""
    names, prototypes = op9_language.learn(op9_language.learned_rows(docs))
    name = fresh(docs, "_language")
    found = docs.withColumn(name, op9_language.language(F.col("text"), names, prototypes))
    return found.filter(op9_language.accepted(F.col(name), names)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash class (four-word shingles, at most 4 differing bits): the
    one with the smallest key (a missing key comes last), then the smallest hash of the text,
    then the first row. Rows are told apart by a number, not by their key, so a repeated or
    missing key loses no text of another class."""
    name = fresh(docs, "_row")
    order = F.struct(
        F.col("doc_id").isNull().alias("keyless"), "doc_id", F.xxhash64("text").alias("text"),
        F.monotonically_increasing_id().alias("number"),
    )
    numbered = store(docs.withColumn(name, order), "numbered")
    found = op4_simhash.near_duplicates(numbered, id_col=name)
    firsts = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.number").alias("first"))
    return numbered.join(firsts, F.col(f"`{name}`.number") == F.col("first"), "left_semi").drop(name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; ``n_chars`` follows the new text."""
    clean = op3_secrets.redact(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), size).otherwise(F.col("n_chars")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` with checksums of the ids and of the text decoded from them."""
    done = op1_bpe.encode_decode(docs, op1_bpe.tokenizer_path())
    return done.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
