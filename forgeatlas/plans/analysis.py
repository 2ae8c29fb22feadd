"""File analysis: label the languages of new files, then measure new Python files (L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.operators.content_language import (
    LanguageModel,
    fit,
    label_with_learned,
    self_labelled,
)
from forgeatlas.operators.languages import label_files, language_rows, unlabelled
from forgeatlas.operators.content_metrics import (
    DIGEST,
    Reader,
    known_contents,
    measure_listed,
    unmeasured_content,
)
from forgeatlas.operators.metrics import python_files
from forgeatlas.schemas import CODE_METRICS, GUESSED_LANGUAGES, LABELLED_CONTENT, MEASURED_CONTENT
from forgeatlas.session import cut_lineage
from forgeatlas.sources.bucket_table import BUCKETS, BucketTable
from forgeatlas.sources.tables import append_languages, processed_paths, read_table
from forgeatlas.sources.tree import digest_files, list_tree, read_contents


# The language table has no sizes; this much per file decides the number of tasks.
UNKNOWN_SIZE = 64 << 10


def run_labelling(spark: SparkSession, root: str, table: str, *, model=None,
                  learned: LanguageModel | None = None, hostname: str | None = None) -> None:
    """Files that are not in the table yet are read, labelled and appended. With ``learned``
    (see :func:`learn_languages`) files that no rule tells are labelled by their content."""
    listing = list_tree(spark, root).withColumn(
        "file_path", F.concat_ws("/", "host", "repo", "rel_path")
    )
    fresh = unlabelled(listing, processed_paths(spark, table))
    texts = read_contents(fresh, root)
    if learned is not None:
        labelled = label_with_learned(texts, learned)
    else:
        labelled = label_files(texts, model)
    append_languages(labelled, table, hostname=hostname)


def update_labels(spark: SparkSession, root: str, path: str, *, model=None,
                  learned: LanguageModel | None = None, hostname: str | None = None,
                  now: Column | None = None, buckets: int = BUCKETS) -> int:
    """Labels of all files below ``root`` in an updated table (``LABELLED_CONTENT``): new files
    are added, files with another content are labelled again, and the rest is neither read
    nor written. Returns the number of buckets of the table that were replaced."""
    table = BucketTable(spark, path, LABELLED_CONTENT).create(buckets)
    listed = digest_files(list_tree(spark, root), root).select("file_path", DIGEST)
    fresh = cut_lineage(unmeasured_content(listed, table.read()))
    parts = F.split("file_path", "/", 3)
    located = fresh.select(
        parts[0].alias("host"), parts[1].alias("repo"), parts[2].alias("rel_path"),
        F.lit(UNKNOWN_SIZE).cast("long").alias("size"),
    )
    texts = read_contents(located, root)
    labelled = label_files(texts, model) if learned is None else label_with_learned(texts, learned)
    # Labels are narrow; contents stay where they were read.
    digested = labelled.withColumn("_now", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    digested = digested.join(fresh, "file_path").withColumn(DIGEST, F.coalesce("_now", DIGEST))
    first = table.read().agg(F.coalesce(F.max("id") + 1, F.lit(1))).scalar()
    stamp = F.current_timestamp() if now is None else now
    rows = language_rows(digested, now=stamp, hostname=hostname, first_id=first, more=(DIGEST,))
    return table.upsert(rows, now=stamp)


def learn_languages(spark: SparkSession, root: str, path: str) -> LanguageModel:
    """A model stored at ``path``, learned from the files below ``root`` that carry a telling
    name; it labels the others."""
    texts = read_contents(list_tree(spark, root), root)
    return fit(self_labelled(texts), path)


def _located(labels: DataFrame) -> DataFrame:
    """Path below the repository, from the stored full path."""
    skip = F.length("hosting_provider") + F.length("repo_name") + 3
    return labels.select(
        F.col("hosting_provider").alias("host"),
        F.col("repo_name").alias("repo"),
        F.substring("file_path", skip, F.length("file_path")).alias("rel_path"),
        F.lit(UNKNOWN_SIZE).cast("long").alias("size"),
    )


def append_measured(spark: SparkSession, listed: DataFrame, read: Reader, target: str) -> None:
    """Listed files (``file_path, content_digest``) whose path and digest are not in
    the table are measured and appended; contents that the table knows are not parsed."""
    stored = read_table(spark, target, MEASURED_CONTENT)
    fresh = unmeasured_content(listed, stored)
    measured = cut_lineage(measure_listed(fresh, read, known_contents(stored)))
    measured.write.mode("append").parquet(target)


def run_metrics(spark: SparkSession, root: str, table: str, target: str) -> None:
    """Python files of the language table are digested where they lie; those that are new or
    have changed since they were measured are measured and appended. Of several rows of a
    path the last content counts, see :func:`current_metrics`."""
    labels = _located(python_files(read_table(spark, table, GUESSED_LANGUAGES)).dropDuplicates(["file_path"]))

    def read(wanted: DataFrame) -> DataFrame:
        parts = F.split("file_path", "/", 3)
        names = {"host": parts[0], "repo": parts[1], "rel_path": parts[2]}
        size = F.lit(UNKNOWN_SIZE).cast("long").alias("size")
        return read_contents(wanted.select(*(v.alias(k) for k, v in names.items()), size), root)

    listed = digest_files(labels, root).select("file_path", DIGEST)
    append_measured(spark, listed, read, target)


def current_metrics(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Metrics of the contents that the files below ``root`` have now."""
    stored = read_table(spark, target, MEASURED_CONTENT).dropDuplicates(["file_path", DIGEST])
    now = digest_files(list_tree(spark, root), root).select("file_path", DIGEST)
    same = now.select("file_path", F.col(DIGEST).alias("_now"))
    found = stored.join(same, "file_path").filter(F.col(DIGEST).eqNullSafe(F.col("_now")))
    return found.select(CODE_METRICS.names)
