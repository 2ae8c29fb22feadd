"""Metrics addressed by content (J5, D1, H2): what is new is decided on paths and digests.

A listing has ``file_path, content_digest``. Files whose path and digest are in the metrics
table are done; a changed file has another digest and is measured again. Of the files left
every different content is parsed once, by the file with the first path; the metrics are
stored by digest and looked up for all files that have it. Contents are read after these
decisions and only for the files that are parsed; a digest that very many files share (an
empty file, a licence stub) is answered by :func:`.lookup.lookup`, which splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.operators.lookup import is_small, lookup
from forgeatlas.operators.metrics import NOT_FOUND, code_metrics
from forgeatlas.schemas import CODE_METRICS, MEASURED_CONTENT
from forgeatlas.session import cut_lineage

DIGEST = "content_digest"
#: From a table with ``file_path`` to ``file_path, content`` of these files.
Reader = Callable[[DataFrame], DataFrame]
_PARSED = f"file_path LIKE '%.py' AND {DIGEST} IS NOT NULL"


def listing(files: DataFrame) -> DataFrame:
    """``file_path, content_digest`` of files with contents; the contents stay in the scan. A
    missing content has no digest."""
    return files.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias(DIGEST))


def contents_of(files: DataFrame) -> Reader:
    """Contents of wanted files out of a table ``file_path, content``. A list of wanted paths
    within the lookup bounds is broadcast, so that contents do not move."""

    def read(wanted: DataFrame) -> DataFrame:
        paths = cut_lineage(wanted.select("file_path").distinct())
        if is_small(paths):
            paths = F.broadcast(paths)
        return files.select("file_path", "content").join(paths, "file_path", "left_semi")

    return read


def unmeasured_content(listed: DataFrame, measured: DataFrame) -> DataFrame:
    """Listed files whose path and digest are not in the metrics table."""
    done = measured.select(F.col("file_path").alias("_path"), F.col(DIGEST).alias("_digest")).distinct()
    same = (F.col("file_path") == F.col("_path")) & F.col(DIGEST).eqNullSafe(F.col("_digest"))
    return listed.join(done, same, "left_anti")


def parse_contents(listed: DataFrame, read: Reader, known: DataFrame | None = None) -> DataFrame:
    """Metrics by ``content_digest``: every different content of the listed Python files that
    ``known`` (metrics by digest of earlier runs) lacks is read and parsed once.

    The digest is taken again from what was read: a file that has changed since it was listed
    is stored under what it is now."""
    firsts = listed.filter(_PARSED).groupBy(DIGEST).agg(F.min("file_path").alias("file_path"))
    if known is not None:
        firsts = firsts.join(known.select(DIGEST).distinct(), DIGEST, "left_anti")
    firsts = cut_lineage(firsts)
    texts = read(firsts.select("file_path"))
    digest = F.sha2(F.col("content").cast("binary"), 256)
    # A path begins with "?" where there is no text; a digest never does.
    named = F.coalesce(F.concat(digest, F.lit(".py")), F.concat(F.lit("?"), "file_path")).alias("file_path")
    parsed = cut_lineage(code_metrics(texts.select(named, "content")))
    values = [c for c in CODE_METRICS.names if c != "file_path"]
    unread = F.col("file_path").startswith("?")
    good = parsed.filter(~unread).select(F.substring_index("file_path", ".", 1).alias(DIGEST), *values)
    bad = parsed.filter(unread).withColumn("file_path", F.expr("substring(file_path, 2)"))
    bad = bad.join(firsts, "file_path").select(DIGEST, *values)
    # Two files may have become equal after they were listed.
    return good.unionByName(bad).dropDuplicates([DIGEST])


def metrics_by_path(listed: DataFrame, by_digest: DataFrame) -> DataFrame:
    """The metrics rows of listed files, with their digest, from metrics by digest.

    A file that is no Python file, or could not be read, has the row of a failed analysis. A
    file whose digest has no metrics (it changed before it was read) has no row and is left
    to the next run."""
    values = [c for c in CODE_METRICS.names if c != "file_path"]
    message = F.concat(F.lit("Could not parse file: "), F.col("file_path"))
    found = lookup(listed.filter(_PARSED), by_digest.select(DIGEST, *values), DIGEST, spread="file_path")
    error = F.when(F.col("analysis_error").isNotNull(), message)
    good = found.filter(F.col("num_assertions").isNotNull()).withColumn("analysis_error", error)
    failed = {
        f.name: F.lit(False if f.name.startswith("has_") else NOT_FOUND).cast(f.dataType) for f in CODE_METRICS
    }
    failed |= {"file_path": F.col("file_path"), "analysis_error": message}
    others = listed.filter(f"NOT ({_PARSED})").select(*(failed[c].alias(c) for c in CODE_METRICS.names), DIGEST)
    return good.select(MEASURED_CONTENT.names).unionByName(others)


def measure_listed(listed: DataFrame, read: Reader, known: DataFrame | None = None) -> DataFrame:
    """Metrics of listed files, each different content parsed once; ``known`` has metrics by
    digest of earlier runs, which are used and not parsed again."""
    listed = cut_lineage(listed.select("file_path", DIGEST))
    parsed = parse_contents(listed, read, known)
    if known is not None:
        wanted = listed.select(DIGEST).distinct()
        parsed = parsed.unionByName(known.select(parsed.columns).join(wanted, DIGEST, "left_semi"))
    return metrics_by_path(listed, parsed)


def known_contents(measured: DataFrame) -> DataFrame:
    """Metrics by digest, out of a table of metrics by path and digest."""
    values = [c for c in CODE_METRICS.names if c != "file_path"]
    return measured.filter(_PARSED).select(DIGEST, *values).dropDuplicates([DIGEST])
