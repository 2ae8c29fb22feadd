"""Enrichment from stored API responses: counts and commits joined back to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.functions import urls
from forgeatlas.operators.enrich import NOT_COUNTED, processable
from forgeatlas.operators.lookup import lookup
from forgeatlas.sources.api_json import latest_commits, test_counts


def with_owner_repo(clean: DataFrame) -> DataFrame:
    """``repo`` (``owner/repo``) of processable rows; null for all others."""
    owner_repo = F.nullif(urls.owner_and_repo(F.col("repourl")), F.lit(""))
    return processable(clean).withColumn("repo", owner_repo)


def api_results(searches: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per repository: ``repo, testfilecount, bad_pages, sha, html_url``. A bad page
    counts no item and is counted itself; of several commit responses with a ``sha`` the
    greatest one is taken, since responses carry no time."""
    counts = test_counts(searches).filter(F.col("repo").isNotNull())
    latest = latest_commits(commits).filter("repo IS NOT NULL AND sha IS NOT NULL")
    latest = latest.groupBy("repo").agg(F.max(F.struct("sha", "html_url")).alias("c"))
    return counts.join(latest.select("repo", "c.*"), "repo", "full")


def run_api_enrichment(clean: DataFrame, searches: DataFrame, commits: DataFrame) -> DataFrame:
    """Processable rows with ``repo, testfilecount, last_commit_hash, last_commit_url,
    complete``. Complete rows have all their pages and a commit; the repositories of the
    others are what is left to request. ``searches`` and ``commits`` hold ``repo, body``."""
    found = lookup(with_owner_repo(clean), api_results(searches, commits), "repo", spread="row_id")
    counted = F.coalesce(F.col("testfilecount"), F.lit(NOT_COUNTED).cast("long"))
    whole = (F.col("bad_pages") == 0) & F.col("sha").isNotNull()
    return found.withColumns(
        {"testfilecount": counted, "complete": F.coalesce(whole, F.lit(False))}
    ).withColumnsRenamed({"sha": "last_commit_hash", "html_url": "last_commit_url"}).drop("bad_pages")
