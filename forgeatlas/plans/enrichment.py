"""Enrichment pipeline: tree inventory -> counts and evidence -> registry -> RDF (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.operators.enrich import (
    add_explanations,
    completed_keys,
    init_result_columns,
    processable,
    with_repo_key,
    write_back,
)
from forgeatlas.operators.files import is_test_file, list_test_files, listing_lines
from forgeatlas.operators.lookup import lookup
from forgeatlas.operators.runners import config_names, evidence_counters, rule_columns
from forgeatlas.sources.reports import write_listing
from forgeatlas.sources.tables import read_table
from forgeatlas.sources.tree import list_tree, read_contents


def repo_results(files: DataFrame, excluded=None, rules=None) -> DataFrame:
    """E5 and E6 per repository key, in one aggregation over the files."""
    key = F.concat_ws("/", "host", "repo").alias("repo_key")
    return files.groupBy(key).agg(
        F.count_if(is_test_file(excluded)).alias("testfilecountlocal"), *evidence_counters(rules)
    )


def enrich_registry(clean: DataFrame, results: DataFrame, commits: DataFrame | None = None,
                    rules=None, failures: DataFrame | None = None) -> DataFrame:
    """Results of a key on all its rows. A key with a tree counts as cloned, one
    without a tree that ``failures`` (``repo_key, error_message``) names as failed;
    ``commits`` is an optional ``(repo_key, last_commit_hash)`` table."""
    found = results.withColumn("clone_status", F.lit("successful"))
    if commits is not None:
        found = found.join(commits, "repo_key", "left")
    if failures is not None:
        failed = failures.filter(F.col("repo_key").isNotNull()).select("repo_key").distinct()
        failed = failed.join(results, "repo_key", "left_anti")
        found = found.unionByName(
            failed.withColumn("clone_status", F.lit("failed")), allowMissingColumns=True
        )
    keyed = with_repo_key(init_result_columns(clean, rules))
    return add_explanations(write_back(keyed, found, rules))


def failure_log(clean: DataFrame, failures: DataFrame) -> DataFrame:
    """Error log: ``row_id, repourl, repo_key, error_message`` of every row whose repository
    failed; of several messages for a key the greatest one."""
    message = failures.groupBy("repo_key").agg(F.max("error_message").alias("error_message"))
    message = message.withColumn("failed", F.lit(True))
    keyed = with_repo_key(clean).select("row_id", "repourl", "repo_key")
    return lookup(keyed, message, "repo_key", spread="row_id").filter("failed").drop("failed")


def stored_results(spark: SparkSession, path: str, rules=None) -> DataFrame:
    """Results of earlier runs: of every key those of its last run."""
    counts = ["testfilecountlocal", *rule_columns(rules)]
    fields = [*counts, "last_commit_hash"]
    schema = ", ".join(
        ["repo_key string", *(f"`{c}` long" for c in counts), "last_commit_hash string", "run long"]
    )
    rows = read_table(spark, path, schema)
    last = rows.groupBy("repo_key").agg(
        F.max_by(F.struct("run", *fields), "run").alias("last")
    )
    return last.select("repo_key", "last.*")


def unfinished(clean: DataFrame, results: DataFrame) -> DataFrame:
    """``host, repo`` of the processable repositories without a finished result."""
    keys = with_repo_key(processable(clean)).filter(F.col("repo_key").isNotNull())
    left = keys.select("repo_key").distinct().join(completed_keys(results), "repo_key", "left_anti")
    parts = F.split("repo_key", "/", 2)
    return left.select(parts[0].alias("host"), parts[1].alias("repo"))


def test_file_lines(clean: DataFrame, listing: DataFrame, excluded=None) -> DataFrame:
    """``repourl, part, line`` of the test files of every listed repository, under
    the URL of its first registry row, or its key if no row names it."""
    urls = with_repo_key(clean).filter(F.col("repo_key").isNotNull()).groupBy("repo_key").agg(
        F.min_by("repourl", "row_id").alias("url")
    )
    keyed = listing.withColumn("repo_key", F.concat_ws("/", "host", "repo"))
    url = F.coalesce("url", "repo_key").alias("repourl")
    repos = lookup(keyed.select("repo_key").distinct(), urls, "repo_key", spread="repo_key").select("repo_key", url)
    named = lookup(list_test_files(keyed, excluded).select("repo_key", "rel_path"), repos, "repo_key", spread="rel_path")
    return listing_lines(named, repos.select("repourl"))


def _scan(spark: SparkSession, root: str, excluded, rules, listing: DataFrame) -> DataFrame:
    """Results of the listed trees. Only configuration files are opened; all other files are
    judged by their names."""
    named = F.col("name").isin(config_names(rules))
    texts = read_contents(listing.filter(named), root).select(
        "host", "repo", "dir", "name", "content"
    )
    others = listing.filter(~named).select(
        "host", "repo", "dir", "name", F.lit(None).cast("string").alias("content")
    )
    return repo_results(texts.unionByName(others), excluded, rules)


def run_enrichment(spark: SparkSession, clean: DataFrame, root: str, *, excluded=None,
                   rules=None, commits: DataFrame | None = None,
                   failures: DataFrame | None = None, results: str | None = None,
                   listing: str | None = None) -> DataFrame:
    """Scan the trees below ``root`` and enrich the registry. The test files of the scanned
    repositories are appended to the report at ``listing``.

    With ``results``, the path of a table of results, a run opens only the repositories of
    processable rows that have no finished result there (a count and a commit), appends what
    it finds, and enriches with all that is stored. Without it every tree is read.
    """
    before = None if results is None else stored_results(spark, results, rules)
    listed = list_tree(spark, root, only=None if before is None else unfinished(clean, before))
    if listing is not None:
        write_listing(test_file_lines(clean, listed, excluded), listing)
    fresh = _scan(spark, root, excluded, rules, listed)
    if before is None:
        return enrich_registry(clean, fresh, commits, rules, failures)
    run = 1 + (before.agg(F.max("run")).first()[0] or 0)
    if commits is None:
        fresh = fresh.withColumn("last_commit_hash", F.lit(None).cast("string"))
    else:
        fresh = fresh.join(commits.select("repo_key", "last_commit_hash"), "repo_key", "left")
    fresh.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(results)
    found = stored_results(spark, results, rules).drop("run")
    return enrich_registry(clean, found, None, rules, failures)
