"""Stored responses of a hosting service's API.

The network client is not part of this package: its responses are a table with
one row per response body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.schemas import COMMITS_BODY, LANGUAGES_BODY, SEARCH_BODY


def search_pages(responses: DataFrame, repo: str = "repo", body: str = "body") -> DataFrame:
    """Number of items per result page; a page without ``items`` carries an error."""
    items = F.from_json(body, SEARCH_BODY)["items"]
    return responses.withColumn("_items", items).select(
        F.col(repo).alias("repo"),
        F.when(F.col("_items").isNotNull(), F.size("_items")).alias("items"),
        F.when(
            F.col("_items").isNull(), F.concat(F.lit("Unable to find 'items' in "), F.col(body))
        ).alias("error"),
    )


def test_counts(responses: DataFrame, repo: str = "repo", body: str = "body") -> DataFrame:
    """Items over all pages of a repository, and the pages that had none to offer."""
    return search_pages(responses, repo, body).groupBy("repo").agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("testfilecount"),
        F.count("error").alias("bad_pages"),
    )


def latest_commits(responses: DataFrame, repo: str = "repo", body: str = "body") -> DataFrame:
    """``sha`` and ``html_url`` of the first commit; both null without a ``sha``."""
    first = F.get(F.from_json(body, COMMITS_BODY), F.lit(0))
    found = first["sha"].isNotNull()
    return responses.select(
        F.col(repo).alias("repo"),
        first["sha"].alias("sha"),
        F.when(found, first["html_url"]).alias("html_url"),
    )


def latest_by_time(commits: DataFrame, repo: str, sha: str, order: list[str]) -> DataFrame:
    """F3 on a commit table: the latest commit per repository, combined on the map side."""
    return commits.groupBy(F.col(repo).alias("repo")).agg(
        F.max_by(F.col(sha), F.struct(*order)).alias("sha")
    )


def language_edges(responses: DataFrame, repo: str = "repo", body: str = "body",
                   status: str = "status") -> DataFrame:
    """``{language: size}`` of one response, the last size of a language that comes twice;
    another status than 200 is an error text."""
    edges = F.from_json(body, LANGUAGES_BODY)["data"]["repository"]["languages"]["edges"]
    pairs = F.transform(edges, lambda e: F.struct(e["node"]["name"].alias("name"), e["size"]))
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["name"].eqNullSafe(p["name"])
        ),
    )
    languages = F.map_from_entries(last)
    ok = F.col(status) == 200
    message = F.format_string("Query failed to run by returning code of %d. %s", status, body)
    return responses.select(
        F.col(repo).alias("repo"),
        F.when(ok, languages).alias("languages"),
        F.when(~ok, message).alias("error"),
    )
