"""File inventory: test-file predicate, counts, listings and profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeatlas.functions.text import suffix

# Suffixes that never count as test files, for checked-out trees
# and for the hosting service's code search.
EXCLUDED = [".txt", ".md", ".h", ".xml", ".html", ".json", ".png", ".jpg"]
SEARCH_EXCLUDED = [".txt", ".md", ".html", ".xml", ".json"]
# End of fixed values.


def with_path_parts(df: DataFrame) -> DataFrame:
    """``dir``, ``name`` and ``suffix`` of ``rel_path``."""
    name = F.substring_index("rel_path", "/", -1)
    folder = F.when(
        F.col("rel_path").contains("/"), F.regexp_replace("rel_path", r"(?s)/[^/]*\z", "")
    ).otherwise("")
    return df.withColumns({"name": name, "dir": folder}).withColumn(
        "suffix", suffix(F.col("name"))
    )


def is_test_file(excluded: list[str] | None = None) -> Column:
    """``test`` in the name or in the folder from the host on, suffix not excluded."""
    folder = F.lower(F.concat_ws("/", "host", "repo", "dir"))
    named = F.lower("name").contains("test") | folder.contains("test")
    return named & ~suffix(F.col("name")).isin(list(excluded or EXCLUDED))


def list_test_files(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """One row per test file (a repository may have any number of them)."""
    return files.filter(is_test_file(excluded))


def count_test_files(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """E5: test files per repository, 0 included."""
    return files.groupBy("host", "repo").agg(
        F.count_if(is_test_file(excluded)).alias("testfilecountlocal")
    )


def tree_profile(files: DataFrame) -> DataFrame:
    """Per host the number of repositories and of files.

    Aggregated per repository first, so that the distinct count is a plain count.
    """
    per_repo = files.groupBy("host", "repo").agg(F.count("*").alias("n"))
    return per_repo.groupBy("host").agg(
        F.count("*").alias("repositories"), F.sum("n").alias("files")
    )


def listing_lines(test_files: DataFrame, repos: DataFrame) -> DataFrame:
    """``(repourl, part, line)`` rows of the listing report.

    Per repository a header (part 0), one line per test file (part 1) and an
    empty line (part 2). Sorting by ``(repourl, part, line)`` gives the report;
    the sort key includes the line, so one huge repository is split over tasks.
    ``repos`` has one ``repourl`` per ``(host, repo)``.
    """
    frame = repos.select(
        "repourl",
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("part"),
                    F.concat(F.lit("Repository URL: "), "repourl").alias("line"),
                ),
                F.struct(F.lit(2).alias("part"), F.lit("").alias("line")),
            )
        ),
    )
    names = test_files.select("repourl", F.lit(1).alias("part"), F.col("rel_path").alias("line"))
    return frame.unionByName(names)
