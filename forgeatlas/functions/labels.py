"""Labels of the flow graph: test-file bucket, primary runner and node captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Captions of the graph nodes, in node order, and the upper bounds
# (inclusive) of the test-file buckets.
ORIGINAL = "Original Data"
SMALL_HOSTS = "Domains with < 10 Repos"
DUPLICATES = "Duplicates"
INCOMPLETE = "Incomplete URLs"
NOT_CLONED = "Repos not Cloned"
CLONED = "Repos Cloned"
RUNNERS = ["JUnit", "pytest", "Mocha"]
NO_RUNNER = "No test runner detected"
BUCKETS = [
    "0 test files",
    "1 - 9 test files",
    "10 - 99 test files",
    "100 - 999 test files",
    "More than 1000 test files",
]
BUCKET_UPPER_BOUNDS = [0, 9, 99, 999]
# End of fixed values.

FIXED_NODES = [
    ORIGINAL, SMALL_HOSTS, DUPLICATES, INCOMPLETE, NOT_CLONED, CLONED,
    *RUNNERS, NO_RUNNER, *BUCKETS,
]
NODE_ID = {label: position for position, label in enumerate(FIXED_NODES)}


def count_bucket(count: Column) -> Column:
    """Right-closed bins; -1 (not counted) has no bucket."""
    label = F.when(count <= -1, F.lit(None).cast("string"))
    for bound, caption in zip(BUCKET_UPPER_BOUNDS, BUCKETS):
        label = label.when(count <= bound, caption)
    return label.when(count.isNotNull(), BUCKETS[-1])


def bucket_ordinal(label: Column) -> Column:
    """Position of a bucket caption, for ordering."""
    position = F.array_position(F.array(*map(F.lit, BUCKETS)), label)
    return F.when(position > 0, position - 1).cast("int")


def primary_runner(junit: Column, pytest: Column, mocha: Column) -> Column:
    """Runner with most matching files, ties to the first named."""
    best = F.greatest(junit, pytest, mocha)
    return (
        F.when(junit + pytest + mocha == 0, NO_RUNNER)
        .when(junit == best, RUNNERS[0])
        .when(pytest == best, RUNNERS[1])
        .when(mocha == best, RUNNERS[2])
    )


def no_runner_flag(junit: Column, pytest: Column, mocha: Column) -> Column:
    """1 if no runner has a matching file."""
    return ((junit == 0) & (pytest == 0) & (mocha == 0)).cast("int")
