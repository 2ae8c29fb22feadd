"""Evidence for test runners.

The rule table is a short list, so each rule becomes one column expression: the
file side is read once, nothing is joined and no pair of file and rule is ever
materialised unless it matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["dependency_patterns", "config_files", "file_patterns"]


@dataclass(frozen=True)
class RunnerRules:
    runner: str
    dependency_patterns: tuple[str, ...] = ()
    config_files: tuple[str, ...] = ()
    file_patterns: tuple[str, ...] = ()
    match_on: str = "name"


# What points to each test runner.
DEFAULT_RULES = [
    RunnerRules(
        "JUnit",
        dependency_patterns=("org.junit.jupiter:junit-jupiter", "junit:junit"),
        config_files=("pom.xml", "build.gradle"),
        file_patterns=(".*Test.java",),
    ),
    RunnerRules(
        "pytest",
        config_files=("pytest.ini", "tox.ini", "pyproject.toml"),
        file_patterns=("test_.*.py", ".*_test.py"),
    ),
    RunnerRules(
        "Mocha",
        dependency_patterns=("mocha",),
        config_files=("package.json", ".mocharc.json", ".mocharc.js"),
        file_patterns=("test/.*.js",),
    ),
]
# End of fixed values.


def rule_columns(rules: list[RunnerRules] | None = None) -> list[str]:
    return [f"{r.runner}_{kind}" for r in rules or DEFAULT_RULES for kind in KINDS]


def _prefix_match(value: Column, pattern: str) -> Column:
    # Anchored at the start only; (?d) lets "." match all but the newline.
    return value.rlike(f"^(?d:{pattern})")


def _rule_hits(rules: list[RunnerRules]) -> list[tuple[str, str, str, Column]]:
    """``(runner, kind, pattern, condition on a file row)`` for every single rule."""
    hits = []
    for rule in rules:
        in_config = F.col("name").isin(list(rule.config_files))
        for pattern in rule.dependency_patterns:
            # The content is looked at only where the name already matches.
            found = F.when(in_config, F.col("content").contains(pattern))
            hits.append((rule.runner, KINDS[0], pattern, F.coalesce(found, F.lit(False))))
        for pattern in rule.config_files:
            hits.append((rule.runner, KINDS[1], pattern, F.col("name") == pattern))
        for pattern in rule.file_patterns:
            matched = _prefix_match(F.col(rule.match_on), pattern)
            hits.append((rule.runner, KINDS[2], pattern, matched))
    return hits


def config_names(rules: list[RunnerRules] | None = None) -> list[str]:
    """Names of all files whose content the rules look at."""
    return sorted({name for r in rules or DEFAULT_RULES for name in r.config_files})


def rule_matches(
    files: DataFrame, kind: str, rules: list[RunnerRules] | None = None
) -> DataFrame:
    """D6, D7 or D8 alone: one row per file and rule of ``kind`` that match."""
    found = F.array(
        *(
            F.when(hit, F.struct(F.lit(runner).alias("runner"), F.lit(pattern).alias("pattern")))
            for runner, of_kind, pattern, hit in _rule_hits(rules or DEFAULT_RULES)
            if of_kind == kind
        )
    )
    return files.select("host", "repo", "dir", "name", F.inline(F.array_compact(found)))


def evidence_counters(rules: list[RunnerRules] | None = None) -> list[Column]:
    """The sums of E6, to be used in any aggregation over a files table."""
    rules = rules or DEFAULT_RULES
    totals = {name: F.lit(0) for name in rule_columns(rules)}
    for runner, kind, _, hit in _rule_hits(rules):
        column = f"{runner}_{kind}"
        totals[column] = totals[column] + hit.cast("int")
    return [F.sum(total).cast("long").alias(name) for name, total in totals.items()]


def detect_test_runners(
    files: DataFrame, rules: list[RunnerRules] | None = None
) -> DataFrame:
    """Counters per repository and runner, in one partial-then-final aggregation."""
    return files.groupBy("host", "repo").agg(*evidence_counters(rules))
