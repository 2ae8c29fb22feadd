"""Metrics of Python files.

Parsing needs Python; Spark partitions the files, ships ``(file_path, content)``
in Arrow batches and gets one row of numbers back per file.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from forgeatlas.schemas import CODE_METRICS

NOT_FOUND = -1
FILES_AT_ONCE = 64
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_WITHS = (ast.With, ast.AsyncWith)


def _decisions(statements: list[ast.stmt]) -> int:
    """Branch points below ``statements``: 1 per if, loop and nested function,
    1 + handlers per try. Blocks of ``finally``, ``except*`` and ``match`` are opaque."""
    total, todo = 0, list(statements)
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.If, *_LOOPS)):
            total += 1
            todo += node.body + node.orelse
        elif isinstance(node, ast.Try):
            total += 1 + len(node.handlers)
            todo += node.body + node.orelse
            for handler in node.handlers:
                todo += handler.body
        elif isinstance(node, _FUNCTIONS):
            total += 1
            todo += node.body
        elif isinstance(node, (ast.ClassDef, *_WITHS)):
            todo += node.body
    return total


def _graph_complexities(tree: ast.Module) -> dict[str, int]:
    """Complexity per control-flow graph. Functions and outermost compound statements
    have one each; equal names replace each other in source order."""
    graphs: dict[str, int] = {}
    todo = [("", node) for node in reversed(tree.body)]
    while todo:
        prefix, node = todo.pop()
        if isinstance(node, _FUNCTIONS):
            graphs[prefix + node.name] = 1 + _decisions(node.body)
        elif isinstance(node, (ast.If, ast.Try, *_LOOPS)):
            kind = {ast.If: "If", ast.Try: "TryExcept"}.get(type(node), "Loop")
            graphs[f"{prefix}{kind} {node.lineno}"] = 1 + _decisions([node])
        elif isinstance(node, ast.ClassDef):
            inner = f"{prefix}{node.name}."
            todo += [(inner, child) for child in reversed(node.body)]
        elif isinstance(node, _WITHS):
            todo += [(prefix, child) for child in reversed(node.body)]
    return graphs


def _failed(file_path: str) -> dict:
    row = dict.fromkeys(CODE_METRICS.names, NOT_FOUND)
    return row | {
        "file_path": file_path,
        "has_setup": False,
        "has_teardown": False,
        "analysis_error": f"Could not parse file: {file_path}",
    }


def file_metrics(file_path: str, content: str | None) -> dict:
    """J3 and J4 of one file; anything that cannot be parsed gives the error row."""
    if content is None or not file_path.endswith(".py"):
        return _failed(file_path)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except Exception:
        return _failed(file_path)
    cases = ifs = asserts = 0
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Assert):
            asserts += 1
        elif isinstance(node, ast.FunctionDef):
            names.add(node.name)
            if node.name.startswith("test_"):
                cases += 1
                ifs += sum(isinstance(child, ast.If) for child in node.body)
    graphs = _graph_complexities(tree)
    return {
        "file_path": file_path,
        "num_test_cases": cases or NOT_FOUND,
        # Counts calls to a function named "assert", which the grammar rules out.
        "num_assertions": NOT_FOUND,
        "assert_statements": asserts,
        "has_setup": "setUp" in names,
        "has_teardown": "tearDown" in names,
        "complexity": cases + ifs or NOT_FOUND,
        "cyclomatic_complexity": sum(graphs.values()) or NOT_FOUND,
        "lines_of_code": len(content.splitlines()),
        "num_functions": len(graphs) or NOT_FOUND,
        "analysis_error": None,
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Few contents at a time are Python objects, however many rows a batch has.
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            paths, contents = (column.to_pylist() for column in batch.slice(at, FILES_AT_ONCE).columns)
            rows = [file_metrics(p, c) for p, c in zip(paths, contents, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(CODE_METRICS))


def code_metrics(files: DataFrame) -> DataFrame:
    """J5 over ``(file_path, content)``."""
    return files.select("file_path", "content").mapInArrow(_measure, CODE_METRICS)


def python_files(files: DataFrame) -> DataFrame:
    """C7."""
    return files.filter(F.col("guessed_language") == "Python")


def unmeasured(files: DataFrame, measured: DataFrame) -> DataFrame:
    """Files that are not in the metrics table yet."""
    return files.join(measured.select("file_path").distinct(), "file_path", "left_anti")


def append_metrics(done: DataFrame, batch: DataFrame) -> DataFrame:
    """H2: columns that one side lacks are null there."""
    return done.unionByName(batch, allowMissingColumns=True)


def roll_up(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Totals and mean complexity over files that could be analysed."""
    counted = F.col("num_functions") > 0
    functions = F.sum(F.when(counted, F.col("num_functions")).otherwise(0))
    complexity = F.sum(F.when(counted, F.col("cyclomatic_complexity")).otherwise(0))
    return metrics.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.count("analysis_error").alias("failed_files"),
        F.sum(F.when(F.col("lines_of_code") > 0, F.col("lines_of_code")).otherwise(0)).alias(
            "lines_of_code"
        ),
        functions.alias("functions"),
        complexity.alias("complexity"),
        F.when(functions > 0, complexity / functions).otherwise(F.lit(0.0)).alias(
            "avg_complexity"
        ),
    )
