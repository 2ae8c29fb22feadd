"""Declared schemas of the tables that pass between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the registry tables.
REGISTRY_COLUMNS = ["projectref", "projectpage", "repourl"]
# End of fixed values.


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, L, B, TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()

REGISTRY_RAW = _struct(("row_id", L), *((c, S) for c in REGISTRY_COLUMNS))

REGISTRY_CLEAN = _struct(
    *((f.name, f.dataType) for f in REGISTRY_RAW),
    ("duplicate_flag", B),
    ("null_value_flag", B),
    ("repodomain", S),
    ("unsupported_url_scheme", B),
    ("incomplete_url_flag", B),
    ("base_repo_url", S),
    ("base_repo_url_flag", B),
)

FILES = _struct(
    ("host", S),
    ("repo", S),
    ("rel_path", S),
    ("dir", S),
    ("name", S),
    ("suffix", S),
    ("size", L),
)

GUESSED_LANGUAGES = _struct(
    ("id", L),
    ("repo_name", S),
    ("hosting_provider", S),
    ("file_path", S),
    ("guessed_language", S),
    ("date_created", TS),
    ("date_updated", TS),
    ("hostname", S),
)

# Labels that say which content they were given for.
LABELLED_CONTENT = T.StructType([*GUESSED_LANGUAGES.fields, T.StructField("content_digest", S, True)])

CODE_METRICS = _struct(
    ("file_path", S),
    ("num_test_cases", L),
    ("num_assertions", L),
    ("assert_statements", L),
    ("has_setup", B),
    ("has_teardown", B),
    ("complexity", L),
    ("cyclomatic_complexity", L),
    ("lines_of_code", L),
    ("num_functions", L),
    ("analysis_error", S),
)

# Metrics rows that say which content they were taken from.
MEASURED_CONTENT = T.StructType([*CODE_METRICS.fields, T.StructField("content_digest", S, True)])

SEARCH_BODY = T.StructType(
    [T.StructField("items", T.ArrayType(_struct(("name", S), ("path", S))), True)]
)
COMMITS_BODY = T.ArrayType(_struct(("sha", S), ("html_url", S)))
_EDGE = T.StructType([T.StructField("node", _struct(("name", S))), T.StructField("size", L)])


def _nested(leaf: T.DataType, *names: str) -> T.DataType:
    for name in reversed(names):
        leaf = T.StructType([T.StructField(name, leaf)])
    return leaf


LANGUAGES_BODY = _nested(T.ArrayType(_EDGE), "data", "repository", "languages", "edges")


def require_columns(df, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"DataFrame is missing required columns: {missing}")
