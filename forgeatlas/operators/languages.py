"""Language labels of files and their table."""

from __future__ import annotations

import platform
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeatlas.functions.text import suffix
from forgeatlas.schemas import GUESSED_LANGUAGES

# Languages by suffix and by whole file name.
UNKNOWN = "Unknown"
LANGUAGE_BY_SUFFIX = {
    ".asm": "Assembly", ".bat": "Batchfile", ".c": "C", ".cc": "C++", ".clj": "Clojure",
    ".cmake": "CMake", ".cob": "COBOL", ".coffee": "CoffeeScript", ".cpp": "C++", ".cs": "C#",
    ".css": "CSS", ".csv": "CSV", ".cxx": "C++", ".dart": "Dart", ".dm": "DM", ".erl": "Erlang",
    ".ex": "Elixir", ".exs": "Elixir", ".f90": "Fortran", ".go": "Go", ".groovy": "Groovy",
    ".h": "C", ".hpp": "C++", ".hs": "Haskell", ".htm": "HTML", ".html": "HTML", ".ini": "INI",
    ".java": "Java", ".jl": "Julia", ".js": "JavaScript", ".json": "JSON", ".kt": "Kotlin",
    ".lisp": "Lisp", ".lua": "Lua", ".m": "Objective-C", ".md": "Markdown", ".ml": "OCaml",
    ".pas": "Pascal", ".php": "PHP", ".pl": "Perl", ".pm": "Perl", ".pro": "Prolog",
    ".ps1": "PowerShell", ".py": "Python", ".r": "R", ".rb": "Ruby", ".rs": "Rust",
    ".scala": "Scala", ".sh": "Shell", ".sql": "SQL", ".swift": "Swift", ".tex": "TeX",
    ".toml": "TOML", ".ts": "TypeScript", ".v": "Verilog", ".vb": "Visual Basic", ".xml": "XML",
    ".yaml": "YAML", ".yml": "YAML",
}
LANGUAGE_BY_NAME = {
    "CMakeLists.txt": "CMake", "Dockerfile": "Dockerfile", "Makefile": "Makefile",
}
# Content patterns for files without a telling name, first match wins.
LANGUAGE_BY_CONTENT = [
    (r"\A#![^\n]*\bpython", "Python"),
    (r"\A#![^\n]*\b(?:ba|z|da|k)?sh\b", "Shell"),
    (r"\A#![^\n]*\bperl", "Perl"),
    (r"\A#![^\n]*\bruby", "Ruby"),
    (r"\A#![^\n]*\bnode", "JavaScript"),
    (r"\A\s*<\?php", "PHP"),
    (r"\A\s*<\?xml", "XML"),
    (r"(?i)\A\s*<!doctype html", "HTML"),
]
# End of fixed values.


def language_by_rules(name: Column, content: Column) -> Column:
    """J1 default: by suffix, by file name, then by content; unreadable is ``Unknown``."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_BY_NAME.items() for x in kv))
    by_name = F.coalesce(F.try_element_at(names, name),
                         F.try_element_at(table, F.lower(suffix(name))))
    by_content = F.lit(None).cast("string")
    for pattern, language in reversed(LANGUAGE_BY_CONTENT):
        by_content = F.when(content.rlike(pattern), language).otherwise(by_content)
    return F.when(content.isNull(), UNKNOWN).otherwise(
        F.coalesce(by_name, by_content, F.lit(UNKNOWN))
    )


def language_by_model(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable:
    """J1 hook: ``load`` returns a ``predict(list of texts)`` and runs once per worker task.

    A text that is missing, and a batch the model fails on, is ``Unknown``.
    """

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            out = pd.Series(UNKNOWN, index=texts.index, dtype=object)
            known = texts.notna()
            if known.any():
                out[known] = _predict_each(predict, texts[known].tolist())
            yield out

    return label


def _predict_each(predict, texts: list[str]) -> list[str]:
    try:
        return list(predict(texts))
    except Exception:
        if len(texts) == 1:
            return [UNKNOWN]
        half = len(texts) // 2
        return _predict_each(predict, texts[:half]) + _predict_each(predict, texts[half:])


def label_files(files: DataFrame, model: Callable | None = None) -> DataFrame:
    """J1 over a files table with ``name`` and ``content``."""
    if model is None:
        label = language_by_rules(F.col("name"), F.col("content"))
    else:
        label = language_by_model(model)(F.col("content"))
    return files.withColumn("guessed_language", label)


def unlabelled(files: DataFrame, labelled: DataFrame) -> DataFrame:
    """Files whose path is not in the table. Run it before contents are read."""
    return files.join(labelled.select("file_path").distinct(), "file_path", "left_anti")


def language_rows(labelled: DataFrame, *, now: Column | None = None,
                  hostname: str | None = None, first_id: Column | int = 1,
                  more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the language table. Values become text, missing values stay missing.
    ``more`` names columns to keep beside those of the table."""
    stamp = F.current_timestamp() if now is None else now
    start = first_id if isinstance(first_id, Column) else F.lit(first_id)
    built = {
        "id": start + F.monotonically_increasing_id(),
        "repo_name": F.col("repo"),
        "hosting_provider": F.col("host"),
        "file_path": F.col("file_path"),
        "guessed_language": F.col("guessed_language"),
        "date_created": stamp,
        "date_updated": stamp,
        "hostname": F.lit(hostname or platform.node()),
    }
    return labelled.select(
        *(built[f.name].cast(f.dataType).alias(f.name) for f in GUESSED_LANGUAGES), *more
    )


def merge_upsert(old: DataFrame, new: DataFrame, *, key: str = "file_path",
                 now: Column | None = None) -> DataFrame:
    """K2: new values replace old ones, null values too; ``date_created`` is kept,
    ``date_updated`` is now.

    Returns the next snapshot. Several new rows for one key are reduced to the
    one with the highest ``id`` (combined on the map side) before the join.
    """
    stamp = F.current_timestamp() if now is None else now
    fields = [c for c in old.columns if c != key]
    latest = new.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.coalesce(F.col("id"), F.lit(-1))).alias("_new")
    )
    packed = old.select(key, F.struct(*fields).alias("_old"))
    joined = packed.join(latest, key, "full")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    given = F.col("_new").isNotNull()
    chosen = {c: F.when(given, F.col("_new")[c]).otherwise(F.col("_old")[c]) for c in fields}
    chosen["id"] = F.coalesce(F.col("_old")["id"], F.col("_new")["id"])
    chosen["date_created"] = F.coalesce(
        F.col("_old")["date_created"], F.col("_new")["date_created"]
    )
    chosen["date_updated"] = F.when(both, stamp).otherwise(chosen["date_updated"])
    return joined.select(*(F.col(key) if c == key else chosen[c].alias(c) for c in old.columns))


def language_sizes(files: DataFrame) -> DataFrame:
    """Bytes per repository and language."""
    return files.groupBy("host", "repo", "guessed_language").agg(F.sum("size").alias("size"))


def top_languages(sizes: DataFrame, limit: int = 10) -> DataFrame:
    """Largest languages of each repository; the groups hold one row per language."""
    ranked = W.partitionBy("host", "repo").orderBy(F.desc("size"), "guessed_language")
    return sizes.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= limit)


def language_map(sizes: DataFrame) -> DataFrame:
    """``{language: size}`` per repository."""
    pairs = F.collect_list(F.struct("guessed_language", "size"))
    return sizes.groupBy("host", "repo").agg(F.map_from_entries(pairs).alias("languages"))
