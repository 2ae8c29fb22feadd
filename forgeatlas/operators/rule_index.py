"""Rule joins for many rules (D7, D8): an index of the literals that rules need.

A short rule list is compiled into columns (:mod:`.runners`). With thousands of rules that
would be as many regex matches per file. Here every pattern gives the longest piece of plain
text that each of its matches must contain; one automaton over these literals finds, in a
single pass over a name or a content, the rules that can match at all. Only these are run, by
the same regex engine as the compiled columns, so the rows are the same. Patterns without a
literal are run on every file.

Rules travel to the tasks in blocks of bounded size; files stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeatlas.operators.runners import RunnerRules, rule_matches
from forgeatlas.session import parallelism

# Up to so many rules of a kind become columns.
COMPILED_RULES = 50
# A block of rules holds at most so many characters of pattern and name.
BLOCK_CHARS = 4 << 20
TASKS_PER_CORE = 4
_SHOWN = ("host", "repo", "dir", "name")
_SPECIAL = set("\\^$.|?*+()[]{}")


def required_literal(pattern: str) -> str:
    """Longest run of plain characters that every match of a regex contains; empty if that
    cannot be told (alternatives, inline flags, only classes)."""
    best, run, at, depth = "", "", 0, 0
    while at < len(pattern):
        char, step, plain = pattern[at], 1, None
        if char == "\\":
            following = pattern[at + 1 : at + 2]
            step = 2
            if following and not following.isalnum():
                plain = following
            elif following in ("Q", "E", "x", "u", "N", "p", "P", "k", "c", "0"):
                return ""  # longer escapes: not taken apart here
        elif char == "[":
            step = _class_end(pattern, at) - at
            if step <= 0:
                return ""
        elif char == "(":
            if pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
                return ""
            depth += 1
        elif char == ")":
            depth -= 1
        elif char == "|":
            if depth == 0:
                return ""
        elif char == "{":
            step = pattern.find("}", at) - at + 1
            if step <= 0:
                return ""
        elif char not in _SPECIAL:
            plain = char
        if depth or plain is None:
            run = ""
        else:
            # A character that may be absent, or repeats, ends the run.
            after = pattern[at + step : at + step + 1]
            if after in ("?", "*", "{"):
                run = ""
            elif after == "+":
                run += plain
                best, run = max(best, run, key=len), ""
            else:
                run += plain
        best = max(best, run, key=len)
        at += step
    return best


def _class_end(pattern: str, at: int) -> int:
    """Place behind a character class; 0 if it is nested or open."""
    place = at + 1
    if pattern.startswith("^", place):
        place += 1
    if pattern.startswith("]", place):
        place += 1
    while place < len(pattern):
        if pattern[place] == "\\":
            place += 2
            continue
        if pattern[place] == "[":
            return 0
        if pattern[place] == "]":
            return place + 1
        place += 1
    return 0


class _Index:
    """Automaton over the literals of a block of ``(runner, pattern, literal)`` rules."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        import ahocorasick

        self.always = [(r, p) for r, p, literal in rules if not literal]
        self.automaton, held = ahocorasick.Automaton(), {}
        for runner, pattern, literal in rules:
            if literal:
                held.setdefault(literal, []).append((runner, pattern))
        for literal, of in held.items():
            self.automaton.add_word(literal, (literal, of))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def candidates(self, text: str | None) -> list[tuple[str, str]]:
        if text is None:
            return []
        found = list(self.always)
        if not self.empty:
            seen = {literal: of for _, (literal, of) in self.automaton.iter(text)}
            for of in seen.values():
                found += of
        return found


@lru_cache(maxsize=4)
def _built(block: tuple[tuple[str, str, str], ...]) -> _Index:
    return _Index(list(block))


def _candidates(files: DataFrame, column: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``files`` with ``runner, pattern`` of every rule whose literal is in the text."""
    shared = files.sparkSession.sparkContext.broadcast(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, runners, patterns = [], [], []
                for k, text in enumerate(part.column(part.schema.names.index(column)).to_pylist()):
                    for runner, pattern in index.candidates(text):
                        rows.append(k)
                        runners.append(runner)
                        patterns.append(pattern)
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in kept), pa.array(runners, pa.string()), pa.array(patterns, pa.string())],
                    names=[*kept, "runner", "pattern"],
                )

    kept = list(_SHOWN)
    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in kept)
    wanted = files.select(*kept, *([column] if column not in kept else []))
    return wanted.mapInArrow(run, f"{kinds}, runner string, pattern string")


def _blocks(rules: list[tuple[str, str, str]]) -> Iterator[list[tuple[str, str, str]]]:
    held, size = [], 0
    for rule in rules:
        if held and size + sum(map(len, rule)) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(rule)
        size += sum(map(len, rule))
    yield held


def match_rules(files: DataFrame, kind: str, rules: list[RunnerRules], *, compiled: int = COMPILED_RULES) -> DataFrame:
    """D7 (``file_patterns``) or D8 (``dependency_patterns``) for rule lists of any length: the
    rows of :func:`.runners.rule_matches`, each pattern of a runner once."""
    pairs = sorted({(r.runner, p) for r in rules for p in getattr(r, kind)})
    if len(pairs) <= compiled or kind == "config_files":
        return rule_matches(files, kind, rules).distinct()
    if kind == "file_patterns":
        column, literal = rules[0].match_on, required_literal
        checked = F.expr(f"{column} rlike concat('^(?d:', pattern, ')')")
    else:
        column, literal = "content", lambda pattern: pattern
        # The rules of a runner look into its configuration files only.
        names = sorted({(r.runner, n) for r in rules for n in r.config_files})
        config = files.sparkSession.createDataFrame(names or [("", "")], "runner string, name string")
        files = files.join(F.broadcast(config.select("name").distinct()), "name", "left_semi")  # as long as the rules
        checked = None
    # Rows are told apart by what is shown of them. Where the rules look at nothing else, equal
    # files are dropped before the rules: each pair then comes once, and no task holds pairs to
    # compare them.
    alone = column in _SHOWN
    if alone:
        # A file is short and its pairs are many: the bytes of the files do not tell the work.
        tasks = TASKS_PER_CORE * parallelism(files.sparkSession)
        files = files.select(*_SHOWN).distinct().repartition(tasks, *_SHOWN)
    # Each block of rules is one pass over the files.
    found = None
    for block in _blocks([(r, p, literal(p)) for r, p in pairs]):
        part = _candidates(files, column, block)
        found = part if found is None else found.unionByName(part)
    if checked is None:
        return found.join(F.broadcast(config), ["runner", "name"], "left_semi").select(
            "host", "repo", "dir", "name", "runner", "pattern"
        ).distinct()
    found = found.filter(checked)
    return found if alone else found.distinct()
