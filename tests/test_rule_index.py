"""Many rules: the rows of a plain match of every rule with every file."""

import random
import re

import pytest

from forgeatlas.operators import rule_index
from forgeatlas.operators.runners import RunnerRules, rule_matches


@pytest.mark.parametrize("pattern,wanted", [
    (".*Test.java", "Test"), ("test_.*.py", "test_"), ("abc+def", "abc"), ("ab?cde", "cde"), ("ab{2}cd", "cd"), ("a|bcd", ""),
    ("(abc|de)fgh", "fgh"), (r"a\.bc", "a.bc"), (r"\d+xy", "xy"), ("[abc]de", "de"), ("(?i)abc", ""), ("[a[b]]c", ""),
    (r"\Qab\E", ""), ("", ""), ("x*", ""), ("^abc$", "abc"), (r"a[\]b]cde", "cde"), (r"(?:longer)ab", "ab"), ("a{2", ""),
])
def test_literals(pattern, wanted):
    assert rule_index.required_literal(pattern) == wanted


def test_a_literal_is_in_every_match():
    rng = random.Random(1)
    parts = ["a", "b", "cd", "[ab]", ".", "(ab|c)", "a?", "b*", "c+", r"\.", "(?:ab)", "d{1,2}", "|"]
    texts = ["".join(rng.choice("abcd.") for _ in range(rng.randrange(9))) for _ in range(400)]
    for _ in range(600):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        literal = rule_index.required_literal(pattern)
        assert all(literal in t for t in texts if re.match(pattern, t)), pattern


def files_of(spark, many):
    rng = random.Random(2)
    rows = []
    for k in range(many):
        name = rng.choice(["pom.xml", "package.json", "".join(rng.choices("abcdef", k=8)) + rng.choice([".py", ".java"])])
        rows.append(("h", f"r{k % 5}", "d", name, rng.choice([None, "", "".join(rng.choices("abcdefgh ", k=60))]), f"d/{name}"))
    return spark.createDataFrame(rows, "host string, repo string, dir string, name string, content string, rel_path string").repartition(3)


def test_rows_are_those_of_compiled_rules(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    rules = [
        RunnerRules(
            f"runner{k}",
            dependency_patterns=tuple(word(3) for _ in range(8)),
            config_files=("pom.xml",) if k % 2 else ("package.json", "pom.xml"),
            file_patterns=tuple(rng.choice([".*", "[a-c]+", "", "(a|b)?"]) + word(2) + rng.choice([".*", "[.]py", ".?"]) for _ in range(12)),
        )
        for k in range(4)
    ]
    df = files_of(spark, 400)
    for kind in ("file_patterns", "dependency_patterns", "config_files"):
        plain = {tuple(r) for r in rule_matches(df, kind, rules).collect()}
        many = rule_index.match_rules(df, kind, rules, compiled=0)
        rows = list(map(tuple, many.select("host", "repo", "dir", "name", "runner", "pattern").collect()))
        assert len(rows) == len(set(rows)) and set(rows) == plain and plain
        few = rule_index.match_rules(df, kind, rules, compiled=1000)
        assert {tuple(r) for r in few.collect()} == plain


def test_ten_thousand_rules_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "BLOCK_CHARS", 100_000)
    rng = random.Random(4)
    patterns = sorted({".*" + "".join(rng.choices("abcdef", k=6)) + ".*" for _ in range(14_000)})[:10_000]
    assert len(patterns) == 10_000
    df = files_of(spark, 200)
    found = rule_index.match_rules(df, "file_patterns", [RunnerRules("x", file_patterns=tuple(patterns))])
    names = {r["name"] for r in df.collect()}
    plain = {(n, p) for n in names for p in patterns if p[2:-2] in n}
    assert {(r["name"], r["pattern"]) for r in found.collect()} == plain and plain
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_files_are_dropped_before_the_rules(spark):
    rows = [("h", r, "d", n, k) for r in ("r", None) for n in ("abc.py", "abd.py", "fabc", None) for k in range(5)]
    df = spark.createDataFrame(rows, "host string, repo string, dir string, name string, row_id int").repartition(3)
    rules = [RunnerRules(f"x{k}", file_patterns=(".*ab", "[d-e]?.?abc", ".*", "(a|d).*")) for k in range(2)]
    found = rule_index.match_rules(df, "file_patterns", rules, compiled=0)
    plain = rule_matches(df, "file_patterns", rules).distinct()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    # Pairs of file and rule meet in no aggregation.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")] and "Aggregate" in plan
