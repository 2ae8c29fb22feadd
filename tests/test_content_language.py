"""The learned language labels against plain counting, and on code without telling names."""

import math
import random
from collections import Counter

import pytest

from forgeatlas.operators import content_language as cl
from forgeatlas.plans.analysis import learn_languages, run_labelling
from forgeatlas.schemas import GUESSED_LANGUAGES
from forgeatlas.sources import tables

WORDS = "count total item value node list index name file user page token".split()


def code(language, rng):
    a, b, c = rng.sample(WORDS, 3)
    n = rng.randrange(100)
    lines = {
        "Python": [f"def {a}_{b}(self, {c}):", f"    if {c} is None:", f"        return {n}", f"    for {a} in range({n}):",
                   f"        self.{b}.append({a})", f"import {a}", f"    raise ValueError('{b}')"],
        "C": [f"#include <{a}.h>", f"static int {a}_{b}(struct {c} *{a}) {{", f"    if (!{a}->{b}) return -{n};", "}",
              f"    for (int i = 0; i < {n}; i++) {a}[i] = 0;", f"    free({b});", f"    printf(\"%d\\n\", {c});"],
        "JavaScript": [f"const {a} = require('{b}');", f"function {a}({b}) {{", f"  return {b} === undefined ? {n} : {c};",
                       "}", f"  {a}.forEach(({b}) => console.log({b}));", f"let {c} = new Promise(r => r({n}));"],
        "HTML": [f"<div class=\"{a}\">", f"<p>{b} <a href=\"/{c}\">{a}</a></p>", "</div>", f"<li id=\"{b}{n}\">{c}</li>",
                 "<br/>", f"<span>{a}</span>"],
        "SQL": [f"SELECT {a}, COUNT(*) FROM {b}s", f"WHERE {c}_id = {n}", f"GROUP BY {a} ORDER BY {b} DESC;",
                f"INSERT INTO {a}s VALUES ({n});", f"LEFT JOIN {c}s ON {a}s.id = {c}s.{a}_id"],
    }[language]
    return "\n".join(rng.choice(lines) for _ in range(rng.randrange(4, 30)))


KINDS = {"Python": ".py", "C": ".c", "JavaScript": ".js", "HTML": ".html", "SQL": ".sql"}


def plain_score(files, name, ending, content):
    """Sums over the definition, gram by gram."""
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    weight = lambda c, n, v: round(1000 * math.log((c + 1) / (n + v)))
    held = {}
    names = Counter(f[1] for f in files)
    known = {n for n, c in names.items() if c >= cl.NAME_FILES}
    for language, file, text, suffix in files:
        g, s, k, n = held.setdefault(language, (Counter(), Counter(), Counter(), Counter()))
        g.update(grams(text.encode()))
        s[suffix] += 1
        k[file] += 1
        n["files"] += 1
    variety = len({x for g, *_ in held.values() for x in g})
    suffixes = len({f[3] for f in files})
    out = {}
    for language, (g, s, k, n) in held.items():
        total = sum(g.values())
        score = round(1000 * math.log(n["files"] / len(files)))
        score += sum(weight(g[x], total, variety) for x in grams(content.encode()))
        score += weight(s[ending], n["files"], suffixes) + weight(k[name] if name in known else 0, n["files"], len(known))
        out[language] = score
    return min((-v, k) for k, v in out.items())


@pytest.fixture(scope="module")
def taught():
    rng = random.Random(1)
    return [(kind, "main" if k % 9 == 0 else f"{kind}{k}", code(kind, rng)) for kind in KINDS for k in range(40)]


def test_sums_are_those_of_the_definition(spark, taught, monkeypatch):
    rng = random.Random(2)
    asked = [(k, f"x{k}" if k % 3 else "main", code(rng.choice(list(KINDS)), rng)) for k in range(25)]
    asked += [(90, None, "short"), (91, "a.py", ""), (92, "main", "ünï\x00😀"), (93, "y", None)]
    model = cl.fit(spark.createDataFrame(taught, "language string, name string, content string"))
    files = spark.createDataFrame(asked, "file_path long, name string, content string").repartition(3)
    plain = [(language, name, text, "") for language, name, text in taught]
    ways = [
        {r.file_path: (r.language, r.score) for r in cl.label_by_content(files, model, packed=way).collect()}
        for way in (True, False, None)
    ]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(asked)
    assert ways[0][93] == (None, None)
    for key, name, content in asked[:-1]:
        score, language = plain_score(plain, name or "", ".py" if key == 91 else "", content)
        assert ways[0][key] == (language, -score), key


def test_pieces_of_a_long_content_lose_no_gram(monkeypatch):
    data = bytes(random.Random(3).randrange(256) for _ in range(1000))
    whole = Counter(c for part in cl._codes(data) for c in part.tolist())
    monkeypatch.setattr(cl, "STEP_BYTES", 7)
    assert Counter(c for part in cl._codes(data) for c in part.tolist()) == whole
    assert sum(whole.values()) == 1000 + 999 + 998 and not list(cl._codes(b""))


def test_a_large_model_is_joined(spark, taught, monkeypatch):
    model = cl.fit(spark.createDataFrame(taught, "language string, name string, content string"))
    assert cl._small(model)
    monkeypatch.setattr(cl, "PACK_ROWS", 10)
    assert not cl._small(model)


def test_nothing_learned(spark):
    model = cl.fit(spark.createDataFrame([(None, "a", "x")], "language string, name string, content string"))
    files = spark.createDataFrame([(1, "a", "x")], "file_path long, name string, content string")
    for way in (True, False):
        assert [(r.language, r.score) for r in cl.label_by_content(files, model, packed=way).collect()] == [(None, None)]


def test_code_without_suffix_is_told(spark, taught):
    """Accuracy on files that no rule tells, after learning from files that a rule does."""
    rng = random.Random(4)
    files = [(f"h/r/{name}{KINDS[kind]}", f"{name}{KINDS[kind]}", text) for kind, name, text in taught]
    asked = [(f"h/r/file{k}", kind, code(kind, rng)) for k, kind in enumerate(list(KINDS) * 30)]
    schema = "file_path string, name string, content string"
    model = cl.fit(cl.self_labelled(spark.createDataFrame(files, schema)))
    labelled = cl.label_with_learned(
        spark.createDataFrame([(p, p[4:], t) for p, _, t in asked] + [("h/r/b.go", "b.go", "x")], schema), model)
    found = {r.file_path: r.guessed_language for r in labelled.collect()}
    assert found["h/r/b.go"] == "Go"  # a rule comes first
    right = sum(found[path] == kind for path, kind, _ in asked)
    assert right >= 0.97 * len(asked), right


def test_labelling_a_tree_with_what_it_teaches(spark, tmp_path, taught):
    root = tmp_path / "repos"
    rng = random.Random(5)
    for kind, name, text in taught:
        file = root / "host" / "repo" / f"{name}_{kind}{KINDS[kind]}"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    for kind in KINDS:
        (root / "host" / "repo" / f"untold_{kind}").write_text("\n".join(code(kind, rng) for _ in range(3)))
    model = learn_languages(spark, str(root), str(tmp_path / "model"))
    run_labelling(spark, str(root), str(tmp_path / "labels"), learned=model, hostname="n")
    rows = tables.read_table(spark, str(tmp_path / "labels"), GUESSED_LANGUAGES).filter("file_path like '%untold%'")
    assert {r.file_path.split("_")[-1]: r.guessed_language for r in rows.collect()} == {k: k for k in KINDS}
    again = cl.load_model(spark, str(tmp_path / "model"))
    assert again.grams.count() == model.grams.count() > 1000
