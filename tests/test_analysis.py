import os
import time
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forgeatlas.operators import content_metrics, languages, lookup, metrics
from forgeatlas.plans.analysis import current_metrics, run_labelling, run_metrics
from forgeatlas.schemas import CODE_METRICS, GUESSED_LANGUAGES
from forgeatlas.sources import api_json, tables
from forgeatlas.sources.tree import digest_files, list_tree, read_contents
from forgeatlas.streaming import progress
from forgeatlas.streaming.progress import measure_stream, measured

TEST_CLASS = """
class T:
    def setUp(self):
        pass
    def test_a(self):
        if self:
            assert self
        for x in y:
            if x: pass
        assert 1
    async def test_async(self):
        if self: pass
    def tearDown(self): pass
"""


def test_test_metrics():
    row = metrics.file_metrics("t.py", TEST_CLASS)
    assert (row["num_test_cases"], row["complexity"]) == (1, 2)
    assert row["num_assertions"] == -1 and row["assert_statements"] == 2
    assert row["has_setup"] and row["has_teardown"]
    # setUp 1, test_a 1 + if + for + if, test_async 2, tearDown 1
    assert row["num_functions"] == 4 and row["cyclomatic_complexity"] == 8


@pytest.mark.parametrize(
    "code, graphs",
    [
        ("def f(): pass", {"f": 1}),
        ("x = 1", {}),
        ("def f():\n    if a: pass\n    elif b: pass\n    else: pass", {"f": 3}),
        ("def f():\n    for x in y: pass\n    else: pass\n    while z: pass", {"f": 3}),
        ("def f():\n  try: pass\n  except A: pass\n  except B: pass\n  else: pass", {"f": 4}),
        ("def f():\n  try: pass\n  finally:\n    if a: pass", {"f": 2}),
        ("def f():\n  with a:\n    if b: pass", {"f": 2}),
        ("def f():\n  def g():\n    if a: pass", {"f": 3}),
        ("def f(): return [x for x in y if x and z] or (1 if q else 2)", {"f": 1}),
        ("def f():\n  match a:\n    case 1:\n      if b: pass", {"f": 1}),
        ("def f():\n  class A:\n    def g(self): pass", {"f": 2}),
        ("if a: pass", {"If 1": 2}),
        ("for a in b:\n  if c: pass", {"Loop 1": 3}),
        ("try: pass\nexcept E: pass", {"TryExcept 1": 3}),
        ("with a:\n  if b: pass", {"If 2": 2}),
        ("class A:\n  def f(self): pass\n  class B:\n    def f(self): pass", {"A.f": 1, "A.B.f": 1}),
        ("def f(): pass\ndef f():\n  if a: pass", {"f": 2}),
        ("if a:\n  def f(): pass", {"If 1": 3}),
    ],
)
def test_graph_complexity(code, graphs):
    import ast

    assert metrics._graph_complexities(ast.parse(code)) == graphs


def test_metrics_of_unusable_files(spark):
    df = spark.createDataFrame(
        [("a.txt", "x = 1"), ("b.py", "def broken(:"), ("c.py", None), ("d.py", ""),
         ("e.py", "a\x0cb = 1\n\x00")],
        "file_path string, content string",
    )
    got = {r.file_path: r for r in metrics.code_metrics(df).collect()}
    for name in ("a.txt", "b.py", "c.py", "e.py"):
        assert got[name].analysis_error == f"Could not parse file: {name}"
        assert got[name].lines_of_code == -1 and got[name].has_setup is False
    assert got["d.py"].analysis_error is None and got["d.py"].lines_of_code == 0
    assert got["d.py"].num_functions == -1


def test_deep_nesting_is_an_error_row():
    assert metrics.file_metrics("x.py", "(" * 5000 + ")" * 5000)["analysis_error"]


def test_roll_up(spark):
    df = spark.createDataFrame(
        [("r", "def f():\n  if a: pass\n"), ("r", "x = 1"), ("r", "def (")],
        "repo string, content string",
    ).withColumn("file_path", F.concat("repo", F.monotonically_increasing_id().cast("string"), F.lit(".py")))
    rolled = metrics.roll_up(metrics.code_metrics(df), []).first()
    assert (rolled.files, rolled.failed_files, rolled.functions, rolled.complexity) == (3, 1, 1, 2)
    assert rolled.avg_complexity == 2.0


def test_append_with_missing_columns(spark):
    done = spark.createDataFrame([("a", 1)], "file_path string, complexity long")
    batch = spark.createDataFrame([("b", -1, "bad")], "file_path string, complexity long, analysis_error string")
    out = metrics.append_metrics(done, batch).orderBy("file_path").collect()
    assert [r.analysis_error for r in out] == [None, "bad"]


def test_language_rules(spark):
    data = [("a.py", "x", "Python"), ("A.PY", "x", "Python"), ("Dockerfile", "FROM x", "Dockerfile"),
            ("run", "#!/usr/bin/env python3\n", "Python"), ("run", "#!/bin/sh\n", "Shell"),
            ("page", "<!DOCTYPE html>", "HTML"), ("x", "text", "Unknown"), ("a.py", None, "Unknown"),
            (".gitignore", "x", "Unknown")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, name string, content string, want string")
    out = languages.label_files(df).collect()
    assert [(r.name, r.guessed_language) for r in out] == [(n, w) for n, _, w in data]


def test_language_model_failures(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return ["ok"] * len(texts)
        return predict

    df = spark.createDataFrame([("a",), ("boom",), (None,), ("b",)], "content string").coalesce(1)
    out = [r.guessed_language for r in languages.label_files(df, load).collect()]
    assert out == ["ok", "Unknown", "Unknown", "ok"]


def test_upsert(spark):
    schema = GUESSED_LANGUAGES
    from datetime import datetime

    old_time, new_time = datetime(2024, 1, 1), datetime(2024, 2, 1)
    old = spark.createDataFrame(
        [(1, "r", "h", "a", "C", old_time, old_time, "n"), (2, "r", "h", "b", "C", old_time, old_time, "n")], schema)
    new = spark.createDataFrame(
        [(7, "r", "h", "b", "Go", new_time, new_time, "m"), (8, "r", "h", "b", "Rust", new_time, new_time, "m"),
         (9, "r", "h", "c", "C", new_time, new_time, "m")], schema)
    now = F.lit(datetime(2024, 3, 1))
    out = {r.file_path: r for r in languages.merge_upsert(old, new, now=now).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"].date_updated == old_time
    assert (out["b"].id, out["b"].guessed_language) == (2, "Rust")
    assert (out["b"].date_created, out["b"].date_updated) == (old_time, datetime(2024, 3, 1))
    assert out["c"].date_created == new_time


def _tree(root):
    for name, text in {"h/r/a.py": "def f(): pass\n", "h/r/test_b.py": TEST_CLASS, "h/r/c.txt": "x",
                       "h/s/.d.py": "if x: pass\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_analysis_pipeline_is_incremental(spark, tmp_path):
    root, table, target = tmp_path / "repos", str(tmp_path / "labels"), str(tmp_path / "metrics")
    _tree(root)
    for _ in range(2):
        run_labelling(spark, str(root), table, hostname="n")
        run_metrics(spark, str(root), table, target)
    labels = tables.read_table(spark, table, GUESSED_LANGUAGES)
    assert labels.count() == 4 and labels.select("id").distinct().count() == 4
    got = {r.file_path: r for r in tables.read_table(spark, target, CODE_METRICS).collect()}
    assert set(got) == {"h/r/a.py", "h/r/test_b.py", "h/s/.d.py"}
    assert got["h/r/test_b.py"].num_test_cases == 1
    (root / "h/r/new.py").write_text("x = 1\n")
    run_labelling(spark, str(root), table, hostname="n")
    run_metrics(spark, str(root), table, target)
    assert tables.read_table(spark, target, CODE_METRICS).count() == 4


def test_stream_resumes(spark, tmp_path):
    manifests, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first = spark.createDataFrame([(f"f{i}.py", "def f(): pass") for i in range(20)], "file_path string, content string")
    first.repartition(4).write.parquet(manifests)
    run = lambda: measure_stream(spark, manifests, target, checkpoint, files_per_batch=1).awaitTermination()
    run()
    assert measured(spark, target).count() == 20
    # One known file, one new file, listed twice.
    more = spark.createDataFrame(
        [("f3.py", "def f(): pass"), ("g.py", "x = 1"), ("g.py", "x = 1")], "file_path string, content string")
    more.coalesce(1).write.mode("append").parquet(manifests)
    run()
    run()
    got = [r.file_path for r in measured(spark, target).collect()]
    assert len(got) == 21 and set(got) == {f"f{i}.py" for i in range(20)} | {"g.py"}


def _append(spark, folder, rows):
    df = spark.createDataFrame(rows, "file_path string, content string")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_measures_changes_and_forgets_old_paths(spark, tmp_path):
    manifests, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    run = lambda keep: measure_stream(spark, manifests, target, checkpoint, keep_seconds=keep).awaitTermination()
    history = lambda: sorted((r.file_path, r.lines_of_code) for r in measured(spark, target, history=True).collect())
    for lines in ("x = 1\n", "x = 1\n", "x = 1\ny = 2\n", "x = 1\n"):
        _append(spark, manifests, [("a.py", lines), ("b.py", "z = 1\n"), ("c.txt", None)])
        run(3600)
    # Listed four times, changed twice; the others passed once.
    assert history() == [("a.py", 1), ("a.py", 1), ("a.py", 2), ("b.py", 1), ("c.txt", -1)]
    assert {r.file_path: r.lines_of_code for r in measured(spark, target).collect()} == {"a.py": 1, "b.py": 1, "c.txt": -1}
    time.sleep(0.2)
    _append(spark, manifests, [("b.py", "z = 1\n")])
    run(0.1)  # not listed for longer than that: passes like a new file
    assert len(history()) == 6 and history()[-3:-1] == [("b.py", 1), ("b.py", 1)]


def test_stream_state_costs_by_buckets_and_cores_not_by_paths_and_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "STATE_BUCKETS", 7)
    manifests, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "40")
    try:
        for turn in range(3):  # every fifth file changes, and changes back
            rows = [(f"f{k}.py", "x = 1\n" * (1 + (k % 5 == 0 and turn == 1))) for k in range(300)]
            _append(spark, manifests, [*rows, (f"new{turn}.py", None)])
            query = measure_stream(spark, manifests, target, checkpoint)
            query.awaitTermination()
            state = query.lastProgress["stateOperators"][0]
            assert state["numRowsTotal"] == 7 and state["numShufflePartitions"] <= 2 * spark.sparkContext.defaultParallelism
            assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    found = sorted((r.file_path, r.batch_id, r.lines_of_code) for r in measured(spark, target, history=True).collect())
    wanted = [(f"f{k}.py", 0, 1) for k in range(300)] + [(f"f{k}.py", t, 3 - t) for k in range(0, 300, 5) for t in (1, 2)]
    assert found == sorted(wanted + [(f"new{t}.py", t, -1) for t in range(3)])


def test_stream_entries_of_a_bucket_expire_alone():
    class State:
        exists = hasTimedOut = False

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.due = self.now + ms

    state, step = State(), progress._changes(100)

    def at(now, *paths, late=False):
        state.now, state.hasTimedOut = now, late
        rows = pd.DataFrame({"file_path": list(paths), "content_digest": "d", "manifest": "m", "listed": now})
        return [p for frame in step((0,), iter([] if late else [rows]), state) for p in frame["file_path"]]

    assert at(0, "a") == ["a"] and at(60, "b") == ["b"] and state.due == 100
    assert at(101, late=True) == [] and state.exists and state.due == 160
    assert at(110, "a", "b") == ["a"]
    assert at(211, late=True) == [] and not state.exists


def test_stream_replays_a_batch_into_its_own_folder(spark, tmp_path):
    """A batch that failed after its write runs again with the same rows."""
    manifests, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    _append(spark, manifests, [(f"f{k}.py", "x = 1") for k in range(9)])
    measure_stream(spark, manifests, target, checkpoint).awaitTermination()
    for name in os.listdir(tmp_path / "ckpt" / "commits"):  # the commit of the batch was lost
        os.remove(tmp_path / "ckpt" / "commits" / name)
    measure_stream(spark, manifests, target, checkpoint).awaitTermination()
    got = [(r.file_path, r.batch_id) for r in measured(spark, target, history=True).collect()]
    assert sorted(got) == [(f"f{k}.py", 0) for k in range(9)]


def test_stream_of_digests_reads_contents_afterwards(spark, tmp_path):
    root = tmp_path / "repos"
    _tree(root)
    listed = digest_files(list_tree(spark, str(root)), str(root)).select("file_path", "content_digest")
    listed.write.parquet(str(tmp_path / "in"))
    asked = []

    def read(wanted):
        asked.extend(r.file_path for r in wanted.collect())
        parts = F.split("file_path", "/", 3)
        return read_contents(
            wanted.select(parts[0].alias("host"), parts[1].alias("repo"), parts[2].alias("rel_path"), F.lit(1).alias("size")), str(root))

    measure_stream(spark, *(str(tmp_path / n) for n in ("in", "out", "ckpt")), read=read).awaitTermination()
    got = {r.file_path: r.num_test_cases for r in measured(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"h/r/a.py", "h/r/test_b.py", "h/r/c.txt", "h/s/.d.py"} and got["h/r/test_b.py"] == 1
    assert sorted(asked) == ["h/r/a.py", "h/r/test_b.py", "h/s/.d.py"]


def test_no_content_moves_before_the_state(spark, tmp_path):
    """The plan of a batch exchanges paths and digests only."""
    manifests, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    _append(spark, manifests, [("a.py", "x = 1")])
    query = measure_stream(spark, manifests, target, checkpoint)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("content#" in line.replace("content_digest#", "") for line in moved)
    below = plan[plan.index("Exchange"):]
    assert "content#" not in below[: below.index("sha2")].replace("content_digest#", "")


def test_few_contents_are_python_objects_at_a_time():
    rows = [(f"f{k}.py", f"x{k} = 1\n" + "# " + "y" * 20_000) for k in range(1500)] + [("n.py", None), ("t.txt", "x = 1")]
    batch = pa.RecordBatch.from_pylist([{"file_path": p, "content": c} for p, c in rows])
    plain = [metrics.file_metrics(p, c) for p, c in rows]
    tracemalloc.start()
    try:
        found = [r for part in metrics._measure(iter([batch])) for r in part.select(["file_path", "lines_of_code"]).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [{k: r[k] for k in ("file_path", "lines_of_code")} for r in plain]
    assert peak < 8 << 20  # the contents take 30 MB


def test_every_different_content_is_parsed_once(spark, tmp_path):
    rows = [(f"{k}.py", f"def test_{k % 3}(): pass") for k in range(30)] + [(f"e{k}.py", "") for k in range(20)]
    rows += [("n.py", None), ("t.txt", "def test_0(): pass"), ("bad.py", "def ("), ("bad2.py", "def (")]
    files = spark.createDataFrame(rows, "file_path string, content string").repartition(4)
    listed, read = content_metrics.listing(files), content_metrics.contents_of(files)
    assert content_metrics.parse_contents(listed, read).count() == 5  # three tests, empty, broken
    plain = {r.file_path: tuple(r) for r in metrics.code_metrics(files).collect()}
    found = content_metrics.measure_listed(listed, read)
    assert {r.file_path: tuple(r)[:-1] for r in found.collect()} == plain
    known = content_metrics.known_contents(found)
    fresh = files.unionByName(spark.createDataFrame([("new.py", "y = 1"), ("copy.py", "")], files.schema))
    assert content_metrics.parse_contents(content_metrics.listing(fresh), content_metrics.contents_of(fresh), known).count() == 1
    again = content_metrics.measure_listed(content_metrics.listing(fresh), content_metrics.contents_of(fresh), known)
    assert again.count() == len(rows) + 2


def test_a_hot_digest_is_looked_up_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    rows = [(f"e{k}.py", "") for k in range(300)] + [(f"{k}.py", f"x = {k}") for k in range(40)]
    files = spark.createDataFrame(rows, "file_path string, content string").repartition(4)
    found = content_metrics.measure_listed(content_metrics.listing(files), content_metrics.contents_of(files))
    assert {r.file_path: tuple(r)[:-1] for r in found.collect()} == {r.file_path: tuple(r) for r in metrics.code_metrics(files).collect()}


def test_a_changed_file_of_a_tree_is_measured_again(spark, tmp_path):
    root, table, target = tmp_path / "repos", str(tmp_path / "labels"), str(tmp_path / "metrics")
    _tree(root)
    run_labelling(spark, str(root), table, hostname="n")
    for _ in range(2):
        run_metrics(spark, str(root), table, target)
    assert tables.read_table(spark, target, CODE_METRICS).count() == 3
    (root / "h/r/a.py").write_text("def f(): pass\n\n\ny = 2\n")
    (root / "h/s/.d.py").write_bytes(b"x = '\xe9'\n")  # cannot be read as text any more
    for _ in range(2):
        run_metrics(spark, str(root), table, target)
    assert tables.read_table(spark, target, CODE_METRICS).count() == 5
    now = {r.file_path: r for r in current_metrics(spark, str(root), target).collect()}
    assert now["h/r/a.py"].lines_of_code == 4 and len(now) == 3
    assert now["h/s/.d.py"].analysis_error == "Could not parse file: h/s/.d.py"


def test_stream_skips_files_measured_elsewhere(spark, tmp_path):
    listed = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "x = 1")], "file_path string, content string")
    listed.write.parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("a.py",)], "file_path string")
    measure_stream(spark, *(str(tmp_path / n) for n in ("in", "out", "ckpt")), done=done).awaitTermination()
    assert [r.file_path for r in measured(spark, str(tmp_path / "out")).collect()] == ["b.py"]


def test_api_bodies(spark):
    pages = spark.createDataFrame(
        [("o/r", '{"items":[{"name":"a","path":"test/a"},{"name":"b","path":"t/b"}]}'),
         ("o/r", '{"items":[]}'), ("o/r", '{"message":"limit"}'), ("o/s", "not json")],
        "repo string, body string")
    got = {r.repo: r for r in api_json.test_counts(pages).collect()}
    assert (got["o/r"].testfilecount, got["o/r"].bad_pages) == (2, 1)
    assert (got["o/s"].testfilecount, got["o/s"].bad_pages) == (0, 1)
    commits = spark.createDataFrame(
        [("a", '[{"sha":"1","html_url":"u"},{"sha":"2"}]'), ("b", "[]"), ("c", '[{"html_url":"u"}]')],
        "repo string, body string")
    latest = {r.repo: (r.sha, r.html_url) for r in api_json.latest_commits(commits).collect()}
    assert latest == {"a": ("1", "u"), "b": (None, None), "c": (None, None)}
    body = '{"data":{"repository":{"languages":{"edges":[{"node":{"name":"Java"},"size":9},{"node":{"name":"C"},"size":1}]}}}}'
    edges = spark.createDataFrame([("a", 200, body), ("b", 401, "denied")], "repo string, status int, body string")
    out = {r.repo: r for r in api_json.language_edges(edges).collect()}
    assert out["a"].languages == {"Java": 9, "C": 1} and out["a"].error is None
    assert out["b"].error == "Query failed to run by returning code of 401. denied"


def test_tables(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, str(tmp_path / "none"), CODE_METRICS)
    assert tables.read_table(spark, str(tmp_path / "none"), CODE_METRICS).count() == 0
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "n long, s string")
    tables.write_snapshot(df, str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), df.schema).collect())) == [
        (1, 'a "q", b'), (2, None)]


def test_repeated_language_keeps_the_last(rows):
    def body(*pairs):
        edges = ",".join('{"node":{"name":"%s"},"size":%d}' % p for p in pairs)
        return '{"data":{"repository":{"languages":{"edges":[%s]}}}}' % edges

    responses = rows(
        [("a", 200, body(("C", 1), ("Go", 2), ("C", 3))), ("b", 200, body()), ("c", 200, "{}")],
        "repo string, status int, body string",
    )
    out = {r.repo: r.languages for r in api_json.language_edges(responses).collect()}
    assert out == {"a": {"C": 3, "Go": 2}, "b": {}, "c": None}
