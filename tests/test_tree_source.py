"""The tree as a data source: rows of the plain listing, and folders that are not opened."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains

from forgeatlas.sources import tree_source
from forgeatlas.sources.tree import list_tree


@pytest.fixture
def root(tmp_path):
    for host in ("a", "b", "c"):
        for repo in ("x", "y"):
            for name in ("m.py", "src/k.c", "src/deep/.hidden", "src/deep/z.tar.gz", "dot."):
                file = tmp_path / host / repo / name
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(name)
    (tmp_path / "loose").write_text("no host")
    return str(tmp_path)


def opened(reader, monkeypatch):
    """Folders that are opened by planning and reading, and the rows."""
    seen, real = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: seen.append(os.path.relpath(path, reader.root)) or real(path))
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    monkeypatch.undo()
    return set(seen), rows


def test_folders_that_cannot_match_are_not_opened(root, monkeypatch):
    everything, rows = opened(tree_source.TreeReader(root), monkeypatch)
    assert len(everything) == 1 + 3 + 6 * 3 and len(rows) == 30
    reader = tree_source.TreeReader(root)
    other = StringContains(("rel_path",), "z")
    assert list(reader.pushFilters([EqualTo(("host",), "b"), In(("repo",), ["y", "q"]), EqualTo(("suffix",), ".c"), other])) == [other]
    some, rows = opened(reader, monkeypatch)
    assert some == {".", "b", "b/y", "b/y/src", "b/y/src/deep"}
    assert [(r["host"], r["repo"], r["rel_path"], r["size"]) for r in rows] == [("b", "y", "src/k.c", 7)]
    none = tree_source.TreeReader(root)
    assert list(none.pushFilters([EqualTo(("host",), "b"), EqualTo(("host",), "c")])) == []
    assert opened(none, monkeypatch) == ({"."}, [])


def test_rows_are_those_of_the_listing(spark, root):
    columns = ["host", "repo", "rel_path", "dir", "name", "suffix", "size"]
    plain = list_tree(spark, root).select(columns)
    found = tree_source.scan_tree(spark, root, slices=3).select(columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    wanted = (F.col("host") != "a") & F.col("suffix").isin(".py", ".gz") & F.col("rel_path").contains("deep")
    assert sorted(map(tuple, found.filter(wanted).collect())) == sorted(map(tuple, plain.filter(wanted).collect()))
    assert found.filter("host = 'nowhere'").count() == 0
    plan = found.filter("host = 'b' AND size > 3")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("host" in line and "= b" in line for line in filters), plan
