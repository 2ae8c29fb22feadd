"""Tables that are updated in place: only buckets with different rows are replaced."""

import os

import pytest
from pyspark.sql import functions as F

from forgeatlas.plans.analysis import update_labels
from forgeatlas.schemas import GUESSED_LANGUAGES, LABELLED_CONTENT
from forgeatlas.sources.bucket_table import BucketTable
from pyspark.sql.types import StructType

FIELDS = "id long, file_path string, guessed_language string, date_created timestamp, date_updated timestamp"


def day(n):
    return F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp")


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL(FIELDS)).create(8)


def rows_of(spark, pairs, n):
    df = spark.createDataFrame([(k, p, v) for k, (p, v) in enumerate(pairs)], "id long, file_path string, guessed_language string")
    return df.withColumns({"date_created": day(n), "date_updated": day(n)})


def files(table):
    found = {}
    for folder, _, names in os.walk(f"{table.path}/rows"):
        for name in names:
            if name.endswith(".parquet"):
                found[os.path.basename(folder), name] = os.stat(os.path.join(folder, name)).st_mtime_ns
    return found


def state(table):
    return {r.file_path: (r.guessed_language, r.date_created.day, r.date_updated.day) for r in table.read().collect()}


def test_only_changed_buckets_are_replaced(spark, table):
    assert table.read().count() == 0
    first = [(f"f{k}", "C") for k in range(200)]
    assert table.upsert(rows_of(spark, first, 1), now=day(1)) == 8
    before = files(table)
    assert len(before) == 8 and len(state(table)) == 200
    assert table.upsert(rows_of(spark, first, 2), now=day(2)) == 0
    assert files(table) == before  # the same input again writes nothing
    update = [("f7", "Go"), ("f8", "C"), ("f9", None)]
    bucket = {r.file_path: r.b for r in table.read().select("file_path", table.bucket().alias("b")).collect()}
    assert table.upsert(rows_of(spark, update, 3), now=day(4)) == len({bucket["f7"], bucket["f9"]})
    after = files(table)
    touched = {f"bucket={bucket[p]}" for p in ("f7", "f9")}
    assert {k: v for k, v in after.items() if k[0] not in touched} == {k: v for k, v in before.items() if k[0] not in touched}
    got = state(table)
    assert got["f7"] == ("Go", 1, 4) and got["f9"] == (None, 1, 4) and got["f8"] == ("C", 1, 1)
    assert sum(v == ("C", 1, 1) for v in got.values()) == 198
    assert table.upsert(rows_of(spark, [("new", "C"), ("new", "Go")], 5), now=day(6)) == 1
    assert state(table)["new"] == ("Go", 5, 5) and len(state(table)) == 201
    assert table.upsert(rows_of(spark, [], 5)) == 0
    with pytest.raises(Exception, match="without file_path"):
        table.upsert(rows_of(spark, [(None, "C")], 5))


def test_only_folders_of_wanted_buckets_are_opened(spark, table):
    table.upsert(rows_of(spark, [(f"f{k}", "C") for k in range(100)], 1), now=day(1))
    some = table.read([2, 5])
    assert 0 < some.count() < 100
    names = {r.n.split("bucket=")[1].split("/")[0] for r in some.select(F.input_file_name().alias("n")).distinct().collect()}
    assert names == {"2", "5"}


def test_another_number_of_buckets(spark, table, tmp_path):
    table.upsert(rows_of(spark, [(f"f{k}", "C") for k in range(50)], 1), now=day(1))
    other = table.rebucket(str(tmp_path / "other"), 3)
    assert state(other) == state(table) and len(files(other)) == 3
    assert other.upsert(rows_of(spark, [("f3", "C")], 2)) == 0
    assert BucketTable(spark, other.path, other.columns).create(99)._buckets() == 3  # made once


def test_labels_of_a_tree_follow_its_files(spark, tmp_path):
    root, path = tmp_path / "repos", str(tmp_path / "labels")
    for name, text in {"h/r/a.py": "x = 1", "h/r/b": "#!/bin/sh\n", "h/r/c": "words", "h/s/d.c": "int x;"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    labels = lambda: {r.file_path: r.guessed_language for r in BucketTable(spark, path, LABELLED_CONTENT).read().collect()}
    assert update_labels(spark, str(root), path, hostname="n", now=day(1), buckets=16) > 1
    assert labels() == {"h/r/a.py": "Python", "h/r/b": "Shell", "h/r/c": "Unknown", "h/s/d.c": "C"}
    assert update_labels(spark, str(root), path, hostname="m", now=day(2)) == 0
    (root / "h/r/c").write_text("#!/usr/bin/python\n")
    (root / "h/s/e.go").write_text("package x")
    assert update_labels(spark, str(root), path, hostname="m", now=day(3)) in (1, 2)
    assert labels() == {"h/r/a.py": "Python", "h/r/b": "Shell", "h/r/c": "Python", "h/s/d.c": "C", "h/s/e.go": "Go"}
    rows = {r.file_path: r for r in BucketTable(spark, path, LABELLED_CONTENT).read().collect()}
    assert (rows["h/r/c"].date_created.day, rows["h/r/c"].date_updated.day) == (1, 3)
    assert (rows["h/r/a.py"].date_updated.day, rows["h/r/a.py"].hostname) == (1, "n")
    assert len({r.id for r in rows.values()}) == 5 and set(GUESSED_LANGUAGES.names) < set(rows["h/r/c"].asDict())
