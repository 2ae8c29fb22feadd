import pytest
from pyspark.sql import functions as F

from forgeatlas.operators import hosts, registry
from forgeatlas.operators.order import fill_by_row_id, number_rows
from forgeatlas.plans import inputs
from forgeatlas.plans.cleaning import clean_rows, run_cleaning
from forgeatlas.sources import reports, tsv

from conftest import TESTDATA

FLAGGED = "repourl string, duplicate_flag boolean"


def test_missing_column(rows):
    other = rows([("x",)], "other_column string")
    for step in (
        registry.get_base_repo_url,
        registry.mark_incomplete_urls,
        registry.convert_http_to_https,
    ):
        with pytest.raises(ValueError):
            step(other)


@pytest.mark.parametrize(
    "data, hosts_, flags",
    [
        (
            [
                ("git://code.test/team/tool", False),
                ("https://www.plain.test", False),
                ("rsync://files.test/x", False),
                (None, False),
            ],
            ["code.test", "www.plain.test", None, None],
            [False, False, True, True],
        ),
        (
            [
                ("rsync://files.test/team/tool", True),
                ("https://code.test/team/tool", True),
                ("https://code.test/team/tool", False),
            ],
            [None, None, "code.test"],
            [True, True, False],
        ),
    ],
)
def test_host_flags(rows, data, hosts_, flags):
    df = rows([(i, *r) for i, r in enumerate(data)], "i int, " + FLAGGED)
    out = registry.extract_and_flag_domains(df).orderBy("i").collect()
    assert [r.repodomain for r in out] == hosts_
    assert [r.unsupported_url_scheme for r in out] == flags


@pytest.mark.parametrize(
    "url, unsupported, expected",
    [
        ("https://code.test/team/tool", False, False),
        ("https://code.test/team/tool", True, True),
        ("https://code.test/team", False, True),
        ("https://code.test", False, True),
        ("", False, True),
        (None, False, True),
        ("https://code.test/team?x=y", False, True),
        ("https://code.test/a b/c'd", False, False),
    ],
)
def test_incomplete(rows, url, unsupported, expected):
    df = rows([(url, False, unsupported)], FLAGGED + ", unsupported_url_scheme boolean")
    assert registry.mark_incomplete_urls(df).first().incomplete_url_flag is expected


def test_duplicates_and_nulls(rows):
    data = [
        (0, "P", "p", "https://x/a/b"), (1, "P", "p", "https://x/a/b"),
        (2, "P", "p", "HTTPS://x/a/b"), (3, "P", "p", None), (4, "P", "p", None),
        (5, "P", "p", "http://x/a/b"),
    ]
    df = rows(data, "row_id long, projectref string, projectpage string, repourl string")
    out = registry.mark_null_values(registry.mark_duplicates(df)).orderBy("row_id").collect()
    assert [r.duplicate_flag for r in out] == [False, True, False, False, True, False]
    # A duplicate with a missing value is not marked as such.
    assert [r.null_value_flag for r in out] == [False, False, False, True, False, False]


def _brute_fill(data):
    last, out = None, []
    for _, a, b, u in data:
        if a is not None:
            last = (a, b)
        out.append((*(last or (None, None)), u))
    return out


@pytest.mark.parametrize("bits, super_bits", [(0, 0), (0, 4), (2, 1), (5, 2), (20, 12)])
def test_fill_and_duplicates_over_many_blocks(rows, bits, super_bits):
    """Blocks far smaller than the runs of continuation rows and of copies."""
    data = []
    for i in range(400):
        header = i in (3, 4, 90, 391)
        url = "https://hot/a/b" if i % 3 else f"https://x/a/{i % 40}"
        data.append((i, f"P{i}" if header else None, f"p{i}" if header else None, url))
    df = rows(data, "row_id long, projectref string, projectpage string, repourl string")
    df = df.repartition(7)
    filled = fill_by_row_id(df, ["projectref", "projectpage"], bits=bits, super_bits=super_bits)
    flagged = registry.mark_duplicates(filled).orderBy("row_id").collect()
    expected = _brute_fill(data)
    assert [(r.projectref, r.projectpage, r.repourl) for r in flagged] == expected
    seen, repeats = set(), []
    for row in expected:
        repeats.append(row in seen)
        seen.add(row)
    assert [r.duplicate_flag for r in flagged] == repeats


def test_numbering_is_dense_and_ordered(rows):
    df = rows([(i * 7 % 100, i) for i in range(100)], "k long, v long")
    out = number_rows(df, [F.desc("k")], "n").collect()
    assert sorted((r.n, r.k) for r in out) == [(i, 99 - i) for i in range(100)]


def _write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_ragged_lines(spark, tmp_path):
    path = _write(tmp_path, "r.tsv", "A\tpa\tu1\nu2\n\t\tu3\n\nB\tpb\tu4\n")
    out = tsv.read_registry(spark, path).orderBy("row_id").collect()
    assert [tuple(r) for r in out] == [
        (0, "A", "pa", "u1"), (1, "A", "pa", "u2"), (2, "A", "pa", "u3"),
        (3, "A", "pa", ""), (4, "B", "pb", "u4"),
    ]


def test_first_line_without_project(spark, tmp_path):
    path = _write(tmp_path, "r.tsv", "u0\nA\tpa\tu1\n")
    out = tsv.read_registry(spark, path).orderBy("row_id").collect()
    assert tuple(out[0]) == (0, None, None, "u0")


def test_bad_width(spark, tmp_path):
    path = _write(tmp_path, "r.tsv", "A\tpa\tu1\nB\tpb\n")
    with pytest.raises(Exception, match="Unexpected number of columns: 2"):
        tsv.read_registry(spark, path).collect()
    assert [r.fields for r in tsv.bad_lines(spark, path).collect()] == [2]


def test_split_file_keeps_its_order(spark, tmp_path):
    lines, expected, last = [], [], (None, None)
    for i in range(3000):
        if i % 701 == 5:
            last = (f"P{i}", f"p{i}")
            lines.append(f"P{i}\tp{i}\tu{i}")
        else:
            lines.append(f"u{i}")
        expected.append((i, *last, f"u{i}"))
    path = _write(tmp_path, "big.tsv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        out = tsv.read_registry(spark, path).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in out] == expected


def test_files_of_a_folder(spark, tmp_path):
    _write(tmp_path, "a.tsv", "A\tpa\tu1\nu2\n")
    _write(tmp_path, "b.tsv", "u3\nB\tpb\tu4\n")
    separate = tsv.read_registry(spark, str(tmp_path)).orderBy("row_id").collect()
    one = tsv.read_registry(spark, str(tmp_path), continuous=True).orderBy("row_id").collect()
    assert [r.row_id for r in separate] == [r.row_id for r in one] == [0, 1, 2, 3]
    assert separate[2].projectref is None and one[2].projectref == "A"


def test_rectangular(spark, tmp_path):
    path = _write(tmp_path, "t.tsv", 'A\tpa\tu1\n\t\t\n\n\t\t"u 3"\nB\tpb\n')
    out = tsv.read_rectangular(spark, path).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("A", "pa", "u1"), ("A", "pa", None), ("A", "pa", "u 3"), ("B", "pb", None),
    ]
    single = tsv.read_rectangular(spark, _write(tmp_path, "s.tsv", "u1\nu2\n"), columns=1)
    assert [tuple(r) for r in single.orderBy("row_id").collect()] == [
        (0, None, None, "u1"), (1, None, None, "u2")
    ]
    with pytest.raises(ValueError):
        tsv.read_rectangular(spark, path, columns=2)


def test_invariants(spark):
    raw = inputs.registry(spark, TESTDATA)
    clean = clean_rows(raw)
    assert clean.count() == raw.count()
    wrong = clean.filter(
        (F.col("duplicate_flag") & ~(F.col("unsupported_url_scheme") & F.col("incomplete_url_flag")))
        | (
            F.col("base_repo_url").isNotNull()
            & (F.col("duplicate_flag") | F.col("unsupported_url_scheme") | F.col("incomplete_url_flag"))
        )
    )
    assert wrong.count() == 0


def test_buckets_with_a_hot_host(spark, tmp_path):
    data = [(i, "https://hot.org/a/b" if i % 3 else f"https://h{i % 60}.org/a/b") for i in range(600)]
    df = spark.createDataFrame(data, "row_id long, repourl string").selectExpr(
        "*", "split(repourl, '/')[2] as repodomain"
    )
    counts = {r.repodomain: r.n for r in hosts.known_host_counts(df).collect()}
    out = hosts.with_bucket(df, min_rows=11).collect()
    assert len(out) == 600
    for row in out:
        own = counts[row.repodomain] >= 11
        assert row.bucket == (row.repodomain.replace(".", "_") if own else "other_domains")
    folder = str(tmp_path / "hosts")
    reports.write_per_host(df, folder, min_rows=11, rows_per_file=50)
    stored = spark.read.parquet(folder)
    assert stored.count() == 600 and "repodomain" not in stored.columns
    hot_files = list((tmp_path / "hosts" / "bucket=hot_org").glob("*.parquet"))
    assert len(hot_files) >= 8


def test_report(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, None), (1, "b.org"), (2, "a.org"), (3, "a.org"), (4, "c.org")],
        "row_id long, repodomain string",
    )
    folder = str(tmp_path / "report")
    reports.write_host_report(df, folder)
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.splitlines() == [
        "Count of repositories for each domain:", "a.org: 2", "b.org: 1", "c.org: 1", "None: 0"
    ]


def test_cleaning_pipeline(spark, tmp_path):
    lines = ["A\thttps://page/A\thttp://github.com/o/r/", "+https://github.com/o/r/issues",
             "https://github.com/o", "B\thttps://page/B\tftp://x/y/z", "ftp://x/y/z"]
    path = _write(tmp_path, "in.tsv", "\n".join(lines))
    clean = run_cleaning(spark, path, str(tmp_path / "out")).orderBy("row_id").collect()
    assert [r.base_repo_url for r in clean] == [
        "https://github.com/o/r", "https://github.com/o/r", None, None, None
    ]
    assert [r.duplicate_flag for r in clean] == [False] * 4 + [True]
    assert spark.read.parquet(str(tmp_path / "out/by_host")).count() == 3


def test_rectangular_fills_each_column(spark, tmp_path):
    path = _write(tmp_path, "r.tsv", "A\tpa\tu1\nB\t\tu2\n\t\tu3\n\tpc\tu4\n")
    out = tsv.read_rectangular(spark, path).orderBy("row_id").collect()
    assert [(r.projectref, r.projectpage, r.repourl) for r in out] == [
        ("A", "pa", "u1"), ("B", "pa", "u2"), ("B", "pa", "u3"), ("B", "pc", "u4")]
    for line in ("B\tpb\tu2\t\tE", "C\tpc\tu3\t", "C\tpc\tu3\tX"):
        with pytest.raises(Exception, match="Unexpected number of columns"):
            tsv.read_rectangular(spark, _write(tmp_path, f"w{len(line)}.tsv", line + "\n")).collect()
