import pytest

from forgeatlas.functions.labels import FIXED_NODES
from forgeatlas.operators import rdf
from forgeatlas.plans import flow
from forgeatlas.sources import ntriples

BASE = "https://projects.test/p/"


def _enriched(spark):
    data, row = [], 0
    plan = [("big.org", 12, "successful", 3, 5), ("big.org", 4, "failed", 0, -1),
            ("small.org", 3, "successful", 0, 0), ("pytest", 11, "successful", 0, 2000),
            ("bigger.org", 20, None, 0, -1)]
    for host, n, status, junit, tests in plan:
        for _ in range(n):
            data.append((row, host, False, False, status, tests, junit, 0, 0))
            row += 1
    data += [(row, "big.org", False, True, None, -1, 0, 0, 0), (row + 1, None, True, True, None, -1, 0, 0, 0)]
    return spark.createDataFrame(
        data,
        "row_id long, repodomain string, duplicate_flag boolean, incomplete_url_flag boolean, "
        "clone_status string, testfilecountlocal long, JUnit_file_patterns long, "
        "pytest_file_patterns long, Mocha_file_patterns long",
    )


def test_flow_graph(spark):
    nodes, links = flow.flow_graph(_enriched(spark))
    ids = {r.label: r.node_id for r in nodes.collect()}
    assert [ids[label] for label in FIXED_NODES] == list(range(15))
    # Big hosts by size; the host named like a fixed node shares it.
    assert ids["bigger.org"] == 15 and ids["big.org"] == 16 and len(ids) == 17
    names = {v: k for k, v in ids.items()}
    got = {(names[r.source], names[r.target]): r.value for r in links.collect()}
    assert got == {
        ("Original Data", "bigger.org"): 20,
        ("Original Data", "big.org"): 17,
        ("Original Data", "pytest"): 11,
        ("Original Data", "Domains with < 10 Repos"): 3,
        ("Original Data", "Duplicates"): 1,
        ("big.org", "Repos Cloned"): 12,
        ("big.org", "Repos not Cloned"): 4,
        ("big.org", "Incomplete URLs"): 1,
        ("pytest", "Repos Cloned"): 11,
        ("Domains with < 10 Repos", "Repos Cloned"): 3,
        ("Repos Cloned", "JUnit"): 12,
        ("Repos Cloned", "No test runner detected"): 14,
        ("JUnit", "1 - 9 test files"): 12,
        ("No test runner detected", "0 test files"): 3,
        ("No test runner detected", "More than 1000 test files"): 11,
    }


def test_flow_without_small_hosts(spark):
    df = _enriched(spark).filter("repodomain = 'big.org'")
    nodes, links = flow.flow_graph(df)
    assert {(r.source, r.target): r.value for r in links.collect()}[(0, 1)] == 0


def _row(spark, **changes):
    values = dict.fromkeys(rdf.ROW_COLUMNS, None) | {
        "projectref": "P1", "repourl": "https://x/a/b", "duplicate_flag": False,
        "testfilecountlocal": -1, "explanation": 'a "quoted"\nline \\ end', "repodomain": "httpd.org",
    } | changes
    kinds = {c: "boolean" if c.endswith(("_flag", "_scheme")) else "string" for c in rdf.ROW_COLUMNS}
    kinds["testfilecountlocal"] = "long"
    schema = "row_id long, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    return spark.createDataFrame([(0, *(values[c] for c in rdf.ROW_COLUMNS))], schema)


def test_row_triples(spark):
    got = {r.p.rsplit("/", 1)[1]: r for r in rdf.row_triples(_row(spark), BASE).collect()}
    assert set(got) == {"projectref", "repourl", "duplicate_flag", "explanation", "repodomain"}
    assert got["repourl"].o_kind == "uri" and got["repourl"].o_datatype is None
    # The test is on the text, so a host that starts with "http" is linked too.
    assert got["repodomain"].o_kind == "uri"
    assert got["duplicate_flag"].o == "false" and got["duplicate_flag"].o_datatype == rdf.XSD_STRING
    assert got["projectref"].s == BASE + "P1"


def test_only_the_number_stands_for_not_counted(spark):
    row = _row(spark, explanation="-1", repourl="-1", testfilecountlocal=-1)
    got = {r.p.removeprefix(BASE): r.o for r in rdf.row_triples(row, BASE).collect()}
    assert got["explanation"] == got["repourl"] == "-1" and "testfilecountlocal" not in got
    assert rdf.row_documents(row, BASE).first().value.count('"-1"') == 2


def test_rows_with_bad_uri_are_rejected(spark):
    bad = _row(spark, repourl="https://x/a b/c")
    assert rdf.row_triples(bad, BASE).count() == 0
    assert rdf.row_documents(bad, BASE).count() == 0
    assert [r.row_id for r in rdf.rejected_rows(bad).collect()] == [0]
    text = _row(spark, repourl="ftp://x/a b/c")
    assert rdf.rejected_rows(text).count() == 0


def test_missing_rdf_column(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        rdf.row_triples(spark.createDataFrame([(1,)], "row_id long"), BASE)


def test_documents_read_back_as_the_same_statements(spark, tmp_path):
    df = _row(spark).unionByName(_row(spark, projectref=None, last_commit_hash="tab\there"))
    path = str(tmp_path / "rdf")
    rdf.row_documents(df, BASE).select("value").write.text(path)
    columns = ["s", "p", "o", "o_kind", "o_datatype"]
    expected = rdf.row_triples(df, BASE).select(columns).collect()
    got = ntriples.read_ntriples(spark, path).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)
    assert ntriples.malformed_lines(spark, path).count() == 0
    lines = rdf.ntriples(rdf.row_triples(df, BASE))
    assert {r.value for r in lines.collect()} <= {r.value for r in spark.read.text(path).collect()}


def test_observations(spark):
    df = spark.createDataFrame(
        [("c1", "manual", 10), ("c1", "manual", 10), ("c2", "GitShell", 9)],
        "CommitHash string, MethodUsed string, TestFileCount long",
    )
    triples = rdf.observation_triples(df, "https://github.com/o/r/")
    assert triples.count() == 12
    assert rdf.statement_count(triples).first().statements == 8
    counts = triples.filter("o_datatype is not null").select("s", "o", "o_datatype").distinct()
    assert sorted(map(tuple, counts.collect())) == [
        ("https://github.com/o/r/c1/manual", "10", rdf.XSD_INTEGER),
        ("https://github.com/o/r/c2/GitShell", "9", rdf.XSD_INTEGER),
    ]


def test_ntriples_escapes(spark, tmp_path):
    path = tmp_path / "x.nt"
    path.write_text(
        '# comment\n\n<http://a> <http://b> "caf\\u00e9 \\"q\\" \\\\n"@fr .\n'
        '_:x <http://b> <http://c> . # end\n<http://a> <http://b> "1"^^<http://t> .\nbroken line\n'
        '<http://a> <http://b> "\\U0001F600 \\\\U0001F600 \\U00000041" .\n'
    )
    got = ntriples.read_ntriples(spark, str(path), skip_malformed=True).collect()
    tagged = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
    assert [(r.s, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in got] == [
        ("http://a", 'caf\u00e9 "q" \\n', "literal", tagged, "fr"),
        ("_:x", "http://c", "uri", None, None),
        ("http://a", "1", "literal", "http://t", None),
        ("http://a", "\U0001f600 \\U0001F600 A", "literal", rdf.XSD_STRING, None),
    ]
    with pytest.raises(Exception, match="not a statement: broken line"):
        ntriples.read_ntriples(spark, str(path)).collect()
    assert ntriples.malformed_lines(spark, str(path)).count() == 1
