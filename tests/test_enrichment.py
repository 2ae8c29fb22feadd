import pytest
from pyspark.sql import functions as F

from forgeatlas.functions import labels
from forgeatlas.operators import enrich, files, lookup as lookup_module, runners
from forgeatlas.operators.lookup import lookup
from forgeatlas.plans import enrichment
from forgeatlas.plans.enrichment import failure_log, run_enrichment
from forgeatlas.sources import tree

FLAGS = (
    "duplicate_flag boolean, null_value_flag boolean, unsupported_url_scheme boolean, "
    "incomplete_url_flag boolean, base_repo_url_flag boolean, repourl string, "
    "testfilecountlocal long, clone_status string, last_commit_hash string"
)


@pytest.mark.parametrize(
    "row, expected",
    [
        ((True, True, True, True, True, None, -1, "failed", None),
         "Row is marked as a duplicate of another entry."),
        ((False, True, True, True, None, None, -1, "failed", None),
         "Row contains null values."),
        ((False, False, False, False, False, "https://code.test/team/tool", 3, "successful", "0a1b"),
         "No issues detected."),
        ((False, False, False, False, None, "https://code.test/team/tool", -1, None, None),
         "Clone status unknown."),
        ((False, False, False, True, None, "https://github.com/o", -1, None, None),
         "URL is incomplete; missing 1 parts (expects protocol, domain, and path)."),
        ((False, False, False, True, None, "https://x.org/a/b", -1, None, None),
         "No issues detected."),
        ((False, False, False, False, True, "https://x.org/a/b", -1, None, None),
         "Unable to extract base repository URL."),
        ((False, False, False, False, False, "https://x.org/a/b", -1, "failed", None),
         "Repository clone failed."),
        ((False, False, False, False, False, "https://x.org/a/b", -1, "successful", None),
         "Test files could not be counted. | Last commit hash could not be retrieved."),
    ],
)
def test_explanations(rows, row, expected):
    assert enrich.add_explanations(rows([row], FLAGS)).first().explanation == expected


def test_explanations_without_columns(rows):
    out = enrich.add_explanations(rows([], "x int"))
    assert "explanation" in out.columns and out.count() == 0


def _files(rows, paths, content=None):
    data = [("h", "r", p, (content or {}).get(p)) for p in paths]
    return files.with_path_parts(
        rows(data, "host string, repo string, rel_path string, content string")
    )


def test_test_file_predicate(rows):
    df = _files(rows, ["src/TestUtil.c", "tests/a.png", "tests/a.PNG", "src/main.c", "test"])
    listed = {r.rel_path for r in files.list_test_files(df).collect()}
    assert listed == {"src/TestUtil.c", "tests/a.PNG", "test"}
    assert files.count_test_files(df).first().testfilecountlocal == 3


def test_runner_evidence(rows):
    names = ["FooTest.javac", "test_a.pyc", "test_happy", "x/test_a_test.py", "mytest_a.py", "a.js",
             "pom.xml", "m/pom.xml", "package.json", "pytest.ini"]
    content = {
        "pom.xml": "junit:junit org.junit.jupiter:junit-jupiter", "m/pom.xml": "mocha",
        "package.json": "mocha", "a.js": "mocha", "pytest.ini": "junit:junit",
    }
    row = runners.detect_test_runners(_files(rows, names, content)).first()
    assert row.JUnit_file_patterns == 1
    assert row.pytest_file_patterns == 4  # test_a.pyc, test_happy, twice test_a_test.py
    assert row.Mocha_file_patterns == 0
    assert (row.JUnit_config_files, row.pytest_config_files, row.Mocha_config_files) == (2, 1, 1)
    assert (row.JUnit_dependency_patterns, row.Mocha_dependency_patterns) == (2, 1)


def test_rules_are_data(rows):
    rules = [runners.RunnerRules("Mocha", file_patterns=("test/.*.js",), match_on="rel_path")]
    df = _files(rows, ["test/a.js", "src/a.js"])
    assert runners.detect_test_runners(df, rules).first().Mocha_file_patterns == 1


@pytest.mark.parametrize(
    "counts, expected",
    [((0, 0, 0), "No test runner detected"), ((2, 2, 0), "JUnit"), ((0, 2, 2), "pytest"),
     ((0, 0, 1), "Mocha")],
)
def test_primary_runner(rows, counts, expected):
    df = rows([counts], "a long, b long, c long")
    assert df.select(labels.primary_runner(F.col("a"), F.col("b"), F.col("c"))).first()[0] == expected


def test_count_buckets(rows):
    values = [-1, 0, 1, 9, 10, 99, 100, 999, 1000, None]
    df = rows([(i, v) for i, v in enumerate(values)], "i int, n long")
    bucket = labels.count_bucket(F.col("n"))
    out = df.select("i", bucket.alias("b"), labels.bucket_ordinal(bucket).alias("o")).orderBy("i")
    numbers = [None, 0, 1, 1, 2, 2, 3, 3, 4, None]
    assert [r.o for r in out.collect()] == numbers
    assert [r.b for r in out.collect()] == [n if n is None else labels.BUCKETS[n] for n in numbers]


@pytest.mark.parametrize(
    "bound, limit, parts",
    [("BROADCAST_ROWS", 0, 1), ("BROADCAST_BYTES", 1, 1000), ("BROADCAST_ROWS", 4, 1)],
)
def test_lookup_matches_a_plain_join(rows, monkeypatch, bound, limit, parts):
    """Hot, missing and unmatched keys, answered from either side of the split."""
    monkeypatch.setattr(lookup_module, "HOT_PARTS", parts)
    monkeypatch.setattr(lookup_module, bound, limit)
    keys = ["hot"] * 300 + ["warm"] * 50 + [f"k{i}" for i in range(40)] + [None] * 100
    left = rows([(i, k) for i, k in enumerate(keys)], "row_id long, key string")
    known = {"hot": 1, "warm": 2, "k3": 3, "k4": None}
    right = rows(list(known.items()), "key string, v long")
    out = lookup(left, right, "key", spread="row_id").collect()
    assert sorted((r.row_id, r.key, r.v) for r in out) == [
        (i, k, known.get(k)) for i, k in enumerate(keys)
    ]


def test_every_hot_key_is_found(spark, monkeypatch):
    monkeypatch.setattr(lookup_module, "HOT_PARTS", 3000)
    counts = spark.range(5000).selectExpr("id AS key", "100 + id % 3 AS n")
    assert lookup_module.frequent_keys(counts, "key").count() == 5000
    monkeypatch.setattr(lookup_module, "HOT_PARTS", 4)
    assert lookup_module.frequent_keys(counts, "key").count() == 0


def test_lookup_plan_depends_on_the_checked_size(rows, monkeypatch):
    left = rows([(0, "a")], "row_id long, key string")
    right = rows([("a", 1)], "key string, v long")

    def joins():
        df = lookup(left, right, "key", spread="row_id")
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")

    assert joins() == 1
    monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", 0)
    assert joins() == 2


def test_pending_and_write_back(rows):
    schema = "row_id long, repo_key string"
    keyed = rows([(0, "a/x"), (1, "a/x"), (2, "a/y"), (3, None)], schema)
    results = rows(
        [("a/x", 5, "sha", "successful"), ("a/y", -1, None, "failed")],
        "repo_key string, testfilecountlocal long, last_commit_hash string, clone_status string",
    )
    assert [r.row_id for r in enrich.pending(keyed, results).orderBy("row_id").collect()] == [2, 3]
    full = enrich.write_back(keyed, results).orderBy("row_id").collect()
    assert [r.testfilecountlocal for r in full] == [5, 5, -1, -1]
    assert [r.clone_status for r in full] == ["successful", "successful", "failed", None]


def _make_tree(root):
    content = {
        "github_com/app/.git/HEAD": b"ref", "github_com/app/pom.xml": b"<d>junit:junit</d>",
        "github_com/app/src/__init__.py": b"", "github_com/app/tests/FooTest.java": b"class A {}",
        "github_com/app/tests/deep/er/test_x.py": b"pass", "github_com/bin/raw.dat": b"\xff\xfe",
        "gitlab_com/lib/test_y.py": b"x = 1", "gitlab_com/lib/.mocharc.json": b"{}",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (root / "stray.txt").write_text("not in a repository")
    return content


@pytest.mark.parametrize("budget", [1, 3, 50_000])
def test_tree_listing(spark, tmp_path, budget):
    content = _make_tree(tmp_path)
    listing = tree.list_tree(spark, str(tmp_path), budget=budget).collect()
    found = {f"{r.host}/{r.repo}/{r.rel_path}": r.size for r in listing}
    assert found == {name: len(data) for name, data in content.items()}
    assert len(listing) == len(content)


def test_tree_contents(spark, tmp_path):
    _make_tree(tmp_path)
    listing = tree.list_tree(spark, str(tmp_path), skip_vcs=True)
    texts = {r.file_path: r for r in tree.read_contents(listing, str(tmp_path)).collect()}
    assert "github_com/app/.git/HEAD" not in texts
    assert texts["gitlab_com/lib/test_y.py"].content == "x = 1"
    assert texts["github_com/app/src/__init__.py"].content == ""
    bad = texts["github_com/bin/raw.dat"]
    assert bad.content is None and bad.read_error.startswith("UnicodeDecodeError")


def test_enrichment_pipeline(spark, tmp_path):
    _make_tree(tmp_path)
    clean = spark.createDataFrame(
        [
            (0, "https://github.com/o/app", "github.com", False),
            (1, "https://github.com/p/app.git", "github.com", False),
            (2, "https://example.org/o/none", "example.org", False),
            (3, "https://github.com/o/app", None, True),
        ],
        "row_id long, repourl string, repodomain string, duplicate_flag boolean",
    ).selectExpr(
        "*", "duplicate_flag as unsupported_url_scheme", "duplicate_flag as incomplete_url_flag",
        "false as null_value_flag", "cast(null as boolean) as base_repo_url_flag",
    )
    commits = spark.createDataFrame([("github_com/app", "abc")], "repo_key string, last_commit_hash string")
    out = run_enrichment(spark, clean, str(tmp_path), commits=commits).orderBy("row_id").collect()
    assert [r.testfilecountlocal for r in out] == [2, 2, -1, -1]
    assert [r.JUnit_dependency_patterns for r in out] == [1, 1, 0, 0]
    assert [r.last_commit_hash for r in out] == ["abc", "abc", None, None]
    assert [r.explanation for r in out] == [
        "No issues detected.", "No issues detected.", "Clone status unknown.",
        "Row is marked as a duplicate of another entry.",
    ]
    report = tmp_path / "report"
    run_enrichment(spark, clean, str(tmp_path), listing=str(report))
    lines = [line for part in sorted(report.glob("part-*")) for line in part.read_text().splitlines()]
    at = lines.index("Repository URL: https://github.com/o/app")
    assert len(lines[at + 1 : lines.index("", at)]) == 2  # its two test files, then an empty line
    assert "Repository URL: gitlab_com/lib" in lines and "test_y.py" in lines  # in no registry row
    failures = rows_of_failures(spark)
    failed = run_enrichment(spark, clean, str(tmp_path), failures=failures).orderBy("row_id").collect()
    assert [r.clone_status for r in failed] == ["successful", "successful", "failed", None]
    assert failed[2].explanation == "Repository clone failed."
    log = failure_log(clean, failures).orderBy("row_id").collect()
    assert [(r.row_id, r.error_message) for r in log] == [(0, "late"), (1, "late"), (2, "gone")]


def rows_of_failures(spark):
    return spark.createDataFrame(
        [("example_org/none", "gone"), ("example_org/none", "a"), ("github_com/app", "late"), (None, "x")],
        "repo_key string, error_message string",
    )


def test_enrichment_resumes(spark, tmp_path, monkeypatch):
    """A second run opens new and unfinished repositories only and keeps earlier results."""
    root, stored = tmp_path / "trees", str(tmp_path / "results")
    _make_tree(root)
    clean = spark.createDataFrame(
        [(0, "https://github.com/o/app", "github.com"), (1, "https://gitlab.com/o/lib", "gitlab.com"),
         (2, "https://github.com/o/late", "github.com")],
        "row_id long, repourl string, repodomain string",
    )
    opened = []

    def watched(*args, **kwargs):
        listing = tree.list_tree(*args, **kwargs)
        opened.append({f"{r.host}/{r.repo}" for r in listing.collect()})
        return listing

    monkeypatch.setattr(enrichment, "list_tree", watched)

    def run(*hashes):
        commits = spark.createDataFrame(list(hashes), "repo_key string, last_commit_hash string")
        out = run_enrichment(spark, clean, str(root), commits=commits, results=stored)
        return [(r.testfilecountlocal, r.last_commit_hash) for r in out.orderBy("row_id").collect()]

    app, lib = ("github_com/app", "abc"), ("gitlab_com/lib", "def")
    assert run(app) == [(2, "abc"), (1, None), (-1, None)]
    late = root / "github_com" / "late" / "test_z.py"
    late.parent.mkdir(parents=True)
    late.write_text("pass")
    (root / "gitlab_com" / "lib" / "test_more.py").write_text("pass")
    (root / "github_com" / "app" / "test_unseen.py").write_text("pass")
    assert run(lib, ("github_com/late", "ghi")) == [(2, "abc"), (2, "def"), (1, "ghi")]
    assert run() == [(2, "abc"), (2, "def"), (1, "ghi")]
    assert opened == [{"github_com/app", "gitlab_com/lib"}, {"gitlab_com/lib", "github_com/late"}, set()]


def test_odd_names_and_unreadable_folders(spark, tmp_path):
    import os

    home = tmp_path / "host" / "repo"
    home.mkdir(parents=True)
    with open(os.path.join(os.fsencode(home), b"caf\xe9.py"), "wb") as file:
        file.write(b"x = 1")
    files_ = tree.list_tree(spark, str(tmp_path))
    assert [(r.rel_path, r.size) for r in files_.collect()] == [("caf\\xe9.py", 5)]
    assert [r.content for r in tree.read_contents(files_, str(tmp_path)).collect()] == ["x = 1"]
    walked = list(tree._walk_item(str(tmp_path), "host", "gone", "", 10, False))
    assert walked == [("error", "host", "gone", "", 0)]
    assert tree.list_tree(spark, str(tmp_path), kind="error").count() == 0
    with pytest.raises(ValueError):
        tree.list_tree(spark, "hdfs://shared/trees")
    assert tree.local_root("file:///a/b") == tree.local_root("file:/a/b") == "/a/b"
