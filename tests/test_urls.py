import pytest
from pyspark.sql import functions as F

from forgeatlas.functions import text, urls
from forgeatlas.operators import registry


def evaluate(rows, function, values):
    df = rows([(i, v) for i, v in enumerate(values)], "i int, u string")
    out = df.select("i", function(F.col("u")).alias("v")).orderBy("i").collect()
    return [r.v for r in out]


def check(rows, function, pairs):
    got = evaluate(rows, function, [p[0] for p in pairs])
    assert got == [p[1] for p in pairs]


def test_host(rows):
    check(rows, urls.host, [
        ("https://plain.test", "plain.test"),
        ("http://sub.plain.test/p/q", "sub.plain.test"),
        ("git://code.test/team/tool", "code.test"),
        ("sftp://files.test/x", None),
        ("data:text/plain,x", None),
        ("https:///only/a/path", None),
        ("", None),
        (None, None),
        ("HTTPS://User@Host.ORG:8080/x", "host.org"),
        ("https://a@b@c.org/x", "c.org"),
        ("https://[::1]:80/x", "::1"),
        ("https://my_host.org/a b", "my_host.org"),
        ("https://h.org?x=1", "h.org"),
        ("https://h.org#x", "h.org"),
        ("  http://sp.org/x", "sp.org"),
        ("https://[abc/x", None),
        ("no-scheme.org/x", None),
    ])


def test_completeness(rows):
    check(rows, urls.is_complete, [
        ("git://code.test/team/tool", True),
        ("https://code.test/team/tool/tree/main", True),
        ("https://code.test/team", False),
        ("https://code.test/", False),
        ("code.test/team/tool", False),
        ("", False),
        (None, False),
    ])


def test_trim(rows):
    check(rows, urls.trim_url, [
        ("++https://x/a//", "https://x/a"),
        ("+ https://x/a \t", "https://x/a"),
        ("\u00a0https://x/a\u2003", "https://x/a"),
        ("https://x/a/ ", "https://x/a/"),
        (None, None),
    ])


def test_scheme_upgrade(rows):
    check(rows, urls.upgrade_scheme, [
        ("http://code.test/a", "https://code.test/a"),
        ("https://code.test/a", "https://code.test/a"),
        ("svn://code.test/a", "svn://code.test/a"),
        ("http-x", "https-x"),
        ("httpx", "httpx"),
        ("http\u00e9", "http\u00e9"),
        ("", ""),
    ])


def test_canonical(rows):
    check(rows, urls.canonical_scheme, [
        ("http://www.github.com/a", "https://github.com/a"),
        ("https://github.com/a?u=http://www.x", "https://github.com/a?u=https://x"),
    ])


def test_owner_and_repo(rows):
    check(rows, urls.owner_and_repo, [
        ("https://github.com/o/r/issues", "o/r"),
        ("https://github.com/o/r", "o/r"),
        ("https://github.com/o", ""),
        ("https://gitlab.com/o/r", None),
        (None, None),
    ])


def test_names(rows):
    check(rows, text.stem, [
        ("mes.git", "mes"), (".git", ".git"), ("a.tar.gz", "a.tar"),
        ("site.github.io", "site.github"), ("foo.", "foo."), ("plain", "plain"),
    ])
    check(rows, text.suffix, [
        ("a.py", ".py"), (".git", ""), ("foo.", ""), ("a.tar.gz", ".gz"), ("A.PNG", ".PNG"),
    ])
    check(rows, urls.repo_name, [("https://x.org/git/mes.git", "mes")])


def test_sanitise(rows):
    check(rows, text.sanitise_name, [
        ("kept_as-it-is_09", "kept_as-it-is_09"),
        ("two words", "two_words"),
        ("code.team.test", "code_team_test"),
        ("a/b:c", "a_b_c"),
        ("~?", "__"),
        ("", ""),
        ("\u00fcber\u4e2d", "\u00fcber\u4e2d"),
    ])


def test_sanitise_rejects_non_text(rows):
    with pytest.raises(TypeError):
        text.with_sanitised(rows([(1,)], "n int"), "n", "out")


# One case per branch: on a forge the first two segments are the repository, with more on
# hosts that nest, and any depth where the host is its own.
BASE_URLS = [
    ("https://github.com/team/tool", "https://github.com/team/tool"),
    ("https://github.com/team/tool/pull/7", "https://github.com/team/tool"),
    ("https://github.com/team/tool.git", "https://github.com/team/tool.git"),
    ("https://github.com/team/tool.git#top", "https://github.com/team/tool.git"),
    ("https://github.com/team/tool.git?tab=2", "https://github.com/team/tool.git"),
    ("https://gitlab.com/team/part/tool", "https://gitlab.com/team/part/tool"),
    ("https://codeberg.org/team", "https://codeberg.org/team"),
    ("https://code.test/team/tool/a/b/c", "https://code.test/team/tool"),
    ("http://code.test/team/tool/a", "http://code.test/team/tool"),
    ("https://h.org/a/b;v=1", "https://h.org/a/b"),
    ("git://h.org/a/b;v=1", "git://h.org/a/b;v=1"),
    ("HTTPS://U@H.org:80/a/b/c", "https://U@H.org:80/a/b"),
    ("https://h.org/a//b", "https://h.org/a/"),
    # Failures.
    (None, None),
    ("", None),
    ("https://github.com/team", None),
    ("https://code.test/", None),
    ("https://code.test", None),
]


def test_base_url(rows):
    df = rows(
        [(i, u, False, False, False) for i, (u, _) in enumerate(BASE_URLS)],
        "i int, repourl string, duplicate_flag boolean, unsupported_url_scheme boolean, "
        "incomplete_url_flag boolean",
    )
    out = registry.get_base_repo_url(df).orderBy("i").collect()
    assert [r.base_repo_url for r in out] == [b for _, b in BASE_URLS]
    assert [r.base_repo_url_flag for r in out] == [b is None for _, b in BASE_URLS]


def test_base_url_skips_flagged_rows(rows):
    df = rows(
        [("words only", False, True, False), ("https:///no/host", False, True, False)],
        "repourl string, duplicate_flag boolean, unsupported_url_scheme boolean, "
        "incomplete_url_flag boolean",
    )
    out = registry.get_base_repo_url(df).collect()
    assert [(r.base_repo_url, r.base_repo_url_flag) for r in out] == [(None, None)] * 2


def test_base_url_of_empty_table(rows):
    df = rows(
        [],
        "repourl string, duplicate_flag boolean, unsupported_url_scheme boolean, "
        "incomplete_url_flag boolean",
    )
    assert registry.get_base_repo_url(df).count() == 0
