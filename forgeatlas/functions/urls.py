"""URL expressions (B1-B11). All of them stay inside generated code; none is a UDF.

``parse_url`` is not used: it rejects spaces, quotes and underscores that the
registry contains and keeps the case of the host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgeatlas.functions.text import WORD, last_segment, sanitise_name, stem, strip

# What counts as a hosted repository URL.
EXPECTED_URL_PARTS = 5
SUPPORTED_SCHEMES = ["http", "https", "git"]
DIRECT_PATH_HOSTS = [
    "gitlab.com",
    "gitlab.torproject.org",
    "codeberg.org",
    "framagit.org",
    "hydrillabugs.koszko.org",
    "git.replicant.us",
    "gerrit.osmocom.org",
    "git.taler.net",
]
# Schemes whose last path segment may carry ";params" (Python's urllib.parse).
PARAM_SCHEMES = [
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
# End of fixed values.

_BLANK = r"[\x00-\x20]*"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_HOST = (
    rf"(?i)^{_BLANK}(?:{'|'.join(SUPPORTED_SCHEMES)})://(?:[^/?#]*@)?\[?"
    r"((?<=\[)[^\]/?#]*(?=\])|(?<!\[)[^:/?#\[\]]*(?=[:/?#]|\z))"
)


def trim_url(url: Column) -> Column:
    """B1: leading ``+``, then trailing ``/``, then outer white space."""
    return strip(strip_trailing_slash(F.ltrim(url, F.lit("+"))))


def strip_trailing_slash(url: Column) -> Column:
    """B4."""
    return F.rtrim(url, F.lit("/"))


def upgrade_scheme(url: Column) -> Column:
    """B2: a leading word ``http`` becomes ``https``."""
    return F.regexp_replace(url, rf"^http(?![{WORD}])", "https")


def canonical_scheme(url: Column) -> Column:
    """Every ``http(s)://`` with an optional ``www.`` becomes ``https://``."""
    return F.regexp_replace(url, r"https?://(www\.)?", "https://")


def parsable(url: Column) -> Column:
    """The URL without the characters the URL standard ignores anywhere in it.

    The functions below that read parts of a URL take this form. Leading blanks
    are skipped by their patterns.
    """
    ignored = url.contains("\n") | url.contains("\r") | url.contains("\t")
    return F.when(ignored, F.translate(url, "\t\r\n", "")).otherwise(url)


def scheme(clean: Column) -> Column:
    return F.lower(F.regexp_extract(clean, rf"^{_BLANK}({_SCHEME}):", 1))


def netloc(clean: Column) -> Column:
    return F.regexp_extract(clean, rf"^{_BLANK}(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(clean: Column) -> Column:
    """Path without outer slashes, query and fragment, and without ``;params`` where the
    scheme has them."""
    whole = rf"^{_BLANK}(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
    raw = F.regexp_extract(clean, whole, 1)
    with_params = rf"(?i)^{_BLANK}(?:(?:{'|'.join(PARAM_SCHEMES)}):|//|[^:]*\z)"
    has_params = clean.contains(";") & clean.rlike(with_params)
    kept = F.when(has_params, F.regexp_replace(raw, r";[^/]*\z", "")).otherwise(raw)
    return F.trim(kept, F.lit("/"))


def host_or_empty(clean: Column) -> Column:
    """Lower-cased host without user info and port, for supported schemes only.

    One pattern finds it: scheme, user info, then the text between brackets or up
    to the port. Unbalanced brackets give no host.
    """
    return F.lower(F.regexp_extract(clean, _HOST, 1))


def host(url: Column) -> Column:
    """Null instead of an empty host."""
    return F.nullif(host_or_empty(parsable(url)), F.lit(""))


def is_complete(url: Column) -> Column:
    """At least protocol, empty part, host and two path segments."""
    return F.coalesce(F.size(F.split(url, "/", -1)) >= EXPECTED_URL_PARTS, F.lit(False))


def is_direct(location: Column) -> Column:
    """The network location contains one of the hosts that use the whole path."""
    direct = location.contains(DIRECT_PATH_HOSTS[0])
    for name in DIRECT_PATH_HOSTS[1:]:
        direct = direct | location.contains(name)
    return direct


def owner_and_repo(url: Column) -> Column:
    """``owner/repo`` after the segment ``github.com``; empty if one of them is
    missing, null if the segment does not occur."""
    parts = F.split(url, "/", -1)
    at = F.array_position(parts, "github.com").cast("int")
    return F.when(
        at > 0,
        F.when(
            F.size(parts) >= at + 2, F.concat_ws("/", F.slice(parts, at + 1, F.lit(2)))
        ).otherwise(""),
    )


def repo_name(url: Column) -> Column:
    """Last segment without its last suffix."""
    return stem(last_segment(url))


def repo_key(domain: Column, url: Column) -> Column:
    """``<sanitised host>/<repo name>``, null when either part is unknown."""
    return F.concat(sanitise_name(domain), F.lit("/"), repo_name(url))
