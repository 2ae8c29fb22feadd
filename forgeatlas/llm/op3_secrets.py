"""Secret scans: fixed patterns, and a battery of randomness tests. Columns only, no Python.

The battery looks at unbroken strings of 20 or more characters with a digit. From the
characters of a string an encoding is inferred, which gives the alphabet of k symbols:
hexadecimal (also in groups with hyphens), base 32, base 36 (digits and letters of one case)
or base 64. A string with ``=``, ``/``, ``_``, ``+`` or ``-`` is also cut at these, as a value
may stand behind a name or in a path: at ``=`` only, then at more of them. Every part of 20 or
more characters with an encoding is tested like a whole string; a string and its parts count
as one test, and of accepted ones that lie inside each other the outermost is listed. Three tests ask whether
the string may be random: chi-squared uniformity over the alphabet, the number of runs
above and below the middle of the alphabet, and the correlation of neighbours. A string
that fails one of them (beyond ``LIMIT`` standard deviations) is no secret.

That alone would let short ordinary strings pass, for which the tests have no power. So
each string also has a p-value against structured text: the number of equal pairs of
characters would be Poisson with the coincidence rate of such text (``TEXT_RATE``); few equal pairs
are evidence of randomness, and the more pairs (the longer the string) the stronger. The
p-values of all strings of the corpus are held against Benjamini-Hochberg thresholds per
stratum of encoding and length, from a histogram of powers of two: at most ``FDR`` of the
added spans of a stratum are expected to be ordinary strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.columns import let, match_spans, running
from forgeatlas.llm.common import fresh, pick, table

# Fixed values of the base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_CHARS = 12
# Runs of the class are maximal, so a shorter run holds no match and no part of one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Tried only where a run begins: a run is searched for its digit once, however long it is.
STRING = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
# No group is repeated in any pattern: the matcher would recurse once for each repetition.
# Encodings in the order in which they are tried: name, pattern, symbols in order, text rate.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Cut at more and more of the characters that join names, paths and values.
PARTS = ("[^=]{20,}", "[^=/]{20,}", "[^=/_]{20,}", "[^=/_+-]{20,}")
MIXED = r"^(?=.*[A-Za-z])(?=.*[0-9])"
TEXT_RATE = 0.066
ENCODINGS = (
    ("hex", MIXED + r"([0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6], 2 / 16),
    ("base32", MIXED + r"[A-Z2-7]+=*$", UPPER + DIGITS[2:8], TEXT_RATE),
    ("base36", MIXED + r"[a-z0-9]+$", DIGITS + LOWER, TEXT_RATE),
    ("base64", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*$", UPPER + LOWER + DIGITS + "+/", TEXT_RATE),
    ("upper36", MIXED + r"[A-Z0-9]+$", DIGITS + UPPER, TEXT_RATE),
    ("groups", MIXED + r"(?=.*-)(?!-)(?!.*--)([0-9a-f-]+|[0-9A-F-]+)(?<!-)$", DIGITS + LOWER[:6], 2 / 16),
)
GROUPS = len(ENCODINGS) - 1
LIMIT = 3.3
FDR = 0.01
# Upper ends of the length strata.
LENGTHS = (24, 32, 48, 64, 128)
BINS = 64
MASK = "[SECRET]"
_TESTED = "array<struct<start:bigint,stop:bigint,stratum:int,bin:int,counted:boolean>>"


def _encoding(text: Column) -> Column:
    """Number of the encoding, null if none fits."""
    chosen = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        chosen = F.when(text.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(chosen)
    return chosen


def _by_encoding(code: Column, values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), code)


def _tested(span: Column) -> Column:
    """Stratum and bin (whole powers of two of the p-value) of a string; bin -1 if a test
    of randomness fails or there is no encoding."""

    def statistics(code: Column) -> Column:
        symbols = F.when(code == 0, F.lower(span["found"])).otherwise(span["found"])
        symbols = F.translate(F.rtrim(F.translate(symbols, "=", " ")), "-_", "+/")
        symbols = F.when(code == GROUPS, F.lower(F.translate(span["found"], "-", ""))).otherwise(symbols)
        alphabet = _by_encoding(code, [e[2] for e in ENCODINGS])
        size = _by_encoding(code, [float(len(e[2])) for e in ENCODINGS])
        rate = _by_encoding(code, [e[3] for e in ENCODINGS])
        return let(symbols, lambda s: let(alphabet, lambda a: numbers(s, a, size, rate, code)))

    def numbers(s: Column, alphabet: Column, k: Column, rate: Column, code: Column) -> Column:
        n = F.length(s).cast("double")
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda got, c: got + F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)),
        )
        values = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(values, lambda v: let(squares, lambda q: verdict(v, q, n, k, rate, code)))

    def verdict(v: Column, squares: Column, n: Column, k: Column, rate: Column, code: Column) -> Column:
        total = lambda of: F.aggregate(of, F.lit(0.0), lambda a, x: a + x)
        chi = k * squares / n - n
        freedom = k - 1
        spread = 2.0 / (9.0 * freedom)
        uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        high = F.transform(v, lambda x: (x >= k / 2).cast("int"))
        ones = total(F.transform(high, lambda h: h.cast("double")))
        runs = let(
            high,
            lambda h: 1.0 + total(F.transform(h, lambda x, i: F.when((i > 0) & (x != F.get(h, i - 1)), 1.0).otherwise(0.0))),
        )
        both = 2.0 * ones * (n - ones)
        wanted = both / n + 1
        noise = both * (both - n) / (n * n * (n - 1))
        runs_z = F.when(noise > 0, (runs - wanted) / F.sqrt(noise)).otherwise(F.lit(99.0))
        mean = total(v) / n
        variance = total(F.transform(v, lambda x: (x - mean) * (x - mean)))
        product = total(F.transform(v, lambda x, i: F.when(i > 0, (x - mean) * (F.get(v, i - 1) - mean)).otherwise(0.0)))
        serial_z = F.when(variance > 0, product / variance * F.sqrt(n)).otherwise(F.lit(99.0))
        # Poisson lower tail (Wilson-Hilferty), then an upper bound of the normal tail.
        pairs = (squares - n) / 2 + 1
        expected = rate * n * (n - 1) / 2
        z = (F.pow(expected / pairs, F.lit(1 / 3)) - 1 + 1 / (9 * pairs)) * 3 * F.sqrt(pairs)
        bits = (z * z / 2 + F.log(z * math.sqrt(2 * math.pi))) / math.log(2)
        evidence = F.least(F.when(z > 1, F.floor(bits)).otherwise(F.lit(0)), F.lit(BINS - 1)).cast("int")
        random = (uniform < LIMIT) & (F.abs(runs_z) < LIMIT) & (F.abs(serial_z) < LIMIT)
        band = F.lit(0)
        for edge in LENGTHS:
            band = band + (n > edge).cast("int")
        stratum = (code * (len(LENGTHS) + 1) + band).cast("int")
        return F.struct(
            span["start"].alias("start"),
            span["stop"].alias("stop"),
            stratum.alias("stratum"),
            F.when(random, evidence).otherwise(F.lit(-1)).cast("int").alias("bin"),
        )

    return let(_encoding(span["found"]), statistics)


def _with_parts(span: Column) -> Column:
    """A string, and what it is cut into, as ``array<struct<start, stop, found>>``."""

    def of(s: Column, base: Column) -> Column:
        return F.struct(
            (base + s["start"]).alias("start"), (base + s["stop"]).alias("stop"), s["found"].alias("found")
        )

    whole = F.array(of(span, F.lit(0).cast("long")))
    parts = [F.transform(match_spans(span["found"], p), lambda m: of(m, span["start"])) for p in PARTS]
    return F.when(span["found"].rlike("[=/_+-]"), F.array_distinct(F.concat(whole, *parts))).otherwise(whole)


def _of_run(span: Column) -> Column:
    """Tested candidates of one string: itself and its parts, as far as they have an encoding.

    They overlap, so they are one test and not several: the p-value of the best of m is
    multiplied by m (its bin loses the binary logarithm of m, rounded up), and only the first
    best one is counted for the thresholds."""
    candidates = F.filter(_with_parts(span), lambda s: _encoding(s["found"]).isNotNull())

    def adjusted(rows: Column) -> Column:
        loss = F.ceil(F.log2(F.size(rows).cast("double"))).cast("int")
        bins = F.transform(rows, lambda s: F.when(s["bin"] > 0, F.greatest(s["bin"] - loss, F.lit(0))).otherwise(s["bin"]))
        return let(
            bins,
            lambda b: F.transform(
                rows,
                lambda s, k: F.struct(
                    s["start"].alias("start"), s["stop"].alias("stop"), s["stratum"].alias("stratum"),
                    F.get(b, k).alias("bin"), (F.array_position(b, F.array_max(b)) == k + 1).alias("counted"),
                ),
            ),
        )

    return let(F.transform(candidates, _tested), adjusted)


def tested_strings(text: Column) -> Column:
    """``array<struct<start, stop, stratum, bin, counted>>`` of the strings and parts with an
    encoding."""
    strings = F.flatten(F.transform(match_spans(text, STRING), _of_run))
    return F.when(text.rlike(STRING), strings).otherwise(F.array().cast(_TESTED))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, stop>>`` of the fixed patterns; kind is a number."""

    def of(spans: Column, kind: int) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))
        )

    assign = F.filter(match_spans(text, ASSIGN, 2), lambda s: F.length(s["part"]) >= ASSIGN_CHARS)
    return F.concat(of(assign, 0), of(match_spans(text, ACCESS), 1), of(match_spans(text, HEX), 2))


def thresholds(docs: DataFrame, *, text_col: str = "text") -> dict[int, int]:
    """Smallest bin that is accepted, per stratum, from the strings of all documents.

    One count per stratum and bin comes to the driver: at most 36 x 65 rows."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    strings = docs.select(F.explode(tested_strings(text)).alias("s"))
    counts = strings.filter("s.counted").groupBy("s.stratum", "s.bin").count().collect()
    accepted = {}
    for stratum in {c["stratum"] for c in counts}:
        held = {c["bin"]: c["count"] for c in counts if c["stratum"] == stratum}
        tests, found = sum(held.values()), 0
        for at in reversed(range(BINS)):
            found += held.get(at, 0)
            if found and tests * 2.0**-at <= FDR * found:
                accepted[stratum] = at
    return accepted


def _outermost(spans: Column) -> Column:
    """Without the spans that lie inside others."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"))))

    def keep(held: Column) -> Column:
        ends = running(F.transform(held, lambda s: -s["back"]), 0, lambda a, b: F.greatest(a, b))
        return let(ends, lambda before: F.filter(held, lambda s, k: -s["back"] > F.get(before, k)))

    return F.transform(let(ordered, keep), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("stop")))


def secret_spans(text: Column, accepted: dict[int, int]) -> Column:
    """All spans as ``array<struct<start, kind, stop>>``, by start, then kind."""
    added = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    if accepted:
        levels = F.create_map(*(F.lit(x) for pair in sorted(accepted.items()) for x in pair))
        strings = F.filter(
            tested_strings(text), lambda s: s["bin"] >= F.coalesce(F.try_element_at(levels, s["stratum"]), F.lit(BINS))
        )
        added = F.transform(
            _outermost(strings), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["stop"].alias("stop"))
        )
    return F.sort_array(F.concat(base_spans(text), added))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, secrets``: all spans of every whole text as ``array<struct<start, kind, stop>>``
    in code points, end exclusive; ``kind`` counts along ``KINDS``.

    A null text counts as empty and has no spans; repeated rows and null keys come back as
    they are; spans of different kinds may overlap or be equal; an empty table gives an empty
    table; other columns are not looked at. The documents are read twice (thresholds, then
    spans) and never shuffled.
    """
    rows = pick(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", secret_spans(F.col("text"), thresholds(rows)).alias("secrets"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MASK``; overlapping spans become
    one. Null texts stay null; all columns and rows are kept."""
    text = F.col(f"`{text_col}`")
    name = fresh(docs, "_secrets")
    marked = docs.withColumn(name, secret_spans(F.coalesce(text, F.lit("")), thresholds(docs, text_col=text_col)))

    def build(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["stop"]), 0, lambda a, b: F.greatest(a, b))

        def parts(before: Column) -> Column:
            kept = F.transform(
                spans,
                lambda s, k: F.when(
                    (k == 0) | (s["start"] >= F.get(before, k)),
                    F.concat(
                        F.substr(text, (F.get(before, k) + 1).cast("int"), (s["start"] - F.get(before, k)).cast("int")),
                        F.lit(MASK),
                    ),
                ).otherwise(F.lit("")),
            )
            rest = F.substr(text, (F.element_at(before, -1) + 1).cast("int"))
            return F.concat(F.array_join(kept, ""), rest)

        return let(ends, parts)

    clean = F.when(F.size(name) > 0, build(F.col(name))).otherwise(text)
    return marked.withColumn(text_col, F.when(text.isNotNull(), clean)).drop(name)


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("secrets")).alias("spans"),
    )
