"""Quality rules with risk-controlled cutoffs. Columns only, no Python on the rows.

Every rule compares one share or mean of a text with a cutoff from a fixed grid. A *setting*
gives every rule its cutoff; settings are ordered from lenient to strict, so what one rejects
the next rejects too. For each stratum (by number of words) the good documents among the
labelled ones that a setting would reject, by any rule, are counted. With n good documents of
which k are rejected, the chance of seeing at most k if the true rate were ``RISK`` is an
exact binomial tail; a setting passes if this chance is at most ``ERROR`` divided by the
number of strata. Settings are tested in their fixed order and the first that does not pass
ends the test, so no correction within the order is needed: with confidence 1 - ``ERROR`` no
stratum loses more than the share ``RISK`` of its good documents to all rules together. The
strictest setting that passed is used; where none passes the rules are silent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.llm.columns import let
from forgeatlas.llm.common import pick, store, table

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
RISK = 0.02
ERROR = 0.05
# Lower ends of the strata after the first, in words.
STRATA = (100, 500)
SHARES = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)
# Rule: value above the cutoff rejects; cutoffs from strict to lenient.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": SHARES,
    "upper_share": (0.05, 0.08, 0.12, 0.2, 0.3, 0.5),
    "bang_share": SHARES,
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.15),
    "mean_word": (8.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
# Joint settings, from lenient (0) to strict; a rule goes through its grid in even steps.
SETTINGS = 9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five that occurs twice or more. Windows are compared by
    a 64-bit hash of their words; texts without a repeated one need no sort."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda s: let(places(s), covered))

    def places(s: Column) -> Column:
        again = F.filter(
            s,
            lambda e, k: F.coalesce(e["x"] == F.get(s, k - 1)["x"], F.lit(False))
            | F.coalesce(e["x"] == F.get(s, k + 1)["x"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated(h)))
    return F.when(F.size(words) < WINDOW, none).otherwise(counted)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs`` (null text: no words)."""
    rows = pick(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    words = F.array_remove(F.split(text, SPLIT), "")
    by_word = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SOLID))
    by_line = let(
        lines,
        lambda a: F.struct(
            F.size(a).cast("long").alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        ),
    )
    size = F.length(text).cast("long")
    counted = rows.select(
        "doc_id",
        by_word.alias("w"),
        by_line.alias("l"),
        _without(text, SPACES).alias("word_chars"),
        (size - _without(text, SYMBOLS)).alias("n_symbols"),
        (size - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (size - _without(text, "!")).alias("n_bangs"),
    )
    return counted.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_bangs")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
    }


def _stratum() -> Column:
    out = F.lit(0)
    for edge in STRATA:
        out = out + (F.col("n_words") >= edge).cast("int")
    return out


def binomial_tail(k: int, n: int, rate: float) -> float:
    """Exact P(X <= k) for n trials, summed from k downwards until terms no longer matter."""
    if k >= n:
        return 1.0
    log = lambda i: (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(rate) + (n - i) * math.log1p(-rate)
    )
    if k > n * rate:
        return 1.0 - binomial_tail_above(k, n, rate)
    total, term = 0.0, math.exp(log(k))
    for i in range(k, -1, -1):
        total += term
        term *= i * (1 - rate) / ((n - i + 1) * rate)
        if term < total * 1e-17:
            break
    return min(1.0, total)


def binomial_tail_above(k: int, n: int, rate: float) -> float:
    """P(X > k), for k above the mean."""
    log = math.lgamma(n + 1) - math.lgamma(k + 2) - math.lgamma(n - k)
    term = math.exp(log + (k + 1) * math.log(rate) + (n - k - 1) * math.log1p(-rate))
    total = 0.0
    for i in range(k + 1, n + 1):
        total += term
        term *= (n - i) * rate / ((i + 1) * (1 - rate))
        if term < total * 1e-17:
            break
    return min(1.0, total)


def cutoff(rule: str, setting: int) -> float:
    """Cutoff of a rule in a joint setting."""
    grid = RULES[rule]
    return grid[round((SETTINGS - 1 - setting) * (len(grid) - 1) / (SETTINGS - 1))]


def _passed() -> Column:
    """Number of settings, from the most lenient on, that keep the text."""
    values, out = _values(), F.lit(0)
    for setting in range(SETTINGS):
        kept = F.lit(True)
        for rule in RULES:
            kept = kept & (values[rule] <= cutoff(rule, setting))
        out = out + kept.cast("int")
    return out


def select_settings(
    measured: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR
) -> dict[int, int]:
    """Strictest setting per stratum that passes, from all labelled documents.

    ``labels`` has ``doc_id, quality``; a document with several labels counts as good only
    if all are 1, and once however often its row is repeated (by the strictest verdict on
    its rows). One count per stratum and setting comes to the driver."""
    good = (
        labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
        .filter("q = 1").select("doc_id")
    )
    judged = measured.filter(~base_failed()).select("doc_id", _stratum().alias("stratum"), _passed().alias("passed"))
    counts = (
        judged.join(good, "doc_id").groupBy("doc_id").agg(F.min(F.struct("passed", "stratum")).alias("x"))
        .groupBy("x.stratum", "x.passed").count().collect()
    )
    chosen = {}
    for stratum in range(len(STRATA) + 1):
        held = {c["passed"]: c["count"] for c in counts if c["stratum"] == stratum}
        n = sum(held.values())
        for setting in range(SETTINGS):
            rejected = sum(x for passed, x in held.items() if passed <= setting)
            if not n or binomial_tail(rejected, n, risk) > error / (len(STRATA) + 1):
                break
            chosen[stratum] = setting
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row with ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rule; repeated rows and null keys
    come back as they are (a null key is never labelled); without labels no setting
    passes and the base rule alone decides; an empty table gives an empty table; other
    columns are not looked at. Texts are read once; the counts are stored, because selection
    and decision both need them.
    """
    measured = store(measures(docs, id_col=id_col, text_col=text_col), "measures")
    chosen = select_settings(measured, labels)
    rejected = F.lit(False)
    for stratum, setting in sorted(chosen.items()):
        rejected = rejected | ((_stratum() == stratum) & (_passed() <= setting))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", *COUNTS, "base_failed", "kept")
