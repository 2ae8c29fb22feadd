"""Quality rules and secret scans over whole tables, against plain versions."""

import hashlib
import math
import random
import re
from math import comb

import duckdb
import pytest

from forgeatlas.llm import op3_secrets, op6_rules

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def texts_of(folder):
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{folder}/documents.parquet'").fetchall()


# Rules -------------------------------------------------------------------------


def plain_values(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    return words, covered, {
        "symbol_share": share(len(re.findall(r"[#*$%&|<>]", text)), chars),
        "upper_share": share(len(re.findall("[A-Z]", text)), chars),
        "bang_share": share(text.count("!"), chars),
        "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "repeat_share": share(len(covered), len(words)),
        "mean_word": share(chars, len(words)),
    }


def test_kept_rows_are_those_of_a_plain_selection(spark):
    labels = dict(duckdb.sql(f"select doc_id, min(quality) from '{LARGER}/labels.parquet' group by 1").fetchall())
    facts = {}
    for key, text in texts_of(LARGER):
        words, covered, values = plain_values(text)
        base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        passed = sum(
            all(values[r] <= op6_rules.cutoff(r, s) for r in op6_rules.RULES) for s in range(op6_rules.SETTINGS)
        )
        facts[key] = (base, sum(len(words) >= edge for edge in op6_rules.STRATA), passed)
    chosen = {}
    for stratum in range(3):
        good = [p for k, (base, s, p) in facts.items() if labels.get(k) == 1 and not base and s == stratum]
        for setting in range(op6_rules.SETTINGS):
            lost = sum(p <= setting for p in good)
            tail = sum(comb(len(good), i) * 0.02**i * 0.98 ** (len(good) - i) for i in range(lost + 1))
            if not good or tail > 0.05 / 3:
                break
            chosen[stratum] = setting
    wanted = {k: not base and p > chosen.get(s, -1) for k, (base, s, p) in facts.items()}
    rows = op6_rules.op6_rules(spark, LARGER).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == wanted and chosen
    assert any(not r["kept"] and not r["base_failed"] for r in rows)


def test_settings_are_nested():
    for rule, grid in op6_rules.RULES.items():
        cuts = [op6_rules.cutoff(rule, s) for s in range(op6_rules.SETTINGS)]
        assert cuts == sorted(cuts, reverse=True) and (cuts[0], cuts[-1]) == (grid[-1], grid[0])


# Secrets -----------------------------------------------------------------------

PATTERNS = [(name, re.compile(p.replace("(?<!-)$", r"(?<!-)\Z")), symbols, rate) for name, p, symbols, rate in op3_secrets.ENCODINGS]


def plain_encoding(text):
    return next((k for k, (_, p, _, _) in enumerate(PATTERNS) if p.search(text)), None)


def plain_bin(text, code):
    """Battery and evidence of one string: (stratum, bin)."""
    _, _, alphabet, rate = PATTERNS[code]
    symbols = text.lower() if code == 0 else text
    symbols = symbols.rstrip("=").translate(str.maketrans("-_", "+/"))
    if code == op3_secrets.GROUPS:
        symbols = text.replace("-", "").lower()
    n, k = len(symbols), len(alphabet)
    v = [alphabet.find(c) for c in symbols]
    squares = sum(symbols.count(c) ** 2 for c in set(symbols))
    chi = max(k * squares / n - n, 0)
    spread = 2 / (9 * (k - 1))
    uniform = ((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    high = [x >= k / 2 for x in v]
    ones = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    both = 2 * ones * (n - ones)
    noise = both * (both - n) / (n * n * (n - 1))
    runs_z = (runs - both / n - 1) / math.sqrt(noise) if noise > 0 else 99
    mean = sum(v) / n
    variance = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / variance * math.sqrt(n) if variance > 0 else 99
    pairs, expected = (squares - n) / 2 + 1, rate * n * (n - 1) / 2
    z = ((expected / pairs) ** (1 / 3) - 1 + 1 / (9 * pairs)) * 3 * math.sqrt(pairs)
    bits = math.floor((z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(2)) if z > 1 else 0
    good = uniform < 3.3 and abs(runs_z) < 3.3 and abs(serial) < 3.3
    stratum = code * 6 + sum(n > edge for edge in (24, 32, 48, 64, 128))
    return stratum, min(bits, 63) if good else -1


def plain_runs(text):
    """Candidates of every string: lists of (start, stop, stratum, bin)."""
    out = []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if not re.search("[0-9]", run[0]):
            continue
        spans = [(run.start(), run.end(), run[0])]
        if re.search("[=/_+-]", run[0]):
            for part in op3_secrets.PARTS:
                spans += [(run.start() + m.start(), run.start() + m.end(), m[0]) for m in re.finditer(part, run[0])]
        found = []
        for span in dict.fromkeys(spans):
            code = plain_encoding(span[2])
            if code is not None:
                found.append((*span[:2], *plain_bin(span[2], code)))
        loss = math.ceil(math.log2(len(found))) if found else 0
        out.append([(a, b, s, max(x - loss, 0) if x > 0 else x) for a, b, s, x in found])
    return out


def plain_random_spans(texts):
    runs = {key: plain_runs(text) for key, text in texts}
    counts: dict = {}
    for held in runs.values():
        for found in held:
            if found:
                top = max(x for *_, x in found)
                stratum = next(s for _, _, s, x in found if x == top)
                counts.setdefault(stratum, []).append(top)
    levels = {}
    for stratum, bins in counts.items():
        for at in range(64):
            found = sum(x >= at for x in bins)
            if found and len(bins) * 2.0**-at <= 0.01 * found:
                levels[stratum] = at
                break
    out = {}
    for key, held in runs.items():
        good = sorted({(a, -b) for found in held for a, b, s, x in found if x >= levels.get(s, 64)})
        kept, reach = [], -1
        for a, back in good:
            if -back > reach:
                kept.append((a, -back))
                reach = -back
        out[key] = kept
    return out


def test_random_spans_are_those_of_a_plain_version(spark):
    rng = random.Random(7)
    texts = texts_of(FOLDER)
    for k in range(150):
        value = "".join(rng.choice(PATTERNS[k % 6][2]) for _ in range(rng.randrange(18, 90)))
        value = "-".join(value[i : i + 8] for i in range(0, len(value), 8)) if k % 6 == 5 else value
        other = "".join(rng.choice("abcde12") for _ in range(30))
        texts.append((10_000 + k, f"see {rng.choice(['', 'key_', 'a=', '/io/'])}{value}{rng.choice(['', '/' + other, '=' + value[::-1]])} end"))
    found = op3_secrets.find_secrets(spark.createDataFrame(texts, SCHEMA)).collect()
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["secrets"] if s["kind"] == 3] for r in found}
    assert got == plain_random_spans(texts)
    assert sum(map(len, got.values())) > 60


def test_secrets_query(spark):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    rows = {r["doc_id"]: r for r in op3_secrets.op3_secrets(spark, FOLDER).collect()}
    for key, text in texts_of(FOLDER):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        written = ",".join(f"{op3_secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert rows[key]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert rows[key]["n_assign"] == sum(k == 0 for _, k, _ in spans)


@pytest.mark.parametrize("unit,size", [
    ("0a1b-", 2_000_000), ("aB3+/", 2_000_000), ("0A1B-", 400_000), ("a1=", 400_000), ("0a1b_", 400_000),
    ("--1a", 400_000), ("token=secret:", 400_000), ("AKIA0Z", 400_000), ("0f" * 40 + "=", 100_000),
])
def test_very_long_strings_of_every_alphabet(spark, unit, size):
    """Very long strings of one alphabet, with its joints, neither recurse nor hang."""
    text = "x " + (unit * (size // len(unit))) + " y"
    row = op3_secrets.find_secrets(spark.createDataFrame([(1, text), (2, "none")], SCHEMA)).filter("doc_id = 1").first()
    assert all(0 <= s["start"] < s["stop"] <= len(text) for s in row["secrets"])
