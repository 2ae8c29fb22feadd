"""Odd inputs for every operator, and results against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from forgeatlas.llm import (
    bpe, catalog, idcoder, op1_bpe, op2_quality, op3_secrets, op4_simhash, op5_idfile,
    op6_rules, op7_chat, op8_tokens, op9_language, op10_decontaminate,
)
from forgeatlas.session import scratch_path

PROSE = "the quick brown fox jumps over the lazy dog near the old river bank "
HEXED = hashlib.sha256(b"x").hexdigest()
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE * 3), (4, PROSE * 3), (5, PROSE * 3), (None, PROSE * 2),
    (6, "a  b <|endoftext|> c"), (7, "Ünï😀 日本 \r\n x"), (8, f"api_key = '{HEXED}' end {HEXED}"),
    (9, PROSE * 3000), (10, "x" * 3000), (11, "token=secret: \"abcdefghijklmnop\""), (12, "!!! ### 123"),
]
SCHEMA = "doc_id long, text string"
CLASH = ["fp", "key", "ids", "n_tokens", "start", "score", "lang_pred", "n_words", "node", "root", "_secrets", "_leak", "_language"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows with extra columns whose names clash with what operators call their own."""
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars",
        *(f"'other' AS {c}" for c in CLASH),
    )
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (4, 1), (12, 0), (8, 0), (None, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "Old river  BANK the quick brown fox jumps over"), (1, "old river bank the quick brown fox jumps over"),
         (2, None), (3, ""), (4, "short")], "item_id long, text string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op1_bpe.tokenizer_path())


def by_id(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_entry_of_the_vocabulary_encodes_to_itself():
    coder = bpe.load(op1_bpe.tokenizer_path())
    special = set(coder.special.values())
    assert all(coder.word(w) == [k] for k, w in enumerate(coder.bytes_of) if k not in special)


def test_words_and_long_words_agree():
    coder, rng = bpe.load(op1_bpe.tokenizer_path()), random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"abeinrst ") for _ in range(rng.randint(1, 90)))
        assert coder.word(word) == coder._long_word(word)


def test_bpe_is_the_library(docs, library):
    rows = op1_bpe.encode_decode(docs, op1_bpe.tokenizer_path()).collect()
    assert len(rows) == len(ODD)
    texts = Counter((k, t or "") for k, t in ODD)
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    for r in rows:
        ids = library.encode(r["decoded"], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)


def test_chunks_do_not_change_words():
    coder = bpe.load(op1_bpe.tokenizer_path())
    text = PROSE * 20 + " a  b\n c" + PROSE * 20
    whole = coder.encode(text)
    parts = list(bpe.chunks(text, 50))
    assert len(parts) > 10 and "".join(parts) == text
    assert b"".join(b"".join(map(coder.encode, [p])) for p in parts) == whole


def test_quality(docs, labels, spark):
    rows = op2_quality.classify(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2)} == {0.5}
    none = op2_quality.classify(docs, labels.filter("quality = 1")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_held_out(spark):
    rng = random.Random(5)
    words = PROSE.split()
    rows = []
    for k in range(240):
        text = " ".join(rng.choice(words) for _ in range(60))
        if k % 3 == 0:
            text = re.sub(r"(\w+)", r"\1###", text)
        rows.append((k, text, 0 if k % 3 == 0 else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = op2_quality.classify(df.select("doc_id", "text"), df.filter("doc_id % 4 != 2").select("doc_id", "quality"))
    for r in scored.filter("doc_id % 4 = 2").collect():
        assert (r["score"] >= op2_quality.ACCEPT) == (r["doc_id"] % 3 != 0)


def test_quality_of_a_key_that_repeats(spark, labels):
    """However many rows have a labelled key, one of them is learned from."""
    rows = [(4, f"{PROSE} {k}") for k in range(3000)] + [(8, "### !!! ###")]
    once = [(4, min(t for k, t in rows if k == 4)), rows[-1]]
    learned = [op2_quality.learn(spark.createDataFrame(r, SCHEMA), labels) for r in (rows, once)]
    assert np.array_equal(*learned)


def plain_spans(text):
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets(docs):
    rows = op3_secrets.find_secrets(docs).collect()
    found = Counter((r["doc_id"], tuple(tuple(s) for s in r["secrets"] if s["kind"] < 3)) for r in rows)
    assert found == Counter((k, tuple(plain_spans(t or ""))) for k, t in ODD)
    assert sum(len(s) for _, s in found) >= 3


def test_many_spans_and_random_strings(spark):
    rng = random.Random(1)
    secrets = ["".join(rng.choices(op3_secrets.ENCODINGS[3][2], k=44)) for _ in range(60)]
    many = " ".join(HEXED for _ in range(700))
    rows = [(k, f"see 😀 {s} now") for k, s in enumerate(secrets)] + [(99, many)]
    rows += [(100 + k, "version1_version1_version1_version1_version1") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["secrets"] for r in op3_secrets.find_secrets(df).collect()}
    assert [tuple(s) for s in got[99] if s["kind"] < 3] == plain_spans(many)
    caught = [k for k in range(60) if (6, 3, 50) in [tuple(s) for s in got[k]]]
    assert len(caught) > 50 and not any(got[100 + k] for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in op3_secrets.redact(df).collect()}
    assert clean[caught[0]] == "see 😀 [SECRET] now" and HEXED not in clean[99]
    assert clean[99].count("[SECRET]") == 700 and clean[100].startswith("version1")


def test_secrets_behind_names_and_in_paths(spark):
    rng = random.Random(5)
    lower, upper = (op3_secrets.DIGITS + letters for letters in (op3_secrets.LOWER, op3_secrets.UPPER))
    forms = {
        "auth={}": lower, "see /io/cb/{} now": lower, "key_{}": lower, "Auth-{}": lower, "a={}&b": upper, "{} end": upper,
    }
    rows, wanted = [], {}
    for k, (form, symbols) in enumerate(forms.items()):
        for n in range(30):
            value = "".join(rng.choices(symbols, k=44))
            rows.append((100 * k + n, form.format(value)))
            wanted[100 * k + n] = value
    for n in range(30):
        value = "-".join("".join(rng.choices("0123456789abcdef", k=8)) for _ in range(6))
        rows.append((900 + n, f"id={value}"))
        wanted[900 + n] = value
    # Ordinary runs with joints and digits stay.
    rows += [(2000 + k, f"/usr/share/some_long_directory_name{k}/another-directory-name/file{k}") for k in range(30)]
    clean = {r["doc_id"]: r["text"] for r in op3_secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    for first in [*range(0, 600, 100), 900]:
        gone = sum(wanted[first + n] not in clean[first + n] for n in range(30))
        assert gone >= 26, (first, gone)
    assert all(clean[k] == text for k, text in rows if k >= 2000)
    spans = op3_secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    for found in ([s for s in r["secrets"] if s["kind"] == 3] for r in spans):
        assert all(a["stop"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


def test_one_unbroken_run_is_searched_once(spark):
    text = "xY" * 400_000 + " " + HEXED
    df = spark.createDataFrame([(1, text)], SCHEMA)
    found = op3_secrets.find_secrets(df).first()["secrets"]
    assert [tuple(s) for s in found if s["kind"] < 3] == [(800_001, 2, 800_065)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_classes(values):
    """Smallest key that is reachable for each (key, fingerprint)."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for k, (key, _) in enumerate(values):
        groups.setdefault(root(k), []).append(key)
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(k)] for k in range(len(values))]


def test_simhash(docs):
    rows = op4_simhash.near_duplicates(docs).collect()
    values = [(k, plain_fingerprint(t)) for k, t in ODD]
    wanted = Counter((k, f"{f:016x}", c) for (k, f), c in zip(values, plain_classes(values), strict=True))
    assert Counter(map(tuple, rows)) == wanted


def test_links_with_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).tolist()
    values = {b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(4)}
    # Many fingerprints that share four bands: one key above a tile.
    values |= {x << 44 for x in rng.integers(0, 2**19, 120).tolist()}
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = op4_simhash.links(df, tile=16)
    roots = {r["node"]: r["root"] for r in op4_simhash.components(edges).collect()}
    wanted = plain_classes([(v, v) for v in values])
    assert [roots.get(v, v) for v in values] == wanted


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.zeros(n, int), np.arange(n) % 7 * 900, rng.integers(65531, 65536, n)):
        coded = idcoder.encode(ids.astype("<u4"))
        assert (idcoder.decode(coded) == ids).all()
    if n > 2048:
        broken = bytearray(coded)
        broken[40] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode(bytes(broken))


def test_id_files(spark, docs, library, monkeypatch):
    monkeypatch.setattr(op5_idfile, "SEGMENT_IDS", 500)
    path = scratch_path(spark, "idfile-test")
    op5_idfile.write_ids(docs, path, op1_bpe.tokenizer_path())
    rows = op5_idfile.read_ids(spark, path).orderBy("start").collect()
    at, keys = 0, []
    texts = Counter()
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and len(ids) == r["n_tokens"] and ids[-1] == 2
        at += len(ids)
        keys.append(r["doc_id"])
        texts[r["doc_id"], library.decode(ids[:-1], skip_special_tokens=False)] += 1
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    assert texts == Counter((k, t or "") for k, t in ODD)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules(docs, labels):
    rows = op6_rules.apply_rules(docs, labels).collect()
    got = Counter((r["doc_id"], *(r[c] for c in op6_rules.COUNTS), r["base_failed"]) for r in rows)
    wanted = Counter()
    for k, t in ODD:
        c = plain_counts(t)
        wanted[(k, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == wanted and all(r["kept"] != r["base_failed"] for r in rows)


def test_cutoffs_are_risk_controlled(spark):
    from math import comb

    for k, n, p in [(0, 50, 0.1), (3, 40, 0.2), (30, 40, 0.2), (5, 5, 0.5), (7, 200, 0.05)]:
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert op6_rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_repeat_words long, n_dup_lines long, n_lines long, n_upper long, n_bangs long"

    def chosen(every, many=8000, copies=1):
        rows = [(k, 200, 1000, 400 if k % every == 0 else 5, 0, 0, 10, 0, 0) for k in range(many)] * copies
        measured = spark.createDataFrame(rows, names)
        return op6_rules.select_settings(measured, measured.selectExpr("doc_id", "1 AS quality"))

    # One good text in 400 has many symbols: losing those is within the risk. One in 40 is not.
    assert chosen(400) == {1: op6_rules.SETTINGS - 1} and chosen(40) == {1: 0}
    # 203 good texts without a rejection are needed, and copies of rows are no evidence.
    assert chosen(10**6, 210) and not chosen(10**6, 190) and not chosen(10**6, 190, copies=3)


def test_chat_folds_events(spark):
    log = [
        (1, 0, 10, 0, "user", "delta", "Hel"), (1, 0, 10, 1, None, "delta", "lo <|end|>"),
        (1, 1, 11, 5, None, "delta", " end"), (1, 1, 11, 0, "assistant", "delta", "draft"),
        (1, 1, 11, 3, None, "regenerate", None), (1, 1, 11, 4, None, None, "</s>[INST]\\"),
        (1, 2, 12, 0, "user", "delta", "x"), (1, 2, 12, 1, "user", "edit", "y"), (None, None, None, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, message_id long, seq long, role string, kind string, text string")
    messages = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in op7_chat.fold_events(events).collect()}
    assert messages == {
        (1, 0): ("user", "Hello <|end|>"), (1, 1): ("assistant", "</s>[INST]\\ end"), (1, 2): ("user", "y"), (None, None): ("", "")}
    for r in op7_chat.format_chats(events).collect():
        assert op7_chat.parse_segment(r["segment"]) == messages[r["conv_id"], r["turn"]]
        inner = r["segment"][len(op7_chat.TURN) : -len(op7_chat.END)]
        assert not re.search(r"<\||</s>|\[/?INST\]", inner)
        assert op7_chat.unescape(r["segment"][r["loss_start"] : r["loss_stop"]]) == (
            messages[1, 1][1] if (r["conv_id"], r["turn"]) == (1, 1) else "")
    assert op7_chat.digests(op7_chat.format_chats(events.limit(0))).collect() == []
    bad = spark.createDataFrame([(1, 0, 0, 0, "user", "other", "x")], events.schema)
    with pytest.raises(Exception, match="unknown kind"):
        op7_chat.fold_events(bad).collect()


def test_chat_logs_of_finished_messages(spark):
    """Drafts, edits and regenerations fold to the rows they were made from; extra columns,
    ties, odd roles and long texts change nothing."""
    rng = random.Random(6)
    pool = ["</s>[INST] ok [/INST]", "", None, "x", "a\\b<n[c\\", "Ünï😀 <|end|>\n", "y" * 200_000]
    rows = [(k % 40, rng.choice([k // 40, 3, None]), rng.choice(["user", "assistant", "a\nb", "<n\n\\", None]), rng.choice(pool)) for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = op7_chat.events_of(df).selectExpr("*", "'z' AS segment", "1 AS log").repartition(7)
    kinds = Counter(r["kind"] for r in events.select("kind").collect())
    assert kinds["edit"] > 100 and kinds["regenerate"] > 100 and kinds["delta"] > 500
    plain = Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    folded = op7_chat.fold_events(events)
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in folded.collect()) == plain
    again = [op7_chat.parse_segment(r["segment"]) for r in op7_chat.render(folded).collect()]
    assert Counter(again) == Counter((r or "", x or "") for _, _, r, x in rows)
    assert sum(r["n_turns"] for r in op7_chat.digests(op7_chat.format_chats(events)).collect()) == 400


@pytest.mark.parametrize("rule", op8_tokens.RULES)
def test_section_tokens(spark, docs, library, rule):
    path = op1_bpe.tokenizer_path()
    rows = op8_tokens.section_tokens(docs, path, rule=rule).collect()
    assert len(rows) == len(ODD)
    lengths = Counter(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD)
    assert Counter(r["n_tokens"] for r in rows) == lengths
    assert all(sum(r["section_tokens"]) == r["n_tokens"] and r["section_starts"][0] == 0 for r in rows)
    given = spark.createDataFrame([(1, "hello world", [0, 3, 99, None]), (2, "hello", None)], "doc_id long, text string, cuts array<long>")
    got = {r["doc_id"]: (r["section_starts"], r["section_tokens"]) for r in
           op8_tokens.section_tokens(given, path, rule=rule, starts_col="cuts").collect()}
    assert got == {1: ([0, 3], [0, 2] if rule == "end" else [1, 1]), 2: ([0], [1])}


def test_language(spark, docs):
    english = [(k, PROSE * 2, "en") for k in range(10)]
    german = [(k, "der schnelle braune fuchs springt über den faulen hund am alten flussufer ", "de") for k in range(10)]
    labelled = spark.createDataFrame(english + german + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    rows = op9_language.identify(docs, labelled).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [got[k] for k in (1, 2, 3, 12)] == ["und"] * 4 and got[4] == got[9] == "en"
    probe = spark.createDataFrame([(1, "über den hund springt der alte fuchs")], SCHEMA)
    assert op9_language.identify(probe, labelled).first()["lang_pred"] == "de"
    assert {r["lang_pred"] for r in op9_language.identify(docs, labelled.limit(0)).collect()} == {"und"}


def test_copies_of_a_text_are_learned_once(spark, monkeypatch):
    monkeypatch.setattr(op9_language, "SAMPLE_PER_LANGUAGE", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(PROSE.split(), k=20)) for _ in range(40)]
    once = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    copied = once.unionByName(spark.createDataFrame([(texts[0], "en")] * 4000, once.schema))
    (_, one), (_, many) = op9_language.learn(once), op9_language.learn(copied)
    assert np.allclose(one, many, atol=1e-5)


def plain_distance(item, text):
    row = list(range(len(item) + 1))
    best = len(item)
    for char in text:
        new = [0]
        for k in range(1, len(item) + 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (item[k - 1] != char)))
        row, best = new, min(best, new[-1])
    return best


def test_myers_and_pieces():
    rng = random.Random(4)
    for _ in range(150):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))
        assert op10_decontaminate.Pattern(item).best(text)[0] == plain_distance(item, text)
    item = op10_decontaminate.normalise(PROSE * 2)
    known = op10_decontaminate.Items([7], [item])
    for _ in range(60):
        edited = list(item)
        for _ in range(op10_decontaminate.budget(len(item))):
            edited[rng.randrange(len(edited))] = "#"
        text = "zz " * rng.randint(0, 9) + "".join(edited) + " yy"
        assert known.search(text)[0][0] == plain_distance(item, text)
    assert known.search("the quick brown fox") == {}


def test_decontaminate(spark, docs, items):
    rows = op10_decontaminate.matches(docs, items).collect()
    assert {r["doc_id"] for r in rows} == {None, 4, 5, 9} and {r["item_id"] for r in rows} == {1}
    assert Counter(r["doc_id"] for r in rows)[4] == 4
    kept = op10_decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 6, 7, 8, 10, 11, 12}
    assert op10_decontaminate.decontaminate(docs, items.limit(0)).count() == len(ODD)
    long = spark.createDataFrame([(1, "q " * 600_000 + PROSE + PROSE)], SCHEMA)
    assert op10_decontaminate.matches(long, items).count() == 2


def test_short_items_and_item_types(spark):
    """Short items are found as whole words, without edits; keys of items may be of any type."""
    docs = spark.createDataFrame([(1, "it is a cat. yes"), (2, "concatenate"), (3, "CAT"), (4, None)], SCHEMA)
    items = spark.createDataFrame([(7, "cat"), (8, " "), (9, None)], "item_id int, text string")
    found = op10_decontaminate.matches(docs, items)
    assert found.schema["item_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect())) == [(1, 7, 0, 11), (3, 7, 0, 3)]
    left = op10_decontaminate.decontaminate(docs, items).collect()
    assert {r["doc_id"] for r in left} == {2, 4}


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(op10_decontaminate, "BLOCK_ITEMS", 2)
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices(PROSE.split(), k=12)) + f" {k}") for k in range(21)]
    docs = [(k, f"before {items[k][1]} after" if k % 2 else "nothing here") for k in range(21)]
    df, held = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["distance"]) for r in op10_decontaminate.matches(df, held).collect() if r["doc_id"] == r["item_id"]) == [
        (k, 0) for k in range(1, 21, 2)]
    assert {r["doc_id"] for r in op10_decontaminate.decontaminate(df, held).collect()} == set(range(0, 21, 2))


def test_many_languages(spark, monkeypatch):
    """No cap on languages; blocks of them give the first of the best."""
    rng = random.Random(8)
    rows = []
    for k in range(700):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows.append((k, " ".join("".join(rng.choices(letters, k=6)) for _ in range(40)), f"l{k:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op9_language.learn(df.select("text", "lang"))
    monkeypatch.setattr(op9_language, "LANGUAGES_AT_ONCE", 64)
    found = op9_language.language(F.col("text"), *model)
    got = df.select("lang", found.alias("l")).select("lang", "l.lang_pred").collect()
    assert len(model[0]) == 700 and sum(r["lang"] == r["lang_pred"] for r in got) > 690


def test_empty_tables(spark, docs, labels, items):
    none, path = docs.limit(0), op1_bpe.tokenizer_path()
    folder = scratch_path(spark, "idfile-empty")
    op5_idfile.write_ids(none, folder, path)
    for df in (
        op1_bpe.encode_decode(none, path), op2_quality.classify(none, labels), op3_secrets.find_secrets(none),
        op3_secrets.redact(none), op4_simhash.near_duplicates(none), op5_idfile.read_ids(spark, folder),
        op6_rules.apply_rules(none, labels), op8_tokens.section_tokens(none, path),
        op9_language.identify(none, docs.select("text", "lang")), op10_decontaminate.matches(none, items),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not kept[0] & {1, 2, 3, 12} and {4, 5, 7, 8} <= kept[0]
    assert 5 not in kept[1] and 4 in kept[1] and not kept[2] & {4, 9, None}
    assert kept[4] == kept[3] == kept[2]
    masked = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}
    assert HEXED not in masked[8]["text"] and masked[8]["n_chars"] == len(masked[8]["text"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Classes and kept rows against all pairs of fingerprints; keys repeat or are missing."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(50):
        base = rng.choices(words, k=400)
        rows.append((k % 30, " ".join(base)))  # some keys have two different texts
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(400)] = "changed"
            rows.append((rng.choice([None, 100 + k, k % 30]), " ".join(copy)))
    rows += [(None, "no copy of this one"), (None, "no copy of that one"), (3, None), (200, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'x' AS _row")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    prints = [op4_simhash.fingerprint(t) for _, t in rows]
    left, wanted = set(range(len(rows))), 0
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            at = todo.pop()
            group.add(at)
            near = {k for k in left if (prints[k] ^ prints[at]).bit_count() <= 4}
            left -= near
            todo += near
        wanted += 1
        keys = [rows[k][0] for k in group if rows[k][0] is not None]
        texts = {rows[k][1] for k in group if rows[k][0] == (min(keys) if keys else None)}
        stays = [r for r in kept.collect() if r["text"] in {rows[k][1] for k in group}] if wanted < 4 else []
        assert wanted >= 4 or (len(stays) == 1 and stays[0]["text"] in texts)
    assert kept.count() == wanted


def test_language_stage_keeps_short_and_unlearned_texts(spark, tmp_path):
    rows = [(k, PROSE * 5 if k % 3 else "A.", "en") for k in range(40)] + [(50, "123", "en"), (51, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert kept == set(range(40))
    nothing = df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, nothing, "").collect()} == set(range(40))


def test_queries_on_tables(spark, library):
    import duckdb

    folder = "/root/testdata/sf0.001"
    queries = catalog.queries()
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{folder}/documents.parquet'").fetchall())
    at = 0
    files = {r["doc_id"]: r for r in queries["op5_idfile"](spark, folder).collect()}
    one = {r["doc_id"]: r for r in queries["op1_bpe"](spark, folder).collect()}
    for key in sorted(texts):
        ids = np.array(library.encode(texts[key], add_special_tokens=False).ids, "<u4")
        assert one[key]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert one[key]["decoded_sha256"] == hashlib.sha256(texts[key].encode()).hexdigest()
        ended = np.r_[ids, 2].astype("<u4")
        row = files[key]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ended), zlib.crc32(ended.tobytes()))
        at += len(ended)
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    wanted = connection.execute(catalog.oracle_sql()["op7_chat"]).fetchall()
    assert sorted(map(tuple, queries["op7_chat"](spark, folder).collect())) == sorted(wanted)


def test_groups_are_found_in_the_lane_of_a_place():
    rng = np.random.default_rng(5)
    state = idcoder.Lanes(40)
    state.count += rng.integers(0, 50, state.count.shape) * (rng.random(state.count.shape) < 0.02)
    state.refresh(40)
    for n in (40, 3):
        ends = state.cumulative[:n, -1] - state.base[:n]
        for inside in (np.zeros(n, np.int64), ends - 1, rng.integers(0, ends), state.cumulative[:n, 500] - state.base[:n]):
            plain = [np.searchsorted(state.cumulative[k] - state.base[k], inside[k], "right") - 1 for k in range(n)]
            assert state.group_of(inside + state.base[:n], n).tolist() == plain


def test_words_of_the_id_files_are_those_of_the_library():
    coder = op5_idfile.LibraryEncoder(op1_bpe.tokenizer_path())
    units = ["a", "Word", "don't", "x1", "1x", "caf\u00e9", "a_b", "", "ABC" * 40, "\u00b5", "\u0130", "a\tb", "a  b", " a", "s't"]
    for text in [*units, *(" " + u for u in units), " ".join(units)]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids
