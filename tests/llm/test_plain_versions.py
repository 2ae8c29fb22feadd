"""Queries over a whole table against loops that work character by character or pair by pair."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from forgeatlas.llm import op1_bpe, op2_quality, op4_simhash, op8_tokens, op9_language, op10_decontaminate

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text, lang from '{FOLDER}/documents.parquet' order by 1").fetchall()


# Token counts --------------------------------------------------------------------


def plain_sections(text, sizes, starts, rule):
    owner = [k for k, c in enumerate(text) for _ in c.encode()]  # character of every byte
    counts, at = [0] * len(starts), 0
    for size in sizes:
        chars = sorted({owner[b] for b in range(at, at + size)})
        at += size
        of = [sum(s <= c for s in starts) - 1 for c in chars]
        if rule == "start":
            counts[of[0]] += 1
        elif rule == "end":
            counts[of[-1]] += 1
        else:
            counts[max(range(of[0], of[-1] + 1), key=lambda s: (of.count(s), -s))] += 1
    return counts


@pytest.mark.parametrize("rule", op8_tokens.RULES)
def test_tokens_are_attributed_character_by_character(spark, texts, rule):
    library = Tokenizer.from_file(op1_bpe.tokenizer_path())
    some = [(k, (t or "")[:900], sorted({0, *(x for x in (7, 8, 40, 41, 300, 77 * (k % 5)) if x < len((t or "")[:900]))})) for k, t, _ in texts[::4]]
    some += [(-1, "Ünï😀 日本\n\n  x" * 9, [0, 3, 5, 8, 9, 30])]
    given = spark.createDataFrame(some, "doc_id long, text string, cuts array<long>")
    found = {r["doc_id"]: r for r in op8_tokens.section_tokens(given, op1_bpe.tokenizer_path(), rule=rule, starts_col="cuts").collect()}
    lengths = {k: len(v) for k, v in enumerate(op1_bpe.bpe.load(op1_bpe.tokenizer_path()).bytes_of)}
    for key, text, starts in some:
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[key]["section_starts"] == starts
        assert found[key]["section_tokens"] == plain_sections(text, [lengths[i] for i in ids], starts, rule)


# Language ------------------------------------------------------------------------


def plain_vector(text):
    codes = [0]
    for char in (text or "").lower():
        code = int(op9_language.letter_codes()[ord(char)])
        if code or codes[-1]:
            codes.append(code)
    codes += [0] if codes[-1] else []
    first, second, third = op9_language.letter_vectors()
    out = np.zeros(op9_language.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        out += first[a].astype(float) * second[b] * third[c]
    return out / max(np.linalg.norm(out), 1e-30), any(codes)


def test_languages_are_those_of_plain_bundling(spark, texts):
    vectors = {k: plain_vector(t) for k, t, _ in texts}
    learned: dict = {}
    for key, text, lang in texts:
        if lang is not None and text is not None and zlib.crc32(str(key).encode()) % 3 != 1:
            learned.setdefault(lang, {})[text] = vectors[key][0]
    names = sorted(learned)
    prototypes = np.stack([sum(learned[n].values()) for n in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    rows = {r["doc_id"]: r for r in op9_language.op9_language(spark, FOLDER).collect()}
    assert len(rows) == len(texts)
    for key, text, _ in texts:
        vector, lettered = vectors[key]
        cosine = prototypes @ vector
        row = rows[key]
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert row["lang_pred"] == (names[int(cosine.argmax())] if text and lettered else "und")
        assert row["score"] == pytest.approx(max(0, cosine.max()) if text and lettered else 0, abs=1e-4)


# Quality -------------------------------------------------------------------------


def plain_features(text):
    mask, mix = 0xFFFFFFFF, 2654435761
    bucket = lambda h: ((h * mix) & mask) >> 16
    points, out = [ord(c) for c in f"\n{text}\n"], []
    for n in op2_quality.GRAMS:
        for at in range(len(points) - n + 1):
            h = points[at]
            for p in points[at + 1 : at + n]:
                h = (h * 0x01000193 + p) & mask
            out.append(bucket((h + n) & mask))
    before = None
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        h = sum(ord(c) * pow(16777619, k & 63, 1 << 32) for k, c in enumerate(word)) & mask
        out.append(0 if h == before else bucket(h ^ 0x9E3779B9))
        before = h
    return out


def test_quality_is_the_average_over_plain_features(spark, texts):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    taught = labels.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2")
    weights = op2_quality.learn(docs.select("doc_id", "text"), taught)
    rows = {r["doc_id"]: r for r in op2_quality.op2_quality(spark, FOLDER).collect()}
    for key, text, _ in texts:
        found = plain_features(text or "")
        logit = sum(float(weights[b]) for b in found) / len(found) + float(weights[-1]) if len(found) > 2 else 0
        assert rows[key]["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)
        assert rows[key]["predicted"] == (rows[key]["score"] >= 0.7)
        assert rows[key]["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    quality = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    rows = [r for r in op2_quality.op2_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in quality]
    assert len(rows) > 50 and sum(r["predicted"] == quality[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


# Pairs ---------------------------------------------------------------------------


def test_classes_are_those_of_all_pairs(spark, texts):
    prints = {key: op4_simhash.fingerprint(text) for key, text, _ in texts}
    root = {key: key for key in prints}

    def top(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(prints)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    rows = op4_simhash.op4_simhash(spark, FOLDER).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (k, f"{prints[k]:016x}", top(k)) for k in keys}


def test_matches_are_those_of_all_pairs(spark, texts):
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    wanted = set()
    for item, text in items:
        normal = op10_decontaminate.normalise(text)
        pattern = op10_decontaminate.Pattern(normal)
        for key, body, _ in texts:
            distance, _ = pattern.best(op10_decontaminate.normalise(body))
            if distance <= op10_decontaminate.budget(len(normal)):
                wanted.add((key, item, distance))
    rows = op10_decontaminate.op10_decontaminate(spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == wanted and wanted
