"""Packing into powers of two and structure repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from forgeatlas.llm import op1_bpe, op11_packing, op12_structure, token_ids
from forgeatlas.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank "


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op1_bpe.tokenizer_path())


# Ids ---------------------------------------------------------------------------


def test_ids_are_the_library_s(library):
    coder, rng = token_ids.load(op1_bpe.tokenizer_path()), random.Random(1)
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} .{chr(c)}1 {chr(c)}" for c in points]
    texts += ["".join(rng.choice("ab1 .\n\t '<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["<|endoftext|>", " x<|endoftext|>y ", "", "a" * 3000, "\n" * 9000 + "a", " " * 5000, "x" + " \n" * 3000 + " y"]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text).tolist() == wanted.ids, text[:50]
    library.encode_special_tokens = True
    try:
        for text in texts[-500:]:
            assert coder.encode(text, special=False).tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False


def test_very_long_runs():
    coder = token_ids.load(op1_bpe.tokenizer_path())
    for text in (" " * 2_000_000, "\n" * 2_000_000 + "x", "x" * 500_000, "ab " * 700_000):
        assert coder.words.decode(coder.encode(text).astype("<u4").tobytes()) == text
    assert coder.encode(None).size == 0


# Packing -----------------------------------------------------------------------


def test_decomposition_covers_every_id_once():
    totals = np.r_[np.arange(0, 300), 2047, 2048, 2049, 4096, 10_000, 1 << 20]
    doc, start, length = op11_packing.decompose(totals)
    for k, total in enumerate(totals):
        mine = doc == k
        ends = np.cumsum(length[mine])
        assert start[mine].tolist() == [0, *ends[:-1]][: mine.sum()] and length[mine].sum() == total
        small = length[mine][length[mine] < 2048]
        assert len(set(small)) == len(small) and list(small) == sorted(small, reverse=True)
    assert (length & (length - 1) == 0).all() and length.max() == 2048


def test_packing_of_odd_rows(spark, library, tmp_path):
    data = [(1, None), (2, ""), (3, PROSE * 900), (3, PROSE * 900), (None, "a"), (4, "x <|endoftext|> y"), (5, " " * 9000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS ids", "'z' AS length")
    rows = op11_packing.pack(docs, op1_bpe.tokenizer_path(), max_length=512).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert all(r["length"] == 1 << r["bucket"] == len(r["ids"]) // 4 <= 512 for r in rows)
    wanted = []
    for key, text in data:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        wanted.append((key, len(ids), ids))
    for key, n, ids in wanted:
        mine = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == key)
        copies = sum(w[0] == key for w in wanted)
        assert b"".join(x for _, x in mine[::copies]) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in rows if r["doc_id"] == key} == {n}
    assert op11_packing.pack(docs.limit(0), op1_bpe.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        op11_packing.pack(docs, op1_bpe.tokenizer_path(), max_length=1000)


def test_buckets_are_read_by_length(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    packed = op11_packing.pack(docs, op1_bpe.tokenizer_path()).cache()
    path = scratch_path(spark, "buckets")
    op11_packing.write_buckets(packed, path)
    for length in (1, 64, 2048):
        held = op11_packing.read_bucket(spark, path, length)
        wanted = packed.filter(f"length = {length}")
        assert sorted(r["sequence_id"] for r in held.collect()) == sorted(r["sequence_id"] for r in wanted.collect())
    op11_packing.write_buckets(packed.limit(0), scratch_path(spark, "no-buckets"))
    packed.unpersist()


def test_packing_query(spark, library):
    texts = duckdb.sql(f"select doc_id, coalesce(text, '') from '{FOLDER}/documents.parquet'").fetchall()
    rows: dict = {}
    for r in op11_packing.op11_packing(spark, FOLDER).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == len(texts)
    for key, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


# Structure ---------------------------------------------------------------------


def plain_repair(rows):
    """Cheapest and least edits of ``(role, text)`` rows, by search over whole strings."""
    counts = dict(blank=0, duplicate=0, truncated=0, illegal=0)
    faults, seen = [], set()
    for k, (role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = (
            "blank" if not body else "duplicate" if (role, text) in seen
            else "truncated" if body[-1] not in ".!?" else None
        )
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
        if k and rows[k - 1][0][:1] + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1

    @lru_cache(None)
    def best(row, state, inserts):
        """(cost, edits) from here; state: 0 nothing, 1 after s, 2 after u, 3 after a."""
        found = [(0, "")] if row == len(rows) and state in (0, 3) else []
        turn, then = ("a", 3) if state == 2 else ("u", 2)
        if inserts < 3:
            found.append(add(3, "I", best(row, then, inserts + 1)))
        if row < len(rows):
            found.append(add(4, "D", best(row + 1, state, 0)))
            if faults[row] not in ("blank", "duplicate"):
                late = 3 * (faults[row] == "truncated")
                found.append(add(3 + late, "R", best(row + 1, then, 0)))
                if rows[row][0][:1] == turn:
                    found.append(add(late, "K", best(row + 1, then, 0)))
                if rows[row][0][:1] == "s" and state == 0:
                    found.append(add(late, "K", best(row + 1, 1, 0)))
        return min(found) if found else (10**9, "")

    def add(cost, edit, rest):
        return cost + rest[0], edit + rest[1]

    cost, audit = best(0, 0, 0)
    out, row, state = [], 0, 0
    for edit in audit:
        name, then = ("assistant", 3) if state == 2 else ("user", 2)
        if edit == "D":
            row += 1
            continue
        if edit == "I":
            out.append(name + ":")
            state = then
            continue
        role, text = rows[row]
        row += 1
        system = edit == "K" and role[:1] == "s"
        out.append((role if edit == "K" else name) + ":" + text)
        state = 1 if system else then
    return *counts.values(), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def gaps(turns):
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def test_program_finds_the_least_edits():
    kinds = [(r, t) for r in ("system", "user", "assistant", "x") for t in ("Yes.", "cut", " ")]
    rng = random.Random(2)
    some = [list(c) for n in range(4) for c in itertools.product(kinds, repeat=n)]
    some += [[(rng.choice(kinds)[0], f"{k % 5}{rng.choice(['.', '!', ''])}") for k in range(rng.randrange(4, 14))] for _ in range(400)]
    for rows in some:
        talk = op12_structure._Conversation(1)
        seen = set()
        for role, text in rows:
            body = text.strip()
            talk.add(None, role, text, bool(body), (role, text) in seen, body[-1:] not in ".!?")
            talk.last = (None, role, None)  # repeats are told by ``seen`` here
            seen.add((role, text))
        block = talk.block(True)
        *_, cost, audit, digest = plain_repair(tuple(rows))
        assert (block[7], block[4]) == (cost, audit), rows
        joined = "\n".join(f"{r}:{t}" for r, t in zip(block[5], block[6], strict=True))
        assert hashlib.sha256(joined.encode()).hexdigest() == digest


def plain_reports(rows):
    """All results from ``(conv, turn, role, text, present)`` rows."""
    talks: dict = {}
    for conv, turn, role, text, present in rows:
        talk = talks.setdefault(conv, [])
        if present:
            talk.append((turn, " " if role is None else role, " " if text is None else text))
    out = set()
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out.add((conv, gaps([t for t, _, _ in talk]), *plain_repair(tuple(r[1:] for r in talk))))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, present boolean"


def random_rows(seed, many, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(many)]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            text = rng.choice(["Yes.", "no", "Is it?  ", "", " \n", None, f"t{rng.randrange(9)}.", "x" * 50, "Ünï!"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text, rng.random() < 0.95))
    rows += [(-5, 1, "user", "a", False), (-6, None, None, None, True)]
    return rows


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_structure_of_random_conversations(spark, block_rows):
    rows = random_rows(block_rows, 60, 25)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cost", "'e' AS edits", "2 AS digest").repartition(5)
    repaired = op12_structure.repair(df, present_col="present", block_rows=block_rows)
    found = op12_structure.reports(repaired)
    assert len(found.collect()) == len({r[0] for r in rows})
    assert set(map(tuple, found.collect())) == plain_reports(rows)
    turns = op12_structure.messages(repaired).orderBy("conv_id", "block_no", "place").collect()
    for conv, group in itertools.groupby(turns, key=lambda r: r["conv_id"]):
        assert re.fullmatch("s?(ua)+", "".join(r["role"][:1] for r in group)), conv


def test_a_giant_conversation_is_spilled(spark):
    rows = [(7, k, ["user", "assistant"][k % 2], f"text {k}.", True) for k in range(2000) if k % 97]
    df = spark.createDataFrame(rows, SCHEMA)
    repaired = op12_structure.repair(df, block_rows=100)
    assert repaired.count() == -(-len(rows) // 100)
    (found,) = op12_structure.reports(repaired).collect()
    audit = found["audit"]
    assert found["gaps"] == 20 and len(audit.replace("I", "")) == len(rows) and not repaired.filter("size(texts) > 250").count()
    turns = op12_structure.messages(repaired).orderBy("block_no", "place").collect()
    joined = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(joined.encode()).hexdigest() == found["repaired_sha256"]
    assert op12_structure.reports(op12_structure.repair(df.limit(0))).count() == 0


def test_structure_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{FOLDER}/conversations.parquet'").fetchall()
    harmed = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        harmed += [(conv, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    df = op12_structure.op12_structure(spark, FOLDER)
    assert df.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert set(map(tuple, df.collect())) == plain_reports(harmed)
