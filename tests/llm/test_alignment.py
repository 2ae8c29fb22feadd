"""Alignment of two tokenizers against plain loops over their tokens."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from forgeatlas.llm import bpe, op1_bpe, op13_alignment

FOLDER = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank "
ODD = [
    (1, None), (2, ""), (3, PROSE * 30), (3, PROSE * 30), (None, "a"), (4, "x <|endoftext|> <s> </s><unk> <0x41>"),
    (5, "   \n\t  "), (6, "bad ▁ mark"), (7, "Ünï😀 日本語 \x00\x85  ①"), (8, " lead and trail "), (9, "x" * 700),
]


@pytest.fixture(scope="module")
def plain():
    """``texts -> results`` with the libraries and no arrays."""
    first = Tokenizer.from_file(op1_bpe.tokenizer_path())
    first.encode_special_tokens = True
    letters = bpe.byte_letters()
    second = sentencepiece.SentencePieceProcessor(model_file=op13_alignment.pieces_path())

    def bytes_b(k):
        name = second.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if second.is_byte(k) else name.replace("▁", " ").encode()

    def run(rows):
        linked, found = Counter(), []
        for key, text in rows:
            a = first.encode(" " + text, add_special_tokens=False) if text else None
            ids_a = a.ids if text else []
            ids_b = second.encode(text, num_threads=1) if text else []
            side_a = [bytes(letters[c] for c in first.id_to_token(k)) for k in ids_a]
            side_b = [bytes_b(k) for k in ids_b]
            whole = (" " + (text or "")).encode()
            if not text or b"".join(side_a) != whole or b"".join(side_b) != whole:
                found.append((key, [], [], [], ""))
                continue
            spans = []
            for side in (side_a, side_b):
                at, mine = 0, []
                for part in side:
                    mine.append((at, at + len(part)))
                    at += len(part)
                spans.append(mine)
            common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
            groups = []
            for end in sorted(common):
                low = groups[-1][2] if groups else 0
                groups.append((
                    [k for k, (s, e) in zip(ids_a, spans[0]) if low <= s and e <= end],
                    [k for k, (s, e) in zip(ids_b, spans[1]) if low <= s and e <= end], end,
                ))
            links = [
                (x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (t, u) in zip(ids_b, spans[1]) if s < u and t < e
            ]
            linked.update(links)
            written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in groups)
            found.append((key, ids_a, ids_b, links, hashlib.sha256(written.encode()).hexdigest(), len(groups)))
        most: dict = {}
        for (_, y), n in linked.items():
            most[y] = max(most.get(y, 0), n)
        return Counter(
            (
                key, len(a), len(b), rest[0] if rest else 0, len(links),
                sum(linked[p] == most[p[1]] for p in links), sum(linked[p] for p in links), sha,
            )
            for key, a, b, links, sha, *rest in found
        ), linked, most

    return run


def test_gallop_is_a_sorted_search():
    rng = np.random.default_rng(1)
    for many in (1, 2, 63, 64, 65, 500, 5000):
        longer = np.cumsum(rng.integers(1, 9, many * 3))
        shorter = np.unique(np.r_[rng.choice(longer[-1], many), longer[-1]])
        rank, common = op13_alignment.gallop(shorter, longer)
        assert (rank == np.searchsorted(longer, shorter)).all() and (common == np.isin(shorter, longer)).all()
    assert op13_alignment.gallop(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0


@pytest.mark.parametrize("chunk_tokens", [1 << 22, 50])
def test_alignment_of_odd_rows(spark, plain, chunk_tokens, monkeypatch):
    rng = random.Random(3)
    rows = ODD + [(20 + k, "".join(rng.choice("ab é\n.1 日") for _ in range(rng.randrange(80)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'z' AS row", "0 AS pair")
    documents, pairs = op13_alignment.align(
        docs, op1_bpe.tokenizer_path(), op13_alignment.pieces_path(), chunk_tokens=chunk_tokens
    )
    wanted, linked, most = plain(rows)
    assert Counter(map(tuple, documents.collect())) == wanted
    assert {tuple(r) for r in pairs.collect()} == {(x, y, n, n == most[y]) for (x, y), n in linked.items()}


def test_a_long_text_is_cut_and_added_up(plain, monkeypatch):
    """Parts of a text in several chunks, and counts above one byte."""
    pair = op13_alignment.load(op1_bpe.tokenizer_path(), op13_alignment.pieces_path())
    assert pair.cuts
    whole = pair.encode(PROSE * 50)
    short = bpe.chunks
    monkeypatch.setattr(op13_alignment.bpe, "chunks", lambda text, limit=100: short(text, limit))
    parts = pair.encode(PROSE * 50)
    assert len(parts) > 20
    for k in range(2):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[0][k].tolist()
    import pyarrow as pa

    records = []
    chunk = op13_alignment._Chunk(pair)
    for key, some in ((1, parts), (2, []), (3, whole)):
        for _ in chunk.add(key, key, some, 200):
            records.append(chunk.record(len(records), pa.int64()).to_pylist()[0])
    if chunk.keys:
        records.append(chunk.record(len(records), pa.int64()).to_pylist()[0])
    (*_, sha), *_ = [r for r in plain([(1, PROSE * 50)])[0]]
    digests = [(k, s) for r in records for k, s, e in zip(r["keys"], r["shas"], r["ended"]) if e]
    assert digests == [(1, sha), (2, ""), (3, sha)] and len(records) > 5
    assert all((s is None) != e for r in records for s, e in zip(r["shas"], r["ended"]))
    links = sum(n for r in records for k, n in zip(r["keys"], r["n_links"]) if k == 1)
    assert links == sum(n for r in records for k, n in zip(r["keys"], r["n_links"]) if k == 3)
    assert all(sum(r["times"]) == sum(r["n_links"]) == sum(r["n"]) for r in records)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    for df in op13_alignment.align(docs, op1_bpe.tokenizer_path(), op13_alignment.pieces_path()):
        assert df.count() == 0


def test_alignment_query(spark, plain):
    texts = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' where length(text) < 3000").fetchall()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    documents, _ = op13_alignment.align(docs.repartition(3), op1_bpe.tokenizer_path(), op13_alignment.pieces_path())
    assert Counter(map(tuple, documents.collect())) == plain(texts)[0]
    whole = op13_alignment.op13_alignment(spark, FOLDER)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.filter("n_links != n_a + n_b - n_groups OR n_best > n_links").count() == 0
    assert whole.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
