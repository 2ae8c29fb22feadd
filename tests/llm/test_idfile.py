"""Token-id files: words of many texts at once, the range coder's batches, files of version 1."""

import random

import numpy as np
import pyarrow as pa
import pytest

from forgeatlas.llm import bpe, idcoder, op1_bpe, op5_idfile
from forgeatlas.llm.words import word_starts

# Written by the code of version 1: these ids three times, as documents of 16 and 32 ids.
FIRST_IDS = [5, 900, 5, 900, 7, 5, 900, 65535, 0, 0, 0, 2, 50256, 5, 900, 2]
FIRST_SEGMENT = bytes.fromhex(
    "4649445301000000000000000200000000000000300000000000000038000000000000001000000000000000200000000000"
    "000030000000515662692c000000a10076d72fcf45bd258d776b3e39562edbae90beae51114dd00d12de8f533d995056b687"
    "df52ac431420f081"
)
PARTS = [
    "a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "1", "9", ".", "-", "\u00e9", "\u6f22",
    "\u0301", "\u00a0", "\u2003", "\u0085", "\u0663", "\u00b2", "\U0001f600", "\U00020000", "\x1c", "\u200b", "S",
    "'s", " '", "\u3000", "\u180e", "\u017f",
]
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def coder():
    return op5_idfile.LibraryEncoder(op1_bpe.tokenizer_path())


def odd_texts(rng, parts=PARTS):
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]


def check(coder, texts):
    found = list(coder.encode_many(pa.array(texts, pa.string()), 2))
    wanted = [[*coder.library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [n for many, _ in found for n in many.tolist()] == list(map(len, wanted))
    assert [x for _, ids in found for x in ids.tolist()] == [x for ids in wanted for x in ids]


def test_words_of_many_texts_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(1500):
        texts = odd_texts(rng)
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        wanted = []
        for text, at in zip(texts, offsets.tolist(), strict=False):
            for word in bpe.WORD.findall(text):
                wanted.append(at)
                at += len(word.encode())
        assert word_starts(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist() == wanted, texts


def test_every_code_point_has_the_class_of_the_pattern():
    # A letter, a number and a sign before each: only its own class joins it.
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for at in range(0, len(points), 1 << 16):
        text = "".join(f"a{p}1{p}.{p}a" for p in points[at : at + (1 << 16)])
        starts = word_starts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        lengths = [len(word.encode()) for word in bpe.WORD.findall(text)]
        assert starts.tolist() == (np.cumsum(lengths) - lengths).tolist()


def test_many_texts_have_the_ids_of_the_library(coder, monkeypatch):
    rng = random.Random(2)
    check(coder, [None, "", "a", None])
    for _ in range(200):
        check(coder, [*odd_texts(rng), None])
    for _ in range(100):  # special tokens, whole and across two texts
        check(coder, odd_texts(rng, [*PARTS, END, END[:5], END[5:]]))
    check(coder, [END[:5], END[5:] + END, END + "x", "<" + END, END[:-1], ">"])
    assert list(coder.encode_many(pa.array([], pa.string()), 2)) == []
    monkeypatch.setattr(op5_idfile, "STRETCH_BYTES", 40)
    monkeypatch.setattr(op5_idfile, "chunks", lambda text: bpe.chunks(text, 20))
    for _ in range(200):
        check(coder, odd_texts(rng, [*PARTS, "word ", "other word ", END]))
    column = pa.array(["left out", None, "a b", "it's", "left out"], pa.string())
    assert [n for many, _ in coder.encode_many(column.slice(1, 3), 2) for n in many] == [1, 3, 3]


def test_the_library_is_asked_once_for_a_word(coder, monkeypatch):
    asked = []
    kept = op5_idfile._Words(coder.library.model)
    tokenize = kept.tokenize
    kept.tokenize = lambda word: asked.append(word) or tokenize(word)
    monkeypatch.setattr(coder, "kept", kept)
    texts = ["one two. two, (two) two", "two; two: one.", "x two"] * 3
    for _ in range(2):
        list(coder.encode_many(pa.array(texts), 2))
    assert len(asked) == len(set(asked))
    assert set(asked) == {w.replace(" ", "\u0120") for t in texts for w in bpe.WORD.findall(t)}


def test_words_that_are_still_met_stay(coder, monkeypatch):
    monkeypatch.setattr(op5_idfile, "KEPT_WORDS", 10)
    kept = op5_idfile._Words(coder.library.model)
    wanted = kept.all([b"stays"])
    for k in range(40):
        kept.all([b"%d" % (10 * k + i) for i in range(6)] + [b"stays"])
        assert len(kept.young) + len(kept.old) <= 40
    kept.tokenize = None  # not asked again
    assert kept.all([b"stays"]) == wanted


def test_bytes_that_are_no_text_are_an_error(coder):
    broken = pa.Array.from_buffers(
        pa.string(), 1, [None, pa.py_buffer(np.array([0, 2], "<i4")), pa.py_buffer(b"a\xff")]
    )
    with pytest.raises(ValueError):
        list(coder.encode_many(broken, 2))


@pytest.mark.parametrize("lanes", [1, 3, 2048])
def test_batches_of_the_range_coder(monkeypatch, lanes):
    monkeypatch.setattr(idcoder, "LANES", lanes)
    monkeypatch.setattr(idcoder, "BLOCK", 64)
    rng = np.random.default_rng(lanes)
    for n in (1, 63, 64, 65, 64 * 3, 64 * 3 + 1, 1500):
        often = np.repeat(rng.integers(0, 65536, n), 7)[:n]
        skewed = (rng.pareto(0.4, n) % 65536).astype(np.int64)
        for ids in (often, skewed, np.full(n, 65535), rng.integers(0, 2, n) * 65535, np.arange(n)):
            coded = idcoder.encode(ids.astype("<u4"))
            assert (idcoder.decode(coded) == ids).all()


def test_every_changed_byte_is_found(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 64)
    ids = np.random.default_rng(3).integers(0, 300, 150).astype("<u4")
    coded = idcoder.encode(ids)
    head = idcoder._BATCH.size + int.from_bytes(coded[4:8], "little")
    for at in (8, 12, head - 1, head + 4, head + 12, head + 30):
        broken = bytearray(coded)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            idcoder.decode(bytes(broken))


def test_ids_take_about_their_entropy():
    rng = np.random.default_rng(4)
    share = 1 / np.arange(1, 5001)
    ids = rng.choice(50000, 5000, replace=False)[rng.choice(5000, 400_000, p=share / share.sum())]
    count = np.bincount(ids)
    count = count[count > 0]
    bits = -(count * np.log2(count / len(ids))).sum()
    assert 8 * len(idcoder.encode(ids.astype("<u4"))) < 1.06 * bits


def test_segments_of_version_1_are_read():
    counts, ids = op5_idfile.unpack(FIRST_SEGMENT)
    assert counts.tolist() == [16, 32] and ids.tolist() == FIRST_IDS * 3
    broken = bytearray(FIRST_SEGMENT)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        op5_idfile.unpack(bytes(broken))
    counts, ids = op5_idfile.unpack(op5_idfile.pack([16, 32], np.array(FIRST_IDS * 3, "<u4")))
    assert counts.tolist() == [16, 32] and ids.tolist() == FIRST_IDS * 3
