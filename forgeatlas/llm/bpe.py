"""Byte-level BPE with a contiguous rank array, and the cutting of texts into words.

A word is merged on two flat lists: the boundaries of its parts and the rank of every
adjacent pair. The smallest rank is found by a scan, its inner boundary is deleted and the
two neighbouring ranks are looked up again. Words repeat, so finished words are kept in a
dictionary of bounded size; a text is then one join of looked-up byte strings.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex

# Fixed values of the tokenizer: its word pattern, with its white space spelled out.
SPACE = r"[\t-\r\x20\x85\xa0  -     　]"
SOLID = SPACE.replace("[", "[^", 1)
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?"
    + SOLID.replace("[^", r"[^\p{L}\p{N}")
    + rf"+|{SPACE}+(?!{SOLID})|{SPACE}+"
)
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
NO_RANK = 1 << 60
SHORT_WORD = 256
CHUNK_CHARS = 1 << 20
KEPT_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a vocabulary file: printable bytes stand for
    themselves, the others follow from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut a long text before single spaces between solid characters. A word never crosses
    such a place, so the words of the chunks are the words of the text."""
    at = 0
    while len(text) - at > limit:
        cut = LONE_SPACE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def pieces(chunk: str) -> tuple[list[str], list[str]]:
    """Units of a chunk that are encoded on their own: units as they are, then units that
    follow a single space (given without it). Unusual white space: word by word."""
    parts = chunk.split(" ")
    first = 1 if parts[0] == "" and len(parts) > 1 else 0
    solid = parts[first:]
    if "" in solid or list(map(str.strip, solid)) != solid:
        return WORD.findall(chunk), []
    return ([], solid) if first else (solid[:1], solid[1:])


class ByteBpe:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        self.ids = {raw(word): k for word, k in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # The rank of a pair is looked up by its joined bytes. That is the rank of the merge
        # if every entry of the vocabulary encodes to itself, which the tests check.
        self.ranks = {raw(a) + raw(b): k for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for word, k in self.ids.items():
            self.bytes_of[k] = word
        for word, k in self.special.items():
            self.bytes_of[k] = word.encode()
        self._split = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self._plain = _Kept(lambda unit: self._unit(unit))
        self._spaced = _Kept(lambda unit: self._unit(" " + unit))

    def _unit(self, unit: str) -> bytes:
        if unit.lstrip(" ").isalpha() and unit.rfind(" ") < 1:
            return array("I", self.word(unit.encode())).tobytes()
        out = array("I")
        for word in WORD.findall(unit):
            out.extend(self.word(word.encode()))
        return out.tobytes()

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if len(word) > SHORT_WORD:
            return self._long_word(word)
        bounds = list(range(len(word) + 1))
        get = self.ranks.get
        ranks = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(word[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                ranks[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        ids = self.ids
        return [ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _long_word(self, word: bytes) -> list[int]:
        """The same merges in the same order; a heap replaces the scan, which would be
        quadratic in a word of unusual length."""
        n = len(word)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        get = self.ranks.get

        def rank(i: int) -> int:
            j = end[i]
            return get(word[i : end[j]], NO_RANK) if j < n else NO_RANK

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) != NO_RANK]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or rank(i) != _:
                continue
            j = end[i]
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank(k)) != NO_RANK:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        out = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for chunk in chunks(part):
                self._plain.trim()
                self._spaced.trim()
                plain, spaced = pieces(chunk)
                out += map(self._plain.__getitem__, plain)
                out += map(self._spaced.__getitem__, spaced)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        out, table = [], self.bytes_of
        step = 4 << 20
        for at in range(0, len(packed), step):
            ids = memoryview(packed[at : at + step]).cast("I")
            out.append(b"".join(map(table.__getitem__, ids)))
        return b"".join(out).decode("utf-8", "replace")


class _Kept(dict):
    """Finished units; emptied when full, so memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        value = self.make(unit)
        if len(unit) <= 64:
            self[unit] = value
        return value

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path)
