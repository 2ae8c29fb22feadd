"""Words of many texts at once, cut as a byte-level tokenizer cuts them.

The word pattern of :mod:`.bpe` is worked out on arrays with one entry per UTF-8 byte: a word
begins where the class of characters changes, a single space joins what follows it, the last
white space of a run stands alone or joins, and contractions are cut after.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from forgeatlas.llm.bpe import SPACE

_WHITE, _LETTER, _NUMBER, _OTHER = range(4)
_POINTS = 0x110000
_QUOTE, _BLANK = ord("'"), ord(" ")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    points = "".join(map(chr, range(_POINTS)))
    table = np.full(_POINTS, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (f"{SPACE}+", _WHITE)):
        for found in regex.finditer(pattern, points):
            table[found.start() : found.end()] = kind
    return table


@lru_cache(maxsize=1)
def _ascii_classes() -> bytes:
    kinds = np.full(256, _OTHER, np.uint8)
    for k in range(128):
        kinds[k] = _LETTER if chr(k).isalpha() else _NUMBER if chr(k).isdigit() else _OTHER
    kinds[[*range(9, 14), 32]] = _WHITE
    return kinds.tobytes()


def _classify(data: np.ndarray, raw: bytes) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    kinds = np.frombuffer(bytearray(raw.translate(_ascii_classes())), np.uint8)
    if raw.isascii():
        return kinds
    lead = np.flatnonzero(data >= 0xC0)
    last = len(data) - 1
    one, two, three = (np.minimum(lead + k, last) for k in (1, 2, 3))
    head = data[lead].astype(np.int64)
    low = [data[at].astype(np.int64) & 0x3F for at in (one, two, three)]
    longer, longest = head >= 0xE0, head >= 0xF0
    point = np.where(
        longest,
        (head & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2],
        np.where(longer, (head & 0x0F) << 12 | low[0] << 6 | low[1], (head & 0x1F) << 6 | low[0]),
    )
    kind = _classes()[np.minimum(point, _POINTS - 1)]
    kinds[lead] = kind
    kinds[one] = kind
    kinds[two[longer]] = kind[longer]
    kinds[three[longest]] = kind[longest]
    return kinds


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which the words of texts begin. ``data`` has the UTF-8 bytes of all texts,
    text k from ``offsets[k]`` to ``offsets[k + 1]``."""
    if not len(data):
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    kinds = _classify(data, raw)
    white = kinds == _WHITE
    start = np.ones(len(data), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    # A space joins the solid character behind it.
    start[1:] &= white[1:] | (data[:-1] != _BLANK)
    # The last character of a run of white space, if something solid follows in the text.
    final = white[:-1] & ~white[1:]
    ends = offsets[1:][(offsets[1:] > 0) & (offsets[1:] < len(data))]
    final[ends - 1] = False
    if raw.isascii():
        start[:-1] |= final
    else:
        place = np.flatnonzero(final)
        while (inner := (data[place] & 0xC0) == 0x80).any():
            place -= inner
        start[place] = True
    begins = offsets[:-1]
    start[begins[begins < len(data)]] = True
    quote = np.flatnonzero(data == _QUOTE)
    quote = quote[start[quote]]
    if len(quote):
        stop = offsets[np.searchsorted(offsets, quote, "right")]
        for tails in ((b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")):
            size = 1 + len(tails[0])
            some = quote[quote + size <= stop]
            fits = np.zeros(len(some), bool)
            for tail in tails:
                same = np.ones(len(some), bool)
                for k, byte in enumerate(tail):
                    same &= data[some + 1 + k] == byte
                fits |= same
            some = some[fits]
            start[some + 1] = False
            after = some + size
            start[after[after < len(data)]] = True
    return np.flatnonzero(start)
