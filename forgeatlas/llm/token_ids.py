"""Ids of whole texts by a byte-level tokenizer file, as numpy arrays.

The vocabulary of the file (``tokenizers`` JSON) is run by tiktoken, which gives the same ids
in a fraction of the time because it tracks no offsets; a test compares both on every code
point. tiktoken's pattern matcher gives up on very long runs of white space, so these are cut
out first and merged by :mod:`.bpe`.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from forgeatlas.llm import bpe

# The last white-space character of a run belongs to what follows; the others are one word.
LONG_SPACE = re.compile(rf"({bpe.SPACE}{{4096,}})(?={bpe.SPACE}|\Z)")
# Fixed value of the tokenizer: its word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """Encoder of one vocabulary file whose ids are its merge order."""

    def __init__(self, path: str):
        import tiktoken

        self.words = bpe.load(path)
        ranks = {word: k for word, k in self.words.ids.items() if k not in self.words.special.values()}
        self.library = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.words.special
        )

    def encode(self, text: str | None, special: bool = True) -> np.ndarray:
        """Ids of a whole text (null: none). ``special``: strings of special tokens in the
        text become these tokens; otherwise they are ordinary text."""
        if not text:
            return np.zeros(0, np.uint32)
        allowed = "all" if special else set()
        out = []
        for chunk in bpe.chunks(text):
            # Odd places of the split are long runs.
            for k, part in enumerate(LONG_SPACE.split(chunk)):
                if k % 2:
                    out.append(np.array(self.words.word(part.encode()), np.uint32))
                elif part:
                    out.append(self.library.encode_to_numpy(part, allowed_special=allowed, disallowed_special=()))
        return out[0] if len(out) == 1 else np.concatenate(out)


@lru_cache(maxsize=2)
def load(path: str) -> TextIds:
    """One encoder per worker process and file."""
    return TextIds(path)
