"""Word shingles as sets of 64-bit codes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit codes of words, remembered for the rows of one batch."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}

    def codes(self, text: str | None) -> np.ndarray:
        """The codes of the words of a text with A-Z lower-cased; bytes split at exactly the six blanks."""
        at, digest = self.at, xxhash.xxh3_64_intdigest
        out = []
        for w in text.encode().lower().split() if text else ():
            c = at.get(w)
            if c is None:
                c = at[w] = digest(w)
            out.append(c)
        return np.array(out, np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of ``n`` words, sorted; fewer words are one run; no words, no run."""
    if not len(words):
        return words
    size = min(n, len(words))
    code = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        code = mix(code * _MIX + words[k : k + len(code)])
    return np.unique(code)
