"""Word n-grams of whole texts as 64-bit hashes, computed for a block of texts at once."""

from __future__ import annotations

import sys

import numpy as np

from medlink.llm.common import let_go

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD_CHARS: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (SplitMix64's last steps); one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_chars() -> np.ndarray:
    """Whether each code point is a letter, a number or an underscore."""
    global _WORD_CHARS
    if _WORD_CHARS is None:
        _WORD_CHARS = np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])
        _WORD_CHARS[ord("_")] = True
    return _WORD_CHARS


def codes_of(texts: list[str], between: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts in a row, ``between`` after each; start of each text and the end)."""
    let_go()
    codes = np.frombuffer("".join([t + between for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.r_[0, np.cumsum([len(t) + len(between) for t in texts], dtype=np.int64)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]


def hash_runs(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the characters of each run; runs are apart and in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE))
    value = (codes[np.repeat(start, length) + place].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


def gram_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of lower-case words.

    Words are runs of letters, numbers and underscores. A text of 1 to n - 1 words has one n-gram, all its words; one
    without words has none.
    """
    codes, bounds = codes_of([t.lower() for t in texts])
    start, end = runs(word_chars()[codes])
    words = hash_runs(codes, start, end)
    first = np.searchsorted(start, bounds)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mix(grams + words[k : k + len(grams)])
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= n:
            out.append(np.unique(grams[low : high - n + 1]))
        elif high > low:
            one = np.array([high - low], np.uint64)
            for k in range(low, high):
                one = mix(one + words[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
