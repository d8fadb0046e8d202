"""Word-shingle sets of whole texts as sorted 64-bit hashes, computed on byte buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from inkwell.llm.tokens import string_buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed at a time; a longer text is one step.
STEP_BYTES = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; kept for steps of usual size."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, STEP_BYTES), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= STEP_BYTES:
            _powers[base] = held
    return held[:n]


def steps_of(at: np.ndarray, size: int):
    """(first, last) rows of consecutive steps of at most ``size`` bytes, one row at least."""
    row = 0
    while row < len(at) - 1:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, stop
        row = stop


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts raw[at[i] : at[i + 1]], A-Z as a-z, and the number of words before each."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = at[:-1][at[1:] > at[:-1]]
    begins[firsts] = inside[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    # the sum of (byte + 1) * base ** place over a word, brought to place 0; white space adds nothing
    terms = np.where(inside, _LOWER[raw].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _power(_BASE, n)
    words = np.add.reduceat(terms, start) * _power(_INVERSE, n)[start]
    return mixed(words), np.searchsorted(start, at)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    A text with fewer words than ``width`` has its whole sequence as one shingle, a
    text without words (or null) none.
    """
    raw, at = string_buffers(texts)
    out = []
    for row, stop in steps_of(at, STEP_BYTES):
        out += _sets(*word_hashes(raw[at[row] : at[stop]], at[row : stop + 1] - at[row]), width)
    return out


def _sets(words: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        total = total + words[k : k + len(total)] * np.uint64(2 * k + 0x2545F4914F6CDD1D)
    total = mixed(total)
    out, at = [], at.tolist()
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            few = np.array([b - a], np.uint64)
            for k in range(a, b):
                few = mixed(few * np.uint64(0x2545F4914F6CDD1D) + words[k : k + 1])
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
