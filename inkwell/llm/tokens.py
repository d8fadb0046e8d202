"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

A byte-level vocabulary never joins a character with white space after it, nor an
ASCII letter with a following non-letter.  Texts are cut at those places, and the
library encodes each distinct piece once per worker; the ids of a text are the
ids of its pieces.  Texts with rare white space, where other rules hold, are
encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Pieces a worker keeps at most, and the longest piece it keeps.
KEPT_PIECES = 1_000_000
KEPT_BYTES = 24
#: Bytes of text that are cut and looked up at a time; a longer text is one step.
STEP_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ASCII_OTHER = np.zeros(256, bool)
_ASCII_OTHER[33:128] = True
_ASCII_OTHER &= ~_LETTER
#: First bytes of white space beyond ASCII, and the separators 1C to 1F.
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

#: The printable stand-ins of byte-level vocabularies: a byte is itself where that prints, else the next free character.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: b for b in _PRINTS} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Give back the memory of the encoders that earlier stages left in this worker."""
    _encoders.clear()


def sliced(batches, rows: int = 1024):
    """The same rows in small batches, so that a worker holds little at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset:]
    size = int(at[-1])
    raw = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return raw[at[0]:], at - at[0]


def _rare_places(raw: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII (some harmless ones included)."""
    at = np.flatnonzero(_RARE[raw])
    if not len(at):
        return at
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    hit = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    hit |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[hit]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] for all i, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.keys = np.zeros((0, 3), np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces that the tokenizer is asked for one by one."""
        found: list = [None] * len(pieces)
        rest = []
        model = self.tokenizer.model
        for i, piece in enumerate(pieces):
            word = (piece[1:] if piece[:1] == b" " else piece).decode("utf-8")
            if word.isalpha() and max(word) < "\u0250":  # one pre-token: the merges alone decide
                found[i] = [t.id for t in model.tokenize(piece.decode("latin-1").translate(_STAND_IN))]
            else:
                rest.append(i)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            texts = [pieces[i].decode("utf-8") for i in part]
            for i, got in zip(part, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                found[i] = got.ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i] : offsets[i + 1]]."""
        raw, at = string_buffers(texts)
        ids, counts, row = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while row < len(at) - 1:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP_BYTES, "right")) - 1)
            part, ends = self._encode(raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
            ids.append(part)
            counts.append(np.diff(ends))
            row = stop
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        space, letter = _SPACE[raw], _LETTER[raw]
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (letter[:-1] & _ASCII_OTHER[raw[1:]])
        rare = _rare_places(raw)
        if len(rare):
            for t in np.unique(np.searchsorted(at, rare, "right") - 1):
                cut[at[t] : at[t + 1]] = False
        firsts = at[:-1][at[1:] > at[:-1]]
        cut[firsts] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, n))
        starts, counts, flat = self._lookup(raw, begin, length)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return gather(flat, starts, counts), ends[np.searchsorted(begin, at)]

    def _lookup(self, raw, begin, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded = np.concatenate([raw, np.zeros(KEPT_BYTES, np.uint8)])
        keys = np.lib.stride_tricks.sliding_window_view(padded, KEPT_BYTES)[begin].view(np.uint64)
        for word in range(3):
            left = np.clip(length - 8 * word, 0, 8).astype(np.uint64)
            mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
            keys[:, word] &= mask
        short = length <= KEPT_BYTES
        with np.errstate(over="ignore"):
            h = keys[:, 0] * _MIX[0]
            h ^= (h >> np.uint64(29)) + keys[:, 1] * _MIX[1] + keys[:, 2] * _MIX[2]
            h ^= h >> np.uint64(32)
            h *= _MIX[3]
        if len(self.hashes) > KEPT_PIECES:
            self._clear()
        place, known = self._find(h, keys, short)
        starts, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        fresh = np.flatnonzero(short & ~known)
        if len(fresh):
            _, first = np.unique(h[fresh], return_index=True)
            first = fresh[first]
            self._remember(h[first], keys[first], self._ids([raw[b : b + k].tobytes() for b, k in zip(begin[first], length[first])]))
            place, known = self._find(h, keys, short)
        starts[known], counts[known] = self.starts[place[known]], self.counts[place[known]]
        flat, odd = self.flat, np.flatnonzero(~known)
        if len(odd):  # long pieces, and equal hashes of different pieces
            ids = self._ids([raw[b : b + k].tobytes() for b, k in zip(begin[odd], length[odd])])
            counts[odd] = [len(x) for x in ids]
            starts[odd] = len(flat) + np.cumsum(counts[odd]) - counts[odd]
            flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in ids)])
        return starts, counts, flat

    def _find(self, h, keys, short) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return place, short & (self.hashes[place] == h) & (self.keys[place] == keys).all(axis=1)

    def _remember(self, h, keys, ids) -> None:
        counts = np.array([len(x) for x in ids], np.int64)
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))])
        place = np.searchsorted(self.hashes, h)  # h is sorted
        self.hashes, self.keys = np.insert(self.hashes, place, h), np.insert(self.keys, place, keys, axis=0)
        self.starts, self.counts = np.insert(self.starts, place, starts), np.insert(self.counts, place, counts)
