"""64-bit hashes of all words of a text buffer, without a Python string per word.

A word's hash is a polynomial over a random value per byte, taken from one
running sum over the buffer (differences of the sum are divided by the power
of their place), then mixed with the word's length.  A-Z are folded to a-z.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: bytes hashed at once (a longer word goes whole); bounds the temporary columns,
#: of eight bytes a byte, and the kept power tables
WINDOW = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd random multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


#: bytes that are not white space (0x20, 0x09-0x0D)
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 0x20
_BYTE = constants(1, 256)[_FOLD]
_powers = {}


def _power_table(n: int):
    size = max(WINDOW, n)
    if size not in _powers:
        up, down = np.full(size, U(_BASE)), np.full(size, U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = U(1)
        entry = np.cumprod(up), np.cumprod(down)
        if size > WINDOW:  # a word longer than the window: not kept
            return entry
        _powers[size] = entry
    return _powers[size]


def _cut(data, off, word_byte, pos: int, end: int) -> int:
    """End of the next window: behind a separator or at a text's start."""
    stop = pos + WINDOW
    if stop >= end:
        return end
    doc = int(off[np.searchsorted(off, stop, "right") - 1])
    back = np.flatnonzero(~word_byte[data[pos:stop]])
    best = max(doc, pos + int(back[-1]) + 1 if len(back) else 0)
    if best > pos:
        return best
    nxt = int(off[np.searchsorted(off, stop, "left")])
    while stop < nxt:
        ahead = np.flatnonzero(~word_byte[data[stop:min(stop + WINDOW, nxt)]])
        if len(ahead):
            return stop + int(ahead[0]) + 1
        stop = min(stop + WINDOW, nxt)
    return nxt


def hash_words(data: np.ndarray, off: np.ndarray, word_byte: np.ndarray = NON_SPACE, prefixes: tuple = ()):
    """Hashes of the words (runs of ``word_byte`` bytes) of all texts, in
    order, and the offsets of each text's words among them; with ``prefixes``
    also, for each length, the hashes of the words' first so many bytes (0 for
    shorter words)."""
    pos, end = int(off[0]), int(off[-1])
    value = np.where(word_byte, _BYTE, U(0))
    hashes, places = [], []
    heads = [[] for _ in prefixes]
    while pos < end:
        stop = _cut(data, off, word_byte, pos, end)
        b = data[pos:stop]
        inside = word_byte[b]
        starts = off[np.searchsorted(off, pos, "right"):np.searchsorted(off, stop, "left")] - pos
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin[starts] = inside[starts]
        last[starts - 1] = inside[starts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(last)
        up, down = _power_table(len(b))
        total = np.cumsum(value[b] * up[:len(b)], dtype=U)
        before = np.where(s > 0, total[np.maximum(s, 1) - 1], U(0))
        h = total[e] - before
        for out, k in zip(heads, prefixes):
            head = (total[np.minimum(s + k - 1, e)] - before) * down[s]
            out.append(np.where(s + k - 1 <= e, mix(head + U(k * 0xA24BAED4963EE407 % (1 << 64))), U(0)))
        hashes.append(mix(h * down[s] + (e - s + 1).astype(U) * U(0xD1B54A32D192ED03)))
        places.append(s + pos)
        pos = stop
    heads = [np.concatenate([*x, np.zeros(0, U)]) for x in heads]
    if not hashes:
        return np.zeros(0, U), np.zeros(len(off), np.int64), *([heads] if prefixes else [])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), off), *([heads] if prefixes else [])
