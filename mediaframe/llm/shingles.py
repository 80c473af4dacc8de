"""Word shingles of Arrow text columns as 64-bit numbers, by NumPy over whole blocks of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are hashed at once; a longer text is cut at white space, which changes nothing.
BLOCK = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 1024), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def _word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in raw and end at `ends`; words in each text."""
    solid = ~_BLANK[raw]
    first = np.empty(len(raw), bool)
    first[:1] = True
    first[1:] = ~solid[:-1]
    starts = ends[:-1]
    first[starts[starts < len(raw)]] = True
    first &= solid
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    chars = _LOWER[raw[solid]].astype(np.uint64) + np.uint64(1)
    rank = np.cumsum(solid)[at] - 1  # of each word's first byte among the solid ones
    sizes = np.diff(np.append(rank, len(chars)))
    place = np.arange(len(chars)) - np.repeat(rank, sizes)
    hashes = np.add.reduceat(chars * _power(int(sizes.max()))[place], rank)
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    return mix(hashes ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), counts


_MULTIPLIERS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _sets(words: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        total = np.zeros(n, np.uint64)
        for k in range(WORDS):
            total += mix(words[k : k + n] * _MULTIPLIERS[k])
        total = mix(total)
    at = 0
    for c in counts.tolist():
        if c >= WORDS:
            found = np.sort(total[at : at + c - WORDS + 1])
            keep = np.empty(len(found), bool)
            keep[:1] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif c:
            own = np.uint64(c) * np.uint64(0xA0761D6478BD642F)
            for k in range(c):
                own = own + mix(words[at + k : at + k + 1] * _MULTIPLIERS[k])
            yield mix(own ^ np.uint64(0x5851F42D4C957F2D))
        else:
            yield words[:0]
        at += c


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct 5-word shingles as sorted numbers; fewer words are one shingle; null and blank texts have none."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    with np.errstate(over="ignore"):
        k = 0
        while k < len(column):
            j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
            lo, hi = int(offsets[k]), int(offsets[j])
            if hi - lo <= 2 * BLOCK:
                yield from _sets(*_word_hashes(data[lo:hi], offsets[k + 1 : j + 1] - lo))
            else:
                parts = []
                while lo < hi:
                    cut = min(lo + BLOCK, hi)
                    while cut < hi and not _BLANK[data[cut]]:
                        ahead = np.flatnonzero(_BLANK[data[cut : min(cut + BLOCK, hi)]])
                        cut = cut + int(ahead[0]) if len(ahead) else min(cut + BLOCK, hi)
                    parts.append(_word_hashes(data[lo:cut], np.array([cut - lo]))[0])
                    lo = cut
                words = np.concatenate(parts)
                yield from _sets(words, np.array([len(words)]))
            k = j
