"""Parsing of texts at rolling-hash triggers, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# one odd number per byte value
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """Rolling hashes of all substrings of a block, from sums of its prefixes."""

    def __init__(self, block: np.ndarray):
        up, self.down = _powers(len(block))
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_CODES[block] * up[:-1], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes at every place."""
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.down[:len(self.sums) - width])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def phrases(block: np.ndarray, ends: np.ndarray, length: int, trigger: int):
    """The phrases of a block of documents laid end to end; ``ends`` are their ends.

    The trigger of a string of ``length`` bytes is the place of the least
    rolling hash of ``trigger`` bytes in it (the first in a tie). Consecutive
    strings of one trigger make a phrase: from the start of the first to the
    end of the last. Equal strings have equal triggers, at equal distances.

    Returns the document, start, stop and trigger of every phrase, the hash of
    its trigger bytes, and the hash of the phrase with the trigger's place.
    """
    none = np.zeros(0, np.int64)
    if len(block) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(block)
    low = hashes.all(trigger)
    # the place in the low bits: equal hashes are ordered by place
    bits = np.uint64(max(1, int(len(low)).bit_length()))
    keys = (low >> bits << bits) | np.arange(len(low), dtype=np.uint64)
    width = length - trigger + 1
    step, least = 1, keys
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:len(keys) - width + 1], least[width - step:])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.ones(len(place), bool)
    cut = np.zeros(len(place) + 1, np.int32)  # no string crosses the end of a document
    np.add.at(cut, np.minimum(np.maximum(ends - length + 1, starts), len(place)), 1)
    np.add.at(cut, np.minimum(ends, len(place)), -1)
    valid = np.cumsum(cut[:-1]) == 0
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    t = place[s]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1])]))
    start, stop = s[first], s[np.append(first[1:], len(s)) - 1] + length
    at = t[first]
    doc = np.searchsorted(ends, start, "right")
    name = hashes.of(start, stop) + (at - start).astype(np.uint64)
    return doc, start, stop, at, low[at], _mixed(name)
