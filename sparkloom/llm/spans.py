"""Words, hashes and ranges over blocks of bytes, in numpy."""

from __future__ import annotations

import numpy as np

#: [\x20\x09-\x0D], by byte.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def word_spans(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of a block begin and end (in bytes), and the numbers of their documents."""
    n = len(text)
    white = WHITE[text]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[ends] = True
    begin, stop = ~white, ~white
    begin[1:] &= white[:-1] | cut[1:n]
    stop[:-1] &= white[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(ends, starts, "right")


BASE = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte.
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """64-bit hashes of any spans of a block, from prefix sums of its bytes. `bits` leaves fewer of them, to force clashes in tests."""

    def __init__(self, text: np.ndarray, bits: int = 64):
        n, self.mask = len(text), np.uint64((1 << bits) - 1)
        power = lambda x: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[text] * power(BASE)[:n], out=self.sums[1:])
        self.inverse = power(pow(BASE, -1, 1 << 64))

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return scramble((self.sums[stops] - self.sums[starts]) * self.inverse[starts]) & self.mask


def rolling(symbols: np.ndarray, depths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """64-bit path hashes of the `d` symbols from each place, for each depth; places with fewer left than the deepest are missing.

    Hashes of depth 1, 2, 4, ... are joined to any depth: hash(a + b) = hash(a) * B**len(b) + hash(b).
    """
    deepest = max(depths)
    n = max(0, len(symbols) - deepest + 1)
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    level, out, size = {1: symbols.astype(np.uint64)}, {}, 1
    while size * 2 <= deepest:
        h = level[size]
        level[size * 2] = h[: max(0, len(h) - size)] * power(size) + h[size:]
        size *= 2
    for d in depths:
        at, h = 0, None
        for s in sorted(level, reverse=True):
            if d - at >= s:
                h = level[s][:n].copy() if h is None else h * power(s) + level[s][at : at + n]
                at += s
        out[d] = scramble(h)
    return out


def _loads(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as one number."""
    wide = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))[at]
    short = sizes < 8
    wide[short] &= (np.uint64(1) << (sizes[short] * 8).astype(np.uint64)) - np.uint64(1)
    return wide


def distinct(block: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different spans of a block, and which of them each span is.

    Spans of up to 16 bytes are compared by size, first and last 8 bytes, in numpy; longer ones by a dict.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    text = np.frombuffer(block + bytes(8), np.uint8)
    which, small = np.empty(len(starts), np.int64), np.flatnonzero(sizes <= 16)
    at, n = starts[small], sizes[small]
    head, tail = _loads(text, at, n), _loads(text, at + np.maximum(n - 8, 0), n)
    h = scramble(head * np.uint64(BASE) + tail + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(h)
    sorted_ = h[order]
    new = np.ones(len(order), bool)
    for x in (head, tail, n):  # equal hashes: the same span, or a new one where one of these differs
        y = x[order]
        np.logical_or(new[1:], y[1:] != y[:-1], out=new[1:]) if x is not head else np.not_equal(y[1:], y[:-1], out=new[1:])
    which[small[order]] = np.cumsum(new) - 1
    lead = order[new]
    if (new[1:] & (sorted_[1:] == sorted_[:-1])).any():  # different spans share a hash, so equal ones may lie apart
        number: dict[bytes, int] = {}
        which[small] = [number.setdefault(block[a : a + k], len(number)) for a, k in zip(at.tolist(), n.tolist())]
        keys = list(number)
    else:
        keys = [block[a : a + k] for a, k in zip(at[lead].tolist(), n[lead].tolist())]
    if len(small) < len(starts):
        more: dict[bytes, int] = {}
        large = np.flatnonzero(sizes > 16)
        which[large] = [more.setdefault(block[a : a + k], len(keys) + len(more)) for a, k in zip(starts[large].tolist(), sizes[large].tolist())]
        keys += more
    return keys, which
