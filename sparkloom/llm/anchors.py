"""Windows that may repeat, found by their anchors, and dealt to groups where they are compared.

The anchor of a window is its gram (a run of `k` symbols) of least hash, the leftmost of equal ones. Equal
windows have equal anchors at the same place, so a window whose anchor's gram occurs once in the whole
table repeats nowhere. Hashes only choose here: a clash lets a window through that is then found not to
repeat. Windows that follow each other share their anchor for a while, so what remains travels in pieces:
a piece is a run of windows with one anchor. A gram's pieces meet in one group. Where very many pieces
hold a gram, each of their windows is a piece of its own and is dealt by the hash of all its symbols, so no
group gets more than its share.

Two passes: `entries` of each chunk go to `mark` (does the gram occur again, is it crowded), and the answers
go back to the chunk, where `pieces` makes the pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .chunks import pack_bits, unpack_bits
from .spans import spread

#: Grams in a group of the first pass, about.
GROUP_GRAMS = 4_000_000
#: Pieces of one gram beyond which its windows are dealt apart.
CROWDED = 2_000
MARK_SCHEMA = "chunk long, grp long, bits binary"


@dataclass
class Runs:
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor's gram."""

    first: np.ndarray
    count: np.ndarray
    gram: np.ndarray


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """least of x[i .. i + n - 1]."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[: len(x) - size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(grams: np.ndarray, valid: np.ndarray) -> Runs:
    """grams: hash of the gram at each place; valid: for each window start, whether the window is within one document."""
    n = len(valid)
    if not n:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    low = _slide_min((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), len(grams) - n + 1)
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(begin)
    end = valid.copy()
    end[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    return Runs(first, np.flatnonzero(end) + 1 - first, grams[at[first]])


class Entries:
    """The distinct grams of a chunk's runs by group, how many runs have each, and the entry of each run."""

    def __init__(self, found: Runs, groups: int):
        keys, inverse, many = np.unique(found.gram, return_inverse=True, return_counts=True)
        grp, code = ((keys >> np.uint64(1)) % np.uint64(groups)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((code, grp))
        self.grp, self.code, self.many = grp[order], code[order], np.minimum(many[order], 255).astype(np.uint8)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of_run = rank[inverse]
        cuts = np.flatnonzero(np.diff(self.grp)) + 1
        self.spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)])) if len(order) else []

    def batch(self, chunk: int) -> pa.RecordBatch:
        grp = pa.array([int(self.grp[a]) for a, _ in self.spans], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(self.spans), pa.int64()), grp, *(pa.array([x[a:b].tobytes() for a, b in self.spans], pa.binary()) for x in (self.code, self.many))], ["chunk", "grp", "codes", "many"])

    def answers(self, by: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: does its gram occur again, and is it crowded."""
        bits = [unpack_bits(by[int(self.grp[a])], 2 * (b - a)).reshape(2, -1) for a, b in self.spans]
        both = np.concatenate(bits, 1) if bits else np.zeros((2, 0), bool)
        return both[0], both[1]


ENTRY_SCHEMA = "chunk long, grp long, codes binary, many binary"


def mark(table: pa.Table, crowded: int = CROWDED) -> pa.Table:
    """One group of entries: two bits for each."""
    codes = [np.frombuffer(x, np.uint32) for x in table.column("codes").to_pylist()]
    many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
    _, key = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(key, weights=many)[key]
    bits, ends = np.stack([total > 1, (total > crowded) | (many == 255)]), np.cumsum([len(x) for x in codes])
    most = np.zeros(int(key.max(initial=-1)) + 1, bool)
    np.logical_or.at(most, key, bits[1])  # crowded in one chunk is crowded in all
    bits[1] = most[key]
    return pa.table({"chunk": table.column("chunk"), "grp": table.column("grp"), "bits": pa.array([pack_bits(x.ravel()) for x in np.split(bits, ends[:-1], 1)], pa.binary())})


@dataclass
class Pieces:
    """first window, number of windows, group and code (of the gram, or of the window) of each piece."""

    first: np.ndarray
    count: np.ndarray
    grp: np.ndarray
    code: np.ndarray


def pieces(found: Runs, entries: Entries, by: dict[int, bytes], window_hash, groups: int) -> Pieces:
    """The pieces of a chunk. `window_hash(first windows)` gives the hashes of whole windows."""
    again, crowd = entries.answers(by)
    keep = again[entries.of_run]
    apart = crowd[entries.of_run] & keep
    whole = keep & ~apart
    one = spread(found.first[apart], found.count[apart])
    h = np.concatenate([found.gram[whole], window_hash(one)])
    return Pieces(np.concatenate([found.first[whole], one]), np.concatenate([found.count[whole], np.ones(len(one), np.int64)]), ((h >> np.uint64(3)) % np.uint64(groups)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32))


class Contents:
    """The pieces of a chunk by content: equal ones travel as one. `texts` are the contents in order of group and code."""

    def __init__(self, got: Pieces, text_of):
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(text_of(f, c), len(number)) for f, c in zip(got.first.tolist(), got.count.tolist())), np.int64, len(got.first))
        texts = list(number)
        lead = np.zeros(len(texts), np.int64)
        lead[same[::-1]] = np.arange(len(same))[::-1]  # the first piece of each content
        order = np.lexsort((got.code[lead], got.grp[lead])) if len(texts) else lead
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of_piece, self.texts, lead = rank[same] if len(same) else same, [texts[i] for i in order.tolist()], lead[order]
        self.grp, self.code, self.count = got.grp[lead], got.code[lead], got.count[lead]
        self.many = np.bincount(self.of_piece, minlength=len(texts))
        cuts = np.flatnonzero(np.diff(self.grp)) + 1
        self.spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)])) if len(order) else []

    def flags(self, by: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The answers for all windows of all contents, and where those of each content begin."""
        bits = [unpack_bits(by[-1 - int(self.grp[a])], int(self.count[a:b].sum())) for a, b in self.spans]
        return np.concatenate(bits) if bits else np.zeros(0, bool), np.cumsum(self.count) - self.count


def batches_by_code(codes: np.ndarray, counts: np.ndarray, most: int):
    """Index arrays of pieces, whole codes together, with about `most` windows in each."""
    order = np.argsort(codes, kind="stable")
    c, n = codes[order], np.cumsum(counts[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + most, "right")))
        to = int(np.searchsorted(c, c[to - 1], "right"))
        yield order[at:to]
        at = to
