"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces are put into buckets by byte length, one padded matrix of token ids per bucket. Each round,
every row merges its leftmost pair of least rank; pair ranks come from an open-addressing hash table
that is probed for whole columns at once. Rows without a pair left leave the matrix (compaction).
Pieces beyond `LONGEST` bytes are matrices of one row. A round there takes all places of the least rank
from left to right, as long as no pair that a merge makes has a lower rank, so the outcome is that of one
merge a round; the columns that are merged away leave the row.

With a pattern of `SPACE_CUT`, texts are cut before each single space that a non-space follows and
between an ASCII letter and another ASCII character, where such a pattern always has a boundary; the cut
parts are encoded (and remembered) apart, each different one of a batch once. Texts where a space
is followed by white space, and all texts under other patterns, are cut into pre-tokens at once.

Defined results: a null or empty text has no ids and decodes to b""; repeated rows each get their
row; other columns never take part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed_steps, worker_state
from .spans import WHITE, distinct, spread

LONGEST = 256
#: Upper byte lengths of the buckets.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, LONGEST)
#: Parts of a generation that a worker remembers, about.
REMEMBER = 150_000
NONE = np.int32(2**31 - 1)
#: Public pre-token patterns that begin a match at every single space before a non-space, and look at most two characters beyond the end of a match.
SPACE_CUT = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)
#: A space before any kind of white space: such texts are cut into pre-tokens at once.
UNCLEAR = re.compile("[ ][\\s\u180e\u200b\ufeff]")
#: The same white space beyond ASCII, by its UTF-8 bytes: two of them, and three.
WIDE_2 = np.array([0xC285, 0xC2A0], np.uint32)
WIDE_3 = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)], np.uint32)
#: ASCII letters, by byte.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the joined bytes, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left = np.array(keys, np.int64)
        value = np.array(values, np.int32)
        slot = self._hash(left)
        while len(left):
            free = self.keys[slot] < 0
            at = np.flatnonzero(free)
            _, first = np.unique(slot[at], return_index=True)
            won = at[first]
            self.keys[slot[won]], self.values[slot[won]] = left[won], value[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, value, slot = left[rest], value[rest], slot[rest]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & self.mask, slot)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is none or an id is negative (padding)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = key[todo]
        slot = self._hash(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out


class MatrixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.whole = {token: int(i).to_bytes(4, "little") for token, i in ranks.items()}
        self.pairs, self.names = PairTable(ranks), token_bytes(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bucket_of = [next(n for n, top in enumerate(BUCKETS) if size <= top) for size in range(LONGEST + 1)]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as little-endian int32."""
        out = list(map(self.whole.get, pieces))
        by: list[list[int]] = [[] for _ in BUCKETS]
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                if len(piece) > LONGEST or not piece:
                    out[i] = self._long(piece)
                else:
                    by[self.bucket_of[len(piece)]].append(i)
        for width, members in zip(BUCKETS, by):
            for at in range(0, len(members), 20000):
                self._bucket(width, members[at : at + 20000], pieces, out)
        return out

    def _bucket(self, width: int, members: list[int], pieces: list[bytes], out: list) -> None:
        mine = [pieces[i] for i in members]
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in mine]), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, mine), np.int64, len(mine))
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        row = np.array(members)
        while len(row):
            n = np.arange(len(row))
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[n, at]
            done = best == NONE
            if done.any():
                full = ids[done]
                flat = full[full >= 0].astype("<i4").tobytes()
                ends = np.cumsum(size[done] * 4).tolist()
                begin = 0
                for r, end in zip(row[done].tolist(), ends):
                    out[r] = flat[begin:end]
                    begin = end
                going = ~done
                ids, rank, row, size, at, best = ids[going], rank[going], row[going], size[going], at[going], best[going]
                if not len(row):
                    return
                n = n[: len(row)]
            most = int(size.max())
            ids, rank = ids[:, :most], rank[:, : most - 1]  # columns that only hold padding go
            col = np.arange(most - 1)
            shift = col > at[:, None] - 1  # from the merged pair on, everything moves one to the left
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[n, at] = best
            size = size - 1
            if most <= 2:
                rank = np.full((len(row), 1), NONE, np.int32)
                continue
            rank = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            right = np.flatnonzero(at + 1 < most - 1)
            rank[right, at[right]] = self.pairs.ranks(best[right], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.ranks(ids[left, at[left] - 1], best[left])

    def _long(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.ranks(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of places that overlap (aaa), every other from the left
                run = np.cumsum(np.concatenate([[0], np.diff(at) != 1]))
                at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            merged = np.full(len(at), best, np.int32)
            # the pairs that each merge makes, one after the other from the left: with what is before it (merged or not), and with what is after it (not merged yet)
            prev = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            prev[1:][at[1:] - at[:-1] == 2] = best
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.minimum(self.pairs.ranks(prev.astype(np.int32), merged), self.pairs.ranks(merged, after.astype(np.int32))) < best
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            ids = ids[keep]
            rank = np.append(rank, NONE)[keep][:-1]
            to = at - np.arange(len(at))  # where the merged ones are now
            for near in (to - 1, to):
                near = near[(near >= 0) & (near < len(rank))]
                rank[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids.astype("<i4").tobytes()


class Remembered:
    """What parts were found to be, in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int = REMEMBER):
        self.young, self.old, self.most = {}, {}, most

    def get(self, keys: list[bytes]) -> tuple[list, list[int]]:
        """What is known of each key (all different), and the places of the unknown ones. Known ones are young after it."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        found, lost = list(map(self.young.get, keys)), []
        for i, x in enumerate(found):
            if x is None:
                x = self.old.get(keys[i])
                if x is None:
                    lost.append(i)
                else:
                    found[i] = self.young[keys[i]] = x
        return found, lost


class TextEncoder:
    """Encodes texts part by part and remembers parts as packed little-endian ids."""

    kind = np.dtype("<i4")

    def __init__(self, bpe: MatrixBPE, pattern: str):
        import regex

        self.bpe, self.findall, self.spaced, self.parts = bpe, regex.compile(pattern).findall, pattern in SPACE_CUT, Remembered()

    def learn(self, parts: list[bytes]) -> None:
        tokens = [list(map(str.encode, self.findall(x.decode()))) for x in parts]
        pieces = list({t for ts in tokens for t in ts})
        ids = dict(zip(pieces, self.bpe.encode(pieces)))
        self.parts.young.update((x, ids[ts[0]] if len(ts) == 1 else b"".join([ids[t] for t in ts])) for x, ts in zip(parts, tokens))

    def parts_of(self, texts: pa.Array | list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different parts of the texts, the part at each place of all texts in turn, and how many each text has."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = texts.cast(pa.large_string())
        _, offsets, values = wide.buffers()
        offsets = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        block = memoryview(values)[offsets[0] : offsets[-1]].tobytes() if values is not None else b""
        ends = offsets[1:] - offsets[0]
        unclear = self.unclear(block, ends) if self.spaced else np.ones(len(ends), bool)
        keys, which, sizes = _cut(block, ends, unclear)
        if unclear.any():
            more, at, out = {k: i for i, k in enumerate(keys)}, 0, []
            for i, (mixed, size) in enumerate(zip(unclear.tolist(), sizes.tolist())):
                if mixed:
                    out.append(np.array([more.setdefault(x.encode(), len(more)) for x in self.findall(texts[i].as_py())], np.int64))
                else:
                    out.append(which[at : at + size])
                    at += size
            keys, which, sizes = list(more), np.concatenate(out), np.array(list(map(len, out)), np.int64)
        return keys, which, sizes

    def unclear(self, block: bytes, ends: np.ndarray) -> np.ndarray:
        """The texts of a block that are cut into pre-tokens at once (and maybe one that ends with a space)."""
        text = np.frombuffer(block + bytes(3), np.uint8)
        space = np.flatnonzero(text[: len(block)] == 32)
        after = text[space + 1]
        bad = WHITE[after] | ((after >= 0x1C) & (after <= 0x1F))
        wide = np.flatnonzero(after >= 0xC2)
        two = after[wide].astype(np.uint32) << np.uint32(8) | text[space[wide] + 2]
        bad[wide] = np.isin(two, WIDE_2) | np.isin(two << np.uint32(8) | text[space[wide] + 3], WIDE_3)
        out = np.zeros(len(ends), bool)
        out[np.searchsorted(ends, space[bad], "right")] = True
        return out

    def known(self, keys: list[bytes]) -> list:
        """What is remembered of each part, learned before where need be. Long parts are forgotten again."""
        found, lost = self.parts.get(keys)
        if lost:
            new = [keys[i] for i in lost]
            self.learn(new)
            young = self.parts.young
            for i, x in zip(lost, new):
                found[i] = young[x]
                if len(x) > 200:
                    del young[x]
        return found

    def ids(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where those of each text end."""
        keys, which, sizes = self.parts_of(texts)
        found = self.known(keys)
        many = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        each = many[which]
        flat = np.frombuffer(b"".join(found), self.kind)[spread((np.cumsum(many) - many)[which], each)]
        return flat, np.append(0, np.cumsum(each))[np.cumsum(sizes)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        flat, ends = self.ids(texts)
        return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _cut(block: bytes, ends: np.ndarray, leave: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different parts of the texts of a block in which no white space follows a space, which of them are where, and how many each text has. Texts to `leave` have none."""
    text = np.frombuffer(block, np.uint8)
    if not len(text):
        return [], np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    begin = np.zeros(len(text) + 1, bool)
    begin[:-1] = text == 32
    begin[1:-1] |= LETTER[text[:-1]] & ~LETTER[text[1:]] & (text[1:] < 128)
    begin[0] = True
    begin[ends] = True
    starts = np.flatnonzero(begin)  # the last is the end of the block
    sizes, starts = np.diff(starts), starts[:-1]
    count = np.diff(np.searchsorted(starts, ends), prepend=0)
    if leave.any():
        keep = np.repeat(~leave, count)
        starts, sizes, count = starts[keep], sizes[keep], np.where(leave, 0, count)
    keys, which = distinct(block, starts, sizes)
    return keys, which, count


def text_encoder(vocabulary: str, pattern: str) -> TextEncoder:
    return worker_state(("text", vocabulary, pattern), lambda: TextEncoder(MatrixBPE(load_ranks(vocabulary)), pattern))


def token_bytes(ranks: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id and their number."""
    names = {i: t for t, i in ranks.items()}
    table = [names.get(i, b"") for i in range(max(names, default=-1) + 1)]
    return table, np.array([len(x) for x in table], np.int64)


def small_steps(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most` bytes in each, a longer single value alone."""
    for batch in batches:
        at = 0
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if batch.num_rows else np.zeros(0, np.int64)
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def encode_batches(batches: Iterable[pa.RecordBatch], vocabulary: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of k, t to batches of k, ids."""
    encoder = text_encoder(vocabulary, pattern)
    for batch in small_steps(batches, "t"):
        ids, ends = encoder.ids(batch.column("t"))
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))], ["k", "ids"])


def encode_table(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (array<int>) of each row. `vocabulary` is a file of base64 tokens and ranks that every executor can open."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` k", f"`{text}` t").mapInArrow(lambda batches: trimmed_steps(encode_batches(batches, vocabulary, pattern)), f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(ids: pa.Array, table: list[bytes], size: np.ndarray) -> pa.Array:
    """The bytes of each list of ids, from `token_bytes`."""
    flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
    raw = b"".join(map(table.__getitem__, flat.tolist()))
    cuts = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], ends])].tolist()
    return pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())


def decode_table(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """key and bytes (binary) of each row of `encode_table`."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        names = worker_state(("bytes", vocabulary), lambda: token_bytes(load_ranks(vocabulary)))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column("k"), decode(some.column("ids"), *names)], ["k", "bytes"])

    return encoded.selectExpr(f"`{key}` k", "ids").mapInArrow(run, f"k {kind}, bytes binary").withColumnRenamed("k", key)


def round_trip_table(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids, and the bytes the ids decode to, in one pass (one Python worker for each task)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        names = text_encoder(vocabulary, pattern).bpe.names
        for batch in encode_batches(batches, vocabulary, pattern):
            yield pa.RecordBatch.from_arrays([*batch.columns, decode(batch.column("ids"), *names)], ["k", "ids", "bytes"])

    return docs.selectExpr(f"`{key}` k", f"`{text}` t").mapInArrow(lambda batches: trimmed_steps(run(batches)), f"k {kind}, ids array<int>, bytes binary").withColumnRenamed("k", key)


def digest_table(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, from the ids and bytes of `round_trip_table`."""
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return round_trip_table(docs, vocabulary, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), told.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
