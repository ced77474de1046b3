"""Edit-aware token counts on segment trees that are kept per document.

`build_trees` writes one row per document: its text, and a segment tree over blocks of its pre-tokens as two
arrays in heap order (node 1 is the root, node i has the children 2i and 2i + 1, the leaves are the second
half) with the characters and the tokens of each subtree. `edit_trees` takes such a table and edit scripts. An
edit (at, drop, put: at character `at` remove `drop` characters and put in `put`) descends to the last block
that can't have looked at the edit, re-encodes from its start to the end of the block behind the edit, and
updates the sums above the touched blocks. The end of a block is a boundary whatever comes before it if a
space and a non-space follow; else pre-tokens are matched on, with the characters behind as context, and the
region grows until a match ends at the end of a block. No other block is read or counted.

Defined results: a null or empty text has no tokens; edits are applied in order of their array, each
to the outcome of those before; places beyond the end mean the end, negative ones the start; a null
`put` is empty; a row without edits keeps its count; repeated rows and rows with a null key each keep their row;
an empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import UNCLEAR, MatrixBPE, TextEncoder, load_ranks, small_steps
from .common import materialize, worker_state

#: Parts (see bpe) in a block.
BLOCK = 16
#: A match of a pattern of SPACE_CUT looks at most so many characters beyond its end.
AHEAD = 2
#: Where `bpe` cuts texts: before a space, and between an ASCII letter and another ASCII character.
CUTS = re.compile(rb"(?= )|(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])")


class PartCounts(TextEncoder):
    """Numbers of tokens of the parts of texts, remembered."""

    def __init__(self, bpe: MatrixBPE, pattern: str, ahead: int | None = None):
        super().__init__(bpe, pattern)
        import regex

        self.finditer = regex.compile(pattern).finditer
        if ahead is None and not self.spaced:
            raise ValueError("say how many characters beyond its end a match of this pattern can look at")
        self.ahead = AHEAD if ahead is None else ahead

    def learn(self, parts: list[bytes]) -> None:
        tokens = [list(map(str.encode, self.findall(x.decode()))) for x in parts]
        pieces = list({t for ts in tokens for t in ts})
        size = dict(zip(pieces, (len(x) // 4 for x in self.bpe.encode(pieces))))
        self.parts.young.update((x, sum([size[t] for t in ts])) for x, ts in zip(parts, tokens))

    def blocks(self, texts: pa.Array | list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Characters and tokens of each block of each text; an empty text has one empty block."""
        keys, which, n = self.parts_of(texts)
        first = np.cumsum(n) - n
        chars = np.fromiter((len(k) if k.isascii() else len(k.decode()) for k in keys), np.int64, len(keys))[which]
        tokens = np.array(self.known(keys), np.int64)[which]
        many = -(-n // BLOCK)
        cuts = np.repeat(first - BLOCK * (np.cumsum(many) - many), many) + BLOCK * np.arange(int(many.sum()))
        sums = [np.add.reduceat(x, cuts) if len(cuts) else x[:0] for x in (chars, tokens)]
        ends, none = np.cumsum(many).tolist(), np.zeros(1, np.int64)
        return [(sums[0][b - k : b], sums[1][b - k : b]) if k else (none, none) for b, k in zip(ends, many.tolist())]

    def cut(self, text: str) -> list[bytes]:
        """The parts of a short text."""
        return [x for x in CUTS.split(text.encode()) if x] if self.spaced and not UNCLEAR.search(text) else list(map(str.encode, self.findall(text)))


def part_counts(vocabulary: str, pattern: str, ahead: int | None) -> PartCounts:
    return worker_state(("counts", vocabulary, pattern, ahead), lambda: PartCounts(MatrixBPE(load_ranks(vocabulary)), pattern, ahead))


def _apart(last: str, behind: str) -> bool:
    """Whether patterns of SPACE_CUT have a boundary between a character and what is behind it, whatever else there is."""
    if last.isascii() and last.isalpha() and behind[0].isascii() and not behind[0].isalpha():
        return True
    return behind[0] == " " and len(behind) > 1 and not UNCLEAR.search(behind)


def heaps(leaves: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of each tree in heap order; trees of one width are summed together."""
    width = np.array([1 << (len(x) - 1).bit_length() for x in leaves])
    out: list = [None] * len(leaves)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w).tolist()
        heap = np.zeros((len(mine), 2 * w), np.int32)
        for row, i in zip(heap, mine):
            row[w : w + len(leaves[i])] = leaves[i]
        half = w
        while half > 1:
            heap[:, half // 2 : half] = heap[:, half : 2 * half : 2] + heap[:, half + 1 : 2 * half : 2]
            half //= 2
        for row, i in zip(heap, mine):
            out[i] = row
    return out


class TokenTree:
    """One document's tree. chars, tokens: the sums in heap order."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], counter: PartCounts):
        self.counter, self.encoded = counter, 0
        self.base, self.chars, self.tokens, self.width = text, chars, tokens, len(chars) // 2
        self.begin, self.changed = list(accumulate(chars[self.width :], initial=0)), {}
        self.pending: dict[int, list[bytes]] = {}  # parts of blocks whose tokens are not counted yet

    @classmethod
    def of(cls, text: str, counter: PartCounts) -> TokenTree:
        chars, tokens = counter.blocks([text])[0]
        return cls(text, heaps([chars])[0].tolist(), heaps([tokens])[0].tolist(), counter)

    @property
    def n_tokens(self) -> int:
        settle([self], self.counter)
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _text(self, i: int) -> str:
        return self.changed[i] if i in self.changed else self.base[self.begin[i] : self.begin[i + 1]]

    def text(self) -> str:
        return "".join(map(self._text, range(self.width))) if self.changed else self.base

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` (the last one with text for the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _add(self, heap: list[int], i: int, value: int) -> None:
        """Give block i a value and update the sums above it."""
        node = self.width + i
        more = value - heap[node]
        while node and more:
            heap[node] += more
            node //= 2

    def _behind(self, last: int, n: int) -> str:
        """The first n characters behind a block."""
        out = ""
        for i in range(last + 1, self.width):
            if len(out) >= n:
                break
            out += self._text(i)[: n - len(out)]
        return out

    def edit(self, at: int, drop: int, put: str) -> None:
        total, ahead = self.n_chars, self.counter.ahead
        at = min(max(at, 0), total)
        drop = min(max(drop, 0), total - at)
        if not (drop or put):
            return
        first, before = self._find(max(at - ahead, 0))
        last, end = self._find(at + drop)
        end += self.chars[self.width + last]
        old = "".join(map(self._text, range(first, last + 1)))
        while True:
            fresh, parts = old[: at - before] + put + old[at + drop - before :], None
            behind = self._behind(last, max(2, ahead)) if end < total else ""
            if not behind or self.counter.spaced and _apart(fresh[-1:], behind):
                parts = self.counter.cut(fresh)
            else:
                pieces, upto = [], 0
                for m in self.counter.finditer(fresh + behind):
                    upto = m.end()
                    if upto > len(fresh):
                        break
                    pieces.append(m.group().encode())
                    if upto == len(fresh):
                        break
                if upto == len(fresh):
                    parts = pieces
            if parts is not None:
                break
            last += 1
            old, end = old + self._text(last), end + self.chars[self.width + last]
        self.encoded += len(fresh)
        if len(fresh) > 200 * BLOCK:
            self._grow(first, last, fresh)
            return
        for i in range(first + 1, last + 1):
            self.changed[i] = ""
            self.pending.pop(i, None)
            self._add(self.chars, i, 0)
            self._add(self.tokens, i, 0)
        self.changed[first], self.pending[first] = fresh, parts
        self._add(self.chars, first, len(fresh))

    def _grow(self, first: int, last: int, fresh: str) -> None:
        """Put the blocks of a long region in place of blocks; the counts of the others stand."""
        settle([self], self.counter)
        rest = [i for i in range(self.width) if not first <= i <= last and self.chars[self.width + i]]
        (c, t), text = self.counter.blocks([fresh])[0], self.text()
        at = sum(self.chars[self.width + i] for i in range(first))
        text = text[:at] + fresh + text[at + sum(self.chars[self.width + i] for i in range(first, last + 1)) :]
        merge = lambda heap, x: np.array([*(heap[self.width + i] for i in rest if i < first), *x.tolist(), *(heap[self.width + i] for i in rest if i > last)], np.int64)
        chars, tokens, encoded = heaps([merge(self.chars, c)])[0].tolist(), heaps([merge(self.tokens, t)])[0].tolist(), self.encoded
        self.__init__(text, chars, tokens, self.counter)
        self.encoded = encoded


def settle(trees: list[TokenTree], counter: PartCounts) -> None:
    """Count the tokens of all blocks that edits have touched, each different part once, and update the sums above them."""
    keys = list({x for tree in trees for parts in tree.pending.values() for x in parts})
    known = dict(zip(keys, counter.known(keys))) if keys else {}
    for tree in trees:
        for i, parts in tree.pending.items():
            tree._add(tree.tokens, i, sum([known[x] for x in parts]))
        tree.pending = {}


def _lists(rows: list) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(x, np.int32) for x in rows]) if rows else np.zeros(0, np.int32)))


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", ahead: int | None = None) -> DataFrame:
    """key, text, chars and tokens (array<int>) of each row: the table of trees, written once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counter = part_counts(vocabulary, pattern, ahead)
        for batch in small_steps(batches, "t"):
            found = counter.blocks(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), *(_lists(heaps([x[i] for x in found])) for i in (0, 1))], ["k", "t", "chars", "tokens"])

    trees = docs.selectExpr(f"`{key}` k", f"`{text}` t").mapInArrow(run, f"k {kind}, t string, chars array<int>, tokens array<int>")
    return materialize(trees.toDF(key, text, "chars", "tokens"), "trees")


def edit_trees(trees: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits", ahead: int | None = None, keep: bool = True) -> DataFrame:
    """trees: rows of `build_trees` with edits, array<struct<at int, drop int, put string>>.

    key, n_tokens, n_tokens_after, n_chars_after and n_chars_encoded (read anew for the edits), and with
    `keep` the edited text, chars and tokens, so that the outcome (its first four columns renamed) is a table of trees again.
    """
    kind = trees.schema[key].dataType.simpleString()
    names = ["k", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded"] + (["t", "chars", "tokens"] if keep else [])

    def run(batches):
        counter = part_counts(vocabulary, pattern, ahead)
        for batch in small_steps(batches, "t"):
            texts = batch.column("t").to_pylist()
            done = [TokenTree(t or "", chars, tokens, counter) for t, chars, tokens in zip(texts, *(batch.column(c).to_pylist() for c in ("chars", "tokens")))]
            before = [tree.tokens[1] for tree in done]
            for tree, script in zip(done, batch.column("e").to_pylist()):
                for e in script or ():
                    if e is not None:
                        tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
            settle(done, counter)
            after, size, encoded = [tree.tokens[1] for tree in done], [tree.n_chars for tree in done], [tree.encoded for tree in done]
            kept = [(None if t is None and not tree.n_chars else tree.text(), *packed(tree)) for t, tree in zip(texts, done)] if keep else []
            more = [pa.array([x[0] for x in kept], pa.string()), _lists([x[1] for x in kept]), _lists([x[2] for x in kept])] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(x, pa.int64()) for x in (before, after, size, encoded)), *more], names)

    rows = trees.selectExpr(f"`{key}` k", f"`{text}` t", "chars", "tokens", f"`{edits}` e")
    out = rows.mapInArrow(run, f"k {kind}, n_tokens long, n_tokens_after long, n_chars_after long, n_chars_encoded long" + (", t string, chars array<int>, tokens array<int>" if keep else ""))
    return out.withColumnsRenamed({"k": key, "t": text})


def packed(tree: TokenTree) -> tuple[np.ndarray, np.ndarray]:
    """The tree's sums without blocks that edits have emptied."""
    full = [i for i in range(tree.width, 2 * tree.width) if tree.chars[i]] or [tree.width]
    return tuple(heaps([np.array([x[i] for i in full], np.int64)])[0] for x in (tree.chars, tree.tokens))


def revision(text: Column) -> Column:
    """A revision script: at each quarter of the text, 7 characters give way to the first 11 of the text."""
    n, start = F.char_length(text), F.substring(text, 1, 11)
    one = lambda q: F.struct(F.floor(n * q / 4).cast("int").alias("at"), F.lit(7).alias("drop"), start.alias("put"))
    return F.array(one(1), one(2), one(3))


def token_count_table(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the counts after the text's revision, which is applied to the written trees."""
    trees = build_trees(docs.select("doc_id", "text"), vocabulary, pattern)
    return edit_trees(trees.withColumn("edits", revision(F.coalesce("text", F.lit("")))), vocabulary, pattern, keep=False)
