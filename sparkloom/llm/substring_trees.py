"""Substring dedup with prefix-partitioned suffix trees.

Suffixes are cut at `window` words, since what is looked for are nodes at that depth or deeper. They are
dealt to groups by a part of variable length: the run of 8 words of least hash in the suffix's window (its
anchor), and all `window` words of it where very many suffixes share the anchor. The part isn't the
suffix's first words, because neighbouring suffixes then go to different groups and each needs its own copy
of its 35 words; by anchors, neighbours travel as one run of words. Suffixes whose anchor occurs once in
the table are nobody's equals and stay at home (see `anchors`).

Each group builds its subtree over the words themselves: the sorted suffixes and the common prefixes of
neighbours (in words). Neighbours with `window` words or more in common hang below one internal node of
that depth; a node with two leaves or more is a repeat, and repeats that start at consecutive words join
to maximal ones. Hashes only decide which suffixes meet; words decide whether they are equal.

Equal runs of one chunk travel as one, so a passage in a third of all documents costs one run per chunk,
and the answer is one bit per suffix.

Defined results: a null or empty text has no words; texts shorter than `window` words keep all; repeated
rows are repeats of each other, whatever their keys (null ones too); other columns never take part; an
empty table gives an empty result. Keys may have any type.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .chunks import CHUNK_BYTES, pack, pack_bits, unpack, volume
from .common import materialize, trimmed, trimmed_steps, worker_state
from .spans import SpanHash, rolling, spread, word_spans

GRAM = 8
#: Words of the table to a group of subtrees, and suffixes of a group that are sorted at a time, about.
GROUP_WORDS, SORTED = 1_500_000, 200_000


class Words:
    """The words of a chunk, and the runs of its windows."""

    def __init__(self, block: bytes, ends: np.ndarray, window: int, groups: int, bits: int = 64):
        self.block, self.window = block, window
        text = np.frombuffer(block, np.uint8)
        self.starts, self.stops, self.doc = word_spans(text, ends)
        self.counts = np.bincount(self.doc, minlength=len(ends))
        self.symbols = SpanHash(text, bits)(self.starts, self.stops)
        n = max(0, len(self.starts) - window + 1)
        grams = rolling(self.symbols, (min(GRAM, window),))[min(GRAM, window)]
        self.runs = anchors.runs(grams & np.uint64(((1 << bits) - 1) << (64 - bits)), self.doc[:n] == self.doc[window - 1 :][:n])
        self.entries = anchors.Entries(self.runs, groups)

    def text_of(self, first: int, count: int) -> bytes:
        """The words of `count` windows, joined by a space."""
        return b" ".join(self.block[self.starts[first] : self.stops[first + count + self.window - 2]].split())

    def contents(self, by: dict[int, bytes], groups: int) -> tuple[anchors.Pieces, anchors.Contents]:
        whole = lambda at: rolling(self.symbols, (self.window,))[self.window][at]
        got = anchors.pieces(self.runs, self.entries, by, whole, groups)
        return got, anchors.Contents(got, self.text_of)


def repeated_suffixes(texts: list[bytes], many: np.ndarray, window: int) -> list[np.ndarray]:
    """For each run of words, a flag per suffix of `window` words or more: its node has another leaf. many: how often a run occurs."""
    number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    alike = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
    times = np.bincount(alike, weights=many)
    words = [t.split(b" ") for t in number]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    names = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    symbols = np.fromiter(map(names.__getitem__, flat), ">u4", len(flat))
    counts = sizes - window + 1
    at = spread(np.cumsum(sizes) - sizes, counts)
    paths = np.lib.stride_tricks.sliding_window_view(symbols, window)[at]
    order = np.argsort(np.ascontiguousarray(paths).view(f"S{4 * window}").ravel(), kind="stable")  # bytes in order are words in order
    near = paths[order]
    common = np.zeros(len(order) + 1, np.int64)  # common prefix with the suffix before
    different = near[1:] != near[:-1]
    common[1:-1] = np.where(different.any(1), different.argmax(1), window)
    deep = np.empty(len(order), bool)
    deep[order] = (common[1:] >= window) | (common[:-1] >= window)
    deep |= np.repeat(times > 1, counts)
    each = np.split(deep, np.cumsum(counts)[:-1])
    return [each[i] for i in alike.tolist()]


def repeated_words(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, extra: tuple[str, ...] = (), as_is: bool = False, crowded: int = anchors.CROWDED, bits: int = 64) -> DataFrame:
    """key, n_words, spans (array of the first word and the one after the last of each maximal repeat, overlapping ones joined) and kept (the other words, joined by a space), and the `extra` columns.

    With `as_is`, kept is the text itself where no word is removed. `bits` of all hashes are used (fewer in tests).
    """
    chunks = pack(docs, chunk_bytes, key, text, extra)
    kind, kinds = docs.schema[key].dataType.simpleString(), [docs.schema[c].dataType.simpleString() for c in extra]
    n_words = volume(chunks) // 6  # about; groups need only be about even
    gram_groups, groups = max(16, n_words // 14 // anchors.GROUP_GRAMS + 1), max(48, n_words // GROUP_WORDS + 1)

    def of(sizes: list[int], body: bytes) -> Words:
        return Words(*unpack(body, np.array(sizes, np.int64)), window, gram_groups, bits)

    def deal(batches):
        worker_state(None, None)
        for batch in batches:
            for chunk, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "body"))):
                yield of(sizes, body).entries.batch(chunk)

    def ship(rows: pa.Table, marks: pa.Table) -> pa.Table:
        out = {c: [] for c in ("chunk", "grp", "codes", "sizes", "many", "body")}
        by = dict(zip(marks.column("grp").to_pylist(), marks.column("bits").to_pylist()))
        for chunk, sizes, body in zip(*(rows.column(c).to_pylist() for c in ("chunk", "sizes", "body"))):
            c = of(sizes, body).contents(by, groups)[1]
            for a, b in c.spans:
                out["chunk"].append(chunk)
                out["grp"].append(int(c.grp[a]))
                out["codes"].append(c.code[a:b].tobytes())
                out["sizes"].append(c.count[a:b].astype(np.int32).tobytes())
                out["many"].append(np.minimum(c.many[a:b], 2).astype(np.uint8).tobytes())
                out["body"].append(zstandard.ZstdCompressor(1).compress(b"\n".join(c.texts[a:b])))
        return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["grp"], pa.int64()), *(pa.array(out[x], pa.binary()) for x in ("codes", "sizes", "many", "body"))], list(out))

    def subtree(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        codes, counts, many = join("codes", np.uint32), join("sizes", np.int32).astype(np.int64), join("many", np.uint8)
        texts = [t for raw in table.column("body").to_pylist() for t in zstandard.ZstdDecompressor().decompress(raw).split(b"\n")]
        flags, first = np.zeros(int(counts.sum()), bool), np.cumsum(counts) - counts
        for some in anchors.batches_by_code(codes, counts, SORTED):
            flags[spread(first[some], counts[some])] = np.concatenate(repeated_suffixes([texts[i] for i in some.tolist()], many[some], window))
        ends = np.append(first, len(flags))[np.cumsum([len(x) // 4 for x in table.column("codes").to_pylist()])]
        return pa.table({"chunk": table.column("chunk"), "grp": pa.array([-1 - g for g in table.column("grp").to_pylist()], pa.int64()), "bits": pa.array([pack_bits(x) for x in np.split(flags, ends[:-1])], pa.binary())})

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, totals, spans, kept = [], [], [], []
        by = dict(zip(answers.column("grp").to_pylist(), answers.column("bits").to_pylist()))
        for sizes, body in zip(*(rows.column(c).to_pylist() for c in ("sizes", "body"))):
            w = of(sizes, body)
            got, c = w.contents(by, groups)
            flags, first = c.flags(by)
            starts = spread(got.first, got.count)[flags[spread(first[c.of_piece], got.count)]]
            edge = np.zeros(len(w.starts) + window + 1, np.int64)
            edge[starts] += 1
            edge[starts + window] -= 1
            gone = np.cumsum(edge)[: len(w.starts)] > 0
            at, end = 0, 0
            for n, size in zip(w.counts.tolist(), sizes):
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone[at : at + n].astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                whole = w.block[end : end + max(size, 0)]
                totals.append(n)
                spans.append(turns)
                if turns or not as_is:
                    bounds = [0, *(x for t in turns for x in t), n]  # words kept are those from each even place to the next
                    parts = [w.block[w.starts[at + a] : w.stops[at + b - 1]].split() for a, b in zip(bounds[::2], bounds[1::2]) if a < b]
                    kept.append(b" ".join(x for p in parts for x in p))
                else:
                    kept.append(None if size < 0 else whole)
                at, end = at + n, end + max(size, 0)
        flat = lambda c: rows.column(c).combine_chunks().flatten()
        return pa.table([flat("keys"), pa.array(totals, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), *(flat(f"x{i}") for i in range(len(kinds)))], ["k", "n_words", "spans", "kept", *(f"x{i}" for i in range(len(kinds)))])

    entries = chunks.select("chunk", "sizes", "body").mapInArrow(lambda batches: trimmed_steps(deal(batches)), anchors.ENTRY_SCHEMA)
    marks = materialize(entries.groupBy("grp").applyInArrow(lambda table: trimmed(anchors.mark, table, crowded), anchors.MARK_SCHEMA), "marks")
    by_chunk = chunks.groupBy("chunk")
    shipped = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(lambda rows, marks: trimmed(ship, rows, marks), "chunk long, grp long, codes binary, sizes binary, many binary, body binary")
    answers = marks.unionAll(shipped.groupBy("grp").applyInArrow(lambda table: trimmed(subtree, table), anchors.MARK_SCHEMA))
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, answers: trimmed(apply, rows, answers), f"k {kind}, n_words long, spans array<array<long>>, kept binary" + "".join(f", x{i} {x}" for i, x in enumerate(kinds)))
    return out.select(F.col("k").alias(key), "n_words", "spans", F.col("kept").cast("string").alias("kept"), *(F.col(f"x{i}").alias(c) for i, c in enumerate(extra)))


def removal_table(docs: DataFrame, window: int = 35) -> DataFrame:
    out = repeated_words(docs.select("doc_id", "text"), window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, unnest(range(35)) AS k FROM rep)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""
