"""Suffix-array dedup: the Burrows-Wheeler transform of many strings, built column by column.

`Collection` inserts one symbol of every string each round (from the last to the first) into the
sorted list of the suffixes so far. The transform and the common prefixes of neighbours are two
columns that a round reads from start to end and writes anew. In the end, neighbours with a common prefix
of `window` bytes or more form the intervals of the suffix array in which a repeated string starts.
The columns of a group are held in memory, not in external files: a group is bounded, and a scratch file
would lie on the local disk of one machine, where a lost executor takes it along.

Which strings are inserted. A round per byte of the longest document would be needed for whole texts. So
windows meet through their anchors (the 30-byte string of least hash in each 50-byte window, see
`anchors`): windows whose anchor occurs once in the table repeat nowhere, the others travel as pieces,
runs of neighbouring windows with one anchor. Pieces that are equal, byte by byte, are one string; an anchor
with different strings brings them all into the collection. Hashes only decide which strings meet.

Defined results: order is by doc_id alone, so rows with equal doc_ids take nothing from each other; a null
doc_id is neither smaller nor larger than any, so its row keeps all and no other row loses bytes for it; a
null or empty text has no bytes; an empty table gives an empty result; other columns never take part.
Keys may have any type with an order.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .chunks import pack, pack_bits, unpack, volume
from .common import materialize, trimmed, trimmed_steps, worker_state
from .spans import SpanHash, spread

GRAM = 30
CHUNK_BYTES = 2 << 20
#: Bytes of the table to a group of strings, and windows of a group that are put into a collection at a time, about.
GROUP_BYTES, INSERTED = 12_000_000, 400_000


class RangeMin:
    """Least values[a..b] of many ranges, from a table of the least of each 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.table = np.empty((max(1, len(values).bit_length()), len(values)), values.dtype)
        self.table[0] = values
        for k in range(1, len(self.table)):
            step, n = 1 << (k - 1), len(values) - (1 << k) + 1
            np.minimum(self.table[k - 1, :n], self.table[k - 1, step : step + n], out=self.table[k, :n])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp(b - a + 1)[1] - 1
        return np.minimum(self.table[level, a], self.table[level, b + 1 - (1 << level)])


class Collection:
    """Suffix array (string, suffix length) and common prefixes of a set of strings."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        m = len(starts)
        kind = np.uint8 if sizes.max(initial=0) < 250 and not (text == 255).any() else np.int32

        def before(s, n):
            """The symbol before the suffix of n bytes; 0 at a string's start."""
            return np.where(n < sizes[s], text[np.minimum(starts[s] + np.maximum(sizes[s] - n - 1, 0), len(text) - 1)].astype(kind) + kind(1), kind(0)).astype(kind)

        who = np.arange(m)
        b, common = before(who, 0), np.zeros(m, kind)
        new, n = np.arange(m), 0
        while True:
            symbol = b[new]
            going = np.flatnonzero(symbol > 0)
            order = np.argsort(b, kind="stable")
            ended = int(np.count_nonzero(b == 0))
            if not len(going):
                break
            n += 1
            put = going[np.argsort(symbol[going], kind="stable")]
            who, new, symbol = who[put], new[put], symbol[put]
            mark = np.zeros(len(b), bool)
            mark[new] = True
            r = np.flatnonzero(mark[order])  # ranks of the new ones among all symbols, in the same order as `new`
            to = m + r - ended  # the suffixes of 0 bytes stand first
            least = RangeMin(common)
            prev, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(b) - 1)]
            has_prev, has_after = (r > 0) & (b[prev] == symbol), (r + 1 < len(b)) & (b[after] == symbol)
            up = np.zeros(len(new), kind)
            up[has_prev] = least(prev[has_prev] + 1, new[has_prev]) + kind(1)
            nxt = np.flatnonzero(has_after)
            down = least(new[nxt] + 1, after[nxt]) + kind(1) if len(nxt) else np.zeros(0, kind)
            fresh = np.zeros(m + len(b) - ended, bool)
            fresh[to] = True
            old = ~fresh

            def merged(x, y):
                out = np.empty(len(fresh), kind)
                out[old], out[fresh] = x, y
                return out

            common = merged(common, up)
            common[to[nxt] + 1] = down
            b, new = merged(b, before(who, n)), to
        # each suffix of n bytes leads to that of n + 1 bytes of its string
        rank = np.empty(len(b), np.int64)
        rank[order] = np.arange(len(b)) + m - ended
        self.string, self.length, self.lcp = np.empty(len(b), np.int32), np.zeros(len(b), np.int32), common
        at, who, n = np.arange(m), np.arange(m, dtype=np.int32), 0
        while len(at):
            self.string[at], self.length[at] = who, n
            going = b[at] > 0
            at, who, n = rank[at[going]], who[going], n + 1


def least_owner(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For each window start of each string in turn, the least owner of a string that holds the window."""
    count = np.maximum(sizes - window + 1, 0)
    out = np.zeros(int(count.sum()), owner.dtype)
    if not len(out):
        return out
    c = Collection(text, starts, sizes)
    begun = np.flatnonzero(np.append(True, c.lcp[1:] < window))
    own = owner[c.string]
    least = np.repeat(np.minimum.reduceat(own, begun), np.diff(np.append(begun, len(own))))
    hit = np.flatnonzero(c.length >= window)
    s = c.string[hit]
    out[(np.cumsum(count) - count)[s] + sizes[s] - c.length[hit]] = least[hit]
    return out


def earlier(texts: list[bytes], codes: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string in turn: does it occur in a string of smaller rank. Strings with different codes share no window."""
    number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    alike = np.fromiter(map(number.__getitem__, texts), np.int64, len(texts))
    distinct, sizes = list(number), np.fromiter(map(len, number), np.int64, len(number))
    owner, code = np.full(len(distinct), np.iinfo(np.int64).max), np.zeros(len(distinct), np.uint32)
    np.minimum.at(owner, alike, rank)
    code[alike] = codes
    _, kind, many = np.unique(code, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(many[kind] > 1)  # an anchor's only string is compared with nothing but its copies
    count = sizes - window + 1
    first = np.cumsum(count) - count
    least = np.repeat(owner, count)
    some = sizes[mixed]
    least[spread(first[mixed], count[mixed])] = least_owner(np.frombuffer(b"".join([distinct[i] for i in mixed.tolist()]), np.uint8), np.cumsum(some) - some, some, owner[mixed], window)
    return least[spread(first[alike], count[alike])] < np.repeat(rank, count[alike])


class Bytes:
    """The bytes of a chunk's documents with a key, and the runs of their windows."""

    def __init__(self, block: bytes, ends: np.ndarray, keyed: np.ndarray, window: int, groups: int, bits: int = 64):
        self.block, self.window = block, window
        self.text = np.frombuffer(block, np.uint8)
        self.hash = SpanHash(self.text, bits)
        n = max(0, len(block) - window + 1)
        at = np.arange(max(0, len(block) - GRAM + 1))
        valid = np.zeros(n, bool)
        begin = np.concatenate([[0], ends[:-1]])
        edge = np.zeros(len(block) + 1, np.int64)
        here = keyed & (ends - begin >= window)
        np.add.at(edge, begin[here], 1)
        np.add.at(edge, ends[here] - window + 1, -1)
        valid = np.cumsum(edge)[:n] > 0
        grams = self.hash(at, at + GRAM)
        if bits < 64:
            grams = grams << np.uint64(64 - bits)
        self.runs = anchors.runs(grams, valid)
        self.entries = anchors.Entries(self.runs, groups)
        self.ends = ends

    def text_of(self, first: int, count: int) -> bytes:
        return self.block[first : first + count + self.window - 1]

    def contents(self, by: dict[int, bytes], groups: int) -> tuple[anchors.Pieces, anchors.Contents, np.ndarray]:
        """The pieces, their contents, and the document of each piece."""
        got = anchors.pieces(self.runs, self.entries, by, lambda at: self.hash(at, at + self.window), groups)
        return got, anchors.Contents(got, self.text_of), np.searchsorted(self.ends, got.first, "right")


def _ranks(keys: pa.Array) -> np.ndarray:
    """Dense ranks of keys by their order (null: 0)."""
    return np.where(np.asarray(pc.is_null(keys)), 0, pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)) if len(keys) else np.zeros(0, np.int64)


def removed_bytes(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, crowded: int = anchors.CROWDED, bits: int = 64) -> DataFrame:
    """key, n_bytes, spans (array of first byte and byte after the last of each removed run) and kept (the other bytes). `bits` of all hashes are used (fewer in tests)."""
    chunks = pack(docs, chunk_bytes, key, text)
    kind = docs.schema[key].dataType.simpleString()
    n_bytes = volume(chunks)
    gram_groups, groups = max(16, n_bytes // 11 // anchors.GROUP_GRAMS + 1), max(48, n_bytes // GROUP_BYTES + 1)
    names = ("chunk", "sizes", "body")

    def rows_of(table):
        keys = table.column("keys")
        keys = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).flatten()
        at = 0
        for chunk, sizes, body in zip(*(table.column(c).to_pylist() for c in names)):
            mine = keys.slice(at, len(sizes))
            at += len(sizes)
            block, ends = unpack(body, np.array(sizes, np.int64))
            yield chunk, mine, sizes, ends, Bytes(block, ends, np.asarray(pc.is_valid(mine)), window, gram_groups, bits)

    def deal(batches):
        worker_state(None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                for chunk, _, _, _, b in rows_of(batch.slice(at, 1)):
                    yield b.entries.batch(chunk)

    def ship(rows: pa.Table, marks: pa.Table) -> pa.Table:
        out, owners = {c: [] for c in ("chunk", "grp", "codes", "sizes", "body")}, []
        by = dict(zip(marks.column("grp").to_pylist(), marks.column("bits").to_pylist()))
        for chunk, keys, _, _, b in rows_of(rows):
            _, c, doc = b.contents(by, groups)
            lead = first_docs(c, doc, _ranks(keys))
            for x, y in c.spans:
                out["chunk"].append(chunk)
                out["grp"].append(int(c.grp[x]))
                out["codes"].append(c.code[x:y].tobytes())
                out["sizes"].append(c.count[x:y].astype(np.int32).tobytes())
                out["body"].append(zstandard.ZstdCompressor(1).compress(b"".join(c.texts[x:y])))
                owners.append(keys.take(pa.array(lead[x:y])))
        ends = np.cumsum([0, *map(len, owners)], dtype=np.int32)
        values = pa.concat_arrays(owners) if owners else pa.array([], rows.schema.field("keys").type.value_type)
        return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["grp"], pa.int64()), *(pa.array(out[x], pa.binary()) for x in ("codes", "sizes", "body")), pa.ListArray.from_arrays(pa.array(ends), values)], [*out, "owners"])

    def collect(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        codes, counts = join("codes", np.uint32), join("sizes", np.int32).astype(np.int64)
        rank = _ranks(table.column("owners").combine_chunks().flatten())
        text = b"".join(zstandard.ZstdDecompressor().decompress(raw) for raw in table.column("body").to_pylist())
        ends, first = np.cumsum(counts + window - 1), np.cumsum(counts) - counts
        flags = np.zeros(int(counts.sum()), bool)
        for some in anchors.batches_by_code(codes, counts, INSERTED):
            flags[spread(first[some], counts[some])] = earlier([text[b - n - window + 1 : b] for b, n in zip(ends[some].tolist(), counts[some].tolist())], codes[some], rank[some], window)
        cuts = np.append(first, len(flags))[np.cumsum([len(x) // 4 for x in table.column("codes").to_pylist()])]
        return pa.table({"chunk": table.column("chunk"), "grp": pa.array([-1 - g for g in table.column("grp").to_pylist()], pa.int64()), "bits": pa.array([pack_bits(x) for x in np.split(flags, cuts[:-1])], pa.binary())})

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        by = dict(zip(answers.column("grp").to_pylist(), answers.column("bits").to_pylist()))
        spans, kept, n_bytes = [], [], []
        for _, keys, sizes, ends, b in rows_of(rows):
            got, c, doc = b.contents(by, groups)
            rank = _ranks(keys)
            flags, first = c.flags(by)
            hit = flags[spread(first[c.of_piece], got.count)]
            if len(got.first):  # a smaller document of the same chunk has the piece
                hit |= np.repeat(rank[doc] > rank[first_docs(c, doc, rank)][c.of_piece], got.count)
            starts = spread(got.first, got.count)[hit]
            edge = np.zeros(len(b.text) + window + 1, np.int64)
            edge[starts] += 1
            edge[starts + window] -= 1
            gone = np.cumsum(edge)[: len(b.text)] > 0
            begin = 0
            for size, end in zip(sizes, ends.tolist()):
                mask = gone[begin:end]
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).tolist())
                n_bytes.append(max(size, 0))
                kept.append(b.text[begin:end][~mask].tobytes() if spans[-1] else b.block[begin:end])
                begin = end
        return pa.table([rows.column("keys").combine_chunks().flatten(), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["k", "n_bytes", "spans", "kept"])

    entries = chunks.mapInArrow(lambda batches: trimmed_steps(deal(batches)), anchors.ENTRY_SCHEMA)
    marks = materialize(entries.groupBy("grp").applyInArrow(lambda table: trimmed(anchors.mark, table, crowded), anchors.MARK_SCHEMA), "marks")
    by_chunk = chunks.groupBy("chunk")
    shipped = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(lambda rows, marks: trimmed(ship, rows, marks), f"chunk long, grp long, codes binary, sizes binary, body binary, owners array<{kind}>")
    answers = marks.unionAll(shipped.groupBy("grp").applyInArrow(lambda table: trimmed(collect, table), anchors.MARK_SCHEMA))
    out = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, answers: trimmed(apply, rows, answers), f"k {kind}, n_bytes long, spans array<array<long>>, kept binary")
    return out.withColumnRenamed("k", key)


def first_docs(c: anchors.Contents, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each content, the document of least rank among those of its pieces."""
    order = np.argsort(rank[doc], kind="stable")[::-1]
    out = np.zeros(len(c.texts), np.int64)
    out[c.of_piece[order]] = doc[order]
    return out


def removal_table(docs: DataFrame, window: int = 50) -> DataFrame:
    out = removed_bytes(docs.select("doc_id", "text"), window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d WHERE len(h) >= 100)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, unnest(range(50)) AS k FROM hit)),
runs AS (SELECT r, count(*) AS n, count(*) FILTER (b IS NULL OR b < p - 1) AS spans FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS b FROM gone) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS t FROM (SELECT r, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM d WHERE r IN (SELECT r FROM runs)) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)
"""
