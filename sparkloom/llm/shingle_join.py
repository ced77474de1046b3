"""Exact self-join of texts on the Jaccard similarity of their word shingles, by prefix filtering.

The shingles of all texts have one order: rare before common, then by hash. If two sets of n and m >= n
shingles reach the similarity t, they share at least t / (1 + t) * (n + m) shingles, so the first shingle
they share is among the first n - ceil(2t / (1 + t) * n) + 1 of the smaller and the first
m - ceil(t * m) + 1 of the larger. Texts therefore meet in buckets, one for each such shingle. Shingles
of a single text meet nothing and are left out, so a text without near copies gets few rows or none.

How common a shingle is comes from counts by its group and 32 bits of its hash: a clash makes it seem
more common, which moves its place in the order for all texts alike and loses no pair.

Within a bucket, first all are compared with one leader for each class of sizes, which joins large groups
in linear time and is repeated with other leaders; then every pair of the bucket whose ends aren't yet in one component is a candidate, so
the components are those of all pairs.

A bucket of very many texts is never brought together: its leaders are a grouped minimum that is broadcast (a row for each such
bucket and class of sizes), and for the pairs that are left, the texts outside its largest component meet parts of the bucket in tasks
of their own.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import pack, unpack, volume
from .common import materialize, trimmed, trimmed_steps, worker_state
from .spans import SpanHash, rolling, word_spans

CHUNK_BYTES = 1 << 20
GROUP_SHINGLES = 1_000_000
EPS = 1e-9


#: ASCII letters in lower case, by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(block: bytes, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a block, as the number of the text and the hash, in this order."""
    import xxhash

    text = LOWER[np.frombuffer(block, np.uint8)]
    starts, stops, doc = word_spans(text, ends)
    paths = rolling(SpanHash(text)(starts, stops), (shingle,))[shingle]
    whole = doc[: len(paths)] == doc[shingle - 1 :][: len(paths)]
    counts = np.bincount(doc, minlength=len(ends))
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    begin = ends - np.diff(ends, prepend=0)
    few = np.fromiter((xxhash.xxh64_intdigest(b" ".join(block[a:b].lower().split()), seed=1) for a, b in zip(begin[short].tolist(), ends[short].tolist())), np.uint64, len(short))
    owner, h = np.concatenate([doc[: len(paths)][whole], short]), np.concatenate([paths[whole], few])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _keys(h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct group << 32 | low bits of the hashes in order, how many each has, and the key of each hash."""
    return np.unique(((h >> np.uint64(40)) % np.uint64(groups)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where the groups begin and the last ends."""
    group = keys >> np.uint64(32)
    return np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def at_least(share: float, n):
    return np.ceil(share * n - EPS).astype(np.int64)


def prefixes(docs: DataFrame, shingle: int = 5, least: float = 0.8, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """d, token, n, pos: the shingles in the prefix of each text (doc_id, text) that other texts have too, the number of its shingles and the place in their order."""
    chunks = pack(docs.select("doc_id", "text"), chunk_bytes)
    groups = max(8, volume(chunks) // 6 // GROUP_SHINGLES + 1)

    def deal(batches):
        worker_state(None, None)
        for batch in batches:
            for chunk, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "body"))):
                keys, _, many = _keys(shingle_hashes(*unpack(body, np.array(sizes, np.int64)), shingle)[1], groups)
                low, many, cuts = keys.astype(np.uint32), np.minimum(many, 255).astype(np.uint8), _cuts(keys)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                grp = (keys[cuts[:-1]] >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(spans), pa.int64()), pa.array(grp), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())], ["chunk", "grp", "low", "many"])

    def weigh(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        _, key = np.unique(np.concatenate(low), return_inverse=True)
        texts = np.bincount(key, weights=np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8))
        rank = np.where(texts < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(texts)))).astype(np.uint8)[key]
        return pa.table({"chunk": table.column("chunk"), "grp": table.column("grp"), "rank": pa.array([x.tobytes() for x in np.split(rank, np.cumsum([len(x) for x in low])[:-1])], pa.binary())})

    def choose(rows: pa.Table, answers: pa.Table) -> pa.Table:
        by = dict(zip(answers.column("grp").to_pylist(), answers.column("rank").to_pylist()))
        out = []
        for ids, sizes, body in zip(*(rows.column(c).to_pylist() for c in ("keys", "sizes", "body"))):
            text, h = shingle_hashes(*unpack(body, np.array(sizes, np.int64)), shingle)
            keys, key, _ = _keys(h, groups)
            rank = np.frombuffer(b"".join(by[g] for g in (keys[_cuts(keys)[:-1]] >> np.uint64(32)).tolist()), np.uint8)[key]
            n = np.bincount(text, minlength=len(ids))
            prefix = n - at_least(least, n) + 1
            some = (np.bincount(text[rank == 0], minlength=len(ids)) < prefix)[text]
            text, h, rank = text[some], h[some], rank[some]
            order = np.lexsort((h, rank, text))
            text, h, rank = text[order], h[order], rank[order]
            pos = np.arange(len(text)) - np.searchsorted(text, text)
            use = (pos < prefix[text]) & (rank > 0)
            out.append((np.array(ids, np.int64)[text[use]], h[use].view(np.int64), n[text[use]], pos[use]))
        return pa.table({c: np.concatenate(xs) if out else np.zeros(0, np.int64) for c, xs in zip(("d", "token", "n", "pos"), zip(*out) if out else [()] * 4)})

    counted = chunks.select("chunk", "sizes", "body").mapInArrow(lambda batches: trimmed_steps(deal(batches)), "chunk long, grp long, low binary, many binary").groupBy("grp").applyInArrow(lambda table: trimmed(weigh, table), "chunk long, grp long, rank binary")
    return materialize(chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lambda rows, answers: trimmed(choose, rows, answers), "d long, token long, n long, pos long"), "prefixes")


def may_reach(n, pos, m, at, least: float):
    """Whether sets of n and m shingles that share the one at `pos` and `at` as their first may be similar."""
    small = np.where(n <= m, pos, at) <= np.minimum(n, m) - at_least(2 * least / (1 + least), np.minimum(n, m))
    shared = np.minimum(pos, at) + 1 + np.minimum(n - pos, m - at) - 1
    return small & (np.minimum(n, m) >= least * np.maximum(n, m) - EPS) & (shared >= at_least(least / (1 + least), n + m))


def _stars(salt: int):
    def way(d, n, pos, c, least):
        order = np.lexsort((d, n))
        d, n, pos, c = d[order], n[order], pos[order], c[order]
        # a leader depends on the whole bucket, so that a text meets other leaders in other buckets
        mixed = (d.astype(np.uint64) ^ np.uint64((int(pos.sum()) + salt) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        lead, i = np.empty(len(d), np.int64), 0
        while i < len(d):  # all of a class may reach each other by size; rounds grow with the logarithm of the sizes
            end = int(np.searchsorted(n, n[i] / least + EPS, "right"))
            found, at, many = np.unique(c[i:end], return_inverse=True, return_counts=True)
            lead[i:end] = i + np.argmin(np.where(at == np.argmax(many), mixed[i:end], np.uint64((1 << 64) - 1)))
            i = end
        ok = may_reach(n[lead], pos[lead], n, pos, least) & (d != d[lead]) & (c != c[lead])
        yield d[lead[ok]], d[ok]

    return way


def _across(d, n, pos, c, least):
    order = np.argsort(n, kind="stable")
    d, n, pos, c = d[order], n[order], pos[order], c[order]
    found, many = np.unique(c, return_counts=True)
    large = found[np.argmax(many)]
    low, high = np.searchsorted(n, least * n - EPS), np.searchsorted(n, n / least + EPS, "right")
    for i in np.flatnonzero(c != large).tolist():
        a, b = int(low[i]), int(high[i])
        ok = (c[a:b] != c[i]) & ((c[a:b] == large) | (np.arange(a, b) > i)) & may_reach(n[i], pos[i], n[a:b], pos[a:b], least)
        if ok.any():
            v = d[a:b][ok]
            yield np.full(len(v), d[i]), v


def _pairs(rows: DataFrame, way, least: float) -> DataFrame:
    """u < v: pairs that `way` finds in the buckets of rows (token, d, n, pos, c)."""

    def run(batches):
        for batch in batches:
            m = batch.column("m")
            ends = m.offsets.to_numpy()
            cols = [x.to_numpy(zero_copy_only=False) for x in m.values.flatten()]
            us, vs, held = [], [], 0
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                for u, v in way(*(x[a:b] for x in cols), least):
                    us.append(np.minimum(u, v))
                    vs.append(np.maximum(u, v))
                    held += len(u)
                    if held > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                        us, vs, held = [], [], 0
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    m = rows.groupBy("token").agg(F.collect_list(F.struct("d", "n", "pos", "c")).alias("m"), F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b")
    return m.select("m").mapInArrow(run, "u long, v long").distinct()


def named(tokens: DataFrame, stars: DataFrame | None) -> DataFrame:
    """tokens with c, the component so far. stars: a, b as components() gives them."""
    if stars is None:
        return tokens.withColumn("c", F.col("d"))
    return tokens.join(stars.select(F.col("a").alias("d"), F.col("b").alias("root")), "d", "left").select("token", "d", "n", "pos", F.coalesce("root", "d").alias("c"))


#: Texts of a bucket beyond which it is dealt to several tasks, and such buckets at most; texts outside the largest component in one task.
CROWDED, MOST_CROWDED, OUTSIDE = 20_000, 20_000, 2_000


def crowded_buckets(tokens: DataFrame, limit: int = CROWDED) -> tuple[int, DataFrame | None]:
    """The size of the largest bucket; token and many of those beyond the limit, or None. They are fewer than MOST_CROWDED."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("many"))
    most, total = counts.agg(F.max("many"), F.sum("many")).first()
    limit = max(limit, (total or 0) // MOST_CROWDED)
    if (most or 0) <= limit:
        return most or 0, None
    return most, materialize(counts.filter(F.col("many") > limit).withColumn("parts", F.ceil(F.col("many") / limit).cast("long")), "crowded")


def reach(n: Column, pos: Column, m: Column, at: Column, least: float) -> Column:
    """`may_reach` as an expression."""
    ceil = lambda share, x: F.ceil(F.lit(share) * x - F.lit(EPS))
    low, high = F.least(n, m), F.greatest(n, m)
    small = F.when(n <= m, pos).otherwise(at) <= low - ceil(2 * least / (1 + least), low)
    return small & (low >= F.lit(least) * high - F.lit(EPS)) & (F.least(pos, at) + F.least(n - pos, m - at) >= ceil(least / (1 + least), n + m))


def _crowded_stars(rows: DataFrame, least: float, salt: int) -> DataFrame:
    classed = rows.withColumn("k", F.floor(F.log("n") / F.lit(-log(least))))
    lead = classed.groupBy("token", "k").agg(F.min_by(F.struct("d", "n", "pos", "c"), F.xxhash64("d", F.lit(salt))).alias("l"))
    both = classed.join(F.broadcast(lead), ["token", "k"]).filter((F.col("c") != F.col("l.c")) & reach(F.col("l.n"), F.col("l.pos"), F.col("n"), F.col("pos"), least))
    return both.select(F.least("d", "l.d").alias("u"), F.greatest("d", "l.d").alias("v"))


def _crowded_across(rows: DataFrame, crowd: DataFrame, least: float) -> DataFrame:
    sizes = rows.groupBy("token", "c").agg(F.count("*").alias("size"))
    large = sizes.groupBy("token").agg(F.max_by("c", F.struct("size", "c")).alias("large"), (F.sum("size") - F.max("size")).alias("others"))
    facts = crowd.join(large, "token").filter("others > 0").withColumn("shares", F.ceil(F.col("others") / OUTSIDE).cast("long"))
    held = rows.join(F.broadcast(facts), "token")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    members = held.withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts"))).withColumn("share", F.explode(every("shares"))).select("token", "part", "share", "d", "n", "pos", "c", "large")
    outside = held.filter("c <> large").withColumn("share", F.pmod(F.xxhash64("d", F.lit(1)), F.col("shares"))).withColumn("part", F.explode(every("parts"))).select("token", "part", "share", "d", "n", "pos", "c").toDF("token", "part", "share", "d", "n", "pos", "c")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            d, n, pos, c, large = (right.column(x).to_numpy() for x in ("d", "n", "pos", "c", "large"))
            for e, m, at, k in zip(*(left.column(x).to_pylist() for x in ("d", "n", "pos", "c"))):
                ok = (c != k) & ((c == large) | (d > e)) & may_reach(m, at, n, pos, least)
                v = d[ok]
                us.append(np.minimum(e, v))
                vs.append(np.maximum(e, v))
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    by = ("token", "part", "share")
    return outside.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(lambda left, right: trimmed(run, left, right), "u long, v long")


def _split(rows: DataFrame, crowd: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary buckets, and those of crowded ones."""
    if crowd is None:
        return rows, None
    marks = F.broadcast(crowd.select("token"))
    return rows.join(marks, "token", "left_anti"), rows.join(marks, "token", "left_semi")


def star_pairs(tokens: DataFrame, stars: DataFrame | None, least: float, salt: int, crowd: DataFrame | None = None) -> DataFrame:
    """Candidates u < v: in each bucket, one text for each class of sizes, of its largest component, and the texts of other components."""
    rows, many = _split(named(tokens, stars), crowd)
    out = _pairs(rows, _stars(salt), least)
    return out if many is None else out.unionAll(_crowded_stars(many, least, salt)).distinct()


def pairs_across(tokens: DataFrame, stars: DataFrame, least: float, crowd: DataFrame | None = None) -> DataFrame:
    """All candidates u < v but those inside one component."""
    rows, many = _split(named(tokens, stars), crowd)
    out = _pairs(rows, _across, least)
    return out if many is None else out.unionAll(_crowded_across(many, crowd, least)).distinct()
