"""LM scoring by deleted interpolation.

An n-gram model: P_k(w | h) = a * c(h w) / c(h) + (1 - a) * P_{k-1}(w | shorter h), down to P_0 = 1 / (V + 1), one
share for each of the V known tokens and one for all others. Each weight a belongs to an order k and a bucket of
c(h), the frequency of the context (powers of two; bucket 0: a context that was never seen). The weights are learned by
expectation maximisation on a deleted part of the training documents, from the counts of the rest; then the deleted part
is put back, and all training documents give the counts for scoring.

Counting. Documents are packed into chunks; the deleted part has chunks of its own. A chunk's distinct n-grams go, as
sorted arrays of 64-bit hashes and counts, to groups of hashes, which add them up and answer each chunk. So a frequent
n-gram costs one entry a chunk, not one an occurrence, no vocabulary is brought to one place, and what is moved grows with the
distinct n-grams of the corpus. Two different n-grams of one hash would share their counts: among n distinct ones
n**2 / 2**65 such pairs are expected. The driver gets the weights' sums (65 buckets an order) and the totals.

Defined results: a null or empty text has one token, its end; a row without a doc_id is scored, but neither learned from nor held
out; repeated rows all count; without training documents every score is 0, and without a deleted part each weight is 0.5; an
empty table gives none; columns other than the two never take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import pack, unpack, volume
from .common import discard, materialize, trimmed, trimmed_steps, worker_state
from .spans import BASE, distinct, scramble, word_spans

CHUNK_BYTES = 8 << 20
#: Bytes of text for each group of hashes, about.
GROUP_BYTES = 24 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Buckets of a context's frequency: 0, 1, 2-3, 4-7, ...
BUCKETS = 65
#: What is no word: it has white space.
END, BEGIN = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" begin")
ROUNDS, TOLERANCE = 20, 1e-5


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def shrunk(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.concatenate(arrays).astype(np.int64).tobytes())


def grown(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64).reshape(rows, -1)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2)."""
    return np.frexp(context.astype(float))[1]


class Grams:
    """The tokens of a chunk and, for each order k, its distinct k-grams."""

    def __init__(self, block: bytes, ends: np.ndarray, order: int):
        block = block.translate(LOWER)
        starts, stops, of = word_spans(np.frombuffer(block, np.uint8), ends)
        words, which = distinct(block, starts, stops - starts)
        docs, n = len(ends), len(words)
        at = np.arange(len(starts)) + of  # an end stands after the words of each document
        self.doc, word = np.empty(len(starts) + docs, np.int64), np.full(len(starts) + docs, n, np.int64)
        self.doc[at], word[at] = of, which
        last = np.cumsum(np.bincount(of, minlength=docs) + 1) - 1
        self.doc[last] = np.arange(docs)
        self.first = np.zeros(len(word), bool)
        self.first[np.append(0, last[:-1] + 1)[:docs]] = True
        single = np.array([*map(xxhash.xxh3_64_intdigest, words), END], np.uint64)
        self.ids, self.keys = [word], [single]
        known = n + 1
        for _ in range(1, order):
            before = np.append(0, self.ids[-1][:-1])
            before[self.first] = len(self.keys[-1])  # nothing but beginnings
            code, ids = np.unique(before * known + word, return_inverse=True)
            head = np.append(self.keys[-1], np.uint64(BEGIN))[code // known]
            self.keys.append(scramble(head * np.uint64(BASE) + scramble(single[code % known])))
            self.ids.append(ids)

    def counts(self, part: np.ndarray) -> list[np.ndarray]:
        """For each order, how often the documents of the kept and of the deleted part (1, 2 in `part`) have each gram."""
        mine = part[self.doc]
        return [np.stack([np.bincount(ids[mine == p], minlength=len(keys)) for p in (1, 2)]) for ids, keys in zip(self.ids, self.keys)]


def split_groups(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order of keys by group and value, their groups, and where each group lies."""
    grp = (keys >> np.uint64(7)) % np.uint64(groups)
    order = np.lexsort((keys, grp))
    grp = grp[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(grp)) + 1
    return order, grp, list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)])) if len(order) else []


COUNTS_SCHEMA = "chunk long, grp long, keys binary, counts binary"
ANSWER_SCHEMA = "chunk long, grp long, totals binary, seen array<long>"


def add_up(table: pa.Table, order: int) -> pa.Table:
    """One group: for each chunk the totals of its keys. For single tokens, `seen` of one row: distinct ones, all, and ends, each of the kept part and of both."""
    keys, counts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()], table.column("counts").to_pylist()
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    _, key = np.unique(np.concatenate(keys), return_inverse=True)
    total, ends = np.zeros((2, int(key.max(initial=-1)) + 1), np.int64), np.zeros(2, np.int64)
    for x, k, at in zip(counts, keys, np.split(key, cuts)):
        c = grown(x, 2)
        total[:, at] += c  # a chunk has each key once
        ends += c[:, k == np.uint64(END)].sum(1)
    both = lambda x: [int(x[0]), int(x.sum())]
    single = table.column("grp")[0].as_py() % order == 0
    facts = [int((total[0] > 0).sum()), int((total.sum(0) > 0).sum()), *both(total.sum(1)), *both(ends)] if single else []
    answers = [shrunk(*total[:, at]) for at in np.split(key, cuts)]
    return pa.table({"chunk": table.column("chunk"), "grp": table.column("grp"), "totals": pa.array(answers, pa.binary()), "seen": pa.array([facts, *[[]] * (len(keys) - 1)], pa.list_(pa.int64()))})


def estimates(totals: list[np.ndarray], grams: Grams, size: int, docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order and token: the count of its gram, and of its context (size: all tokens, docs: all documents)."""
    out = []
    for k, (total, ids) in enumerate(zip(totals, grams.ids)):
        count = total[ids]
        if k:
            context = np.append(0, out[-1][0][:-1])
            context[grams.first] = docs
        else:
            context = np.full(len(ids), size)
        out.append((count, context))
    return out


def interpolate(counts: np.ndarray, contexts: np.ndarray, weights: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    """P_0, P_1, ... of each token. counts, contexts: (orders, tokens); weights: (orders, BUCKETS)."""
    out = [np.full(counts.shape[1], 1 / (vocabulary + 1))]
    for c, h, a in zip(counts, contexts, weights):
        share = np.where(h > 0, a[bucket(h)], 0.0)
        out.append(share * (c / np.maximum(h, 1)) + (1 - share) * out[-1])
    return out


def expected(counts: np.ndarray, contexts: np.ndarray, many: np.ndarray, weights: np.ndarray, vocabulary: int) -> tuple[np.ndarray, float]:
    """(orders, 2, BUCKETS): how many events reach an order, and how many of them it is expected to have made; and the events' log probability."""
    p = interpolate(counts, contexts, weights, vocabulary)
    out, reach = np.zeros((len(weights), 2, BUCKETS)), many.astype(float)
    for k in range(len(weights) - 1, -1, -1):
        h = contexts[k]
        b = bucket(h)
        own = np.where(h > 0, weights[k][b] * counts[k] / np.maximum(h, 1), 0.0) / p[k + 1]
        out[k] = np.bincount(b, reach, BUCKETS), np.bincount(b, reach * own, BUCKETS)
        reach = reach * (1 - own)
    return out, float((many * np.log10(p[-1])).sum())


def maximise(events: DataFrame, order: int, vocabulary: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """The weights (order, BUCKETS), and the events' log probability before each round. One pseudo-event on either side keeps a weight from 0 and 1."""
    weights, said = np.full((order, BUCKETS), 0.5), []
    for _ in range(rounds):

        def run(batches, weights=weights):
            worker_state(None, None)
            total, log = np.zeros((order, 2, BUCKETS)), 0.0
            for batch in batches:
                for raw in batch.column("events").to_pylist():
                    e = grown(raw, 2 * order + 1)
                    for at in range(0, e.shape[1], 1 << 18):
                        some = e[:, at : at + (1 << 18)]
                        got, p = expected(some[:order], some[order : 2 * order], some[-1], weights, vocabulary)
                        total, log = total + got, log + p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), log))], ["i", "x"])

        sums = {r["i"]: r["x"] for r in events.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}  # 2 * BUCKETS * order + 1 rows
        if not sums:
            break
        total = np.array([sums[i] for i in range(len(sums) - 1)]).reshape(order, 2, BUCKETS)
        said.append(sums[len(sums) - 1])
        weights = np.where(total[:, 0] > 0, (total[:, 1] + 1) / (total[:, 0] + 2), 0.5)
        if len(said) > 1 and said[-1] - said[-2] < TOLERANCE * -said[-1]:
            break
    for a, seen in zip(weights, (total[:, 0] > 0) if said else np.zeros((order, BUCKETS), bool)):  # a bucket without events has the weight of the next smaller with some
        for b in range(1, BUCKETS):
            if not seen[b] and seen[:b].any():
                a[b] = a[b - 1]
    return weights, said


class Model:
    """What `learned` found: chunks and the answers to them, weights, tokens and distinct tokens in training."""

    def __init__(self, chunks: DataFrame, answers: DataFrame, weights: np.ndarray, said: list[float], tokens: int, vocabulary: int, docs: int, groups: int, kind: str):
        self.chunks, self.answers, self.weights, self.said, self.tokens, self.vocabulary, self.docs, self.groups, self.kind = chunks, answers, weights, said, tokens, vocabulary, docs, groups, kind


def _each(table: pa.Table, order: int):
    """Keys, parts and grams of each chunk of a table."""
    keys, at = table.column("keys").combine_chunks().flatten(), 0
    for sizes, body, part in zip(*(table.column(c).to_pylist() for c in ("sizes", "body", "x0"))):
        mine, at = keys.slice(at, len(sizes)), at + len(sizes)
        block, ends = unpack(body, np.array(sizes, np.int64))
        yield mine, np.array(part), Grams(block, ends, order)


def _answered(grams: Grams, answers: pa.Table, groups: int) -> list[np.ndarray]:
    """For each order, (2, grams): the totals of the kept and of the deleted part."""
    by, out = dict(zip(answers.column("grp").to_pylist(), answers.column("totals").to_pylist())), []
    for k, keys in enumerate(grams.keys):
        order, grp, spans = split_groups(keys, groups)
        total = np.zeros((2, len(keys)), np.int64)
        for a, b in spans:
            total[:, order[a:b]] = grown(by[int(grp[a]) * len(grams.keys) + k], 2)
        out.append(total)
    return out


def learned(docs: DataFrame, order: int = 2, parts: int = 7, test: int = 2, deleted: int = 3, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Model:
    """A model of the documents whose `remainder` is not `test`; those where it is `deleted` are the part that the weights are learned on."""
    kind = docs.schema[key].dataType.simpleString()
    left = remainder(F.col(key), parts)
    rows = docs.select(key, text, F.when(left.isNull() | (left == test), 0).when(left == deleted, 2).otherwise(1).alias("part"))
    rest = pack(rows.filter("part <> 2"), chunk_bytes, key, text, ("part",))
    apart = pack(rows.filter("part = 2"), chunk_bytes, key, text, ("part",))
    held = apart.withColumn("chunk", F.col("chunk").bitwiseOR(F.lit(1 << 62)))
    chunks = rest.unionByName(held)
    groups = max(12, (volume(rest) + volume(apart)) // GROUP_BYTES + 1)

    def deal(batches):
        worker_state(None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                for _, part, grams in _each(one, order):
                    for k, (keys, counts) in enumerate(zip(grams.keys, grams.counts(part))):
                        by, grp, spans = split_groups(keys, groups)
                        columns = ([one.column("chunk")[0].as_py()] * len(spans), [int(grp[a]) * order + k for a, _ in spans], [keys[by[a:b]].tobytes() for a, b in spans], [shrunk(*counts[:, by[a:b]]) for a, b in spans])
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "grp", "keys", "counts"])

    dealt = chunks.mapInArrow(lambda batches: trimmed_steps(deal(batches)), COUNTS_SCHEMA)
    answers = materialize(dealt.groupBy("grp").applyInArrow(lambda table: trimmed(add_up, table, order), ANSWER_SCHEMA), "totals")
    sums = answers.filter(F.size("seen") > 0).select(*(F.sum(F.get("seen", F.lit(i))).alias(f"s{i}") for i in range(6))).first()
    v1, v, t1, t, d1, d = (x or 0 for x in sums)

    def collect(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for _, _, grams in _each(rows, order):
            got = estimates([x[0] for x in _answered(grams, answers, groups)], grams, t1, d1)
            same, at, many = np.unique(grams.ids[-1], return_index=True, return_counts=True)  # equal grams of the highest order are equal events
            out.append(shrunk(*(c[at] for c, _ in got), *(h[at] for _, h in got), many))
        return pa.table({"events": pa.array(out, pa.binary())})

    events = materialize(held.groupBy("chunk").cogroup(answers.filter(F.col("chunk") >= 1 << 62).groupBy("chunk")).applyInArrow(lambda x, y: trimmed(collect, x, y), "events binary"), "events")
    weights, said = maximise(events, order, v1)
    discard(events)
    return Model(chunks, answers, weights, said, t, v, d, groups, kind)


def scored(model: Model, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score and score of each row the model was made of, held out or not."""
    order, groups, weights, n, v, docs = len(model.weights), model.groups, model.weights, model.tokens, model.vocabulary, model.docs

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for keys, _, grams in _each(rows, order):
            got = estimates([x.sum(0) for x in _answered(grams, answers, groups)], grams, n, docs)
            count = got[0][0]
            p = interpolate(np.stack([c for c, _ in got]), np.stack([h for _, h in got]), weights, v)[-1]
            per_doc = lambda x: np.bincount(grams.doc, x, len(keys))
            out.append(pa.table([keys, per_doc(None), per_doc(count > 0).astype(np.int64), per_doc(np.log10((count + 1) / (n + v + 1))), per_doc(np.log10(p))], ["k", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    by_chunk = model.chunks.groupBy("chunk").cogroup(model.answers.groupBy("chunk"))
    return by_chunk.applyInArrow(lambda x, y: trimmed(run, x, y), f"k {model.kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("k", key)


def score_table(docs: DataFrame, order: int = 2, parts: int = 7, test: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model = learned(docs.select("doc_id", "text"), order, parts, test)
    held_out = F.coalesce(remainder(F.col("doc_id"), parts) == test, F.lit(False))
    return scored(model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
