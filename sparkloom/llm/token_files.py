"""Token ids in sharded binary files with a minimal perfect hash index.

Files. Two Parquet tables, so that any store Spark can write holds them and a failed task leaves
nothing behind:
* `shards`: ids of the documents in ascending key order, cut into payloads of raw little-endian
  ids (2 bytes where all ids of the vocabulary fit, else 4), with part and shard number, the ids before the
  shard in its part, and the directory (key, number among equal keys, ids) of its documents. Part p + 1 follows part p.
* `index`: the keys dealt to buckets by hash. Per bucket a minimal perfect hash (seeds) sends
  each key to its own slot; the slot holds a 32-bit fingerprint of the key, the shard and the offset.

A lookup reads one index row, computes one slot, compares the fingerprint and slices one payload,
whatever the number of documents.

Texts are encoded before the order is made, so that ids and not texts are moved. Rows of one key are
ordered by text hash and dealt to several parts where they are many.

Defined results: a null or empty text holds only the end id; null keys come first and can be looked
up like others; rows that repeat a key are told apart by their number among equals; an empty table
gives empty files. Keys may have any type with an order. A special token's string in a text is that token, as the
library has it by default (`special_as_text` makes it ordinary text). Two keys of a bucket with one 64-bit hash
are told apart by a second hash.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered, TextEncoder, small_steps
from .common import discard, materialize, shared_dir, trim, worker_state

SHARD_BYTES = 1 << 20
BUCKET_KEYS = 4096
#: Bytes of texts that are encoded at a time, about: the more, the fewer parts are looked up again.
STEP_BYTES = 8 << 20


class LibraryEncoder(TextEncoder):
    """Texts to packed ids with a byte-level file of the tokenizers library; parts are remembered as in `TextEncoder`."""

    def __init__(self, path: str, end_id: int = 0, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.findall, self.spaced, self.parts = (lambda text: [text]), True, Remembered(400_000)
        self.special = [] if special_as_text else [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        most = max([end_id, *names.values()])
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.begins = np.zeros(most + 1, bool)  # ids that begin with a space, which byte-level files write so
        self.begins[[i for t, i in names.items() if t.startswith("\u0120")]] = True

    def unclear(self, block: bytes, ends: np.ndarray) -> np.ndarray:
        out = super().unclear(block, ends)
        for mark in self.special:  # texts with a special token are encoded as a whole
            for m in re.finditer(re.escape(mark), block):
                out[np.searchsorted(ends, m.start(), "right")] = True
        return out

    def learn(self, parts: list[bytes]) -> None:
        ids_of = lambda texts: [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain, odd = [], []
        for x in parts:
            (plain if len(x) > 1 and x.startswith(b" ") and x.find(b" ", 1) < 0 else odd).append(x)
        size = self.kind.itemsize
        for at in range(0, len(plain), 5000):  # many parts as one text: each begins with its only space
            some = plain[at : at + 5000]
            ids = ids_of([b"".join(some).decode()])[0]
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(some):
                odd += some
                continue
            raw, cuts = ids.tobytes(), [*(begin * size).tolist(), len(ids) * size]
            self.parts.young.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        for at in range(0, len(odd), 5000):
            some = odd[at : at + 5000]
            self.parts.young.update((x, ids.tobytes()) for x, ids in zip(some, ids_of(list(map(bytes.decode, some)))))


SHARD_SCHEMA = "part int, shard int, base long, n_ids long, width int, keys array<{kind}>, nth array<int>, sizes array<int>, starts array<long>, payload binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", special_as_text: bool = False) -> DataFrame:
    """k, h (hash of the text), r (row number), width and ids (binary) of each row, written once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = worker_state(("library", tokenizer, end_id, special_as_text), lambda: LibraryEncoder(tokenizer, end_id, special_as_text))
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in small_steps(batches, "t", STEP_BYTES):
            ids = pa.array([x + end for x in encoder.encode(batch.column("t"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "h", "r")), pa.array(np.full(batch.num_rows, encoder.kind.itemsize, np.int32)), ids], ["k", "h", "r", "width", "ids"])
            trim()

    rows = docs.selectExpr(f"`{key}` k", f"xxhash64(`{text}`) h", "monotonically_increasing_id() r", f"`{text}` t")
    return materialize(rows.mapInArrow(run, f"k {kind}, h long, r long, width int, ids binary"), "ids")


def write_shards(ids: DataFrame, path: str) -> None:
    """ids: rows of `encoded`."""
    kind = ids.schema["k"].dataType.simpleString()
    names = [x.split()[0] for x in SHARD_SCHEMA.format(kind=kind).split(", ")]

    def run(batches):
        worker_state(None, None)
        part = TaskContext.get().partitionId()
        shard = base = 0
        keys, nth, sizes, payload, held = [], [], [], [], 0
        last, seen, width, of = object(), 0, 0, None

        def flush():
            n = sum(sizes)
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([width], pa.int32()),
                    pa.array([keys], pa.list_(of)), pa.array([nth], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.cumsum(sizes) - sizes], pa.list_(pa.int64())), pa.array([b"".join(payload)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names), n

        for batch in small_steps(batches, "ids"):
            of = batch.schema.field("k").type
            for k, width, raw in zip(*(batch.column(c).to_pylist() for c in ("k", "width", "ids"))):
                if held and held + len(raw) > SHARD_BYTES:
                    out, n = flush()
                    yield out
                    shard, base, keys, nth, sizes, payload, held = shard + 1, base + n, [], [], [], [], 0
                seen = seen + 1 if k == last else 0
                last = k
                keys.append(k)
                nth.append(seen)
                sizes.append(len(raw) // width)
                payload.append(raw)
                held += len(raw)
        if keys:
            yield flush()[0]

    dealt = ids.repartitionByRange("k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "width", "ids")
    dealt.mapInArrow(run, SHARD_SCHEMA.format(kind=kind)).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)


def carried(shards: DataFrame) -> list[tuple[int, object, int]]:
    """(part, key, rows): parts that begin with the key with which earlier parts end, and how many rows of it those have. One row per part comes to the driver."""
    ends = shards.groupBy("part").agg(F.min_by(F.element_at("keys", 1), "shard").alias("first"), F.max_by(F.struct(F.element_at("keys", -1).alias("k"), F.element_at("nth", -1).alias("n")), "shard").alias("last"))
    out, key, rows = [], object(), 0
    for part, first, (last, n) in sorted(ends.collect(), key=lambda r: r[0]):
        if first == key:
            out.append((part, first, rows))
        rows = n + 1 + (rows if first == key and last == first else 0)
        key = last
    return out


def _mix(h: np.ndarray, seed) -> np.ndarray:
    x = h ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def build_mph(h: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct uint64 keys: hash and displace, groups of about 4 keys, largest first.

    A group of one key stores its slot itself, as -slot - 1.
    """
    n = len(h)
    seeds = np.zeros(max(1, n // 4), np.int64)
    free = np.ones(n, bool)
    group = (_mix(h, 0x5BD1) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    left = None
    for members in sorted(np.split(order, cuts), key=len, reverse=True) if n else []:
        g = group[members[0]]
        if len(members) == 1:
            left = np.flatnonzero(free).tolist() if left is None else left
            slot = left.pop()
            seeds[g], free[slot] = -slot - 1, False
            continue
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64)
            slots = (_mix(h[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[slots].all(1)
            for t in np.flatnonzero(fits):
                if len(set(slots[t].tolist())) == len(members):
                    seeds[g], free[slots[t]] = tries[t], False
                    break
            else:
                seed += 64
                continue
            break
    return seeds


def mph_slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(len(h), np.int64)
    s = seeds[(_mix(h, 0x5BD1) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(s < 0, -s - 1, (_mix(h, np.maximum(s, 0)) % np.uint64(n)).astype(np.int64))


INDEX_SCHEMA = "bucket long, n int, salt int, seeds array<long>, prints array<int>, part array<int>, shard array<int>, start array<long>, size array<int>"


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    """df: k, nth. Adds h, more (a second hash), print and bucket."""
    return df.withColumn("h", F.xxhash64("k", "nth")).withColumn("more", F.xxhash64("nth", "k", F.lit("more"))).withColumn("print", F.hash("nth", "k")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))


def salted(h: np.ndarray, more: np.ndarray, salt: int) -> np.ndarray:
    """The hashes that a bucket with this salt uses: h alone for 0."""
    return h if not salt else _mix(h, salt) ^ _mix(more, salt + 1)


def choose_salt(h: np.ndarray, more: np.ndarray) -> int:
    """The least salt by which all keys of a bucket differ."""
    for salt in range(16):
        if len(np.unique(salted(h, more, salt))) == len(h):
            return salt
    raise ValueError("two keys of the index have the same 128 bits of hashes")


def write_index(shards: DataFrame, path: str) -> None:
    spark = shards.sparkSession
    n = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))

    def build(table: pa.Table) -> pa.Table:
        h, more = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "more"))
        salt = choose_salt(h, more)
        h = salted(h, more, salt)
        seeds, at = build_mph(h), np.empty(len(h), np.int64)
        at[mph_slots(h, seeds, len(h))] = np.arange(len(h))
        take = lambda c: pa.array([table.column(c).to_numpy()[at]])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "n": pa.array([len(h)], pa.int32()), "salt": pa.array([salt], pa.int32()), "seeds": pa.array([seeds]), "prints": take("print"), "part": take("part"), "shard": take("shard"), "start": take("start"), "size": take("size")})

    each = shards.select("part", "shard", F.inline(F.arrays_zip("keys", "nth", "sizes", "starts"))).toDF("part", "shard", "k", "nth", "size", "start")
    before = carried(shards)
    if before:
        kind = shards.schema["keys"].dataType.elementType.simpleString()
        more = F.broadcast(spark.createDataFrame(before, f"part int, first {kind}, rows int"))  # at most a row per part
        each = each.join(more, "part", "left").withColumn("nth", F.col("nth") + F.when(F.col("k").eqNullSafe(F.col("first")), F.coalesce("rows", F.lit(0))).otherwise(0)).drop("first", "rows")
    _hashed(each, buckets).drop("k", "nth").groupBy("bucket").applyInArrow(build, INDEX_SCHEMA).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)


class TokenFiles:
    """Written files. `lookup` finds keys through the index; `fetch` slices the payloads."""

    def __init__(self, spark, path: str, kind: str):
        self.spark, self.kind = spark, kind
        self.shards = spark.read.schema(SHARD_SCHEMA.format(kind=kind)).parquet(f"{path}/shards")
        self.index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys: k, nth. k, part, shard, start and size of those the index holds."""
        buckets = self.index.agg(F.max("bucket")).first()[0]

        def find(keys: pa.Table, index: pa.Table) -> pa.Table:
            names, kinds = ["k", "part", "shard", "start", "size"], [keys.schema.field("k").type, pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            if not index.num_rows or not keys.num_rows:
                return pa.table([pa.array([], x) for x in kinds], names)
            get = lambda c: index.column(c).combine_chunks().flatten().to_numpy()
            n = index.column("n")[0].as_py()
            h = salted(*(keys.column(c).to_numpy().view(np.uint64) for c in ("h", "more")), index.column("salt")[0].as_py())
            slot = mph_slots(h, get("seeds"), n)
            here = np.flatnonzero(get("prints")[slot] == keys.column("print").to_numpy())
            at = slot[here]
            return pa.table([keys.column("k").take(pa.array(here)), *(pa.array(get(c)[at], t) for c, t in zip(names[1:], kinds[1:]))], names)

        return _hashed(keys, (buckets or 0) + 1).groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(find, f"k {self.kind}, part int, shard int, start long, size int")

    def _cut(self, places: DataFrame, names: list[str], kinds: list, what, schema: str) -> DataFrame:
        """For each row of `lookup`: k, start (ids of all documents before it) and what(ids of the shard as 4 bytes each, begin, number) gives."""
        before, total = {}, 0
        for part, n in sorted(self.shards.groupBy("part").agg(F.sum("n_ids")).collect()):  # as many rows as parts
            before[part], total = total, total + n

        def cut(places: pa.Table, shard: pa.Table) -> pa.Table:
            names_, kinds_ = ["k", "start", *names], [places.schema.field("k").type, pa.int64(), *kinds]
            if not shard.num_rows:
                return pa.table([pa.array([], t) for t in kinds_], names_)
            part, base, width = (shard.column(c)[0].as_py() for c in ("part", "base", "width"))
            raw = memoryview(np.frombuffer(shard.column("payload")[0].as_buffer(), f"<u{width}").astype("<u4").view(np.uint8))
            start, size = places.column("start").to_numpy(), places.column("size").to_numpy()
            got = list(zip(*(what(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), size.tolist()))))
            return pa.table([places.column("k").combine_chunks(), pa.array(before[part] + base + start, pa.int64()), *(pa.array(x, t) for x, t in zip(got, kinds))], names_)

        payloads = self.shards.select("part", "shard", "base", "width", "payload")
        return places.groupBy("part", "shard").cogroup(payloads.groupBy("part", "shard")).applyInArrow(cut, f"k {self.kind}, start long, {schema}")

    def fetch(self, places: DataFrame) -> DataFrame:
        """places: rows of `lookup`. k, start (ids of all documents before it) and ids (binary, 4 bytes each)."""
        return self._cut(places, ["ids"], [pa.binary()], lambda raw: (bytes(raw),), "ids binary")

    def digests(self, places: DataFrame) -> DataFrame:
        """places: rows of `lookup`. k, start, n_tokens and ids_crc32 (of the ids as 4 bytes each), taken where the ids are read."""
        return self._cut(places, ["n_tokens", "ids_crc32"], [pa.int64(), pa.int64()], lambda raw: (len(raw) // 4, zlib.crc32(raw)), "n_tokens long, ids_crc32 long")


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, key: str = "doc_id", special_as_text: bool = False) -> TokenFiles:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/sparkloom/token-files-{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()
    ids = encoded(docs, tokenizer, end_id, key=key, special_as_text=special_as_text)
    write_shards(ids, f"{path}/shards")
    discard(ids)
    write_index(spark.read.schema(SHARD_SCHEMA.format(kind=kind)).parquet(f"{path}/shards"), f"{path}/index")
    return TokenFiles(spark, path, kind)


def token_file_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back through the index."""
    files = write_files(docs, tokenizer, end_id)
    keys = docs.groupBy(F.col("doc_id").alias("k")).count().select("k", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("nth"))
    return files.digests(files.lookup(keys)).withColumnRenamed("k", "doc_id")
