"""Centroid clustering by delta Lloyd.

Vectors of exactly `dim` finite components become integers floor(scale * x) and are packed into blocks, once, dealt to buckets of
a table in the shared folder. Two things last from round to round: each block's assignments (owner and distance of
each vector, a table with the same buckets, so that a round joins them without a shuffle and never writes a vector again), and
the global sums (count and component sums of each centroid, a small table).

A round compares a vector with all centroids only if its owner moved; else with the changed centroids alone, since its
distance to its owner is still the least of those to the others. A vector that changes its owner takes its components from one sum to the other: each
block gives the signed integer transfers by centroid, these are added up, and the sums of the round before plus the transfers are the new sums.
So a round in which few vectors move ships few numbers, and sums stay exact. The driver holds k centroids.

Defined results: a vector that is null, of another length, or with a null or non-finite component is left out, and so is one with an
integer beyond 2**27, whose squared distances a long can't hold; a null id is written as an empty text where ids are hashed; repeated
ids are rows of their own, ties of the hash go by the components; ties of distance go to the smaller number; fewer vectors than k make as
many centroids; an empty centroid stays; an empty table gives none; columns other than id and vector never take part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, trimmed_steps, worker_state

#: Vectors in a block; vectors in a bucket, about.
BLOCK_ROWS, BUCKET_ROWS = 2048, 200_000
#: Largest integers: of any component, and of those that doubles compare exactly.
MOST, EXACT = 1 << 27, 1 << 22


class Buckets:
    """Tables of one bucketing by `block`; the catalog knows them until `drop`, their files lie in the shared folder."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.names = spark, n, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        name = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/sparkloom/{name}"
        df.write.bucketBy(self.n, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names.append((name, path))
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """All but the last `keep` tables."""
        while len(self.names) > keep:
            name, path = self.names.pop(0)
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pack_vectors(rows: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """block, ids, vec (binary, 32-bit integers of the block's vectors one after the other) of the vectors that are kept."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        worker_state(None, None)
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("k")
            sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float), nan=-1)
            at = np.flatnonzero(sizes == dim)
            values = np.floor(scale * lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(at), dim)
            good = (np.abs(values) <= MOST).all(1)  # not where one is null, NaN or infinite
            at, values = at[good], values[good].astype(np.int32)
            for a in range(0, len(at), BLOCK_ROWS):
                some = ids.take(pa.array(at[a : a + BLOCK_ROWS]))
                held = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([pa.array([block]), held, pa.array([values[a : a + BLOCK_ROWS].tobytes()], pa.binary())], ["block", "ids", "vec"])
                block += 1

    return rows.selectExpr(f"`{key}` k", f"CAST(`{vector}` AS array<double>) v").mapInArrow(lambda batches: trimmed_steps(run(batches)), f"block long, ids array<{kind}>, vec binary")


def first_centroids(blocks: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The k vectors of least sha256 of salt and id. Each block sends its own k at most."""

    def run(batches):
        for batch in batches:
            for ids, vec in zip(batch.column("ids").to_pylist(), batch.column("vec").to_pylist()):
                v = np.frombuffer(vec, np.int32).reshape(-1, dim)
                few = sorted((hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), x) for x, i in enumerate(ids))
                last = few[k - 1][0] if len(few) >= k else "g"
                few = sorted((h, v[x].tolist()) for h, x in few if h <= last)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in few], pa.string()), pa.array([x for _, x in few], pa.list_(pa.int64()))], ["h", "v"])

    found = blocks.select("ids", "vec").mapInArrow(run, "h string, v array<long>").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in found], np.int64).reshape(len(found), dim)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, exact, of each vector to each centroid."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:  # every term and sum is below 2**53
        x, y = v.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    x, y = v.astype(np.int64), c.astype(np.int64)
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)


def reassign(v: np.ndarray, owner: np.ndarray, dist: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances were computed. An owner of -1 counts as moved."""
    owner, dist, moved = owner.copy(), dist.copy(), (owner < 0) | changed[owner]
    every, rest, some = np.flatnonzero(moved), np.flatnonzero(~moved), np.flatnonzero(changed)
    if len(every):
        d = distances(v[every], c)
        owner[every] = d.argmin(1)
        dist[every] = d.min(1)
    if len(rest) and len(some):
        d = distances(v[rest], c[some])
        best, least = some[d.argmin(1)], d.min(1)
        take = (least < dist[rest]) | (least == dist[rest]) & (best < owner[rest])
        owner[rest[take]], dist[rest[take]] = best[take], least[take]
    return owner, dist, len(every) * len(c) + len(rest) * len(some)


def transfers(v: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """Per centroid that gained or lost vectors: the signed count and component sums."""
    at = np.flatnonzero(before != after)
    total = np.zeros((k + 1, v.shape[1] + 1), np.int64)  # the last row is for owner -1
    given = np.concatenate([np.ones((len(at), 1), np.int64), v[at].astype(np.int64)], 1)
    np.add.at(total, after[at], given)
    np.subtract.at(total, before[at], given)
    touched = np.unique(np.concatenate([after[at], before[at]]))
    return [{"cluster": int(x), "sums": total[x].tolist()} for x in touched.tolist() if x >= 0]


STATE = "owner array<int>, dist array<long>, compared long, moves array<struct<cluster: int, sums: array<long>>>"


class Clusters:
    """What `cluster` found: `rows` (ids, owner, dist: arrays, a row for each block), centroids, and of each pass how many distances it computed and how many vectors there are."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, compared: list[int]):
        self.rows, self.centroids, self.compared = rows, centroids, compared


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", key: str = "vec_id", vector: str = "embedding") -> Clusters:
    """`rounds` rounds of assigning and moving, then a last assigning. Rounds in which no centroid changed are left out, as nothing could change after them."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    packed = materialize(pack_vectors(rows, key, vector, dim, scale), "vectors")
    n_blocks, n_rows = packed.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    tables = Buckets(spark, int(max(1, min(n_blocks, spark.sparkContext.defaultParallelism), n_rows // BUCKET_ROWS + 1)))
    vectors = tables.write(packed.repartition(tables.n, "block"), "vectors")
    discard(packed)
    c, compared, state, sums, last = first_centroids(vectors, k, dim, salt), [], None, None, None
    changed = np.ones(len(c), bool)

    def assign(c: np.ndarray, changed: np.ndarray, first: bool):
        def run(batches):
            worker_state(None, None)
            for batch in batches:
                for i, vec in enumerate(batch.column("vec").to_pylist()):
                    v = np.frombuffer(vec, np.int32).reshape(-1, dim)
                    owner = np.full(len(v), -1, np.int32) if first else batch.column("owner")[i].values.to_numpy()
                    dist = np.zeros(len(v), np.int64) if first else batch.column("dist")[i].values.to_numpy()
                    now, d, n = reassign(v, owner, dist, c, changed)
                    columns = [batch.column(x).slice(i, 1) for x in ("block", "ids")]
                    columns += [pa.array([x], t) for x, t in ((now, pa.list_(pa.int32())), (d, pa.list_(pa.int64())), (n, pa.int64()))]
                    moves = pa.array([transfers(v, owner, now, len(c))], pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])))
                    yield pa.RecordBatch.from_arrays([*columns, moves], ["block", "ids", "owner", "dist", "compared", "moves"])

        return run

    for r in range(rounds + 1 if len(c) else 0):
        joined = vectors if state is None else vectors.join(state.select("block", "owner", "dist").hint("shuffle_hash"), "block")
        run = assign(c, changed, state is None)
        state = tables.write(joined.mapInArrow(lambda batches, run=run: trimmed_steps(run(batches)), f"block long, ids array<{kind}>, {STATE}"), "owners")
        compared.append(state.agg(F.sum("compared")).first()[0])
        if r == rounds:
            break
        moved = state.select(F.explode("moves").alias("m")).select("m.cluster", F.posexplode("m.sums").alias("at", "x"))
        old = sums
        sums = materialize((moved if old is None else old.unionByName(moved)).groupBy("cluster", "at").agg(F.sum("x").alias("x")), "sums")
        if old is not None:
            discard(old)
        total = np.zeros((len(c), dim + 1), object)
        for x in sums.collect():  # k * (dim + 1) rows
            total[x["cluster"], x["at"]] = x["x"]
        new = c.copy()
        for i, (n, *s) in enumerate(total.tolist()):
            if n:
                new[i] = [x // n for x in s]
        changed, c = (new != c).any(1), new
        if not changed.any():
            break
    if sums is not None:
        discard(sums)
    last = materialize((state if state is not None else vectors.selectExpr("ids", "CAST(NULL AS array<int>) owner", "CAST(NULL AS array<long>) dist")).select("ids", "owner", "dist"), "clusters")
    tables.drop()
    return Clusters(last, c, compared)


def cluster_table(rows: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept."""
    spark, found = rows.sparkSession, cluster(rows.select("vec_id", "embedding"), k, rounds)
    each = found.rows.select(F.explode(F.arrays_zip("ids", "owner", "dist")).alias("x")).select(F.col("x.ids").alias("vec_id"), F.col("x.owner").alias("cluster"), F.col("x.dist").alias("distance"))
    digests = [(i, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(found.centroids.tolist())]
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = each.groupBy("cluster").agg(exact.alias("own"))
    sums = {r["cluster"]: int(r["own"]) for r in inertia.collect()}  # k rows
    facts = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), h) for i, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    d = "vv + cc - 2 * list_inner_product(v, w)"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        "rows_ AS (SELECT r, vec_id, v, list_inner_product(v, v) AS vv FROM kept)",
        f"c0 AS (SELECT c - 1 AS c, v AS w, list_inner_product(v, v) AS cc FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) AS c FROM kept) WHERE c <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT r, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT r, c, {d} AS d FROM rows_, c{i}) GROUP BY r)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, j, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS j FROM a{i} JOIN rows_ USING (r)) GROUP BY c, j)")
            parts.append(f"n{i} AS (SELECT c, list(x ORDER BY j) AS w FROM m{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT o.c, coalesce(n.w, o.w) AS w, list_inner_product(coalesce(n.w, o.w), coalesce(n.w, o.w)) AS cc FROM c{i} o LEFT JOIN n{i} n ON n.c = o.c)")
    return (
        "WITH " + ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts) + f" SELECT vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(list_transform(w, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} a JOIN rows_ USING (r) JOIN c{rounds} q ON q.c = a.c"
    )


ORACLE_SQL = _oracle()
