"""A vector index of inverted lists, kept as a table in the shared folder.

Coarse centroids come from k-means over a bounded sample (`sample_rows` rows, by hash of the id); every row is assigned to its nearest
one. A list is cut into tiles of bounded size, one row of the table each: ids, 8-bit codes of what is left after the centroid, and the
unit vectors. The table is bucketed by list and tile, so a search ships queries to tiles and never the base; only tiles that very many queries
ask for are copied, once for each block of these.

A search probes the lists nearest to a query. Codes choose what is scored exactly: with the tile's largest error of a
code as a margin, so that of a probed list none of the k best is lost. How many lists are probed is measured when the index is built: as many as
`recall` of the neighbours of sampled queries among sampled rows need, which errs to more, as neighbours in a sample lie further away.
`pairs_above` probes every list that can hold a vector of the wanted cosine, by the list's widest angle, so it is exact.

All vectors have one length; null and empty ones are left out, and an index of none finds none.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.retrieval import _unit, nearest
from sparkloom.storage import shared_folder, written

#: Rows in a tile at most, about; rows for each list; queries that meet a tile at a time, about.
TILE, LIST_ROWS, QUERY_BLOCK = 20_000, 1_000, 20_000
#: Pairs that a task of `pairs_above` may give, about, if all are above the threshold.
PAIRS = 4_000_000
#: Queries that recall is measured with.
TRIAL = 200


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


class VectorIndex:
    def __init__(self, spark, path: str, centroids: np.ndarray, sizes: np.ndarray, angles: np.ndarray, buckets: int, probes: int, name: str):
        self.spark, self.path, self.centroids, self.sizes, self.angles, self.buckets, self.probes, self.name = spark, path, centroids, sizes, angles, buckets, probes, name

    @property
    def tiles(self) -> np.ndarray:
        """How many tiles each list has."""
        return np.maximum(-(-self.sizes // TILE), 1)

    @classmethod
    def build(cls, rows: DataFrame, k: int = 20, recall: float = 0.95, lists: int | None = None, sample_rows: int = 50_000, seed: int = 7, id: str = "id", vector: str = "vec", path: str | None = None) -> VectorIndex:
        """An index of all rows with a vector. `lists` is at most 4096, so that centroids stay a few MB."""
        spark = rows.sparkSession
        base = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
        n = base.count()
        share = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
        sample = written(base.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share), "sample")
        centroids = cls._centroids(sample, lists or int(min(4096, max(1, n // LIST_ROWS, round(n**0.5 / 2)))), seed)
        probes = cls._measured(sample, centroids, k, recall, seed)
        found = written(base.mapInArrow(cls._assign(centroids), "list int, id long, vec binary, angle double"), "assigned")
        facts = {r["list"]: (r["n"], r["angle"]) for r in found.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}  # a row for each list
        sizes = np.array([facts.get(i, (0, 0.0))[0] for i in range(len(centroids))], np.int64)
        angles = np.array([facts.get(i, (0, 0.0))[1] for i in range(len(centroids))])
        name = f"vectors_{uuid.uuid4().hex}"
        index = cls(spark, path or f"{shared_folder(spark)}/sparkloom/{name}", centroids, sizes, angles, int(max(1, min(spark.sparkContext.defaultParallelism, (sizes > 0).sum()), n // 200_000)), probes, name)
        tiles = index.tiles
        place = F.element_at(F.lit(tiles.tolist()), F.col("list") + 1) if len(tiles) else F.lit(1)
        dealt = found.withColumn("tile", F.pmod(F.xxhash64("id"), place).cast("int"))
        packed = dealt.groupBy("list", "tile").applyInArrow(cls._pack(centroids), "list int, tile int, ids array<long>, codes binary, scale double, error double, vecs binary")
        packed.repartition(index.buckets, "list", "tile").write.bucketBy(index.buckets, "list", "tile").option("path", index.path).option("compression", "zstd").saveAsTable(name)
        return index

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def _centroids(sample: DataFrame, lists: int, seed: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if sample.isEmpty():
            return np.zeros((0, 1), np.float32)
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        unit = sample.select(F.transform("vec", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("v")).select(array_to_vector("v").alias("features"))
        got = KMeans(k=max(2, lists), seed=seed, maxIter=10, tol=1e-3).fit(unit).clusterCenters() if lists > 1 else [np.ones(len(sample.first()["vec"]))]
        c = np.array(got, float)
        size = np.linalg.norm(c, axis=1, keepdims=True)
        return (c / np.where(size == 0, 1, size)).astype(np.float32)

    @staticmethod
    def _measured(sample: DataFrame, centroids: np.ndarray, k: int, recall: float, seed: int) -> int:
        """How many lists `recall` of the k neighbours of TRIAL sampled queries lie in."""
        asked = sample.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(TRIAL)
        found = nearest(asked.withColumnRenamed("id", "query_id"), sample, k).select("query_id", "id")
        pairs = found.join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id").join(sample, "id").select("q", "vec")
        rows = pairs.collect()  # TRIAL * k rows
        if not rows:
            return max(1, len(centroids))
        q, x = np.array([r["q"] for r in rows]), np.array([r["vec"] for r in rows])
        order = np.argsort(-(q @ centroids.T), 1, "stable")
        home = (x @ centroids.T).argmax(1)
        place = (order == home[:, None]).argmax(1) + 1
        return int(np.quantile(place, recall, method="higher"))

    @staticmethod
    def _assign(centroids: np.ndarray):
        def run(batches):
            for batch in batches:
                v = _unit(pa.chunked_array([batch.column("vec")]))
                if not len(v):
                    continue
                s = v @ centroids.T
                home = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(v)), home], -1, 1))
                raw = v.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("id"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(angle)], ["list", "id", "vec", "angle"])

        return run

    @staticmethod
    def _pack(centroids: np.ndarray):
        def run(table: pa.Table) -> pa.Table:
            v, home = _vectors(table.column("vec")), table.column("list")[0].as_py()
            rest = v - centroids[home]
            scale = float(np.abs(rest).max(initial=0) / 127) or 1.0
            codes = np.round(rest / scale).astype(np.int8)
            error = float(np.linalg.norm(rest - codes * np.float32(scale), axis=1).max(initial=0)) + 1e-5
            ids = table.column("id").combine_chunks()
            one = lambda x, t: pa.array([x], t)
            return pa.table({"list": one(home, pa.int32()), "tile": table.column("tile").slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "codes": one(codes.tobytes(), pa.binary()), "scale": one(scale, pa.float64()), "error": one(error, pa.float64()), "vecs": one(v.tobytes(), pa.binary())})

        return run

    def _asked(self, queries: DataFrame, lists_of) -> DataFrame:
        """list, tile, block, query_id, vec: every tile that a query has to see. lists_of(scores to all centroids) -> (query, list) index arrays."""
        centroids, tiles = self.centroids, self.tiles

        def run(batches):
            for batch in batches:
                v = _unit(pa.chunked_array([batch.column("v")])).astype(np.float32)
                if not len(v) or not len(centroids):
                    continue
                who, where = lists_of(v @ centroids.T)
                who, each = np.repeat(who, tiles[where]), np.repeat(where, tiles[where])
                tile = np.arange(len(each)) - np.repeat(np.cumsum(tiles[where]) - tiles[where], tiles[where])
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.int32)), pa.array(tile.astype(np.int32)), batch.column("qid").take(pa.array(who)), raw.take(pa.array(who))], ["list", "tile", "qid", "q"])

        return queries.mapInArrow(run, "list int, tile int, qid long, q binary")

    def _met(self, asked: DataFrame, answer, schema: str, most: int | None = None) -> DataFrame:
        """answer(queries of a tile, the tile) for every tile that is asked. Tiles with more than `most` (QUERY_BLOCK) queries are copied for each block of these."""
        most = most or QUERY_BLOCK
        asked = written(asked, "asked")
        many = asked.groupBy("list", "tile").count().filter(F.col("count") > most)
        hot = written(many.select("list", "tile", F.ceil(F.col("count") / most).cast("int").alias("blocks")), "hot")
        tiles, keys = self.table(), ["list", "tile"]
        if hot.isEmpty():
            return asked.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(answer, schema)
        few = F.broadcast(hot)  # fewer than tiles, and than asked / QUERY_BLOCK rows
        cold = asked.join(few, keys, "left_anti").groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(answer, schema)
        apart = asked.join(few.withColumnRenamed("blocks", "of"), keys).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("of")).cast("int")).drop("of")
        copies = tiles.join(few.withColumnRenamed("blocks", "copies"), keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        return cold.unionByName(apart.groupBy(*keys, "block").cogroup(copies.groupBy(*keys, "block")).applyInArrow(answer, schema))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", vector: str = "vec", exclude_self: bool = True) -> DataFrame:
        """query_id, id, score, rank as of `nearest`, from the `probes` nearest lists of each query. A query's row is left out of its own hits if `exclude_self`."""
        probes, centroids = min(probes or self.probes, len(self.centroids)), self.centroids

        def nearest_lists(s: np.ndarray):
            top = np.argpartition(-s, probes - 1, 1)[:, :probes] if probes < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            return np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if left.num_rows and right.num_rows:
                q, qid = _vectors(left.column("q")), left.column("qid").to_numpy()
                for at in range(0, len(q), 256):
                    out += _best(q[at : at + 256], qid[at : at + 256], right, centroids, k, exclude_self)
            return pa.table({c: np.concatenate(v) for c, v in zip(("query_id", "id", "score"), zip(*out))})

        asked = self._asked(_named(queries, query_id, vector), nearest_lists)
        found = self._met(asked, answer, "query_id long, id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def pairs_above(self, rows: DataFrame, above: float, id: str = "id", vector: str = "vec") -> DataFrame:
        """i < j and their cosine s, above a threshold: every such pair of a row of `rows` and a row of the index."""
        centroids, angles, wide = self.centroids, self.angles, float(np.arccos(above))

        def possible(s: np.ndarray):
            return np.nonzero(np.arccos(np.clip(s, -1, 1)) - angles[None] <= wide + 1e-4)

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if left.num_rows and right.num_rows:
                q, qid = _vectors(left.column("q")), left.column("qid").to_numpy()
                ids, v = right.column("ids")[0].values.to_numpy(), _vectors(right.column("vecs")).reshape(-1, centroids.shape[1])
                for at in range(0, len(q), 512):
                    s = q[at : at + 512].astype(float) @ v.astype(float).T
                    a, b = np.nonzero((s > above) & (qid[at : at + 512, None] < ids[None]))
                    out.append((qid[at : at + 512][a], ids[b], s[a, b]))
            return pa.table({c: np.concatenate(v) for c, v in zip("ijs", zip(*out))})

        return self._met(self._asked(_named(rows, id, vector), possible), answer, "i long, j long, s double", max(1, PAIRS // max(1, int(np.max(-(-self.sizes // self.tiles), initial=0)))))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _named(queries: DataFrame, id: str, vector: str) -> DataFrame:
    return queries.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id).cast("long").alias("qid"), F.col(vector).cast("array<float>").alias("v"))


def _best(q: np.ndarray, qid: np.ndarray, tile: pa.Table, centroids: np.ndarray, k: int, exclude_self: bool) -> list:
    """The k best of a tile for each query: by code first, then exactly."""
    dim = centroids.shape[1]
    ids, home = tile.column("ids")[0].values.to_numpy(), tile.column("list")[0].as_py()
    codes = np.frombuffer(tile.column("codes")[0].as_py(), np.int8).reshape(-1, dim)
    v = np.frombuffer(tile.column("vecs")[0].as_py(), np.float32).reshape(-1, dim)
    rough = (q @ codes.astype(np.float32).T) * np.float32(tile.column("scale")[0].as_py()) + (q @ centroids[home])[:, None]
    if exclude_self:
        rough[qid[:, None] == ids[None]] = -np.inf
    keep = np.isfinite(rough)
    if rough.shape[1] > k:
        edge = -np.partition(-rough, k - 1, 1)[:, k - 1 : k]
        keep &= rough >= edge - 2 * tile.column("error")[0].as_py()
    a, b = np.nonzero(keep)
    exact = np.einsum("ij,ij->i", q[a].astype(float), v[b].astype(float))
    order = np.lexsort((ids[b], -np.round(exact, 9), a))
    a, b, exact = a[order], b[order], exact[order]
    first = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
    return [(qid[a[first]], ids[b[first]], exact[first])]
