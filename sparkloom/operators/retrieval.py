"""Nearest neighbours, rank fusion, reranking and retrieval quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores


#: Queries in a block and base rows in a tile that meet in one task, about; rows of a tile that are scored at a time.
QUERY_BLOCK, BASE_TILE, SCORED = 2048, 100_000, 8192
#: The same where every product is a row: a task holds a block's product with a tile, of 24 bytes a row.
PRODUCT_BLOCK, PRODUCT_TILE = 512, 2048


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of length 1 (a zero vector stays)."""
    lists = column.combine_chunks()
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def keep_best(s: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (a row for each query) cut to 2k columns at most that hold the k best; of equal scores the least ids."""
    if s.shape[1] <= 2 * k:
        return s, found
    edge = -np.partition(-s, k - 1, 1)[:, k - 1 : k]
    keep = min(s.shape[1], max(2 * k, int((s >= edge - 1e-9).sum(1).max())))  # more than 2k only where scores tie
    pick = np.argpartition(-s, keep - 1, 1)[:, :keep] if keep < s.shape[1] else np.broadcast_to(np.arange(keep), s.shape)
    s, found = np.take_along_axis(s, pick, 1), np.take_along_axis(found, pick, 1)
    if keep > 2 * k:
        order = np.lexsort((found, -np.round(s, 9)), axis=1)[:, :k]
        s, found = np.take_along_axis(s, order, 1), np.take_along_axis(found, order, 1)
    return s, found


def best_of(top: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of the k best of each row, without those of -inf."""
    order = np.lexsort((at, -np.round(top, 9)), axis=1)[:, :k]
    top, at = np.take_along_axis(top, order, 1), np.take_along_axis(at, order, 1)
    which, place = np.nonzero(np.isfinite(top))
    return which, at[which, place], top[which, place]


def nearest(queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id", base_id: str = "id", vector: str = "vec", same_part: str | None = None, exclude_self: bool = True, block: int = QUERY_BLOCK, tile: int = BASE_TILE) -> DataFrame:
    """query_id, id, score (cosine), rank: the k nearest of each query, exact; ties by id (SRT4, SRT15, JON9).

    Blocks of the stated queries meet tiles of the base in a cogroup, so neither side is collected or broadcast; each
    task keeps the k best of its tile for every query, and what is shuffled after it is queries * tiles * k rows.
    With `same_part`, a query only meets rows with an equal value there (FLT3): blocks and tiles are then within a part.
    Null vectors are left out.
    """
    parts = [same_part] if same_part else []
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.col(vector).cast("array<float>").alias("v"), *(F.col(c).alias("part") for c in parts))
    b = base.filter(F.col(vector).isNotNull()).select(F.col(base_id).cast("long").alias("bid"), F.col(vector).cast("array<float>").alias("v"), *(F.col(c).alias("part") for c in parts))
    blocks, tiles = max(1, -(-q.count() // block)), max(1, -(-b.count() // tile))
    on = ["part"] if parts else []
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("bt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    b = b.withColumn("bt", F.pmod(F.xxhash64("bid"), F.lit(tiles))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            x, ids, every, base_ids = _unit(left.column("v")), left.column("qid").to_numpy(), _unit(right.column("v")), right.column("bid").to_numpy()
            top, at = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for begin in range(0, len(base_ids), SCORED):
                there = base_ids[begin : begin + SCORED]
                s = x @ every[begin : begin + SCORED].T
                if exclude_self:
                    s[ids[:, None] == there[None, :]] = -np.inf
                s, found = np.concatenate([top, s], 1), np.concatenate([at, np.broadcast_to(there, (len(ids), len(there)))], 1)
                top, at = keep_best(s, found, k)
            which, best_ids, score = best_of(top, at, k)
            out.append((ids[which], best_ids, score))
        return pa.table({c: np.concatenate(v) for c, v in zip(("query_id", "id", "score"), zip(*out))})

    found = q.groupBy("qb", "bt", *on).cogroup(b.groupBy("qb", "bt", *on)).applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def all_cosines(queries: DataFrame, base: DataFrame, query_id: str = "query_id", base_id: str = "id", vector: str = "vec", block: int = PRODUCT_BLOCK, tile: int = PRODUCT_TILE) -> DataFrame:
    """query_id, id, score: every stated query with every other row of the base (JON9). Blocks meet tiles and give their products, of about block * tile rows each; nothing is ranked. The result has queries * rows rows."""
    side = lambda df, id, name: df.filter(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias(name), F.col(vector).cast("array<float>").alias("v"))
    q, b = side(queries, query_id, "qid"), side(base, base_id, "bid")
    blocks, tiles = max(1, -(-q.count() // block)), max(1, -(-b.count() // tile))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q, b = q.withColumn("qb", deal("qid", blocks)).withColumn("bt", spread(tiles)), b.withColumn("bt", deal("bid", tiles)).withColumn("qb", spread(blocks))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, there = left.column("qid").to_numpy(), right.column("bid").to_numpy()
        s = _unit(left.column("v")) @ _unit(right.column("v")).T
        i, j = np.nonzero(ids[:, None] != there[None, :])
        return pa.table({"query_id": ids[i], "id": there[j], "score": s[i, j]})

    return q.groupBy("qb", "bt").cogroup(b.groupBy("qb", "bt")).applyInArrow(product, "query_id long, id long, score double")


def source_ranks(hits: DataFrame) -> DataFrame:
    """Adds source_rank: 1..n in each list of a query and source, by rank (WIN1)."""
    return hits.withColumn("source_rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")))


def priors_first(hits: DataFrame, k: int, override: str = "override") -> DataFrame:
    """The k best of 2k nearest hits, overrides before the others, then by rank (SRT5)."""
    w = Window.partitionBy("query_id").orderBy(F.col(override).desc(), "rank")
    return hits.filter(F.col("rank") <= 2 * k).withColumn("prior_rank", F.row_number().over(w)).filter(F.col("prior_rank") <= k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, c: int = scores.RRF_K) -> DataFrame:
    """Two ranked lists (2k each) joined by the sum of 1 / (c + rank) (SRT10)."""
    d = dense.filter(F.col("rank") <= 2 * k).select("query_id", "id", F.col("rank").alias("d"))
    s = sparse.filter(F.col("rank") <= 2 * k).select("query_id", "id", F.col("rank").alias("s"))
    score = F.coalesce(scores.rrf(F.col("d"), c), F.lit(0.0)) + F.coalesce(scores.rrf(F.col("s"), c), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full_outer").withColumn("score", score)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def tagged_union(caps: DataFrame, docs: DataFrame, priors: DataFrame) -> DataFrame:
    """atom_id, source, id, score of three ranked lists; priors weighed by their own score (SET1, MTH5, MTH7)."""
    one = lambda df, name, score: df.select("atom_id", F.lit(name).alias("source"), "id", "rank", score.alias("score"))
    rank = F.col("rank")
    return one(caps, "capability", scores.rrf(rank)).unionByName(one(docs, "doc", scores.rrf(rank))).unionByName(one(priors, "prior", scores.rrf(rank) * F.col("prior_score")))


def mentions(a: Column, b: Column) -> Column:
    """Either text holds the other; blank ones hold nothing (JON10, JON11)."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def adaptive_k(ranked: DataFrame, low: int = 3, high: int = 7) -> DataFrame:
    """Rows up to the largest drop between neighbours at ranks low..high; all where there are no more than `low` (WIN2)."""
    by = Window.partitionBy("query_id").orderBy("rank")
    n = F.count("*").over(Window.partitionBy("query_id"))
    gaps = ranked.withColumn("n", n).withColumn("gap", F.col("score") - F.lead("score").over(by))
    usable = (F.col("rank") >= low) & (F.col("rank") <= F.least(F.lit(high), F.col("n") - 1))
    cut = gaps.filter(usable).groupBy("query_id").agg(F.max(F.struct(F.round("gap", 9).alias("g"), (-F.col("rank")).alias("r")))["r"].alias("r"))
    return gaps.join(cut, "query_id", "left").withColumn("k", F.when(F.col("n") <= low, F.col("n")).otherwise(F.coalesce(-F.col("r"), F.least(F.lit(high), F.col("n"))))).filter(F.col("rank") <= F.col("k")).drop("n", "gap", "r")


def quality(ranked: DataFrame, has_history: Column) -> DataFrame:
    """HIGH, MEDIUM or LOW: best above 0.5, spread to the 5th (or last) above 0.01, history: all three, two, fewer (WIN3, MTH14)."""
    n = F.count("*").alias("n")
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1")
    size = ranked.groupBy("query_id").agg(n, top)
    at = ranked.join(size, "query_id").groupBy("query_id", "n", "top1").agg(F.max(F.when(F.col("rank") == F.least(F.lit(5), F.col("n")), F.col("score"))).alias("fifth"))
    points = F.when(F.col("top1") > 0.5, 1).otherwise(0) + F.when(F.col("top1") - F.col("fifth") > 0.01, 1).otherwise(0) + F.when(has_history, 1).otherwise(0)
    return at.select("query_id", "n", "top1", "fifth", F.when(points == 3, "HIGH").when(points == 2, "MEDIUM").otherwise("LOW").alias("quality"))


def greedy_distinct(items: Column, alike) -> Column:
    """Items of an array in order, without those alike to a kept one (WIN4)."""
    return F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: alike(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def trim_descriptions(rows: DataFrame, by: list[str], key: str, size: str, budget: int, least: int = 80) -> DataFrame:
    """The rows with new sizes: in each list the longest are cut first until the sum meets the budget, none below `least` (WIN6).

    What a row gives up is what is still over after the longer ones have given all they can, so this is a running sum.
    """
    w = Window.partitionBy(*by)
    before = w.orderBy(F.col(size).desc(), key).rowsBetween(Window.unboundedPreceding, -1)
    can = F.greatest(F.lit(0).cast("long"), F.col(size).cast("long") - least)
    out = rows.withColumn("__can", can).withColumn("__left", F.sum(F.col(size).cast("long")).over(w) - budget - F.coalesce(F.sum("__can").over(before), F.lit(0)))
    return out.withColumn(size, F.col(size).cast("long") - F.least(F.col("__can"), F.greatest(F.lit(0).cast("long"), F.col("__left")))).drop("__can", "__left")


def bm25_vocabulary(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """term, n_docs, idf over a corpus; negative idf is a quarter of the mean (AGG33)."""
    from sparkloom.functions.text import bm25_idf

    terms = docs.select(doc_id, F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    total = docs.agg(F.count("*").alias("total"))
    raw = terms.join(F.broadcast(total)).withColumn("raw", bm25_idf(F.col("total"), F.col("n_docs")))  # total has one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "n_docs", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_encode(docs: DataFrame, vocabulary: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """doc_id, term, idf of the first-seen distinct known terms with idf above 0 (TXT18)."""
    return docs.select(doc_id, F.posexplode(F.array_distinct(tokens)).alias("pos", "term")).join(vocabulary.filter("idf > 0").select("term", "idf"), "term").select(doc_id, "pos", "term", "idf")


def rank_metrics(rankings: DataFrame, k: int = 5, relevant: float = 0.5) -> DataFrame:
    """Per query: nDCG@k (code form and standard form), MRR, Recall@k, success@k (AGG17)."""
    rel = F.col("score") > relevant
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("score") / (1 + F.log2(F.col("rank")))))
    std = F.sum(F.when(F.col("rank") <= k, F.col("score") / F.log2(F.col("rank") + 1)))
    ideal = sum(1 / (1 + np.log2(i)) for i in range(1, k + 1))
    ideal_std = sum(1 / np.log2(i + 1) for i in range(1, k + 1))
    first = F.min(F.when(rel, F.col("rank")))
    total, got = F.count_if(rel), F.count_if(rel & (F.col("rank") <= k))
    return rankings.groupBy("query_id").agg(
        (dcg / F.lit(float(ideal))).alias("ndcg"), (std / F.lit(float(ideal_std))).alias("ndcg_standard"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        F.when(total == 0, 1.0).otherwise(got / total).alias("recall"), F.coalesce(first <= k, F.lit(False)).alias("success"),
    )
