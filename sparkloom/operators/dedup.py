"""Near-duplicate removal over vectors (DED1-DED4). Pairs are formed within blocks of equal `block` value only."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.retrieval import _unit
from sparkloom.operators.vector_index import VectorIndex
from sparkloom.storage import written

#: Rows of a tile, about: a block of n rows is n / TILE_ROWS tiles, and each two of them meet in one task.
TILE_ROWS = 4096
#: Rows of a block from which the index way takes over.
MATRIX_ROWS = 300
#: Rows that a round of `greedy_by_index` decides among themselves, at first.
CANDIDATES = 4096


def similar_pairs(rows: DataFrame, above: float, block: str, tile: int = TILE_ROWS) -> DataFrame:
    """i < j and their cosine, above a threshold, within a block; the block's rows are compared tile by tile (JON12)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            a, b, x, y = _unit(left.column("vec")), _unit(right.column("vec")), left.column("id").to_numpy(), right.column("id").to_numpy()
            same = left.column("t")[0] == left.column("u")[0]
            for at in range(0, len(a), 1024):
                s = a[at : at + 1024] @ b.T
                near = s > above
                if same:
                    near &= x[at : at + 1024, None] < y[None, :]
                p, q = np.nonzero(near)
                i, j = x[at : at + 1024][p], y[q]
                out.append((np.minimum(i, j), np.maximum(i, j), s[p, q]))
        return pa.table({c: np.concatenate(v) for c, v in zip("ijs", zip(*out))})

    sizes = rows.groupBy(F.col(block).alias("b")).agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    held = rows.filter(F.col("vec").isNotNull()).select(F.col("id").cast("long"), F.col("vec").cast("array<float>"), F.col(block).alias("b")).join(sizes, "b").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    zero = F.lit(0).cast("long")
    left = held.withColumn("u", F.explode(F.sequence("t", F.col("tiles") - 1))).select("b", "t", "u", "id", "vec")
    right = held.withColumn("u", F.col("t")).withColumn("t", F.explode(F.sequence(zero, "u"))).select("b", "t", "u", "id", "vec").toDF("b", "t", "u", "id", "vec")
    return left.groupBy("b", "t", "u").cogroup(right.groupBy("b", "t", "u")).applyInArrow(run, "i long, j long, s double")


def owners(rows: DataFrame, hard: float = 0.92, soft: float = 0.80, block: str = "b") -> DataFrame:
    """id, owner (the least i with a cosine above `hard`, else null), soft (only similar above `soft`) (DED2).

    Owners are not tested for having been absorbed themselves, so this is a grouped minimum.
    """
    pairs = similar_pairs(rows, soft, block)
    marks = pairs.groupBy("j").agg(F.min(F.when(F.col("s") > hard, F.col("i"))).alias("owner"), F.max(F.when(F.col("s") <= hard, F.lit(1))).alias("near"))
    return rows.select("id").join(marks.withColumnRenamed("j", "id"), "id", "left").select("id", "owner", (F.col("owner").isNull() & F.col("near").isNotNull()).alias("soft"))


def greedy(rows: DataFrame, hard: float = 0.92, soft: float = 0.80, block: str = "b", pairs: DataFrame | None = None) -> DataFrame:
    """id, owner, soft where an absorbed row absorbs no other (DED3). pairs: those above `soft`, if they are known.

    What the pairs in (i, j) order decide one by one: a row is absorbed if a smaller similar row is kept, and kept if all
    of those are absorbed. Each round decides every row whose smaller neighbours are decided, so rounds follow the
    longest chain of such rows, not the number of pairs. A pair remembers what was decided of its i, so a round joins and writes new
    decisions only. The owner is the least kept neighbour; a row is soft if a kept row was similar to it before it was absorbed.
    """
    pairs = written(similar_pairs(rows, soft, block) if pairs is None else pairs, "pairs")
    hard_pairs = pairs.filter(F.col("s") > hard).select("i", "j")
    live = hard_pairs.withColumn("known", F.lit(None).cast("boolean"))
    new = written(hard_pairs.select(F.col("i").alias("id")).distinct().join(hard_pairs.select(F.col("j").alias("id")).distinct(), "id", "left_anti").withColumn("kept", F.lit(True)), "decided")
    decided = [new]
    while not new.isEmpty():
        told = live.join(new.withColumnRenamed("id", "i"), "i", "left").select("i", "j", F.coalesce("known", "kept").alias("known"))
        told = written(told, "live")
        seen = told.groupBy(F.col("j").alias("id")).agg(F.max(F.coalesce("known", F.lit(False))).alias("any_kept"), F.min(F.col("known").isNotNull()).alias("all_known"))
        new = written(seen.filter("any_kept OR all_known").select("id", (~F.col("any_kept")).alias("kept")), "decided")
        live = told.join(new.select(F.col("id").alias("j")), "j", "left_anti")
        decided.append(new)
    status = reduce(DataFrame.unionByName, decided)
    gone = status.filter(~F.col("kept")).select(F.col("id").alias("i"))
    owner = hard_pairs.join(gone, "i", "left_anti").groupBy(F.col("j").alias("id")).agg(F.min("i").alias("owner"))
    near = pairs.filter(F.col("s") <= hard).select("i", F.col("j").alias("id")).join(gone, "i", "left_anti").groupBy("id").agg(F.min("i").alias("first"))
    out = rows.select("id").join(owner, "id", "left").join(near, "id", "left")
    return out.select("id", "owner", (F.col("first").isNotNull() & (F.col("owner").isNull() | (F.col("first") < F.col("owner")))).alias("soft"))


def greedy_by_index(rows: DataFrame, hard: float = 0.92, soft: float = 0.80, first: int = CANDIDATES) -> DataFrame:
    """`greedy` over a whole table without blocks: pairs come from a vector index, which leaves out lists that can't hold any (DED3).

    Only pairs with a kept row decide anything, so only kept rows are asked for. A round decides the next rows that no kept row has absorbed, `first` of them in the
    order of ids, among themselves; then those that stay are looked up in the index, and what they absorb is decided too. Where a round keeps most of
    its rows, the next one takes twice as many, so rounds don't follow the number of rows.
    """
    index = VectorIndex.build(rows)
    vectors = written(rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).select(F.col("id").cast("long"), F.col("vec").cast("array<float>")), "vectors")
    todo, found = vectors.select("id"), []
    while True:
        last = todo.orderBy("id").limit(first).agg(F.max("id"), F.count("*")).first()
        if not last[1]:
            break
        some = todo.filter(F.col("id") <= last[0])
        among = greedy(vectors.join(some, "id", "left_semi").withColumn("b", F.lit(0)), hard, soft, "b")
        kept = written(among.filter("owner IS NULL").select("id"), "kept")
        pairs = written(index.pairs_above(vectors.join(kept, "id", "left_semi"), soft), "pairs")
        found.append(pairs)
        gone = pairs.filter(F.col("s") > hard).select(F.col("j").alias("id")).distinct()
        todo = written(todo.filter(F.col("id") > last[0]).join(gone, "id", "left_anti"), "todo")
        first *= 1 + (2 * kept.count() > last[1])
    index.drop()
    if not found:
        return rows.select("id", F.lit(None).cast("long").alias("owner"), F.lit(False).alias("soft"))
    near = reduce(DataFrame.unionByName, found).groupBy(F.col("j").alias("id")).agg(F.min(F.when(F.col("s") > hard, F.col("i"))).alias("owner"), F.min(F.when(F.col("s") <= hard, F.col("i"))).alias("first"))
    return rows.select("id").join(near, "id", "left").select("id", "owner", (F.col("first").isNotNull() & (F.col("owner").isNull() | (F.col("first") < F.col("owner")))).alias("soft"))


def deduplicate(rows: DataFrame, hard: float = 0.92, soft: float = 0.80, block: str = "b", most: int = MATRIX_ROWS, large: Column | None = None) -> DataFrame:
    """id, owner, soft: blocks of up to `most` rows by `owners`, larger ones by `greedy`; a block of one row has no pairs (DED1).

    large: of the block's value, where a caller says which blocks are large, so that the way of a block doesn't change as the table grows.
    """
    if large is None:
        sizes = rows.groupBy(block).agg((F.count("*") > most).alias("__large"))
        marked = rows.join(sizes, block)
    else:
        marked = rows.filter(F.col(block).isNotNull()).withColumn("__large", large)
    return owners(marked.filter(~F.col("__large")), hard, soft, block).unionByName(greedy(marked.filter("__large"), hard, soft, block))


def text_copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Adds is_copy: an equal text has a smaller key (DED5, DED6). Texts are compared by SHA-256; null ones are no copies."""
    hashed = rows.withColumn("__sha", F.sha2(F.col(text), 256))
    first = hashed.groupBy("__sha").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).filter("__n > 1 AND __sha IS NOT NULL").drop("__n")
    return hashed.join(first, "__sha", "left").withColumn("is_copy", F.coalesce(F.col(key) > F.col("__first"), F.lit(False))).drop("__sha", "__first")


def merge(rows: DataFrame, owned: DataFrame, ref: str = "source_ref") -> DataFrame:
    """The rows without an owner; their reference is followed by the ids they absorbed, in order (DED4, SET4, JON19)."""
    taken = owned.filter(F.col("owner").isNotNull())
    lists = taken.groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_list(F.col("id").alias("x"))).alias("ids"))
    kept = rows.join(taken.select("id"), "id", "left_anti").join(lists, "id", "left")
    return kept.select("id", F.concat_ws(",", F.col(ref), F.array_join(F.col("ids").cast("array<string>"), ",")).alias(ref), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("absorbed")).withColumn("absorbed", F.greatest(F.col("absorbed"), F.lit(0).cast("long")))


