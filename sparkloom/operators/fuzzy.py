"""Pairs of short texts whose token-set ratio, or trigram cosine, is above a threshold, without comparing all pairs (TXT7, TXT8).

The ratio is the best of three (`functions.headers.ratio`), and each has a bound of its own:
* common words against all words of one side: they are more than t / (2 - t) of that side's length. So they include one of its rarest words, those
  after which less than that is left (its prefix), and a join of prefixes with words finds the pair;
* all words against all words: the shorter is more than t / (2 - t) of the longer, and the characters in common, counted, are at least the common subsequence. Texts are dealt to
  bands of length; a band's texts meet only those of its neighbours, tile by tile, and only pairs that pass the count of characters are scored.
The cosine of trigram counts is bound likewise: trigrams in common include one of the rarest of one side, after which less than t of its norm is left.
What remains is scored exactly, so no pair above the threshold is lost.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import headers
from sparkloom.functions.text import strip
from sparkloom.storage import written

#: Texts of a side that meet in one task, about; classes that characters are counted in.
TILE, CLASSES = 4096, 64


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def _prefix(parts: DataFrame, rank: DataFrame, size: str, left: Column) -> DataFrame:
    """Of parts (t, part, and their `size`): the rarest of each text, up to where what is left is at most `left` (a function of the text's whole size)."""
    order = Window.partitionBy("t").orderBy("n", "part")
    run = parts.join(rank, "part").withColumn("__before", F.sum(size).over(order) - F.col(size)).withColumn("__all", F.sum(size).over(Window.partitionBy("t")))
    return run.filter(F.col("__all") - F.col("__before") > left).select("t", "part")


def _shared(a: DataFrame, b: DataFrame, size: str, left: Column) -> DataFrame:
    """(x, y) where a rare part of one text is a part of the other. a, b: t, part, size."""
    rank = written(a.select("part").unionAll(b.select("part")).groupBy("part").agg(F.count("*").alias("n")), "rank")
    one = _prefix(a, rank, size, left).withColumnRenamed("t", "x").join(b.select(F.col("t").alias("y"), "part"), "part").select("x", "y")
    two = _prefix(b, rank, size, left).withColumnRenamed("t", "y").join(a.select(F.col("t").alias("x"), "part"), "part").select("x", "y")
    return one.unionAll(two).distinct()


def _histograms(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), CLASSES), np.int16)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES)
    return out


def _by_length(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """(x, y) whose lengths and characters allow a ratio above t of all their words. a, b: t, s (the words, joined)."""
    base = log((2 - t) / t)
    band = F.floor(F.log(F.char_length("s")) / base).cast("int")
    tiles = lambda df: max(1, -(-df.count() // TILE))
    n, m = tiles(a), tiles(b)
    near = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band + d)).alias("band")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda k: F.pmod(F.xxhash64("t"), F.lit(k)).cast("int")
    left = a.select("t", "s", near, deal(n).alias("i")).withColumn("j", spread(m))
    right = b.select("t", "s", band.alias("band"), deal(m).alias("j")).withColumn("i", spread(n))

    def pairs(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        x, y = l.column("t").to_pylist(), r.column("t").to_pylist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if x and y:
            p, q = l.column("s").to_pylist(), r.column("s").to_pylist()
            hp, hq = _histograms(p), _histograms(q)
            np_, nq = np.array(list(map(len, p))), np.array(list(map(len, q)))
            for i in range(len(x)):
                size = np_[i] + nq
                some = np.flatnonzero(2 * np.minimum(np_[i], nq) > t * size)
                hit = some[2 * np.minimum(hp[i], hq[some]).sum(1) > t * size[some]]
                out.append((np.full(len(hit), i), hit))
        at = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"x": pa.array(x, pa.string()).take(pa.array(at[0])), "y": pa.array(y, pa.string()).take(pa.array(at[1]))})

    keys = ["band", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pairs, "x string, y string")


def ratio_pairs(a: DataFrame, b: DataFrame, above: float, text: str = "t") -> DataFrame:
    """x, y, score (percent) of the distinct texts of both sides with a token-set ratio above `above` percent. Blank texts have none."""
    t = above / 100
    if not 0 < t < 1:
        raise ValueError("the threshold is between 0 and 100")
    side = lambda df: written(df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).distinct().withColumn("w", _words(F.col("t"))).filter(F.size("w") > 0).select("t", "w", F.array_join(F.array_sort("w"), " ").alias("s")), "side")
    x, y = side(a), side(b)
    each = lambda df: df.select("t", F.explode("w").alias("part")).withColumn("size", F.char_length("part") + 1)  # noqa: E731  a space for each word
    # c of the n + 1 characters (with spaces) are common: 2 (c - 1) / (c - 1 + n) > t, so c > t / (2 - t) * n
    found = _shared(each(x), each(y), "size", F.lit(t / (2 - t)) * (F.col("__all") - 1) - 1e-9).unionAll(_by_length(x, y, t)).distinct()

    @F.pandas_udf("double")
    def scored(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([headers.ratio(u, v) for u, v in zip(p, q)])

    return found.withColumn("score", scored("x", "y")).filter(F.col("score") > above)


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(strip(c)), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def trigram_pairs(a: DataFrame, b: DataFrame, above: float, text: str = "t") -> DataFrame:
    """x, y, score of the distinct texts of both sides with a cosine of trigram counts above `above`."""
    side = lambda df: written(df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).distinct().select("t", F.explode(trigrams(F.col("t"))).alias("part")).groupBy("t", "part").agg(F.count("*").alias("c")).withColumn("size", F.col("c") * F.col("c")), "side")
    x, y = side(a), side(b)
    found = _shared(x, y, "size", F.lit(above * above) * F.col("__all") - 1e-9)

    @F.pandas_udf("double")
    def scored(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([headers.trigram_cosine(u, v) for u, v in zip(p, q)])

    return found.withColumn("score", scored("x", "y")).filter(F.col("score") > above)
