"""Header resolution: exact, then fuzzy by token-set ratio (TXT7, TXT8, SRC12, PRJ1)."""

from __future__ import annotations

from collections import Counter
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import written


def _indel(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|), in percent."""
    if not a and not b:
        return 100.0
    mask, rows = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    s = mask
    for c in b:
        u = s & rows.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def ratio(a: str | None, b: str | None) -> float:
    """Best of three similarities of the sorted common words and what each side adds; 0 if a side has no words."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    p, q = (both + " " + left).strip(), (both + " " + right).strip()
    return max(_indel(p, q), _indel(both, p) if both else 0.0, _indel(both, q) if both else 0.0)


def token_set_ratio(a, b):
    """`ratio` of two text columns, between 0 and 1."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) / 100 for x, y in zip(a, b)])

    return scored(a, b)


def load_synonyms(spark, synonyms: dict[str, list[str]]) -> DataFrame:
    """canonical, term (lower case, trimmed), ord; of equal terms the first wins."""
    rows, seen = [], set()
    for canonical, terms in synonyms.items():
        for term in terms:
            t = term.strip().lower()
            if t not in seen:
                seen.add(t)
                rows.append((canonical, t, len(rows)))
    return spark.createDataFrame(rows, "canonical string, term string, ord int")


#: Synonyms that are broadcast and compared with each unknown header, at most, where the similarity is the caller's own.
MOST_SYNONYMS = 20_000


def trigram_cosine(a: str | None, b: str | None) -> float:
    """Cosine of the counts of three-letter runs of two lower-cased texts: a stand-in for word vectors."""
    x, y = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (f"  {(v or '').strip().lower()} " for v in (a, b)))
    n = sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / n if n else 0.0


def map_headers(headers: DataFrame, synonyms: DataFrame, header: str = "header", fuzzy_above: float = 70.0, alike_above: float = 0.65, alike=None) -> DataFrame:
    """The headers with canonical, confidence and tier: exact, else fuzzy (token-set ratio above `fuzzy_above`), else nlp (`alike` above `alike_above`), else unmatched (TXT8).

    Of equal scores the earlier synonym wins. Each different unknown header is compared once, and only with terms that may be above a threshold
    (`operators.fuzzy`). A similarity of the caller's own (`alike`) has no such bound, so it is asked for each term, of at most MOST_SYNONYMS.
    """
    from sparkloom.operators import fuzzy

    named = headers.withColumn("__h", F.lower(F.trim(header)))
    exact = named.join(synonyms.select(F.col("term").alias("__h"), F.col("canonical").alias("__exact")), "__h", "left")
    unknown = written(exact.filter(F.col("__exact").isNull() & F.col("__h").isNotNull()).select(F.col("__h").alias("t")).distinct(), "headers")
    terms = written(synonyms.select(F.col("term").alias("t"), "canonical", "ord"), "terms")
    near = written(fuzzy.ratio_pairs(unknown, terms, fuzzy_above).select("x", "y", F.lit(2).alias("t"), (F.col("score") / 100).alias("r")), "near")
    rest = unknown.join(near.select(F.col("x").alias("t")).distinct(), "t", "left_anti")
    if alike is None:
        told = fuzzy.trigram_pairs(rest, terms, alike_above)
    else:
        if terms.count() > MOST_SYNONYMS:
            raise ValueError(f"more than {MOST_SYNONYMS} synonyms")
        scored = F.pandas_udf(lambda a, b: pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=float), "double")
        told = rest.select(F.col("t").alias("x")).crossJoin(F.broadcast(terms.select(F.col("t").alias("y")))).withColumn("score", scored("x", "y")).filter(F.col("score") > alike_above)
    pairs = near.unionByName(told.select("x", "y", F.lit(1).alias("t"), F.col("score").alias("r")))
    best = pairs.join(terms.withColumnRenamed("t", "y"), "y").groupBy(F.col("x").alias("__h")).agg(F.max(F.struct("t", "r", (-F.col("ord")).alias("o"), "canonical")).alias("b")).select("__h", "b.t", "b.r", F.col("b.canonical").alias("__near"))
    out = exact.join(best, "__h", "left")
    is_exact = F.col("__exact").isNotNull()
    return out.select(*headers.columns, F.coalesce("__exact", "__near").alias("canonical"), F.when(is_exact, 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("confidence"), F.when(is_exact, "exact").when(F.col("t") == 2, "fuzzy").when(F.col("t") == 1, "nlp").otherwise("unmatched").alias("tier"))


def canonical_rows(rows: DataFrame, mapping: DataFrame, cells: str = "cells", required: str = "requirement_text") -> DataFrame:
    """cells (map<header, value>) renamed to canonical names; blank cells go, and rows without the required field (PRJ1)."""
    mapped = mapping.filter(F.col("canonical").isNotNull()).select("header", "canonical").distinct()
    if mapped.count() > MOST_SYNONYMS:
        raise ValueError(f"more than {MOST_SYNONYMS} mapped headers")
    m = mapped.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "canonical")))).alias("m"))
    out = rows.join(F.broadcast(m)).withColumn("pairs", F.filter(F.transform(F.map_entries(cells), lambda e: F.struct(F.element_at(F.col("m"), e["key"]).alias("k"), F.trim(e["value"]).alias("v"))), lambda e: e["k"].isNotNull() & (e["v"] != "")))
    keys = F.array_distinct(F.transform("pairs", lambda e: e["k"]))
    named = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter("pairs", lambda e: e["k"] == k)[0]["v"])))
    return out.withColumn("canonical", named).filter(F.map_contains_key("canonical", F.lit(required))).drop("m", "pairs")
