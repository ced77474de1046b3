"""Keyed inserts, merges, overlays, paging and state tables as DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new with a key that old lacks; the first of equal new keys by the other columns (SNK1, SNK2)."""
    rest = [c for c in new.columns if c not in key]
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key)))).filter("__n = 1").drop("__n")
    return old.unionByName(first)


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str], set_on_update: dict[str, Column] | None = None) -> DataFrame:
    """Rows of either side by key; in both, the `update` columns come from new and the others stay. Of equal new keys the largest row counts (SNK3, SNK4)."""
    in_old, in_new = F.col("o.__in").isNotNull(), F.col("n.__in").isNotNull()
    last = new.groupBy(*key).agg(F.max(F.struct(*(c for c in new.columns if c not in key))).alias("__row")).select(*key, "__row.*") if set(new.columns) - set(key) else new.distinct()
    both = old.withColumn("__in", F.lit(1)).alias("o").join(last.withColumn("__in", F.lit(1)).alias("n"), key, "full_outer")

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if set_on_update and c in set_on_update:
            return F.when(in_old & in_new, set_on_update[c]).when(in_new, fresh).otherwise(F.col(f"o.{c}")).alias(c)
        take = in_new & (~in_old | F.lit(c in update))
        return F.when(take, fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*map(value, old.columns))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """(SNK5)"""
    return rows.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (SNK9)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(o.desc() for o in order)))).filter("__n = 1").drop("__n")


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (WIN12, STR3)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def delete_keys(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """(SNK10)"""
    return rows.join(keys.select(*key).distinct(), key, "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The `columns` from `over` wherever it has the key, nulls included (JON6)."""
    o = over.select(*key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(1).alias("__in"))
    joined = base.join(o, key, "left")
    return joined.select(*(F.when(F.col("__in").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def fill_missing(base: DataFrame, more: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Null `columns` of base from `more` (JON8)."""
    m = more.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    return base.join(m, key, "left").select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in base.columns))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on each column that is given; None means no condition (FLT1, FLT2, FLT3)."""
    conditions = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else rows


SORTABLE = ("confidence", "classification", "module", "wave")


def page(rows: DataFrame, sort: str, ascending: bool, offset: int, size: int, tie: str, allowed=SORTABLE, default: str = "confidence") -> DataFrame:
    """One page; an unknown sort field falls back to the default, ties go by `tie` (SRT1, SRT2, FLT16)."""
    field = F.col(sort if sort in allowed else default)
    return rows.orderBy(field.asc() if ascending else field.desc(), F.col(tie)).offset(offset).limit(size)


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive contains on any of the columns (FLT17)."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns))


def violations(rows: DataFrame, **constraints: Column) -> DataFrame:
    """Per constraint, the number of rows that break it; null counts as broken (FLT25)."""
    return rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in constraints.items()))


def only_known(m: Column, known: tuple[str, ...]) -> Column:
    """Entries of a map with a known key (FLT15)."""
    return F.map_filter(m, lambda k, _: k.isin(*known))


def one_after_other(parts: list[DataFrame], by: list[str], order: str) -> DataFrame:
    """The rows of all parts with pos, from 1 within each group: those of the first part, then of the next, each in order (SET2, SET3)."""
    every = reduce(DataFrame.unionByName, (p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("__part", order))).drop("__part")


def split_at(rows: DataFrame, key: str, first: int, head: str, tail: str) -> DataFrame:
    """Adds part: `head` for the `first` rows in order of a unique key, else `tail`. Only those rows' keys are broadcast (SRC11)."""
    top = F.broadcast(rows.select(key).orderBy(key).limit(first).withColumn("__top", F.lit(True)))
    return rows.join(top, key, "left").withColumn("part", F.when(F.col("__top"), head).otherwise(tail)).drop("__top")


def in_batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch: 0, 1, ... for each `size` rows of a group in order (WIN11)."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))
