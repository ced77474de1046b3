"""Small values as Column expressions: ids, times, lists, overrides, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds since 1970 (DTJ1)."""
    return F.unix_timestamp(ts.cast("timestamp"))


def iso(ts: Column) -> Column:
    """ISO 8601 to the second (DTJ1)."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def content_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the joined parts (DTJ5)."""
    return F.left(F.sha2(F.concat(*parts), 256), F.lit(length))


def packed(*columns: str) -> Column:
    """Columns as JSON text (DTJ2)."""
    return F.to_json(F.struct(*columns))


def counted_up(m: Column, key: str, by: int = 1) -> Column:
    """The map with one more for the key, from 0 where it has none (DTJ4)."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), F.coalesce(F.element_at(m, F.lit(key)), F.lit(0)) + by))


def override(decision: Column, chosen: Column) -> Column:
    """struct<classification> of a decision OVERRIDE that names a class, else null (DTJ8)."""
    return F.when((decision == "OVERRIDE") & chosen.isNotNull(), F.struct(chosen.alias("classification")))


def gate_number(name: Column) -> Column:
    """1 to 4 of 'gate_N', else null (DTJ9)."""
    n = F.regexp_extract(name, r"^gate_(\d+)$", 1).try_cast("int")
    return F.when(n.between(1, 4), n)


def without_capability(none: Column, classification: Column, confidence: Column) -> list[Column]:
    """classification and confidence, GAP and 0 where there is no capability (DTJ11)."""
    return [F.when(none, "GAP").otherwise(classification).alias("classification"), F.when(none, 0.0).otherwise(confidence).alias("confidence")]


def review_required() -> list[Column]:
    """classification and confidence of what a person has to look at (DTJ12)."""
    return [F.lit("REVIEW_REQUIRED").alias("classification"), F.lit(0.0).alias("confidence")]


def merged(*lists: Column) -> Column:
    """One list of what any of the lists holds, each once, first ones first (SET4, SET5)."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.slice(x, 1, 0)) for x in lists)))


def known_module(module: Column, vocabulary: list[str], default: str) -> Column:
    """The module where the vocabulary has it, else the default (TXT20)."""
    return F.when(module.isin(*vocabulary), module).otherwise(default)


def change(old: Column, new: Column) -> list[Column]:
    """delta and pct of a metric; 0 percent of a metric that was 0 (AGG18)."""
    return [(new - old).alias("delta"), F.when(old > 0, 100 * (new - old) / old).otherwise(0.0).alias("pct")]


#: Cuts of texts by where they are shown (fixed).
CUTS = {"excerpt": 500, "hit": 512, "prompt": 2000, "title": 30}


def cut(text: Column, where: str) -> Column:
    """The first characters of a text, as many as are shown there (TXT19)."""
    return F.substring(F.coalesce(text, F.lit("")), 1, CUTS[where])


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash (TXT19)."""
    return F.regexp_extract(path, r"([^/\\\\]*)$", 1)
