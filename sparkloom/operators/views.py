"""Projections, joins and rollups that the engine's pages and phases read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters a page of text has at least, and the share of them below which a file is read as images (fixed).
PAGE_CHARS, LEAST_RATIO = 2000, 0.3
#: Bonus of a capability for each document on its feature before fusion (fixed).
FEATURE_BONUS = 0.05


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The rows with the given values (SRC13)."""
    for c, v in keys.items():
        rows = rows.filter(F.col(c) == v)
    return rows


def collection_size(rows: DataFrame) -> DataFrame:
    """One row: n (SRC15)."""
    return rows.agg(F.count("*").alias("n"))


def text_ratio(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, ratio: characters over what as many full pages hold (AGG15)."""
    return pages.groupBy(key).agg((F.sum(F.char_length(text)) / (F.count("*") * float(PAGE_CHARS))).alias("ratio"))


def needs_ocr(pages: DataFrame, key: str, text: str, least: float = LEAST_RATIO) -> DataFrame:
    """key, needs_ocr: too little text for its pages (SRC7)."""
    return text_ratio(pages, key, text).select(key, (F.col("ratio") < least).alias("needs_ocr"))


def page_windows(rows: DataFrame, page: str, size: int = 5) -> DataFrame:
    """Adds win: the number of the window of `size` pages (SRC9)."""
    return rows.withColumn("win", F.floor(F.col(page) / size))


def pending(every: DataFrame, applied: DataFrame, key: str, order: str) -> DataFrame:
    """What is not applied yet, in order of name (SRC19)."""
    return every.join(applied.select(key).distinct(), key, "left_anti").orderBy(order)


def power_law_ranking(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, pos (from 0 in each group) with power-law scores of capabilities and documents, and priors that fit but for a group's last (SRC20)."""
    w = Window.partitionBy(by).orderBy(order)
    i = F.row_number().over(w) - 1
    last = F.lead(F.lit(1)).over(w).isNull()
    return rows.select(by, order, i.alias("pos"), last.alias("__last")).select(by, order, "pos", (0.95 / F.pow(F.col("pos") + 1, F.lit(0.8))).alias("capability"), (0.90 / F.pow(F.col("pos") + 1, F.lit(0.7))).alias("doc"), F.when(F.col("__last"), "PARTIAL_FIT").otherwise("FIT").alias("prior"))


def first_uploads(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """content_hash, the first upload with it, and how many there are (SNK15, DED5)."""
    return rows.groupBy(content.alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def requirement_lines(rows: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """key, pos (from 1) and line of the lines with `least` characters or more besides white space at the ends (PRJ2)."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "line"))
    return lines.filter(F.char_length(F.trim("line")) >= least).select(key, (F.col("p") + 1).cast("long").alias("pos"), "line")


def atom_ids(rows: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """key, pos (from 1) and atom_id of the lines with `least` characters or more (PRJ3)."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "x")).filter(F.char_length("x") >= least)
    name = F.concat(F.lit("REQ-"), F.lpad(F.col(key).cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("p").cast("string"), 4, "0"))
    return lines.select(key, (F.col("p") + 1).cast("long").alias("pos"), name.alias("atom_id"))


def dominant_modality(tables: Column, images: Column) -> Column:
    """TABLE where there is any, else IMAGE where there is any, else TEXT (PRJ4)."""
    return F.when(tables > 0, "TABLE").when(images > 0, "IMAGE").otherwise("TEXT")


def gate_rows(rows: DataFrame, capabilities: Column) -> DataFrame:
    """The rows of a gate: the first capability's name and score, '' and 0 without one (PRJ5)."""
    top = rows.withColumn("__top", F.get(capabilities, F.lit(0)))
    return top.withColumn("top_capability", F.coalesce("__top.name", F.lit(""))).withColumn("top_score", F.coalesce("__top.score", F.lit(0.0))).drop("__top")


def hit(text: Column, score: Column, cut: int = 512) -> list[Column]:
    """excerpt and score of a search hit, the score within 0 and 1 (PRJ6)."""
    return [F.substring(text, 1, cut).alias("excerpt"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")]


def journeys(atoms: DataFrame, results: DataFrame, priors: DataFrame, key: str) -> DataFrame:
    """key, n_results, best_class and priors of each atom; empty where it has none. priors: module and a count (PRJ7)."""
    side = results.join(priors, "module", "left").groupBy(key).agg(F.count("*").alias("n"), F.max("classification").alias("best"), F.sum("priors").alias("priors"))
    return atoms.select(key).join(side, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_results"), F.coalesce("best", F.lit("")).alias("best_class"), F.coalesce("priors", F.lit(0)).alias("priors"))


def result_view(rows: DataFrame) -> DataFrame:
    """atom_id, label and evidence as the pages show a result (PRJ11)."""
    return rows.select("atom_id", F.concat_ws("/", "module", "classification").alias("label"), F.round("confidence", 1).alias("evidence"))


def template_line(feature: Column, classification: Column, confidence: Column) -> Column:
    """'feature — class (NN%)' (PRJ13)"""
    return F.format_string("%s — %s (%d%%)", feature, classification, F.bround(confidence * 100).cast("int"))


def open_interrupts(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """What waits in each batch: how many modules, and the last atom (PRJ15)."""
    return rows.groupBy(by).agg(F.count_distinct("module").alias("modules"), F.max("atom_id").alias("last_atom"))


def payload_id(payload: Column, own: Column, name: str = "_id") -> tuple[Column, Column]:
    """The id that a payload keeps (else the row's own), and the payload without it (PRJ18)."""
    return F.coalesce(F.element_at(payload, F.lit(name)), own.cast("string")), F.map_filter(payload, lambda k, _: k != name)


def compare_batches(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups that both have with different classes: class_a, class_b, and the change of the mean confidence; largest first (JON16)."""
    side = lambda rows, c, s: rows.groupBy(*by).agg(F.max("classification").alias(c), F.avg("confidence").alias(s))
    both = side(a, "class_a", "__a").join(side(b, "class_b", "__b"), by).filter("class_a <> class_b")
    return both.orderBy(F.col("__b").desc(), *by).select(*by, "class_a", "class_b", (F.col("__b") - F.col("__a")).alias("delta"))


def append_missing(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """live, and what is stored and not live (JON17)."""
    return live.unionByName(stored.join(live, key, "left_anti"))


def split_flagged(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Adds flagged: whether the ids hold the row's key (JON18)."""
    return rows.join(ids.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn("flagged", F.col("__in").isNotNull()).drop("__in")


def feature_boost(capabilities: DataFrame, docs: DataFrame, feature: str = "feature", bonus: float = FEATURE_BONUS) -> DataFrame:
    """Scores with a bonus for each document on the same feature, 1 at most (JON22)."""
    n = docs.groupBy(feature).agg(F.count("*").alias("__n"))
    return capabilities.join(n, feature, "left").withColumn("score", F.least(F.lit(1.0), F.col("score") + bonus * F.coalesce("__n", F.lit(0)))).drop("__n")


def modality_shares(rows: DataFrame, key: str, modality: str, size: Column) -> DataFrame:
    """key, modality, share of the group's size (AGG13)."""
    sums = rows.groupBy(key, modality).agg(F.sum(size).alias("__n"))
    return sums.select(key, modality, (F.col("__n") / F.sum("__n").over(Window.partitionBy(key))).alias("share"))


def rollup(rows: DataFrame, key: str, page: str, label: str) -> DataFrame:
    """key, first and last page, the labels in order, and how many rows (AGG14)."""
    return rows.groupBy(key).agg(F.min(page).alias("first"), F.max(page).alias("last"), F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("n"))


def char_offsets(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Adds char_offset: characters up to the end of the row, with one between rows (WIN8)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("char_offset", F.sum(F.char_length(text) + 1).over(w))


def section_changes(rows: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Adds changed: the first element of the path is another than the row's before; the first row is a change (CHK5)."""
    before = F.lag(F.struct(F.get(path, F.lit(0)).alias("h"))).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("changed", before.isNull() | ~F.get(path, F.lit(0)).eqNullSafe(before["h"]))


def positions(rows: DataFrame, by: list[str], *order: Column | str, name: str = "pos") -> DataFrame:
    """Adds the place of each row in its group, from 1 (SRT7, SRT8, SRT9)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def newest(rows: DataFrame, at: str, tie: str, size: int) -> DataFrame:
    """The first page, newest first (SRT11)."""
    return rows.orderBy(F.col(at).desc(), tie).limit(size)


def slice_of(rows: DataFrame, order: list[Column | str], offset: int, size: int) -> DataFrame:
    """A page in the given order (SRT13)."""
    return rows.orderBy(*order).offset(offset).limit(size)


def sizes_of(rows: DataFrame, key: str, last: str | None = None) -> DataFrame:
    """key, n and, if named, the largest value of a column, for the values of key that aren't blank (AGG9, AGG28)."""
    more = [F.max(last).alias("last")] if last else []
    return rows.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"), *more)


def values_of(rows: DataFrame, key: str) -> DataFrame:
    """The values of a column in order (AGG10)."""
    return rows.select(key).distinct().orderBy(key)


def common_values(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The values that both sides have (SET6)."""
    return a.select(key).intersect(b.select(key))


def with_file_names(batches: DataFrame, uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    """batches with the file name of their upload, '' without one (JON1)."""
    return batches.join(uploads.select(key, "filename"), key, "left").withColumn("filename", F.coalesce("filename", F.lit("")))


def beside(rows: DataFrame, other: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with columns of what the other side has under their key, null where it has nothing (JON2, JON7)."""
    return rows.join(other.select(key, *columns), key, "left")


def prior_counts(rows: DataFrame, priors: DataFrame, by: str) -> DataFrame:
    """Adds n_priors: how many priors have the row's value (JON4)."""
    n = priors.groupBy(by).agg(F.count("*").alias("n_priors"))
    return rows.join(n, by, "left").withColumn("n_priors", F.coalesce("n_priors", F.lit(0)))


def citations(refs: DataFrame, meta: DataFrame, key: str, cut: int = 500) -> DataFrame:
    """refs with source_ref and an excerpt of what they cite, '' where it is unknown. meta: key, source, text (JON14)."""
    known = meta.select(key, F.col("source").alias("source_ref"), F.substring("text", 1, cut).alias("excerpt"))
    return refs.join(known, key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_ref", "excerpt")})


def reference_counts(rows: DataFrame, refs: DataFrame, key: str, name: str = "n_artifacts") -> DataFrame:
    """Adds how many references each row has (JON15)."""
    return rows.join(refs.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def not_shown(rows: DataFrame, by: str, item: str, shown: Column) -> DataFrame:
    """by, left_over: the items of a group of which no row is shown, in order (JON20)."""
    lists = rows.groupBy(by).agg(F.collect_set(item).alias("__every"), F.collect_set(F.when(shown, F.col(item))).alias("__shown"))
    return lists.select(by, F.array_sort(F.array_except("__every", "__shown")).alias("left_over"))


def usable_priors(rows: DataFrame, vector: str = "embedding", **equal) -> DataFrame:
    """Rows with a vector, and with the given values (FLT4)."""
    return lookup(rows.filter(F.col(vector).isNotNull()), **equal)


def undecided(rows: DataFrame, decided: DataFrame, key: str, reviewed: str = "reviewed") -> DataFrame:
    """Rows that are not reviewed and not decided in this session (FLT19)."""
    return rows.filter(~F.col(reviewed)).join(decided.select(key).distinct(), key, "left_anti")


def in_status(rows: DataFrame, *statuses: str) -> DataFrame:
    """(FLT21, FLT23)"""
    return rows.filter(F.col("status").isin(*statuses))


def input_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line: the lines that are neither blank nor comments (FLT22)."""
    lines = rows.select(key, F.explode(F.split(F.col(text), "\n")).alias("__x")).select(key, F.trim("__x").alias("line"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def happening(rows: DataFrame, by: str, condition: Column) -> DataFrame:
    """by, n: how many rows meet the condition, where any does (FLT24)."""
    return rows.groupBy(by).agg(F.count_if(condition).alias("n")).filter("n > 0")
