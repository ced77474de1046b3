"""Votes, overrides, batch counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import config_steps

#: Columns of a report, in order (fixed).
REPORT_COLUMNS = ("req_id", "requirement", "module", "country", "wave", "classification", "confidence", "d365_capability", "rationale", "config_steps", "gap_description", "reviewer", "override")


def batch_counts(verdicts: DataFrame, by: str = "batch_id") -> DataFrame:
    """Counts by class, and whether they sum to the total (AGG1)."""
    c = F.col("classification")
    out = verdicts.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(c == k).alias(n) for k, n in (("FIT", "fit"), ("PARTIAL_FIT", "partial"), ("GAP", "gap"), ("REVIEW_REQUIRED", "review"))))
    return out.withColumn("consistent", F.col("fit") + F.col("partial") + F.col("gap") + F.col("review") == F.col("total"))


def majority(votes: DataFrame, least: int = 2) -> DataFrame:
    """votes: atom_id, call_no, ok, verdict. The verdict of `least` or more successful calls, of the earliest call among equals; else REVIEW_REQUIRED (AGG8)."""
    each = votes.filter("ok").groupBy("atom_id", "verdict").agg(F.count("*").alias("n"), F.min("call_no").alias("first_call"))
    best = each.groupBy("atom_id").agg(F.sum("n").alias("votes"), F.max(F.struct("n", (-F.col("first_call")).alias("c"), "verdict")).alias("b"))
    return best.select("atom_id", "votes", F.when((F.col("votes") >= least) & (F.col("b.n") >= least), F.col("b.verdict")).otherwise("REVIEW_REQUIRED").alias("verdict"))


def merge_overrides(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flagged rows take the class of an override that names one; the others, and rows without flags, keep theirs (JON3, JON5, FLT14)."""
    d = decisions.select("atom_id", F.col("decision").alias("__d"), F.col("override_classification").alias("__c"), F.col("reviewer").alias("__r"))
    out = flagged.drop("reviewer", "reviewer_override").join(d, "atom_id", "left")
    is_flagged = F.size("flags") > 0
    takes = F.coalesce(is_flagged & (F.col("__d") == "OVERRIDE") & F.col("__c").isNotNull(), F.lit(False))
    return out.withColumn("reviewer_override", takes).withColumn("reviewer", F.when(is_flagged, F.col("__r"))).withColumn("classification", F.when(takes, F.col("__c")).otherwise(F.col("classification"))).drop("__d", "__c", "__r")


def writable(verdicts: DataFrame) -> DataFrame:
    """Decisions that may be written back (SNK6, SNK7)."""
    return verdicts.filter(F.col("classification") != "REVIEW_REQUIRED")


def report_rows(merged: DataFrame) -> DataFrame:
    """The rows of the two reports with the thirteen columns as text; missing columns are empty (SNK8)."""
    have = {"req_id": F.col("atom_id").cast("string"), "confidence": F.format_string("%.4f", F.col("confidence").cast("double"))}
    if "reviewer_override" in merged.columns:
        have["override"] = F.when(F.col("reviewer_override"), "yes").otherwise("")
    cols = [have.get(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in merged.columns else F.lit("")).alias(c) for c in REPORT_COLUMNS]
    return writable(merged).select(F.when(F.col("classification") == "GAP", "gaps").otherwise("fits").alias("report"), *cols)


def write_reports(merged: DataFrame, path: str) -> None:
    """Two folders of CSV files with headers, one per report."""
    report_rows(merged).write.partitionBy("report").option("header", True).mode("overwrite").csv(path)


def histogram(verdicts: DataFrame) -> DataFrame:
    """Ten confidence bins by class with the dominant class, FIT before PARTIAL_FIT before GAP in ties; empty bins included (AGG22)."""
    c = F.col("classification")
    b = F.least(F.floor(F.round(F.col("confidence") * 10, 6)).cast("int"), F.lit(9))
    h = verdicts.groupBy(b.alias("bin")).agg(*(F.count_if(c == k).alias(n) for k, n in (("FIT", "fit"), ("PARTIAL_FIT", "partial"), ("GAP", "gap"))))
    full = verdicts.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").fillna(0, ["fit", "partial", "gap"])
    top = F.greatest("fit", "partial", "gap")
    return full.withColumn("dominant", F.when(top == 0, F.lit(None).cast("string")).when(F.col("fit") == top, "FIT").when(F.col("partial") == top, "PARTIAL_FIT").otherwise("GAP"))


def steps_of(classification: Column, given: Column, text: Column) -> Column:
    """Steps of a PARTIAL_FIT: the list, else the parsed text, else null (DTJ10)."""
    parsed = config_steps(text)
    return F.when(classification == "PARTIAL_FIT", F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).when(F.size(parsed) > 0, parsed))


def _is(*classes: str) -> Column:
    return F.col("classification").isin(*classes)


def module_breakdown(verdicts: DataFrame) -> DataFrame:
    """module, fit, partial, gap; what needs review counts nowhere (AGG2)."""
    return writable(verdicts).groupBy("module").agg(F.count_if(_is("FIT")).alias("fit"), F.count_if(_is("PARTIAL_FIT")).alias("partial"), F.count_if(_is("GAP")).alias("gap"))


def phase_counts(verdicts: DataFrame, by: str = "batch_id") -> DataFrame:
    """by, flagged (needs review), validated (AGG6)."""
    return verdicts.groupBy(by).agg(F.count_if(_is("REVIEW_REQUIRED")).alias("flagged"), F.count_if(~_is("REVIEW_REQUIRED")).alias("validated"))


def remaining_reviews(verdicts: DataFrame, by: str = "batch_id") -> DataFrame:
    """by, remaining (AGG11)."""
    return verdicts.filter(_is("REVIEW_REQUIRED")).groupBy(by).agg(F.count_if(~F.col("reviewed")).alias("remaining"))


def smoke_summary(verdicts: DataFrame, n_lines: int, by: str = "batch_id") -> DataFrame:
    """by, deduped: lines that are neither results nor up for review, 0 at least (AGG19)."""
    return verdicts.groupBy(by).agg(F.greatest(F.lit(0).cast("long"), F.lit(n_lines) - F.count("*") - F.count_if(_is("REVIEW_REQUIRED"))).alias("deduped"))


def wave_totals(verdicts: DataFrame) -> DataFrame:
    """wave, total, fit, gap in order (AGG20)."""
    return verdicts.groupBy("wave").agg(F.count("*").alias("total"), F.count_if(_is("FIT")).alias("fit"), F.count_if(_is("GAP")).alias("gap")).orderBy("wave")


def distribution(verdicts: DataFrame) -> DataFrame:
    """classification, pct of all; classes that don't occur have no row (AGG24)."""
    n = verdicts.groupBy("classification").agg(F.count("*").alias("__n"))
    return n.crossJoin(n.agg(F.sum("__n").alias("__all"))).select("classification", (100.0 * F.col("__n") / F.col("__all")).alias("pct"))  # the right side is one row


def deltas(verdicts: DataFrame, second: Column) -> DataFrame:
    """fit_delta, gap_delta and confidence_delta from the rows that aren't `second` to those that are (AGG25)."""
    n = lambda c: F.count_if(second & _is(c)) - F.count_if(~second & _is(c))
    mean = lambda side: F.avg(F.when(side, F.col("confidence")))
    return verdicts.agg(n("FIT").alias("fit_delta"), n("GAP").alias("gap_delta"), (mean(second) - mean(~second)).alias("confidence_delta"))


def tab_counts(rows: DataFrame) -> DataFrame:
    """tab, n: for each class and ALL (AGG27)."""
    return rows.rollup("classification").agg(F.count("*").alias("n")).select(F.coalesce("classification", F.lit("ALL")).alias("tab"), "n")


def fit_trend(verdicts: DataFrame, last: int = 10) -> DataFrame:
    """batch_id, fit_share of the last batches by wave (AGG31)."""
    b = verdicts.groupBy("batch_id").agg(F.min("wave").alias("wave"), F.count_if(_is("FIT")).alias("fit"), F.count_if(~_is("REVIEW_REQUIRED")).alias("total"))
    return b.orderBy(F.col("wave").desc(), F.col("batch_id").desc()).limit(last).select("batch_id", F.when(F.col("total") > 0, F.col("fit") / F.col("total")).otherwise(0.0).alias("fit_share"))


def review_queue(verdicts: DataFrame, *order: str) -> DataFrame:
    """What waits for review, oldest first (SRT3)."""
    return verdicts.filter(_is("REVIEW_REQUIRED") & ~F.col("reviewed")).orderBy(*order)
