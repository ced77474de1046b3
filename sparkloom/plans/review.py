"""Votes, flags, overrides, batch counts, dashboards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import values as va
from sparkloom.functions.text import review_reason
from sparkloom.operators import review as rv
from sparkloom.operators import views as vw
from sparkloom.plans.base import VERDICTS, counts, query, table, verdicts



@query("agg1_batch_counts", f"WITH {VERDICTS} SELECT batch_id, count(*) AS total, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification = 'PARTIAL_FIT') AS partial, count(*) FILTER (classification = 'GAP') AS gap, count(*) FILTER (classification = 'REVIEW_REQUIRED') AS review, true AS consistent FROM v GROUP BY 1")
def agg1(spark, d):
    return rv.batch_counts(verdicts(spark, d))


@query("agg2_module_breakdown", f"WITH {VERDICTS} SELECT module, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification = 'PARTIAL_FIT') AS partial, count(*) FILTER (classification = 'GAP') AS gap FROM v WHERE classification <> 'REVIEW_REQUIRED' GROUP BY 1")
def agg2(spark, d):
    return rv.module_breakdown(verdicts(spark, d))


_FLAGS = """f AS (SELECT *, [x FOR x IN [CASE WHEN classification = 'GAP' AND confidence > 0.85 THEN 'high_confidence_gap' END, CASE WHEN classification = 'FIT' AND top_score < 0.6 THEN 'low_score_fit' END,
 CASE WHEN classification = 'REVIEW_REQUIRED' THEN 'llm_schema_retry_exhausted' END, CASE WHEN classification NOT IN ('GAP', 'REVIEW_REQUIRED') AND confidence < 0.6 THEN 'low_confidence' END, CASE WHEN classification = 'GAP' THEN 'gap_review' END,
 CASE WHEN wave = 7 THEN 'phase3_anomaly' END, CASE WHEN quantity = 13 THEN 'response_pii_leak' END, CASE WHEN classification = 'PARTIAL_FIT' AND wave % 2 = 0 THEN 'partial_fit_no_config' END] IF x IS NOT NULL] AS flags FROM v),
r AS (SELECT *, CASE WHEN list_contains(flags, 'response_pii_leak') THEN 'pii_detected' WHEN list_contains(flags, 'gap_review') THEN 'gap_review' WHEN list_contains(flags, 'partial_fit_no_config') THEN 'partial_fit_no_config'
 WHEN list_has_any(flags, ['phase3_anomaly', 'high_confidence_gap', 'low_score_fit', 'llm_schema_retry_exhausted']) THEN 'anomaly' ELSE 'low_confidence' END AS reason FROM f)"""


def flagged(spark, d):
    v = verdicts(spark, d)
    caveats = F.when(F.col("quantity") == 13, F.lit("G11: found")).otherwise(F.lit("none"))
    flags = scores.sanity_flags(F.col("classification"), F.col("confidence"), F.col("top_score"), F.lit(True), F.col("wave") == 7, caveats, F.col("wave") % 2 != 0)
    return v.withColumn("flags", flags).withColumn("reason", review_reason(F.col("flags")))


@query("flt12_sanity_flags", f"WITH {VERDICTS}, {_FLAGS} SELECT atom_id, array_to_string(flags, ',') AS flags, reason FROM r")
def flt12(spark, d):
    return flagged(spark, d).select("atom_id", F.array_join("flags", ",").alias("flags"), "reason")


@query("agg3_reason_counts", f"WITH {VERDICTS}, {_FLAGS} SELECT reason, count(*) AS n FROM r WHERE len(flags) > 0 GROUP BY 1")
def agg3(spark, d):
    return flagged(spark, d).filter(F.size("flags") > 0).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg4_hitl_summary", f"WITH {VERDICTS}, {_FLAGS} SELECT batch_id, count(*) AS total, count(*) FILTER (len(flags) > 0) AS flagged, count(*) FILTER (len(flags) = 0) AS auto_approved FROM r GROUP BY 1")
def agg4(spark, d):
    return flagged(spark, d).groupBy("batch_id").agg(F.count("*").alias("total"), *counts(flagged=F.size("flags") > 0, auto_approved=F.size("flags") == 0))


@query("agg6_phase4_counts", f"WITH {VERDICTS} SELECT batch_id, count(*) FILTER (classification = 'REVIEW_REQUIRED') AS flagged, count(*) FILTER (classification <> 'REVIEW_REQUIRED') AS validated FROM v GROUP BY 1")
def agg6(spark, d):
    return rv.phase_counts(verdicts(spark, d))


@query("agg8_majority_vote", f"""WITH {VERDICTS}, t AS (SELECT atom_id // 8 AS atom, wave AS call_no, classification FROM v WHERE wave <= 3 AND quantity > 5), c AS (SELECT atom, classification, count(*) AS n, min(call_no) AS first_call FROM t GROUP BY 1, 2),
b AS (SELECT atom, sum(n)::BIGINT AS ok, max(n) AS most, max(struct_pack(n := n, c := -first_call, verdict := classification)).verdict AS verdict FROM c GROUP BY 1) SELECT atom AS atom_id, ok AS votes, CASE WHEN ok >= 2 AND most >= 2 THEN verdict ELSE 'REVIEW_REQUIRED' END AS verdict FROM b""")
def agg8(spark, d):
    votes = verdicts(spark, d).filter("wave <= 3").select(F.expr("atom_id div 8").alias("atom_id"), F.col("wave").alias("call_no"), (F.col("quantity") > 5).alias("ok"), F.col("classification").alias("verdict"))
    return rv.majority(votes)


@query("mth12_sane_verdict", f"WITH {VERDICTS} SELECT atom_id, CASE WHEN classification = 'FIT' AND top_score < 0.50 THEN 'PARTIAL_FIT' WHEN classification = 'GAP' AND top_score > 0.75 THEN 'REVIEW_REQUIRED' ELSE classification END AS classification FROM v")
def mth12(spark, d):
    return verdicts(spark, d).select("atom_id", scores.sane_verdict(F.col("classification"), F.col("top_score"), 0.75).alias("classification"))


@query("jon5_override_merge", f"""WITH {VERDICTS}, {_FLAGS}, d AS (SELECT atom_id, CASE WHEN atom_id % 3 = 0 THEN 'OVERRIDE' ELSE 'APPROVE' END AS decision, CASE WHEN atom_id % 6 = 0 THEN 'FIT' END AS override_classification, 'r' || wave AS reviewer FROM v WHERE atom_id % 2 = 0)
SELECT r.atom_id, CASE WHEN len(flags) > 0 AND decision = 'OVERRIDE' AND override_classification IS NOT NULL THEN override_classification ELSE classification END AS classification, coalesce(len(flags) > 0 AND decision = 'OVERRIDE' AND override_classification IS NOT NULL, false) AS reviewer_override,
 CASE WHEN len(flags) > 0 THEN d.reviewer END AS reviewer FROM r LEFT JOIN d USING (atom_id)""")
def jon5(spark, d):
    f = flagged(spark, d)
    dec = f.filter("atom_id % 2 = 0").select("atom_id", F.when(F.col("atom_id") % 3 == 0, "OVERRIDE").otherwise("APPROVE").alias("decision"), F.when(F.col("atom_id") % 6 == 0, "FIT").alias("override_classification"), F.concat(F.lit("r"), F.col("wave").cast("string")).alias("reviewer"))
    return rv.merge_overrides(f, dec).select("atom_id", "classification", "reviewer_override", "reviewer")


@query("snk8_report_rows", f"WITH {VERDICTS} SELECT CASE WHEN classification = 'GAP' THEN 'gaps' ELSE 'fits' END AS report, atom_id::VARCHAR AS req_id, format('{{:.4f}}', confidence) AS confidence, classification FROM v WHERE classification <> 'REVIEW_REQUIRED'")
def snk8(spark, d):
    return rv.report_rows(verdicts(spark, d)).select("report", "req_id", "confidence", "classification")


@query("snk6_writable_decisions", f"WITH {VERDICTS} SELECT count(*) AS n FROM v WHERE classification <> 'REVIEW_REQUIRED'")
def snk6(spark, d):
    return rv.writable(verdicts(spark, d)).agg(F.count("*").alias("n"))


@query("agg9_kb_modules", "SELECT p_brand AS module, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 1")
def agg9(spark, d):
    return vw.sizes_of(table(spark, d, "part").withColumnRenamed("p_brand", "module"), "module")


@query("agg10_modules_sorted", "SELECT DISTINCT p_brand AS module FROM part")
def agg10(spark, d):
    return vw.values_of(table(spark, d, "part").withColumnRenamed("p_brand", "module"), "module")


@query("agg11_remaining_reviews", f"WITH {VERDICTS} SELECT batch_id, count(*) FILTER (NOT reviewed) AS remaining FROM v WHERE classification = 'REVIEW_REQUIRED' GROUP BY 1")
def agg11(spark, d):
    return rv.remaining_reviews(verdicts(spark, d))


@query("agg12_reasons_on_reconnect", f"WITH {VERDICTS}, {_FLAGS} SELECT batch_id, coalesce(reason, 'low_confidence') AS reason, count(*) AS n FROM r WHERE classification = 'REVIEW_REQUIRED' GROUP BY 1, 2")
def agg12(spark, d):
    return flagged(spark, d).filter(F.col("classification") == "REVIEW_REQUIRED").groupBy("batch_id", F.coalesce("reason", F.lit("low_confidence")).alias("reason")).agg(F.count("*").alias("n"))


@query("agg19_smoke_summary", f"WITH {VERDICTS} SELECT batch_id, greatest(0, 700 - count(*) - count(*) FILTER (classification = 'REVIEW_REQUIRED')) AS deduped FROM v GROUP BY 1")
def agg19(spark, d):
    return rv.smoke_summary(verdicts(spark, d), 700)


@query("agg20_wave_totals", f"WITH {VERDICTS} SELECT wave, count(*) AS total, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification = 'GAP') AS gap FROM v GROUP BY 1")
def agg20(spark, d):
    return rv.wave_totals(verdicts(spark, d))


@query("agg21_overall_rates", f"WITH {VERDICTS} SELECT CASE WHEN count(*) = 0 THEN 0 ELSE floor(100.0::DOUBLE * count(*) FILTER (classification = 'FIT') / count(*) + 0.5)::BIGINT END AS fit_rate, CASE WHEN count(*) = 0 THEN 0 ELSE floor(100.0::DOUBLE * count(*) FILTER (classification = 'GAP') / count(*) + 0.5)::BIGINT END AS gap_rate FROM v")
def agg21(spark, d):
    rate = lambda c: F.when(F.count("*") == 0, F.lit(0).cast("long")).otherwise(scores.half_up(100.0 * F.count_if(F.col("classification") == c) / F.count("*")))
    return verdicts(spark, d).agg(rate("FIT").alias("fit_rate"), rate("GAP").alias("gap_rate"))


@query("agg22_confidence_histogram", f"""WITH {VERDICTS}, h AS (SELECT least(floor(round(confidence * 10, 6))::INT, 9) AS bin, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification = 'PARTIAL_FIT') AS partial, count(*) FILTER (classification = 'GAP') AS gap FROM v GROUP BY 1)
SELECT b.i::INT AS bin, coalesce(fit, 0) AS fit, coalesce(partial, 0) AS partial, coalesce(gap, 0) AS gap, CASE WHEN coalesce(fit + partial + gap, 0) = 0 THEN NULL WHEN fit >= partial AND fit >= gap THEN 'FIT' WHEN partial >= gap THEN 'PARTIAL_FIT' ELSE 'GAP' END AS dominant FROM range(10) b(i) LEFT JOIN h ON h.bin = b.i""")
def agg22(spark, d):
    return rv.histogram(verdicts(spark, d))


@query("agg23_module_fit_rate", f"WITH {VERDICTS}, m AS (SELECT module, floor(100.0::DOUBLE * count(*) FILTER (classification = 'FIT') / count(*) + 0.5)::BIGINT AS rate FROM v GROUP BY 1) SELECT module, rate, CASE WHEN rate >= 80 THEN 'green' WHEN rate >= 50 THEN 'amber' ELSE 'red' END AS band FROM m")
def agg23(spark, d):
    m = verdicts(spark, d).groupBy("module").agg(scores.half_up(100.0 * F.count_if(F.col("classification") == "FIT") / F.count("*")).alias("rate"))
    return m.withColumn("band", F.when(F.col("rate") >= 80, "green").when(F.col("rate") >= 50, "amber").otherwise("red")).orderBy(F.col("rate").desc(), "module")


@query("agg24_distribution", f"WITH {VERDICTS} SELECT classification, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM v), 4) AS pct FROM v GROUP BY 1")
def agg24(spark, d):
    return rv.distribution(verdicts(spark, d)).withColumn("pct", F.round("pct", 4))


@query("agg25_comparison", f"WITH {VERDICTS}, a AS (SELECT batch_id % 2 AS side, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification = 'GAP') AS gap, avg(confidence) AS c FROM v GROUP BY 1) SELECT b.fit - a.fit AS fit_delta, b.gap - a.gap AS gap_delta, round(b.c - a.c, 6) AS confidence_delta FROM a, a b WHERE a.side = 0 AND b.side = 1")
def agg25(spark, d):
    return rv.deltas(verdicts(spark, d), F.col("batch_id") % 2 == 1).withColumn("confidence_delta", F.round("confidence_delta", 6))


@query("agg27_tab_counts", f"WITH {VERDICTS} SELECT coalesce(classification, 'ALL') AS tab, count(*) AS n FROM v WHERE NOT reviewed GROUP BY ROLLUP (classification)")
def agg27(spark, d):
    return rv.tab_counts(verdicts(spark, d).filter(~F.col("reviewed")))


@query("agg28_artifacts_by_type", "SELECT event_type AS type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def agg28(spark, d):
    return vw.sizes_of(table(spark, d, "events").withColumnRenamed("event_type", "type"), "type", "event_id").withColumnRenamed("last", "last_id")


@query("agg31_confidence_trend", f"WITH {VERDICTS}, b AS (SELECT batch_id, min(wave) AS wave, count(*) FILTER (classification = 'FIT') AS fit, count(*) FILTER (classification <> 'REVIEW_REQUIRED') AS total FROM v GROUP BY 1) SELECT batch_id, round(CASE WHEN total > 0 THEN fit / total ELSE 0 END, 6)::DOUBLE AS fit_share FROM b ORDER BY wave DESC, batch_id DESC LIMIT 10")
def agg31(spark, d):
    return rv.fit_trend(verdicts(spark, d)).withColumn("fit_share", F.round("fit_share", 6))


@query("dtj10_config_steps", f"WITH {VERDICTS} SELECT atom_id, CASE WHEN classification <> 'PARTIAL_FIT' THEN 0 WHEN wave % 3 = 0 THEN 2 WHEN wave % 3 = 1 THEN 1 ELSE 0 END AS n_steps FROM v")
def dtj10(spark, d):
    given = F.when(F.col("wave") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    text = F.when(F.col("wave") % 3 == 1, F.lit("1. only step"))
    steps = rv.steps_of(F.col("classification"), given, text)
    return verdicts(spark, d).select("atom_id", F.greatest(F.coalesce(F.size(steps), F.lit(0)), F.lit(0)).alias("n_steps"))


@query("dtj11_no_capability_gap", f"WITH {VERDICTS} SELECT atom_id, CASE WHEN wave > 5 THEN 'GAP' ELSE classification END AS classification, CASE WHEN wave > 5 THEN 0.0 ELSE confidence END AS confidence FROM v")
def dtj11(spark, d):
    none = F.size(F.when(F.col("wave") > 5, F.array()).otherwise(F.array(F.lit(1)))) == 0
    return verdicts(spark, d).select("atom_id", *va.without_capability(none, F.col("classification"), F.col("confidence")))


@query("jon4_priors_by_atom", f"WITH {VERDICTS}, p AS (SELECT module, count(*) AS n FROM v WHERE wave = 7 GROUP BY 1) SELECT atom_id, coalesce(n, 0) AS n_priors FROM v LEFT JOIN p USING (module)")
def jon4(spark, d):
    v = verdicts(spark, d)
    return vw.prior_counts(v, v.filter("wave = 7"), "module").select("atom_id", "n_priors")


@query("pip5_validation", f"""WITH {VERDICTS}, {_FLAGS}, m AS (SELECT batch_id, CASE WHEN len(flags) > 0 AND atom_id % 6 = 0 THEN 'FIT' ELSE classification END AS c FROM r)
SELECT batch_id, count(*) AS total, count(*) FILTER (c = 'FIT') AS fit, count(*) FILTER (c = 'PARTIAL_FIT') AS partial, count(*) FILTER (c = 'GAP') AS gap, count(*) FILTER (c = 'REVIEW_REQUIRED') AS review, true AS consistent FROM m GROUP BY 1""")
def pip5(spark, d):
    f = flagged(spark, d)
    dec = f.filter("atom_id % 6 = 0").select("atom_id", F.lit("OVERRIDE").alias("decision"), F.lit("FIT").alias("override_classification"), F.lit("r").alias("reviewer")).distinct()
    return rv.batch_counts(rv.merge_overrides(f, dec))
