"""Joins, filters, merges, paging, projections and state tables over the relational side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions import scores
from sparkloom.functions import values as va
from sparkloom.functions.text import tolerant_json
from sparkloom.operators import relational as rel
from sparkloom.operators import review as rv
from sparkloom.operators import views as vw
from sparkloom.plans.base import VERDICTS, query, table, verdicts
from sparkloom.sources import files
from sparkloom.sources.keyed import KeyedTable
from sparkloom.storage import shared_folder

BATCHES = "b AS (SELECT o_orderkey AS batch_id, o_custkey AS upload_id, o_orderstatus AS status, o_orderpriority AS country, o_totalprice AS total, o_orderdate AS created_at FROM orders)"


def batches(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey batch_id", "o_custkey upload_id", "o_orderstatus status", "o_orderpriority country", "o_totalprice total", "o_orderdate created_at")


def uploads(spark, d):
    """Every third upload has no row, so that the outer join shows."""
    return table(spark, d, "customer").filter("c_custkey % 3 <> 0").selectExpr("c_custkey upload_id", "c_name filename", "c_mktsegment product_id")


@query("jon1_batches_with_uploads", f"WITH {BATCHES} SELECT b.batch_id, b.upload_id, b.status, coalesce(u.c_name, '') AS filename FROM b LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) u ON u.c_custkey = b.upload_id")
def jon1(spark, d):
    return vw.with_file_names(batches(spark, d), uploads(spark, d)).select("batch_id", "upload_id", "status", "filename")


@query("flt1_batches_by_optional_filters", f"WITH {BATCHES} SELECT batch_id, status, country FROM b WHERE status = 'F' AND country = '1-URGENT'")
def flt1(spark, d):
    return rel.matching(batches(spark, d), status="F", country="1-URGENT", upload_id=None).select("batch_id", "status", "country")


@query("srt1_batch_page", f"WITH {BATCHES} SELECT batch_id, created_at, status FROM b ORDER BY created_at DESC, batch_id LIMIT 25 OFFSET 50")
def srt1(spark, d):
    return batches(spark, d).orderBy(F.col("created_at").desc(), "batch_id").offset(50).limit(25).select("batch_id", "created_at", "status")


@query("flt2_srt2_results_page", f"WITH {VERDICTS} SELECT atom_id, module, classification, confidence FROM v WHERE classification = 'FIT' ORDER BY confidence DESC, atom_id LIMIT 20 OFFSET 20")
def srt2(spark, d):
    rows = rel.matching(verdicts(spark, d), classification="FIT", module=None)
    return rel.page(rows, "no such field", False, 20, 20, "atom_id").select("atom_id", "module", "classification", "confidence")


@query("agg7_result_count", f"WITH {VERDICTS} SELECT count(*) AS n FROM v WHERE classification = 'GAP'")
def agg7(spark, d):
    return rel.matching(verdicts(spark, d), classification="GAP").agg(F.count("*").alias("n"))


@query("src13_point_lookup", f"WITH {BATCHES} SELECT * FROM b WHERE batch_id = 7")
def src13(spark, d):
    return vw.lookup(batches(spark, d), batch_id=7)


@query("srt3_review_queue", f"WITH {VERDICTS} SELECT atom_id, wave FROM v WHERE classification = 'REVIEW_REQUIRED' AND NOT reviewed")
def srt3(spark, d):
    return rv.review_queue(verdicts(spark, d), "wave", "atom_id").select("atom_id", "wave")


@query("jon6_decision_overlay", """SELECT o_orderkey AS atom_id, CASE WHEN d.o_orderkey IS NOT NULL THEN d.status ELSE o.o_orderstatus END AS status, CASE WHEN d.o_orderkey IS NOT NULL THEN d.prio ELSE o.o_orderpriority END AS reviewer
FROM orders o LEFT JOIN (SELECT o_orderkey, 'X' AS status, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'r' END AS prio FROM orders WHERE o_orderkey % 5 = 0) d USING (o_orderkey)""")
def jon6(spark, d):
    base = table(spark, d, "orders").selectExpr("o_orderkey atom_id", "o_orderstatus status", "o_orderpriority reviewer")
    over = base.filter("atom_id % 5 = 0").selectExpr("atom_id", "'X' status", "CASE WHEN atom_id % 10 = 0 THEN NULL ELSE 'r' END reviewer")
    return rel.overlay(base, over, ["atom_id"], ["status", "reviewer"])


@query("jon8_fill_missing", """SELECT o_orderkey AS atom_id, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END, c_mktsegment) AS module FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def jon8(spark, d):
    base = table(spark, d, "orders").selectExpr("o_custkey k", "o_orderkey atom_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END module")
    return rel.fill_missing(base, table(spark, d, "customer").selectExpr("c_custkey k", "c_mktsegment module"), ["k"], ["module"]).select("atom_id", "module")


@query("snk1_insert_if_absent", """SELECT o_orderkey AS batch_id, 'old' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0""")
def snk1(spark, d):
    o = table(spark, d, "orders")
    return rel.insert_absent(o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey batch_id", "'old' status"), o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey batch_id", "'new' status"), ["batch_id"])


_UPSERT = """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS confidence, o_orderpriority AS module FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS k, -1.0::DOUBLE AS confidence, 'changed' AS module FROM orders WHERE o_orderkey % 3 = 0)"""


def _upsert_sides(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey k", "o_totalprice confidence", "o_orderpriority module"), o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey k", "-1.0D confidence", "'changed' module")


@query("snk3_upsert_results", _UPSERT + " SELECT k, CASE WHEN n.k IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, CASE WHEN o.k IS NOT NULL THEN o.module ELSE n.module END AS module FROM o FULL JOIN n USING (k)")
def snk3(spark, d):
    return rel.upsert(*_upsert_sides(spark, d), ["k"], ["confidence"])


@query("snk4_upsert_decision", _UPSERT + " SELECT k, CASE WHEN n.k IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN 'reviewed' WHEN n.k IS NOT NULL THEN n.module ELSE o.module END AS module FROM o FULL JOIN n USING (k)")
def snk4(spark, d):
    return rel.upsert(*_upsert_sides(spark, d), ["k"], ["confidence"], {"module": F.lit("reviewed")})


@query("snk5_keyed_update", f"WITH {BATCHES} SELECT batch_id, CASE WHEN upload_id % 7 = 0 THEN 'complete' ELSE status END AS status FROM b")
def snk5(spark, d):
    return rel.update_where(batches(spark, d).select("batch_id", "status", "upload_id"), F.col("upload_id") % 7 == 0, {"status": F.lit("complete")}).select("batch_id", "status")


@query("snk9_latest_by_id", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def snk9(spark, d):
    return rel.latest_by(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("snk10_delete_points", "SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def snk10(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return rel.delete_keys(e, e.filter("vec_id % 5 = 0"), ["vec_id"])


@query("snk15_upload_dedup", "SELECT md5(text) AS content_hash, min(doc_id) AS upload_id, count(*) AS copies FROM documents GROUP BY 1")
def snk15(spark, d):
    return vw.first_uploads(table(spark, d, "documents").withColumnRenamed("doc_id", "upload_id"), "upload_id", F.md5(F.col("text").cast("binary")))


@query("src19_pending_migrations", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def src19(spark, d):
    applied = table(spark, d, "lineitem").filter("l_quantity > 40").selectExpr("l_partkey id")
    return vw.pending(table(spark, d, "part").selectExpr("p_partkey id", "p_name name"), applied, "id", "name")


@query("src11_split_kb", "SELECT p_partkey AS id, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 120 THEN 'capabilities' ELSE 'docs' END AS part FROM part")
def src11(spark, d):
    return rel.split_at(table(spark, d, "part").selectExpr("p_partkey id"), "id", 120, "capabilities", "docs")


@query("set6_module_overlap", "SELECT DISTINCT p_brand AS module FROM part WHERE p_partkey <= 120 INTERSECT SELECT p_brand FROM part WHERE p_partkey > 120")
def set6(spark, d):
    p = table(spark, d, "part").selectExpr("p_brand module", "p_partkey")
    return vw.common_values(p.filter("p_partkey <= 120"), p.filter("p_partkey > 120"), "module")


@query("src15_collection_count", "SELECT count(*) AS n FROM embeddings")
def src15(spark, d):
    return vw.collection_size(table(spark, d, "embeddings"))


@query("jon16_compare_batches", f"""WITH {VERDICTS}, a AS (SELECT module, wave, max(classification) AS c, avg(confidence) AS s FROM v WHERE batch_id % 2 = 0 GROUP BY ALL), b AS (SELECT module, wave, max(classification) AS c, avg(confidence) AS s FROM v WHERE batch_id % 2 = 1 AND classification <> 'REVIEW_REQUIRED' GROUP BY ALL)
SELECT module, wave, a.c AS class_a, b.c AS class_b, round(b.s - a.s, 6) AS delta FROM a JOIN b USING (module, wave) WHERE a.c <> b.c""")
def jon16(spark, d):
    v = verdicts(spark, d)
    both = vw.compare_batches(v.filter("batch_id % 2 = 0"), v.filter("batch_id % 2 = 1 AND classification <> 'REVIEW_REQUIRED'"), ["module", "wave"])
    return both.withColumn("delta", F.round("delta", 6))


@query("jon17_append_missing", "SELECT o_orderkey AS id, 'live' AS src FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'stored' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0")
def jon17(spark, d):
    o = table(spark, d, "orders")
    return vw.append_missing(o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey id", "'live' src"), o.filter("o_orderkey % 5 = 0").selectExpr("o_orderkey id", "'stored' src"), "id")


@query("jon18_auto_approved", f"WITH {VERDICTS} SELECT batch_id, count(*) FILTER (f) AS flagged, count(*) FILTER (NOT f) AS auto_approved FROM (SELECT batch_id, atom_id IN (SELECT atom_id FROM v WHERE confidence < 0.6) AS f FROM v) GROUP BY batch_id")
def jon18(spark, d):
    v = verdicts(spark, d)
    held = vw.split_flagged(v, v.filter("confidence < 0.6"), "atom_id")
    return held.groupBy("batch_id").agg(F.count_if("flagged").alias("flagged"), F.count_if(~F.col("flagged")).alias("auto_approved"))


@query("jon22_doc_boost", """WITH c AS (SELECT p_partkey AS id, p_brand AS feature, p_size / 100.0 AS score FROM part), m AS (SELECT p_brand AS feature, count(*) AS n FROM part WHERE p_partkey % 4 = 0 GROUP BY 1)
SELECT id, round(least(1.0, score + 0.05 * coalesce(n, 0)), 6) AS score FROM c LEFT JOIN m USING (feature)""")
def jon22(spark, d):
    p = table(spark, d, "part")
    caps = p.selectExpr("p_partkey id", "p_brand feature", "CAST(p_size AS DOUBLE) / 100.0 score")
    return vw.feature_boost(caps, p.filter("p_partkey % 4 = 0").selectExpr("p_brand feature")).select("id", F.round("score", 6).alias("score"))


@query("flt25_constraint_violations", f"WITH {VERDICTS} SELECT count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS confidence_range, count(*) FILTER (NOT wave >= 2) AS wave_min, count(*) FILTER (NOT length(module) > 0) AS module_set FROM v")
def flt25(spark, d):
    return rel.violations(verdicts(spark, d), confidence_range=F.col("confidence").between(0, 1), wave_min=F.col("wave") >= 2, module_set=F.length("module") > 0)


@query("flt17_search", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def flt17(spark, d):
    return table(spark, d, "part").filter(rel.contains_any(["p_name", "p_type"], "AN")).selectExpr("p_partkey id")


@query("flt18_journeys", f"WITH {VERDICTS} SELECT atom_id FROM v WHERE classification = 'GAP' AND module = 'Brand#1' AND contains(lower(module || ' ' || wave), 'brand')")
def flt18(spark, d):
    v = rel.matching(verdicts(spark, d), classification="GAP", module="Brand#1")
    return v.withColumn("s", F.concat_ws(" ", "module", "wave")).filter(rel.contains_any(["s"], "brand")).select("atom_id")


@query("flt19_pending", f"WITH {VERDICTS} SELECT batch_id, count(*) AS pending FROM v WHERE NOT reviewed AND atom_id % 3 <> 0 GROUP BY 1")
def flt19(spark, d):
    v = verdicts(spark, d)
    return vw.undecided(v, v.filter("atom_id % 3 = 0"), "atom_id").groupBy("batch_id").agg(F.count("*").alias("pending"))


@query("flt21_batches_by_status", f"WITH {BATCHES} SELECT status, count(*) AS n FROM b WHERE status IN ('F', 'O') GROUP BY 1")
def flt21(spark, d):
    return vw.in_status(batches(spark, d), "F", "O").groupBy("status").agg(F.count("*").alias("n"))


@query("flt15_known_overrides", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k') IS NOT NULL")
def flt15(spark, d):
    m = F.from_json("props", "map<string,int>")
    return table(spark, d, "events").withColumn("m", rel.only_known(m, ("k",))).filter(F.size("m") > 0).select("event_id", F.element_at("m", F.lit("k")).alias("k"))


@query("prj5_gate_rows", f"WITH {VERDICTS} SELECT atom_id, classification, coalesce(CASE WHEN wave % 3 = 0 THEN NULL ELSE module END, '') AS top_capability, CASE WHEN wave % 3 = 0 THEN 0.0 ELSE top_score END AS top_score FROM v")
def prj5(spark, d):
    caps = F.when(F.col("wave") % 3 == 0, F.array().cast("array<struct<name:string,score:double>>")).otherwise(F.array(F.struct(F.col("module").alias("name"), F.col("top_score").alias("score"))))
    return vw.gate_rows(verdicts(spark, d), caps).select("atom_id", "classification", "top_capability", "top_score")


@query("prj6_hit_projection", "SELECT doc_id, left(text, 512) AS excerpt, greatest(0.0, least(1.0, n_chars / 5000.0)) AS score FROM documents")
def prj6(spark, d):
    return table(spark, d, "documents").select("doc_id", *vw.hit(F.col("text"), F.col("n_chars").cast("double") / 5000.0))


@query("prj7_atom_journey", f"""WITH {VERDICTS}, h AS (SELECT module, count(*) AS priors FROM v WHERE classification = 'FIT' AND wave = 1 GROUP BY 1)
SELECT o_orderkey AS atom_id, coalesce(x.n, 0) AS n_results, coalesce(x.best, '') AS best_class, coalesce(x.priors, 0)::BIGINT AS priors FROM orders LEFT JOIN (SELECT atom_id // 8 AS k, count(*) AS n, max(classification) AS best, sum(priors) AS priors FROM v LEFT JOIN h USING (module) GROUP BY 1) x ON k = o_orderkey""")
def prj7(spark, d):
    v = verdicts(spark, d)
    priors = v.filter("classification = 'FIT' AND wave = 1").groupBy("module").agg(F.count("*").alias("priors"))
    atoms = table(spark, d, "orders").selectExpr("o_orderkey atom")
    return vw.journeys(atoms, v.withColumn("atom", F.expr("atom_id div 8")), priors, "atom").withColumnRenamed("atom", "atom_id")


@query("prj8_tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (props->>'k')::INT END AS k FROM events")
def prj8(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", tolerant_json(raw, "k int")["k"].alias("k"))


@query("prj12_vector_literal", "SELECT vec_id, len(embedding) AS n, '[' || array_to_string([round(x::DOUBLE * 1000)::BIGINT FOR x IN embedding], ',') || ']' AS literal FROM embeddings")
def prj12(spark, d):
    from sparkloom.functions.text import vector_literal

    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), vector_literal(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))).alias("literal"))


@query("prj13_template_line", f"WITH {VERDICTS} SELECT atom_id, format('{{}} — {{}} ({{}}%)', module, classification, round_even(confidence * 100, 0)::INT) AS line FROM v")
def prj13(spark, d):
    return verdicts(spark, d).select("atom_id", vw.template_line(F.col("module"), F.col("classification"), F.col("confidence")).alias("line"))


@query("prj15_flatten_interrupts", f"WITH {VERDICTS} SELECT batch_id, count(DISTINCT module) AS modules, max(atom_id) AS last_atom FROM v WHERE classification = 'GAP' GROUP BY 1")
def prj15(spark, d):
    return vw.open_interrupts(verdicts(spark, d).filter("classification = 'GAP'"))


@query("prj18_payload_id", "SELECT event_id, coalesce(props->>'_id', event_id::VARCHAR) AS id, len(map_keys(map_from_entries(CASE WHEN props->>'k' IS NULL THEN [] ELSE [('k', 1)] END))) AS rest FROM events")
def prj18(spark, d):
    name, rest = vw.payload_id(F.from_json("props", "map<string,string>"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", name.alias("id"), F.size(rest).cast("long").alias("rest"))


@query("dtj9_gate_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN (o_orderkey % 6)::INT END AS gate FROM orders")
def dtj9(spark, d):
    name = F.when(F.col("o_orderkey") % 6 == 5, F.lit("review")).otherwise(F.concat(F.lit("gate_"), (F.col("o_orderkey") % 6).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", va.gate_number(name).alias("gate"))


@query("dtj8_override", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 0 THEN o_orderpriority END AS classification FROM orders")
def dtj8(spark, d):
    decision = F.when(F.col("o_orderstatus") == "O", "OVERRIDE").otherwise("APPROVE")
    over = va.override(decision, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", over["classification"].alias("classification"))


@query("dtj1_timestamps", "SELECT event_id, floor(epoch(ts))::BIGINT AS epoch, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def dtj1(spark, d):
    return table(spark, d, "events").select("event_id", va.epoch(F.col("ts")).alias("epoch"), va.iso(F.col("ts")).alias("iso"))


@query("dtj5_content_hash", "SELECT doc_id, left(sha256(text), 16) AS element_id, left(sha256(source || text), 24) AS chunk_id FROM documents")
def dtj5(spark, d):
    return table(spark, d, "documents").select("doc_id", va.content_id(F.col("text")).alias("element_id"), va.content_id(F.col("source"), F.col("text"), length=24).alias("chunk_id"))


@query("dtj6_uuid5", r"""WITH h AS (SELECT doc_id, sha1('\x6B\xA7\xB8\x11\x9D\xAD\x11\xD1\x80\xB4\x00\xC0\x4F\xD4\x30\xC8'::BLOB || encode(doc_id::VARCHAR)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%x', (('0x' || h[17])::INT & 3) | 8) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def dtj6(spark, d):
    import uuid

    from sparkloom.functions.text import uuid5

    return table(spark, d, "documents").select("doc_id", uuid5(uuid.NAMESPACE_URL.bytes, F.col("doc_id").cast("string")).alias("point_id"))


@query("mth13_progress_percent", "SELECT conv_id, round_even(100.0 * count(*) FILTER (role = 'user') / count(*), 0)::INT AS pct FROM conversations GROUP BY 1")
def mth13(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(scores.percent(F.count_if(F.col("role") == "user"), F.count("*")).alias("pct"))


@query("set2_clean_then_resolved", f"WITH {VERDICTS} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY flagged, atom_id) AS pos, atom_id FROM (SELECT batch_id, atom_id, (confidence < 0.6)::INT AS flagged FROM v)")
def set2(spark, d):
    v = verdicts(spark, d)
    both = rel.one_after_other([v.filter("confidence >= 0.6"), v.filter("confidence < 0.6")], ["batch_id"], "atom_id")
    return both.select("batch_id", F.col("pos").cast("long").alias("pos"), "atom_id")


@query("srt11_index_newest_first", f"WITH {BATCHES} SELECT batch_id, floor(epoch(created_at))::BIGINT AS at FROM b ORDER BY created_at DESC, batch_id LIMIT 50")
def srt11(spark, d):
    return vw.newest(batches(spark, d), "created_at", "batch_id", 50).select("batch_id", va.epoch(F.col("created_at")).alias("at"))


def _keyed(spark, name, schema, key, rows):
    """A new keyed table in the shared folder, with a bucket for each 500,000 rows, about."""
    return KeyedTable.create(spark, f"{shared_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}", StructType.fromDDL(schema), [key], 8 + rows // 500_000)


@query("snk3_table_merges", _UPSERT + """, m AS (SELECT k, CASE WHEN n.k IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, CASE WHEN o.k IS NOT NULL THEN o.module ELSE n.module END AS module FROM o FULL JOIN n USING (k))
SELECT k, confidence, CASE WHEN k % 7 = 0 THEN 'seen' ELSE module END AS module FROM m WHERE k % 11 <> 0 UNION ALL SELECT o_orderkey, o_totalprice, 'late' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0""")
def snk3_table(spark, d):
    """Insert, upsert, keyed update, delete and insert-if-absent, each a commit of one lasting table."""
    old, new = _upsert_sides(spark, d)
    t = _keyed(spark, "results", "k long, confidence double, module string", "k", old.count())
    t.merge(old, [])
    t.merge(new, ["confidence"])
    t.update_where(F.col("k") % 7 == 0, {"module": F.lit("seen")})
    t.delete(t.read().filter("k % 11 = 0").select("k"))
    t.insert_absent(table(spark, d, "orders").filter("o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0").selectExpr("o_orderkey k", "o_totalprice confidence", "'late' module"))
    return t.read()


@query("snk9_table_points", """WITH t AS (SELECT *, CASE WHEN event_id < (SELECT (count(*) + 2) // 3 FROM events) THEN 1 ELSE 2 END AS part FROM events)
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, CASE WHEN max(part) = 1 THEN 'v1' ELSE 'v2' END AS kind FROM t GROUP BY 1""")
def snk9_table(spark, d):
    """Points upserted by id in three runs; a column is added once, between the first and the second, and older rows have its fill."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    n = e.count()
    first, second = (n + 2) // 3, (n + 2) // 3 + (n + 1) // 3
    t = _keyed(spark, "points", "user_id long, event_id long, event_type string", "user_id", n)
    t.merge(e.filter(F.col("event_id") < first), ["event_id", "event_type"])
    for _ in range(2):
        t.migrate("V2", "kind string", {"kind": "v1"})
    later = e.withColumn("kind", F.lit("v2"))
    t.merge(later.filter((F.col("event_id") >= first) & (F.col("event_id") < second)), ["event_id", "event_type", "kind"])
    t.merge(later.filter(F.col("event_id") >= second), ["event_id", "event_type", "kind"])
    return t.read()


@query("snk13_state_with_expiry", """WITH n AS (SELECT max(floor(epoch(ts))) AS now FROM events) SELECT user_id AS batch_id, event_type AS field, arg_max(value, ts) AS value FROM events, n WHERE now - floor(epoch(ts)) < 86400 GROUP BY 1, 2""")
def snk13_state(spark, d):
    """States put in two runs, and read a day before the last event expires: the last value of each field that is younger."""
    e = table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    folder = f"{shared_folder(spark)}/sparkloom/state-{uuid.uuid4().hex}"
    for part in (0, 1):
        files.put_state(e.filter(F.col("event_id") % 2 == part).drop("event_id"), folder)
    now = e.agg(F.max("at")).first()[0]
    return files.get_state(spark, folder, F.lit(now)).select("batch_id", "field", F.col("value").cast("double").alias("value"))


@query("src17_read_report", f"WITH {VERDICTS} SELECT atom_id::VARCHAR AS req_id, module FROM v WHERE classification = 'GAP'")
def src17_report(spark, d):
    """Reports written as CSV files, and one of them read back."""
    folder = f"{shared_folder(spark)}/sparkloom/reports-{uuid.uuid4().hex}"
    rv.report_rows(verdicts(spark, d)).write.option("header", True).partitionBy("report").csv(folder)
    return files.read_reports(spark, folder, "gaps").select("req_id", "module")


@query("snk11_seeded_collection", "SELECT p_type AS id, max(p_partkey) AS v FROM part GROUP BY 1")
def snk11_seed(spark, d):
    """The last row of each id, written, counted and read back."""
    folder = f"{shared_folder(spark)}/sparkloom/collection-{uuid.uuid4().hex}"
    files.seed(table(spark, d, "part").selectExpr("p_type id", "p_partkey v"), folder)
    return spark.read.parquet(folder).select("id", "v")
