"""Progress state, replay and status over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.functions import values as va
from sparkloom.plans.base import query, table
from sparkloom.storage import shared_folder
from sparkloom.streaming import live
from sparkloom.streaming import progress as pr

_KIND = "CASE event_id % 7 WHEN 0 THEN 'phase_start' WHEN 1 THEN 'step_progress' WHEN 2 THEN 'phase_complete' WHEN 3 THEN 'classification' WHEN 4 THEN 'classification' WHEN 5 THEN 'step_progress' ELSE CASE WHEN event_id % 49 = 6 THEN 'complete' ELSE 'phase_start' END END"
EVENTS = f"""e AS (SELECT event_id AS seq, ts, {_KIND} AS event, user_id AS batch_id, (event_id % 5 + 1)::INT AS phase, event_type AS step, (floor(value)::BIGINT % 11)::INT AS completed, 10 AS total, event_id % 40 AS atom_id, event_type AS classification, (event_id % 100)::INT AS atoms_produced, value AS latency_ms FROM events)"""


def events(spark, d):
    return _as_events(table(spark, d, "events"))


def _as_events(raw):
    return raw.selectExpr("event_id seq", "CAST(ts AS timestamp) ts", f"{_KIND} event", "user_id batch_id", "CAST(event_id % 5 + 1 AS INT) phase", "event_type step", "CAST(CAST(floor(value) AS BIGINT) % 11 AS INT) completed", "10 total", "event_id % 40 atom_id", "event_type classification", "CAST(event_id % 100 AS INT) atoms_produced", "value latency_ms")


_STATES = """s AS (SELECT batch_id, phase, arg_max(struct_pack(status := CASE WHEN event = 'phase_complete' THEN 'complete' ELSE 'in_progress' END, pct := CASE event WHEN 'phase_start' THEN 0 WHEN 'phase_complete' THEN 100 ELSE round_even(completed * 100.0 / total, 0)::INT END,
 step := CASE WHEN event = 'step_progress' THEN step END, produced := CASE WHEN event = 'phase_complete' THEN atoms_produced ELSE 0 END), seq) AS x FROM e WHERE event IN ('phase_start', 'step_progress', 'phase_complete') GROUP BY 1, 2)"""


@query("str2_phase_states", f"WITH {EVENTS}, {_STATES} SELECT batch_id, phase, x.status AS status, x.pct AS pct, x.step AS step, x.produced AS atoms_produced FROM s")
def str2(spark, d):
    return pr.phase_states(events(spark, d)).select("batch_id", "phase", "status", "pct", "step", "atoms_produced")


@query("str3_first_classifications", f"WITH {EVENTS} SELECT batch_id, atom_id, arg_min(classification, seq) AS classification FROM e WHERE event = 'classification' GROUP BY 1, 2")
def str3(spark, d):
    return pr.first_classifications(events(spark, d))


@query("str4_until_terminal", f"WITH {EVENTS}, t AS (SELECT batch_id, min(seq) AS stop FROM e WHERE event = 'complete' GROUP BY 1) SELECT batch_id, count(*) AS n FROM e LEFT JOIN t USING (batch_id) WHERE stop IS NULL OR seq <= stop GROUP BY 1")
def str4(spark, d):
    return pr.until_terminal(events(spark, d)).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("str5_replay", f"""WITH {EVENTS}, {_STATES}, c AS (SELECT batch_id, atom_id, arg_min(classification, seq) AS k FROM e WHERE event = 'classification' GROUP BY 1, 2)
SELECT batch_id, 0 AS part, phase::BIGINT AS pos, 'phase:' || phase || ':' || x.status AS what FROM s UNION ALL SELECT batch_id, 1, atom_id, 'atom:' || atom_id || ':' || k FROM c UNION ALL SELECT DISTINCT batch_id, 2, 0, 'complete' FROM e WHERE event = 'complete'""")
def str5(spark, d):
    return pr.replay(events(spark, d))


@query("str6_repaired_states", f"WITH {EVENTS}, {_STATES} SELECT batch_id, phase, CASE WHEN phase < max(phase) OVER (PARTITION BY batch_id) THEN 'complete' ELSE x.status END AS status, CASE WHEN phase < max(phase) OVER (PARTITION BY batch_id) THEN 100 ELSE x.pct END AS pct FROM s")
def str6(spark, d):
    return pr.repaired(pr.phase_states(events(spark, d))).select("batch_id", "phase", "status", "pct")


@query("str7_progress_view", f"WITH {EVENTS}, {_STATES}, p AS (SELECT * FROM (SELECT DISTINCT batch_id FROM s), range(1, 6) r(phase)) SELECT p.batch_id, p.phase::INT AS phase, coalesce(x.status, 'pending') AS status, coalesce(x.pct, 0) AS pct FROM p LEFT JOIN s q ON q.batch_id = p.batch_id AND q.phase = p.phase")
def str7(spark, d):
    return pr.progress_view(pr.phase_states(events(spark, d)))


@query("str8_live_states", "SELECT user_id AS batch_id, max(ts) AS last FROM events GROUP BY 1 HAVING epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) < 86400")
def str8(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("batch_id")).agg(F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))
    held = last.join(F.broadcast(now)).withColumn("t", F.col("last").cast("timestamp"))  # now has one row
    return pr.alive(held, "t", F.col("now").cast("timestamp")).select("batch_id", "last")


@query("str9_illegal_steps", """WITH x AS (SELECT user_id AS batch_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'gate_1' ELSE 'complete' END AS status FROM events), y AS (SELECT *, lag(status) OVER (PARTITION BY batch_id ORDER BY seq) AS before FROM x)
SELECT batch_id, seq, before, status FROM y WHERE before IS NOT NULL AND NOT coalesce((before = 'queued' AND status IN ('processing', 'error')) OR (before = 'processing' AND status IN ('gate_1', 'complete', 'error')) OR (before = 'gate_1' AND status IN ('gate_2', 'error')), false)""")
def str9(spark, d):
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t == "view", "processing").when(t == "purchase", "gate_1").otherwise("complete")
    return pr.illegal_steps(table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("seq"), status.alias("status"))).select("batch_id", "seq", "before", "status")


@query("agg29_phases_complete", f"WITH {EVENTS}, {_STATES} SELECT batch_id, count(*) FILTER (x.status = 'complete') AS phases_complete, sum(x.produced)::BIGINT AS atoms FROM s GROUP BY 1")
def agg29(spark, d):
    return pr.phase_states(events(spark, d)).groupBy("batch_id").agg(F.count_if(F.col("status") == "complete").alias("phases_complete"), F.sum("atoms_produced").alias("atoms"))


@query("agg30_phase_latency", f"WITH {EVENTS} SELECT batch_id, phase, floor(arg_max(latency_ms, seq) / 1000 + 0.5)::BIGINT AS seconds FROM e WHERE event IN ('phase_start', 'step_progress', 'phase_complete') GROUP BY 1, 2 HAVING arg_max(event, seq) = 'phase_complete'")
def agg30(spark, d):
    return pr.phase_states(events(spark, d)).filter("status = 'complete'").select("batch_id", "phase", F.floor(F.col("latency_ms") / 1000 + 0.5).alias("seconds"))


@query("dtj3_event_decode", "SELECT event_id AS seq, event_type AS event FROM events WHERE event_id % 5 <> 0")
def dtj3(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.when(F.col("event_id") % 5 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("event")))).alias("value"))
    return pr.decode(raw, "seq long, event string")


@query("dtj4_map_update", "SELECT event_id, ((props->>'k')::BIGINT + 1) AS k FROM events WHERE (props->>'k') IS NOT NULL")
def dtj4(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").filter(F.element_at(m, F.lit("k")).isNotNull()).select("event_id", F.element_at(va.counted_up(m, "k"), F.lit("k")).alias("k"))


_LIVE = """g AS (SELECT *, epoch_ms(ts) AS ms, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w >= 86400000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY batch_id ORDER BY epoch_ms(ts), seq)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY batch_id ORDER BY ms, seq) AS part, max(ms) OVER (PARTITION BY batch_id) AS last FROM g),
x AS (SELECT * FROM n WHERE part = (SELECT max(part) FROM n m WHERE m.batch_id = n.batch_id) AND (SELECT max(ms) FROM g) - 3600000 - last < 86400000)"""


@query("str10_live_state", f"""WITH {EVENTS}, {_LIVE}, p AS (SELECT batch_id, phase, max(seq) AS seq, arg_max(event, seq) AS event, arg_max(completed, seq) AS completed, arg_max(step, seq) AS step, arg_max(atoms_produced, seq) AS made, arg_max(latency_ms, seq) AS ms FROM x WHERE event IN ('phase_start', 'step_progress', 'phase_complete') GROUP BY 1, 2)
SELECT batch_id, 'phase' AS kind, phase::BIGINT AS pos, seq, CASE WHEN event = 'phase_complete' THEN 'complete' ELSE 'in_progress' END AS status, CASE event WHEN 'phase_start' THEN 0 WHEN 'phase_complete' THEN 100 ELSE completed * 10 END::INT AS pct, CASE WHEN event = 'step_progress' THEN step END AS step, CASE WHEN event = 'phase_complete' THEN made ELSE 0 END AS atoms_produced, CASE WHEN event = 'phase_complete' THEN ms END AS latency_ms FROM p
UNION ALL SELECT batch_id, 'atom', atom_id, min(seq), arg_min(classification, seq), NULL, NULL, NULL, NULL FROM x WHERE event = 'classification' GROUP BY 1, 3
UNION ALL SELECT batch_id, 'end', 0, min(seq), arg_min(event, seq), NULL, NULL, NULL, NULL FROM x WHERE event = 'complete' GROUP BY 1""")
def str10(spark, d):
    """The stream over the whole table of events: what its keyed state holds at the end, a day of silence having dropped batches by their timers."""
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    folder = f"{shared_folder(spark)}/sparkloom/live-{uuid.uuid4().hex}"
    live.run(live.changes(_as_events(raw)), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return live.snapshot(spark.read.schema(live.LOG).parquet(f"{folder}/log"))
