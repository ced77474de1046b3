"""Progress events folded into state: a batch form, and the same over a stream of files.

Events: seq, ts, event (phase_start, step_progress, phase_complete, classification, or a terminal one), batch_id, phase, step,
completed, total, atom_id, classification, atoms_produced, atoms_validated, atoms_flagged, latency_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scores import percent

PHASES = 5
TERMINAL = ("complete", "error", "review_required", "gate")
SCHEMA = "seq long, ts timestamp, event string, batch_id long, phase int, step string, completed int, total int, atom_id long, classification string, atoms_produced int, latency_ms double"
#: Steps from one status to the next.
NEXT = {"queued": ("processing", "error"), "processing": ("gate_1", "complete", "error"), "gate_1": ("gate_2", "error"), "gate_2": ("gate_3", "error"), "gate_3": ("gate_4", "error"), "gate_4": ("review_required", "complete", "error"), "review_required": ("complete", "error")}


def decode(raw: DataFrame, schema: str = SCHEMA, column: str = "value") -> DataFrame:
    """JSON messages as events; what can't be read is left out (DTJ3)."""
    return raw.select(F.from_json(column, schema).alias("e")).filter(F.col("e.event").isNotNull()).select("e.*")


def until_terminal(events: DataFrame) -> DataFrame:
    """Events of each batch up to its first terminal one (STR4)."""
    stop = F.min(F.when(F.col("event").isin(*TERMINAL), F.col("seq"))).over(Window.partitionBy("batch_id"))
    return events.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col("seq") <= F.col("__stop"))).drop("__stop")


def phase_states(events: DataFrame) -> DataFrame:
    """Last state of each phase: start resets, a step sets pct and step, complete sets all (STR2)."""
    at = events.filter(F.col("event").isin("phase_start", "step_progress", "phase_complete"))
    pct = F.when(F.col("event") == "phase_start", 0).when(F.col("event") == "phase_complete", 100).otherwise(percent(F.col("completed"), F.col("total")))
    status = F.when(F.col("event") == "phase_complete", "complete").otherwise("in_progress")
    state = F.struct(status.alias("status"), pct.alias("pct"), F.when(F.col("event") == "step_progress", F.col("step")).alias("step"), F.when(F.col("event") == "phase_complete", F.col("atoms_produced")).otherwise(0).alias("atoms_produced"), F.when(F.col("event") == "phase_complete", F.col("latency_ms")).alias("latency_ms"))
    return at.groupBy("batch_id", "phase").agg(F.max_by(state, "seq").alias("s")).select("batch_id", "phase", "s.*")


def repaired(states: DataFrame) -> DataFrame:
    """A phase that came later forces the earlier ones complete (STR6)."""
    top = F.max("phase").over(Window.partitionBy("batch_id"))
    late = F.col("phase") < top
    return states.withColumn("status", F.when(late, "complete").otherwise(F.col("status"))).withColumn("pct", F.when(late, 100).otherwise(F.col("pct")))


def progress_view(states: DataFrame) -> DataFrame:
    """Always five rows for a batch, with defaults (STR7)."""
    every = states.select("batch_id").distinct().withColumn("phase", F.explode(F.sequence(F.lit(1), F.lit(PHASES))))
    return every.join(states, ["batch_id", "phase"], "left").select("batch_id", "phase", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("pct", F.lit(0)).alias("pct"))


def first_classifications(events: DataFrame) -> DataFrame:
    """The first classification of each atom (STR3)."""
    c = events.filter(F.col("event") == "classification")
    return c.groupBy("batch_id", "atom_id").agg(F.min_by("classification", "seq").alias("classification"))


def replay(events: DataFrame) -> DataFrame:
    """What a late subscriber is sent: phases in order, then classifications, then the terminal event (STR5)."""
    phases = phase_states(events).select("batch_id", F.lit(0).alias("part"), F.col("phase").cast("long").alias("pos"), F.concat_ws(":", F.lit("phase"), "phase", "status").alias("what"))
    cls = first_classifications(events).select("batch_id", F.lit(1).alias("part"), F.col("atom_id").alias("pos"), F.concat_ws(":", F.lit("atom"), "atom_id", "classification").alias("what"))
    end = events.filter(F.col("event").isin(*TERMINAL)).groupBy("batch_id").agg(F.min(F.struct("seq", "event")).alias("e")).select("batch_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("e.event").alias("what"))
    return phases.unionByName(cls).unionByName(end)


def alive(states: DataFrame, at: str, now, ttl_s: int = 86_400) -> DataFrame:
    """States younger than the time to live (STR8, SNK13)."""
    return states.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(at)) < ttl_s)


def illegal_steps(statuses: DataFrame) -> DataFrame:
    """statuses: batch_id, seq, status. Rows whose status can't follow the one before (STR9)."""
    before = F.lag("status").over(Window.partitionBy("batch_id").orderBy("seq"))
    ok = F.col("before").isNull()
    for a, to in NEXT.items():
        ok = ok | ((F.col("before") == a) & F.col("status").isin(*to))
    return statuses.withColumn("before", before).filter(~ok)


def fold_stream(events: DataFrame, checkpoint: str, table: str):
    """A streaming query that keeps the phase states of `phase_states` in a memory table, updated per trigger.

    Needs no custom state: the fold is the state of the last event, so a streaming max_by holds it.
    """
    return phase_states(events).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(events: DataFrame, path: str, checkpoint: str):
    """Append events as JSON files, the channel of this engine (STR1)."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
