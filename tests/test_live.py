"""The live state of batches: equal to the batch form on shuffled, late and repeated events, over restarts, with expiry and subscribers."""

import random

from pyspark.sql import functions as F

from sparkloom.streaming import live, progress

EVENTS = progress.SCHEMA + ", subscriber string"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
T0 = 1_700_000_000


def event(seq, second, kind, batch=1, **more):
    from datetime import datetime, timezone

    row = dict.fromkeys(NAMES) | {"seq": seq, "ts": datetime.fromtimestamp(T0 + second, timezone.utc), "event": kind, "batch_id": batch} | more
    return tuple(row[c] for c in NAMES)


def story(seed, batches=6, n=60):
    rng, out, seq = random.Random(seed), [], 0
    for b in range(batches):
        for k in range(n):
            seq += 1
            kind = rng.choice(["phase_start", "step_progress", "phase_complete", "classification", "classification", "complete" if k > 50 else "step_progress"])
            out.append(event(seq, 10 * k + rng.randrange(10), kind, b, phase=rng.randrange(1, 6), step="s", completed=rng.randrange(11), total=rng.choice([0, 10]), atom_id=rng.randrange(8), classification=rng.choice("ABC"), atoms_produced=rng.randrange(9), latency_ms=1.5 * rng.randrange(9)))
    return out


class Feed:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.dir, self.n, self.options = spark, tmp_path, 0, options

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{self.dir}/in/{self.n:03}")

    def go(self):
        stream = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.dir}/in/*")
        query = live.run(live.changes(stream, **self.options), f"{self.dir}/log", f"{self.dir}/checkpoint")
        query.awaitTermination()
        return self.spark.read.schema(live.LOG).parquet(f"{self.dir}/log")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def batch_form(spark, events):
    """phases, atoms and ends of a table of events."""
    e = spark.createDataFrame(events, EVENTS)
    p = progress.phase_states(e).join(e.filter(F.col("event").isin(*live.PHASE_EVENTS)).groupBy("batch_id", "phase").agg(F.max("seq").alias("seq")), ["batch_id", "phase"])
    phases = p.select("batch_id", F.lit("phase"), F.col("phase").cast("long"), "seq", "status", "pct", "step", "atoms_produced", "latency_ms")
    return rows(phases), rows(progress.first_classifications(e)), rows(e.filter(F.col("event").isin(*progress.TERMINAL)).groupBy("batch_id").agg(F.min_by("event", "seq")))


def stream_form(state):
    columns = [f.strip().split()[0] for f in live.PHASE.split(",")]
    return rows(state.filter("kind = 'phase'").select("batch_id", "kind", "pos", *columns)), rows(state.filter("kind = 'atom'").select("batch_id", "pos", "status")), rows(state.filter("kind = 'end'").select("batch_id", "status"))


def test_shuffled_repeated_and_restarted_streams_give_the_batch_form(spark, tmp_path):
    events = story(1)
    rng = random.Random(2)
    mixed = rng.sample(events, len(events)) + rng.sample(events, 90)
    feed = Feed(spark, tmp_path)
    for at in range(0, 300, 100):
        feed.add(mixed[at : at + 100])
    first = live.snapshot(feed.go())
    assert stream_form(first) == batch_form(spark, mixed[:300])
    feed.add(mixed[300:])
    log = feed.go()  # a new query, from the checkpoint
    assert stream_form(live.snapshot(log)) == batch_form(spark, events)
    assert log.groupBy("batch_id", "version").count().filter("count > 1").isEmpty()


def test_a_late_subscriber_is_told_what_is_known_and_then_events_until_the_end(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([event(1, 0, "phase_start", phase=1), event(2, 1, "classification", atom_id=7, classification="FIT"), event(3, 2, "phase_complete", phase=1, atoms_produced=3, latency_ms=2.0)])
    feed.add([event(4, 3, "subscribe", subscriber="late"), event(5, 4, "phase_start", phase=2), event(6, 5, "classification", atom_id=7, classification="GAP")])
    feed.add([event(9, 8, "phase_start", phase=3), event(8, 7, "complete"), event(7, 6, "step_progress", phase=2, completed=1, total=2, step="x")])
    feed.add([event(10, 9, "phase_start", phase=4), event(11, 10, "subscribe", subscriber="after")])
    log = feed.go()
    told = [(r.kind, r.pos, r.status) for r in live.sent(log, "late").orderBy("version").collect()]
    assert told == [("phase", 1, "complete"), ("atom", 7, "FIT"), ("event", 5, "phase_start"), ("event", 6, "classification"), ("event", 7, "step_progress"), ("event", 8, "complete")]
    told = [(r.kind, r.pos, r.status) for r in live.sent(log, "after").orderBy("version").collect()]
    assert told == [("phase", 1, "complete"), ("phase", 2, "in_progress"), ("phase", 3, "in_progress"), ("phase", 4, "in_progress"), ("atom", 7, "FIT"), ("end", 0, "complete")]


def test_silent_batches_expire_by_their_timers(spark, tmp_path):
    feed = Feed(spark, tmp_path, ttl_s=100, delay="10 seconds")
    feed.add([event(1, 0, "phase_start", 1, phase=1), event(2, 0, "phase_start", 2, phase=1), event(3, 0, "subscribe", 2, subscriber="s")])
    feed.add([event(4, 90, "phase_start", 1, phase=2)])
    feed.add([event(5, 150, "phase_start", 3, phase=5)])
    log = feed.go()
    assert [(r.batch_id, r.kind) for r in log.filter("kind = 'expired'").collect()] == [(2, "expired")]
    assert {(r.batch_id, r.pos) for r in live.snapshot(log).collect()} == {(1, 1), (1, 2), (3, 5)}
    feed.add([event(6, 160, "phase_start", 2, phase=4), event(7, 195, "phase_start", 1, phase=3)])  # batch 2 begins anew; batch 1 was silent for too long
    log = feed.go()
    assert {(r.batch_id, r.pos) for r in live.snapshot(log).collect()} == {(1, 3), (2, 4), (3, 5)}
    assert live.sent(log, "s").filter("kind = 'event'").isEmpty()


def test_batch_form_of_expiry(spark):
    events = [event(1, 0, "phase_start", 1, phase=1), event(2, 99, "phase_start", 1, phase=2), event(3, 199, "phase_start", 1, phase=3), event(4, 50, "phase_start", 2, phase=1)]
    left = live.sessions(spark.createDataFrame(events, EVENTS), 100, (T0 + 210) * 1000)
    assert [(r.batch_id, r.seq) for r in left.collect()] == [(1, 3)]


def test_odd_rows_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([event(None, 0, "complete"), event(1, 0, "complete", None), event(2, 0, None), event(3, 0, "no such event"), event(4, 0, "phase_start"), event(5, 0, "classification")])
    log = feed.go()
    assert log.count() == 0
