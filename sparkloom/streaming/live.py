"""Live state of batches, kept by a stream: folded events, subscribers, expiry by timers.

One keyed state for each batch: a map of phases (the event of largest seq counts), a map of atoms (the first classification counts), the first
terminal event, the subscribers, and the time of the last event. Each of these is a least or a greatest, so order and
repeats of events change nothing, and state after a restart goes on from the checkpoint.

The stream writes a log of changes. A row belongs to the state (`to` is null) or was sent to a subscriber. `version` counts up
within a batch (a state that begins takes its first event's time, so one that begins anew goes on above what expired); a row of kind `expired` ends all before it. `snapshot` gives the state that holds after the last row.

A batch whose last event is `ttl` old, by the watermark or by the next event of its own, is dropped by its timer (STR8, SNK13). A subscriber is a row with event `subscribe`: it is
sent what is known (phases in order, atoms, the end), then every event in order until a terminal one (STR4, STR5). Events that
come later than the watermark's delay after newer ones are not taken up, as usual for streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sparkloom.streaming.progress import TERMINAL

DAY_S = 86_400
PHASE = "seq long, status string, pct int, step string, atoms_produced int, latency_ms double"
LOG = f"batch_id long, version long, to string, kind string, pos long, {PHASE}"
COLUMNS = [c.split()[0] for c in LOG.split(", ")]
PHASE_EVENTS = ("phase_start", "step_progress", "phase_complete")


def _phase(e) -> tuple:
    """What a phase is after its event: the same as `progress.phase_states`."""
    if e.event == "phase_start":
        return int(e.seq), "in_progress", 0, None, 0, None
    if e.event == "phase_complete":
        return int(e.seq), "complete", 100, None, _none(e.atoms_produced, int), _none(e.latency_ms, float)
    return int(e.seq), "in_progress", int(round(100 * e.completed / e.total)) if e.total and e.total > 0 else 0, e.step, 0, None


def _none(x, kind):
    return None if pd.isna(x) else kind(x)


class BatchState(StatefulProcessor):
    """The state of one batch; `ttl_s` seconds without an event end it."""

    def __init__(self, ttl_s: int = DAY_S):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.phases = handle.getMapState("phases", "phase int", PHASE)
        self.atoms = handle.getMapState("atoms", "atom_id long", "seq long, classification string")
        self.end = handle.getValueState("end", "seq long, event string")
        self.subscribers = handle.getMapState("subscribers", "name string", "since long")
        self.clock = handle.getValueState("clock", "last_ms long, version long")

    def close(self) -> None:
        pass

    def _clear(self) -> None:
        for state in (self.phases, self.atoms, self.end, self.subscribers):
            state.clear()

    def _known(self) -> list[tuple]:
        """kind, pos, and the columns of PHASE: phases in order, atoms in order, the end."""
        out = [("phase", k[0], *v) for k, v in sorted(self.phases.iterator())]
        out += [("atom", k[0], v[0], v[1], None, None, None, None) for k, v in sorted(self.atoms.iterator())]
        if self.end.exists():
            seq, event = self.end.get()
            out.append(("end", 0, seq, event, None, None, None, None))
        return out

    def _fold(self, run: list) -> Iterator[tuple]:
        """Takes up events and gives what they changed. State is asked once for each phase and atom of the run."""
        phases, atoms, end = {}, {}, None
        for e in run:
            if e.event in PHASE_EVENTS and not pd.isna(e.phase) and (e.phase not in phases or e.seq > phases[e.phase].seq):
                phases[e.phase] = e
            elif e.event == "classification" and not pd.isna(e.atom_id) and (e.atom_id not in atoms or e.seq < atoms[e.atom_id].seq):
                atoms[e.atom_id] = e
            elif e.event in TERMINAL and (end is None or e.seq < end.seq):
                end = e
        for k, e in sorted(phases.items()):
            key, now = (int(k),), _phase(e)
            if not self.phases.containsKey(key) or self.phases.getValue(key)[0] < now[0]:
                self.phases.updateValue(key, now)
                yield ("phase", int(k), *now)
        for k, e in sorted(atoms.items()):
            key, now = (int(k),), (int(e.seq), e.classification)
            if not self.atoms.containsKey(key) or self.atoms.getValue(key)[0] > now[0]:
                self.atoms.updateValue(key, now)
                yield ("atom", int(k), *now, None, None, None, None)
        if end is not None and (not self.end.exists() or self.end.get()[0] > end.seq):
            self.end.update((int(end.seq), end.event))
            yield ("end", 0, int(end.seq), end.event, None, None, None, None)

    def _send(self, run: list) -> Iterator[tuple]:
        """The events of the run for each subscriber that waits, up to a terminal one, which ends the subscription."""
        names = [k[0] for k, _ in self.subscribers.iterator()]
        sent = []
        for e in run:
            sent.append(("event", int(e.seq), int(e.seq), e.event, None, None, None, None))
            if e.event in TERMINAL:
                break
        for name in sorted(names):
            yield from ((name, *row) for row in sent)
            if run and sent[-1][3] in TERMINAL:
                self.subscribers.removeKey((name,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, out = key[0], []
        last, version = self.clock.get() if self.clock.exists() else (None, None)

        def add(to, *row):
            nonlocal version
            version += 1
            out.append((batch, version, to, *row))

        def settle(run):
            if run:
                changes, news = list(self._fold(run)), list(self._send(run))
                for row in changes:
                    add(None, *row)
                for row in news:
                    add(*row)
                run.clear()

        table = pd.concat(rows, ignore_index=True)
        table = table.sort_values(["ms", "seq"], kind="stable").drop_duplicates(["seq", "event", "subscriber"])
        run: list = []
        for e in table.itertuples(index=False):
            version = int(e.ms) << 20 if version is None else version
            if last is not None and e.ms - last >= self.ttl_ms:  # its timer, had the watermark come by
                settle(run)
                self._clear()
                add(None, "expired", 0, *[None] * 6)
            last = e.ms if last is None else max(last, e.ms)
            if e.event == "subscribe":
                settle(run)
                for row in self._known():
                    add(e.subscriber, *row)
                if not self.end.exists():
                    self.subscribers.updateValue((e.subscriber,), (int(e.ms),))
            else:
                run.append(e)
        settle(run)
        self.clock.update((int(last), version))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last) + self.ttl_ms)
        yield _log(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, version = self.clock.get()
        if expiredTimerInfo.getExpiryTimeInMs() - last >= self.ttl_ms:
            self._clear()
            self.clock.clear()
            yield _log([(key[0], version + 1, None, "expired", 0, *[None] * 6)])


def _log(rows: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=COLUMNS)
    return table.astype({"batch_id": "int64", "version": "int64", "pos": "int64", "seq": "Int64", "pct": "Int32", "atoms_produced": "Int32", "latency_ms": "float64"}).astype(object).where(table.notna(), None)


def changes(events: DataFrame, ttl_s: int = DAY_S, delay: str = "1 hour") -> DataFrame:
    """The log of changes of a stream of events (columns of `progress.SCHEMA`, and `subscriber` where it has any)."""
    if "subscriber" not in events.columns:
        events = events.withColumn("subscriber", F.lit(None).cast("string"))
    named = events.filter(F.col("batch_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull()).select("batch_id", "seq", "ts", F.unix_millis("ts").alias("ms"), "event", "subscriber", "phase", "step", "completed", "total", "atom_id", "classification", "atoms_produced", "latency_ms")
    return named.withWatermark("ts", delay).groupBy("batch_id").transformWithStateInPandas(BatchState(ttl_s), LOG, "Append", "EventTime")


def run(log: DataFrame, path: str, checkpoint: str):
    """Writes what is there to the log's folder and ends; called again, it goes on from the checkpoint. This query alone runs on the RocksDB state store, which maps and timers need."""
    conf, key = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(key, before) if before else conf.unset(key)


def snapshot(log: DataFrame) -> DataFrame:
    """batch_id, kind, pos and the columns of PHASE of the state after the last row of the log: one aggregate to find where each batch begins, one for the latest rows."""
    own = log.filter(F.col("to").isNull())
    rows = own.groupBy("batch_id", "kind", "pos").agg(F.max_by(F.struct(*COLUMNS[5:]), "version").alias("s"), F.max("version").alias("version"))
    begun = own.filter("kind = 'expired'").groupBy("batch_id").agg(F.max("version").alias("begun"))
    live = rows.filter("kind <> 'expired'").join(begun, "batch_id", "left").filter("begun IS NULL OR version > begun")
    return live.select("batch_id", "kind", "pos", "s.*")


def sent(log: DataFrame, subscriber: str) -> DataFrame:
    """What a subscriber was sent, in order of `version` within a batch."""
    return log.filter(F.col("to") == subscriber)


def sessions(events: DataFrame, ttl_s: int = DAY_S, now_ms: int | None = None) -> DataFrame:
    """The batch form: the events that count for the state of each batch, which are those after its last silence of `ttl_s`; none of a batch that is silent for so long at `now_ms`."""
    from pyspark.sql import Window

    ms = F.unix_millis("ts")
    order = Window.partitionBy("batch_id").orderBy(ms, "seq")
    cut = events.withColumn("__new", F.coalesce((ms - F.lag(ms).over(order) >= ttl_s * 1000).cast("int"), F.lit(0)))
    numbered = cut.withColumn("__s", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("batch_id")
    last = numbered.withColumn("__last", F.max("__s").over(whole)).withColumn("__at", F.max(ms).over(whole)).filter("__s = __last")
    if now_ms is not None:
        last = last.filter(F.lit(now_ms) - F.col("__at") < ttl_s * 1000)
    return last.drop("__new", "__s", "__last", "__at")


