"""Phases with gates that last: many batches go through phases, wait after each, and go on in any later session (PIP6, PIP7, PIP9).

A phase is a function from rows to rows, of any number of batches at once; rows have batch_id. A phase's rows are written to a folder of their own, and then one commit
of a keyed table (batch_id, gate) says for each batch that this gate is reached, with the atoms, those flagged, and the folder. A batch's
status is that of its last gate, so there is nothing else to keep in step: a run that dies before its commit has changed nothing, and
of two that run one phase of one batch the first counts. A finished phase is never run again, since its rows are read from its folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.keyed import KeyedTable
from sparkloom.storage import written

GATES = "batch_id long, gate int, phase_name string, atoms_count long, flagged_count long, status string, folder string"


class GateLedger:
    """phases: (name, function) in order. flagged: which rows of the last phase need a review; without one, a batch is complete after it."""

    def __init__(self, spark: SparkSession, path: str, phases: list[tuple[str, Callable[[DataFrame], DataFrame]]], flagged: Column | None = None, buckets: int = 8):
        self.spark, self.path, self.phases, self.flagged = spark, path.rstrip("/"), phases, flagged
        self.gates = KeyedTable.create(spark, f"{self.path}/gates", StructType.fromDDL(GATES), ["batch_id", "gate"], buckets)
        self.runs = 0

    def status(self) -> DataFrame:
        """batch_id, gate, status of each batch: its last gate's."""
        last = self.gates.read().groupBy("batch_id").agg(F.max(F.struct("gate", "status")).alias("x"))
        return last.select("batch_id", "x.gate", "x.status")

    def start(self, rows: DataFrame) -> int:
        """The first phase, for batches that the ledger doesn't know yet. Returns how many phases ran."""
        known = self.gates.read().select("batch_id").distinct()
        new = rows.join(known, "batch_id", "left_anti")
        return self._run(1, new, new.select("batch_id").distinct())

    def proceed(self, batches: DataFrame | None = None) -> int:
        """Each waiting batch (of `batches`, if given) goes on by one phase; later gates first, so that none goes twice. Returns how many phases ran."""
        waiting = self.status().filter(F.col("gate") < len(self.phases))
        if batches is not None:
            waiting = waiting.join(batches.select("batch_id").distinct(), "batch_id", "left_semi")
        at = sorted((r["gate"] for r in waiting.select("gate").distinct().collect()), reverse=True)  # at most a gate for each phase
        ready = [(g, written(waiting.filter(F.col("gate") == g).select("batch_id"), "waiting")) for g in at]
        return sum(self._run(g + 1, self.results(g, b), b) for g, b in ready)

    def run(self) -> int:
        """Until no batch waits."""
        total = 0
        while n := self.proceed():
            total += n
        return total

    def results(self, gate: int, batches: DataFrame | None = None) -> DataFrame:
        """The rows that a phase gave, of some batches or of all that have come so far."""
        rows = self.gates.read().filter(F.col("gate") == gate)
        if batches is not None:
            rows = rows.join(batches.select("batch_id"), "batch_id", "left_semi")
        folders = [r["folder"] for r in rows.select("folder").distinct().collect()]  # one for each run of the phase
        if not folders:
            raise ValueError(f"no batch has come to gate {gate}")
        held = self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*(f"{self.path}/rows/{f}" for f in folders))
        wanted = rows.select("batch_id", F.col("folder").alias("__folder"))
        said = held.withColumn("__folder", F.regexp_extract(F.input_file_name(), r"rows/([0-9a-f]{32})", 1))
        return said.join(wanted, ["batch_id", "__folder"], "left_semi").drop("__folder")

    def resume(self, batches: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> int:
        """Batches in review are complete with the rows that `resolve` makes of theirs (overrides applied); others stay (PIP9)."""
        open_ = self.status().filter("status = 'review_required'").join(batches.select("batch_id").distinct(), "batch_id", "left_semi")
        if open_.isEmpty():
            return 0
        return self._commit(len(self.phases) + 1, "Review", resolve(self.results(len(self.phases), open_)), open_.select("batch_id"), lambda n: F.lit("complete"))

    def final(self) -> DataFrame:
        """The rows of complete batches: after their review, or else after the last phase."""
        done = self.status().filter("status = 'complete'")
        parts = [self.results(int(r["gate"]), done.filter(F.col("gate") == r["gate"])) for r in done.select("gate").distinct().collect()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _run(self, gate: int, rows: DataFrame, batches: DataFrame) -> int:
        name, phase = self.phases[gate - 1]
        if batches.isEmpty():
            return 0
        last = gate == len(self.phases)
        review = lambda n: F.when(n > 0, "review_required").otherwise("complete") if last else F.lit(f"gate_{gate}")
        self.runs += 1
        return self._commit(gate, name, phase(rows), batches, review, self.flagged if last else None)

    def _commit(self, gate: int, name: str, rows: DataFrame, batches: DataFrame, status: Callable[[Column], Column], flagged: Column | None = None) -> int:
        folder = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/rows/{folder}")
        counts = self.spark.read.parquet(f"{self.path}/rows/{folder}").groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(flagged, F.lit(False)) if flagged is not None else F.lit(False)).alias("f"))
        facts = batches.join(counts, "batch_id", "left").select("batch_id", F.lit(gate).alias("gate"), F.lit(name).alias("phase_name"), F.coalesce("n", F.lit(0)).alias("atoms_count"), F.coalesce("f", F.lit(0)).alias("flagged_count"))
        self.gates.insert_absent(facts.withColumn("status", status(F.col("flagged_count"))).withColumn("folder", F.lit(folder)))
        return 1
