"""Gates: stop anywhere, resume anywhere, the same result, each phase once."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.ledger import GateLedger

NAMES = ("Ingestion", "RAG", "Matching", "Classification", "Validation")


class Phases:
    def __init__(self):
        self.seen = []

    def all(self, broken: str | None = None):
        def phase(name, i):
            def run(rows):
                self.seen.append((name, sorted(r.batch_id for r in rows.select("batch_id").distinct().collect())))
                if name == broken:
                    return rows.withColumn("x", F.raise_error(F.lit("killed")).cast("long"))
                out = rows.withColumn("x", F.col("x") * 10 + i)
                if name == "Ingestion":
                    out = out.filter("atom_id <> 13")  # batch 3 is left without atoms
                return out

            return run

        return [(n, phase(n, i)) for i, n in enumerate(NAMES, 1)]


FLAG = "atom_id % 4 = 0"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 4, 0), (2, 2, 0), (2, 6, 0), (3, 13, 0), (4, 8, 0)], "batch_id long, atom_id long, x long")


def resolve(overrides):
    return lambda r: r.withColumn("x", F.when(F.col("atom_id").isin(list(overrides)), -1).otherwise(F.col("x")))


def told(ledger):
    return sorted((r.batch_id, r.atom_id, r.x) for r in ledger.final().collect()), {r.batch_id: (r.gate, r.status) for r in ledger.status().collect()}


def whole(spark, path, rows):
    led = GateLedger(spark, path, Phases().all(), F.expr(FLAG))
    led.start(rows)
    led.run()
    led.resume(rows, resolve({4}))
    return told(led)


@pytest.fixture(scope="module")
def want(spark, rows, tmp_path_factory):
    """One run from start to end."""
    return whole(spark, f"file://{tmp_path_factory.mktemp('whole')}", rows)


@pytest.mark.parametrize("stop", [2, 5])
def test_stop_after_any_gate_and_resume_in_a_new_session(spark, tmp_path, rows, want, stop):
    path, first = f"file://{tmp_path}/parts", Phases()
    led = GateLedger(spark, path, first.all(), F.expr(FLAG))
    assert led.start(rows) == 1
    for _ in range(stop - 1):
        assert led.proceed() == 1
    assert len(first.seen) == stop
    second, other = Phases(), spark.newSession()
    led = GateLedger(other, path, second.all(), F.expr(FLAG))
    assert led.start(other.createDataFrame(rows.collect(), rows.schema)) == 0  # known batches
    assert led.run() == 5 - stop and [n for n, _ in second.seen] == list(NAMES[stop:])
    assert {r.batch_id: r.status for r in led.status().collect()} == {1: "review_required", 2: "complete", 3: "complete", 4: "review_required"}
    assert led.resume(other.createDataFrame([(1,), (4,)], "batch_id long"), resolve({4})) == 1
    assert led.resume(other.createDataFrame([(1,), (4,)], "batch_id long"), resolve({4})) == 0
    assert told(led) == want


def test_batches_at_different_gates_go_on_by_one_phase_each(spark, tmp_path, rows, want):
    phases = Phases()
    led = GateLedger(spark, f"file://{tmp_path}/l", phases.all(), F.expr(FLAG))
    led.start(rows.filter("batch_id <= 2"))
    led.proceed(rows.filter("batch_id = 2"))
    led.start(rows)
    assert {r.batch_id: r.gate for r in led.status().collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    led.proceed()
    assert {r.batch_id: r.gate for r in led.status().collect()}[1] == 2 and {r.batch_id: r.gate for r in led.status().collect()}[2] == 3
    led.run()
    seen = [(n, b) for n, bs in phases.seen for b in bs]
    assert len(seen) == len(set(seen))  # no phase twice for a batch
    led.resume(rows, resolve({4}))
    assert told(led) == want


def test_a_phase_that_dies_changes_nothing(spark, tmp_path, rows, want):
    path = f"file://{tmp_path}/l"
    led = GateLedger(spark, path, Phases().all("Matching"), F.expr(FLAG))
    led.start(rows)
    led.proceed()
    before = sorted(map(tuple, led.status().collect()))
    with pytest.raises(Exception, match="killed"):
        led.proceed()
    assert sorted(map(tuple, led.status().collect())) == before
    led = GateLedger(spark, path, Phases().all(), F.expr(FLAG))
    led.run()
    led.resume(rows, resolve({4}))
    assert told(led) == want


def test_of_two_that_run_one_phase_the_first_counts(spark, tmp_path, rows, want):
    path = f"file://{tmp_path}/l"
    one = GateLedger(spark, path, Phases().all(), F.expr(FLAG))
    one.start(rows)
    waiting = one.results(1)
    one.proceed()
    GateLedger(spark, path, Phases().all(), F.expr(FLAG))._run(2, waiting, waiting.select("batch_id").distinct())  # a second worker, late
    assert one.gates.read().groupBy("batch_id", "gate").count().filter("count > 1").isEmpty()
    assert sorted((r.batch_id, r.atom_id, r.x) for r in one.results(2).collect()) == [(1, 1, 12), (1, 4, 12), (2, 2, 12), (2, 6, 12), (4, 8, 12)]
