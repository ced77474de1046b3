"""Keyed tables: what merges rewrite, what readers and dead writers see, conflicts, migrations."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.keyed import Conflict, KeyedTable

DDL = "k long, part string, score double, note string"


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable.create(spark, f"file://{tmp_path}/t", StructType.fromDDL(DDL), ["k"], 8)
    t.merge(rows(spark, range(100)), ["score"])
    return t


def rows(spark, ks, score=1.0, note="old"):
    return spark.createDataFrame([(k, f"p{k % 3}", score, note) for k in ks], DDL)


def held(t, version=None):
    return {r.k: (r.score, r.note) for r in t.read(version).collect()}


def test_a_merge_rewrites_the_touched_buckets_only(spark, table):
    before = table.manifest()
    assert table.merge(rows(spark, [5, 1000], 2.0, "new"), ["score"]) <= 2
    after = table.manifest()
    same = [b for b in before.folders if after.folders[b] == before.folders[b]]
    assert after.version == before.version + 1 and len(same) >= 6
    got = held(table)
    assert got[5] == (2.0, "old") and got[1000] == (2.0, "new") and got[6] == (1.0, "old") and len(got) == 101


def test_all_changes_give_what_their_plain_forms_give(spark, table):
    assert table.insert_absent(rows(spark, range(90, 110), 3.0)) >= 1
    assert held(table)[95][0] == 1.0 and held(table)[105][0] == 3.0
    assert table.insert_absent(rows(spark, range(0, 110))) == 0  # nothing is new, so nothing is written
    table.update_where(F.col("k") == 7, {"note": F.lit("seen")})
    assert held(table)[7] == (1.0, "seen")
    assert table.delete(spark.createDataFrame([(7,), (9999,)], "k long")) == 1
    assert 7 not in held(table) and len(held(table)) == 109
    table.merge(rows(spark, [8, 8], 4.0).unionByName(rows(spark, [8], 5.0)), ["score"], {"note": F.lit("again")})
    assert held(table)[8] == (5.0, "again")
    assert [r.k for r in table.lookup(8).collect()] == [8] and table.lookup(12345).isEmpty()
    assert table.delete(table.read().select("k")) == 8 and held(table) == {} and table.manifest().folders == {}


def test_readers_keep_their_version_and_dead_writers_change_nothing(spark, table, tmp_path):
    reader, version = table.read(), table.manifest().version
    table.merge(rows(spark, range(50), 9.0), ["score"])
    assert {r.score for r in reader.collect()} == {1.0} and set(held(table, version).values()) == {(1.0, "old")}
    with pytest.raises(Exception, match="killed"):
        table.change(lambda m: list(range(8)), lambda m, old: old.withColumn("score", F.raise_error(F.lit("killed")).cast("double")))

    class Dies(KeyedTable):
        def _commit(self, m):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Dies(spark, table.root).merge(rows(spark, [3], 77.0), ["score"])
    assert table.manifest().version == version + 1 and held(table)[3][0] == 9.0
    assert table.vacuum() >= 1 and held(table)[3][0] == 9.0 and held(table)[99][0] == 1.0 and table.versions() == [version + 1]


def test_writers_of_other_buckets_do_not_redo_their_work_and_of_the_same_do(spark, table):
    m = table.manifest()
    by = {}
    for r in table.read().select("k", table._bucket(m).alias("b")).collect():
        by.setdefault(r.b, []).append(r.k)
    (one, *_), (two, *_) = list(by.values())[:2]
    made = []

    def slow(key, inner):
        def make(m, old):
            made.append(key)
            if len(made) == 1:
                inner()  # another writer commits meanwhile
            return old.withColumn("score", F.when(F.col("k") == key, F.col("score") + 1).otherwise(F.col("score")))

        return make

    of = lambda k: lambda m: table._of(m, spark.createDataFrame([(k,)], "k long"))
    table.change(of(one), slow(one, lambda: table.update_where(F.col("k") == two, {"score": F.lit(5.0)})))
    assert made == [one] and held(table)[one][0] == 2.0 and held(table)[two][0] == 5.0
    made.clear()
    table.change(of(one), slow(one, lambda: table.update_where(F.col("k") == one, {"score": F.lit(10.0)})))
    assert made == [one, one] and held(table)[one][0] == 11.0
    with pytest.raises(Conflict):
        table.change(of(one), lambda m, old: (table.update_where(F.col("k") == one, {"score": F.col("score") + 1}), old)[1], tries=2)


def test_threads_that_write_at_once_all_have_their_effect(spark, table):
    def add(n):
        table.update_where(F.col("k") == 11, {"score": F.col("score") + n})

    threads = [threading.Thread(target=add, args=(10 ** i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held(table)[11][0] == 1112.0


def test_tables_and_migrations_are_made_once(spark, table):
    again = KeyedTable.create(spark, table.root, StructType.fromDDL("other int"), ["other"], 3)
    assert again.manifest() == table.manifest()
    before = table.manifest().folders
    assert table.migrate("V1", "kind string, size int", {"kind": "none"}) and not table.migrate("V1", "kind string")
    assert table.manifest().folders == before
    assert {(r.kind, r["size"]) for r in table.read().collect()} == {("none", None)}
    table.merge(rows(spark, [1], 2.0).withColumn("kind", F.lit("x")), ["kind"])
    table.merge(rows(spark, [500]), ["score"])
    got = {r.k: r.kind for r in table.read().collect()}
    assert got[1] == "x" and got[2] == "none" and got[500] == "none"


def test_odd_keys(spark, table):
    assert table.merge(rows(spark, []), ["score"]) == 0
    odd = spark.createDataFrame([(None, "p", 1.0, "n"), (-1, None, None, None)], DDL)
    table.insert_absent(odd)
    assert table.lookup(None).count() == 1 and table.lookup(-1).count() == 1
