"""The vector index: every row indexed, recall against brute force, exact lists, hot tiles, and no copy of the base."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dedup, retrieval, vector_index
from sparkloom.operators.vector_index import VectorIndex


def clustered(spark, n, dim=16, centers=12, spread=0.25, seed=3):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centers, dim))
    home = np.where(rng.random(n) < 0.34, 0, rng.integers(0, centers, n))  # one group holds a third and more
    v = mid[home] + spread * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")


def hits(df):
    return {(r.query_id, r.id) for r in df.collect()}


def asked(v, every=10):
    return v.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_stated_queries(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id id", "embedding vec")
    index, q = VectorIndex.build(v), asked(v, 100)
    want = hits(retrieval.nearest(q, v, 20))
    got = hits(index.search(q, 20))
    print(f"{sf}: recall@20 {len(got & want) / len(want):.3f}, {index.probes} of {len(index.centroids)} lists")
    assert len(got & want) >= 0.9 * len(want)
    assert hits(index.search(q, 20, probes=10_000)) == want
    assert int(index.sizes.sum()) == index.table().agg(F.sum(F.size("ids"))).first()[0] == v.count()
    index.drop()


def test_few_lists_do_where_vectors_have_clusters_and_hot_tiles_are_split(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE", 60)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 15)
    v = clustered(spark, 2500)
    index, q = VectorIndex.build(v, lists=30), asked(v)
    assert index.tiles.max() > 1 and index.probes < 15
    want = hits(retrieval.nearest(q, v, 10))
    got = hits(index.search(q, 10))
    print(f"clusters: recall@10 {len(got & want) / len(want):.3f}, {index.probes} of {len(index.centroids)} lists")
    assert len(got & want) >= 0.9 * len(want)
    first = index.search(q, 10).orderBy("query_id", "rank").first()
    exact = retrieval.nearest(q, v, 10).orderBy("query_id", "rank").first()
    assert first.score == pytest.approx(exact.score, abs=1e-6)
    index.drop()


def test_the_base_is_not_shuffled_by_a_search(spark):
    v = clustered(spark, 600)
    index = VectorIndex.build(v, lists=8)
    plan = index.search(asked(v), 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert below.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in below
    index.drop()


def test_pairs_above_a_cosine_are_all_found(spark):
    v = clustered(spark, 700, spread=0.15)
    index = VectorIndex.build(v, lists=20)
    got = {(r.i, r.j): r.s for r in index.pairs_above(v, 0.92).collect()}
    want = {(r.i, r.j): r.s for r in dedup.similar_pairs(v.withColumn("b", F.lit(1)), 0.92, "b").collect()}
    assert len(want) > 100 and all(want[p] == pytest.approx(got[p], abs=1e-6) for p in set(got) & set(want))
    assert all(abs((want | got)[p] - 0.92) < 1e-6 for p in set(got) ^ set(want))
    index.drop()


def test_greedy_by_index_is_the_sequential_form(spark):
    v = clustered(spark, 300, dim=8, spread=0.3)
    raw = {r.id: np.array(r.vec) / np.linalg.norm(r.vec) for r in v.collect()}
    owner, soft = {}, set()
    for i in sorted(raw):
        if i not in owner:
            for j in sorted(raw):
                if j > i and j not in owner:
                    s = raw[i] @ raw[j]
                    if s > 0.92:
                        owner[j] = i
                    elif s > 0.80:
                        soft.add(j)
    got = {r.id: (r.owner, r.soft) for r in dedup.greedy_by_index(v).collect()}
    assert got == {i: (owner.get(i), i in soft) for i in raw}


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(20)] + [(100, [0.0] * 4), (101, None), (102, []), (0, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<float>")
    index = VectorIndex.build(v, lists=3)
    assert int(index.sizes.sum()) == 22
    assert index.search(asked(v, 5), 3, probes=3).groupBy("query_id").count().filter("count > 3").isEmpty()
    index.drop()
    none = VectorIndex.build(v.filter("false"))
    assert none.search(asked(v, 5), 3).collect() == []
    one = VectorIndex.build(v.filter("id = 7"))
    assert hits(one.search(asked(v, 5), 3)) == {(q, 7) for q in (0, 5, 10, 15, 100)}


def test_greedy_by_index_asks_for_kept_rows_only(spark, monkeypatch):
    """Copies and near copies, a few candidates a round: as over all pairs, while copies that were absorbed are not looked up."""
    from sparkloom.operators import dedup

    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(20, 4)), 8, 0) + np.tile(rng.normal(size=(8, 4)), (20, 1)) * 0.01
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(rng.permutation(v))] + [(1000, None)], "id long, vec array<double>")
    asked, plain = [], VectorIndex.pairs_above
    monkeypatch.setattr(VectorIndex, "pairs_above", lambda self, rows, above: asked.append(rows.count()) or plain(self, rows, above))
    got = {r.id: (r.owner, r.soft) for r in dedup.greedy_by_index(df, 0.9, 0.6, first=16).collect()}
    assert got == {r.id: (r.owner, r.soft) for r in dedup.greedy(df.withColumn("b", F.lit(0)), 0.9, 0.6).collect()} and sum(asked) <= 20
