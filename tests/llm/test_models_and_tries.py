"""op11, op12 and op13 against plain Python, on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sparkloom.llm import conversation_trie, delta_lloyd, lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]  # None: the end


def part_of(doc_id):
    left = None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7
    return 0 if left in (None, 2) else 2 if left == 3 else 1


def brute_lm(docs, order):
    """(n_tokens, n_known, N, base, score) of each row."""
    counts = {1: [Counter() for _ in range(order)], 2: [Counter() for _ in range(order)]}
    begun = {1: 0, 2: 0}
    for i, t in docs:
        p, padded = part_of(i), ["^"] * (order - 1) + split(t)
        if p:
            begun[p] += 1
            for at in range(order - 1, len(padded)):
                for k in range(order):
                    counts[p][k][tuple(padded[at - k : at + 1])] += 1

    def facts(c, docs_seen, gram):
        """(count, context) for each order of a gram of the highest order."""
        out = []
        for k in range(order):
            g = gram[order - 1 - k :]
            context = sum(c[0].values()) if not k else docs_seen if all(x == "^" for x in g[:-1]) else c[k - 1][g[:-1]]
            out.append((c[k][g], context))
        return out

    def p_of(fs, w, v):
        ps = [1 / (v + 1)]
        for k, (c, h) in enumerate(fs):
            a = w[k][h.bit_length()] if h else 0.0
            ps.append(a * c / max(h, 1) + (1 - a) * ps[-1])
        return ps

    events = Counter(tuple((["^"] * (order - 1) + split(t))[at - order + 1 : at + 1]) for i, t in docs if part_of(i) == 2 for at in range(order - 1, order - 1 + len(split(t))))
    weights, said, v1 = [[0.5] * 65 for _ in range(order)], [], len(counts[1][0])
    reach = None
    for _ in range(lm.ROUNDS if events else 0):
        reach, own, log = [[0.0] * 65 for _ in range(order)], [[0.0] * 65 for _ in range(order)], 0.0
        for gram, many in events.items():
            fs = facts(counts[1], begun[1], gram)
            ps, left = p_of(fs, weights, v1), float(many)
            log += many * math.log10(ps[-1])
            for k in range(order - 1, -1, -1):
                c, h = fs[k]
                b = h.bit_length()
                mine = weights[k][b] * c / h / ps[k + 1] if h else 0.0
                reach[k][b] += left
                own[k][b] += left * mine
                left *= 1 - mine
        said.append(log)
        weights = [[(own[k][b] + 1) / (reach[k][b] + 2) if reach[k][b] > 0 else 0.5 for b in range(65)] for k in range(order)]
        if len(said) > 1 and said[-1] - said[-2] < lm.TOLERANCE * -said[-1]:
            break
    for k in range(order):
        for b in range(1, 65):
            if reach and reach[k][b] == 0 and any(reach[k][:b]):
                weights[k][b] = weights[k][b - 1]
    every = [counts[1][k] + counts[2][k] for k in range(order)]
    n, v = sum(every[0].values()), len(every[0])
    out = []
    for _, t in docs:
        padded = ["^"] * (order - 1) + split(t)
        grams = [tuple(padded[at - order + 1 : at + 1]) for at in range(order - 1, len(padded))]
        c = [every[0][g[-1:]] for g in grams]
        out.append((len(grams), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), sum(math.log10(p_of(facts(every, sum(begun.values()), g), weights, v)[-1]) for g in grams)))
    return out, said


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "tHe", "Über", "x" * 30, "\x1c", "\xa0"]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(1, 60)))) for i in range(n)]


ODD_DOCS = [(None, "the null id"), (5, None), (6, ""), (7, " \t\n "), (5, "w0 w1 w2"), (5, "w0 w1 w2"), (900, "only here zzz"), (-3, "W0 W0 W0"), (901, "w0 w1 " * 20000), (902, None)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    docs = texts(3, 120) + ODD_DOCS
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, score string, n_tokens double").repartition(3)
    want, said = brute_lm(docs, order)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_table(frame, order).collect()]
    assert len(got) == len(docs) and len(said) > 1
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    wanted = sorted(((i, part_of(i) == 0 and i is not None, *w) for (i, _), w in zip(docs, want)), key=key)
    for g, w in zip(sorted(got, key=key), wanted):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_small_chunks_and_many_groups_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(texts(4, 150), "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.score for r in lm.scored(lm.learned(frame)).collect()}
    monkeypatch.setattr(lm, "GROUP_BYTES", 500)
    parts = lm.learned(frame, chunk_bytes=800)
    assert parts.groups > 20 and parts.chunks.count() > 10
    for r in lm.scored(parts).collect():
        assert r.score == pytest.approx(whole[r.doc_id], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, 50)
    weights = rng.random((2, lm.BUCKETS))
    after = rng.integers(0, 2, 50) * counts
    p = lm.interpolate(np.stack([counts, after]), np.stack([np.full(50, counts.sum()), np.full(50, after.sum())]), weights, 50)[-1]
    unknown = lm.interpolate(np.zeros((2, 1), int), np.array([[counts.sum()], [after.sum()]]), weights, 50)[-1]
    assert p.sum() + unknown[0] == pytest.approx(1)


def test_learned_weights_are_better_than_fixed_ones_on_held_out_rows(spark, sf_dir):
    rows = [r for r in queries.op11_lm_scoring(spark, sf_dir).collect() if r.held_out]
    tokens, base, own = sum(r.n_tokens for r in rows), sum(r.base_score for r in rows), sum(r.score for r in rows)
    print(f"held-out log10 probability a token: base {base / tokens:.3f}, interpolated {own / tokens:.3f}")
    assert rows and own > base


def test_lm_of_tables_with_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_table(none).count() == 0
    left = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.score_table(spark.createDataFrame([(i, "a b") for i in left], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 1][:3]
    got = lm.score_table(spark.createDataFrame([(str(i), "a b") for i in ids], "doc_id string, text string")).collect()
    assert len(got) == 3 and all(r.train_tokens == 9 and r.score > r.base_score for r in got)


def brute_lloyd(rows, k, rounds, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(math.floor(256 * x)) <= 1 << 27 for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        c = [[sum(x) // len(by[n]) for x in zip(*by[n])] if n in by else w for n, w in enumerate(c)]
    ends = [near(v) for _, v in kept]
    own = Counter()
    for d, n in ends:
        own[n] += d
    return [(i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, ends)], c


def _tuples(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_delta_lloyd_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 7, 0.7) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)]  # copies
    rows += [(7, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (None, rows[2][1]), (None, [0.0] * 64), (-4, [-1.25] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None, *[1.0] * 63]), (2005, [float("nan"), *[1.0] * 63]), (2006, [float("inf"), *[1.0] * 63]), (2007, [1e30, *[1.0] * 63]), (2008, [3e4, *[1.0] * 63])]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    monkeypatch.setattr(delta_lloyd, "BLOCK_ROWS", 50)
    monkeypatch.setattr(delta_lloyd, "BUCKET_ROWS", 60)
    for k, rounds in ((40, 5), (3, 8), (1, 2)):
        want, _ = brute_lloyd(rows, k, rounds)
        assert _tuples(delta_lloyd.cluster_table(frame, k, rounds)) == sorted(want, key=str)
    assert not spark.sql("SHOW TABLES").collect()


def test_delta_lloyd_of_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(5)]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert _tuples(delta_lloyd.cluster_table(frame)) == sorted(brute_lloyd(few, 40, 5)[0], key=str)
    assert delta_lloyd.cluster_table(frame.filter("false")).collect() == []
    assert delta_lloyd.cluster_table(frame.selectExpr("vec_id", "CAST(NULL AS array<float>) embedding")).collect() == []


def test_delta_rounds_compare_less_and_transfers_are_signed(spark, sf_dir):
    found = delta_lloyd.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=12)
    assert found.compared[-1] < found.compared[0] / 2
    v = np.arange(8).reshape(4, 2)
    moves = delta_lloyd.transfers(v, np.array([0, 1, 1, -1]), np.array([0, 0, 1, 2]), 3)
    assert moves == [{"cluster": 0, "sums": [1, 2, 3]}, {"cluster": 1, "sums": [-1, -2, -3]}, {"cluster": 2, "sums": [1, 6, 7]}]
    far = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    assert delta_lloyd.distances(far, far).tolist() == [[0, 64 << 56], [64 << 56, 0]]


def test_a_round_joins_without_a_shuffle(spark):
    rows = spark.range(500).selectExpr("id vec_id", "transform(sequence(1, 64), x -> double(x * id)) embedding")
    tables = delta_lloyd.Buckets(spark, 3)
    left = tables.write(delta_lloyd.pack_vectors(rows, "vec_id", "embedding", 64, 256).repartition(3, "block"), "a")
    right = tables.write(left.selectExpr("block", "size(ids) n"), "b")
    plan = left.join(right.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    tables.drop()
    assert "Exchange" not in plan and "Sort " not in plan


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in paths.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = sorted(c for c in members[p] if len(paths[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["yes", "no", "é", ""])) for c in range(n) for t in range(rng.randrange(0, 14))]
    long = [(t, "user", f"turn {t}") for t in range(22)]
    for c in range(500, 560):  # copies, and copies that end early
        rows += [(c, *x) for x in long[: 22 if c % 3 else c % 22]]
    return rows


ODD_TURNS = [
    (None, 0, "user", "lost"), (1000, None, "user", "null first"), (1000, 0, None, "x"), (1000, 0, None, None), (1000, 1, "user", None), (1001, 0, "a", "bc"), (1002, 0, "ab", "c"), (1003, 0, "user", "b"), (1003, 0, "user", "a"), (1003, 0, "bot", "c"),
    (1003, None, "user", "z"), (1003, None, "user", "y"), (1003, 0, "user", "a"), (-7, 0, "user", "minus"), (-5, 0, "user", "five"), (-5, 1, "user", "more"), (1 << 40, 0, "user", "far"), (1010, 0, "user", "\U0001f600" * 3000), (1011, 0, "user", "\U0001f600" * 3000),
]


@pytest.mark.parametrize("rows", [conversations(1, 60), conversations(2, 200) + ODD_TURNS, ODD_TURNS, ODD_TURNS[1:2]])
def test_trie_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 7)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    assert _tuples(conversation_trie.trie_table(frame)) == sorted(brute_trie(rows), key=str)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie_table(none).collect() == []
    assert conversation_trie.trie_table(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).collect() == []


def test_levels_end_where_nothing_branches(spark):
    """A thousand copies of one long conversation take one level."""
    rows = spark.range(1000).selectExpr("id conv_id", "explode(sequence(0, 30)) turn").selectExpr("conv_id", "turn", "'user' role", "concat('turn ', turn) text")
    turns = conversation_trie.with_tails(conversation_trie.ordered(rows))
    nodes, ends, used = conversation_trie.build(turns, rows.select("conv_id").distinct())
    assert len(used) == 5  # live, nodes and members of one level, two levels of sums
    assert sorted((r.depth, r.conv_id, r.n_convs) for r in nodes.collect()) == [(d, 0, 1000) for d in range(32)]
    assert ends.count() == 1000 and ends.select("depth", "node").distinct().count() == 1


@pytest.mark.parametrize("name", ["op12_delta_lloyd", "op13_conversation_trie"])
def test_new_queries_equal_their_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    told = con.execute(queries.ORACLES[name])
    names = [c[0] for c in told.description]
    assert names == frame.columns
    assert _tuples(frame) == sorted(told.fetchall(), key=str)
