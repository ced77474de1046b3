"""Prefix trie of conversations, level by level.

Turns are known by the SHA-256 of role and text; texts aren't moved. A node is named by its depth and its smallest member. Going down, each level groups the live
conversations by (parent node, next turn), which gives the nodes of the next depth with their smallest members; a node whose
members all go on alike (one member, or copies of one conversation) needs no more grouping: what follows is one chain of
nodes, told by its smallest member's turns alone, so its conversations stop being live. Levels end where nothing branches any more, not with the
longest conversation. Going up, each level's children are added up and joined to their parents: children, leaves, savings.

Hot groups: a turn that very many conversations share is grouped with map-side sums, and its one row is broadcast to
its members (`spread_join`). The ids that end at a node are written as sorted runs in any number of tasks; one task reads
the runs of a node as a stream, in order, for its digest. A conversation's turns are ordered in one task, which holds one of them at a time.

Each level is written to the shared folder, so a lost executor costs at most that level.

Defined results: turns are ordered by turn (null first), then role, then text, so turns that repeat are turns of their own; rows
without a conv_id belong to no conversation and are left out; a conversation that is rebuilt without turns ends at the root; an empty table
has no root; columns other than the four never take part.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join, trimmed_steps, worker_state

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Ids in a run, at most.
RUN = 1 << 16
#: Levels that are read side by side.
LEVELS = 16


def turn_key(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only: the role's length keeps them apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256))


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ...), turn_id, n_bytes of every turn with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mine = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = mine.select("conv_id", "turn", "role", turn_key(F.col("role"), F.col("text")).alias("turn_id"), F.octet_length("text").cast("long").alias("n_bytes"))
    like = Window.partitionBy("conv_id").orderBy("turn", "role", "turn_id")
    other = (F.lag("turn").over(like).eqNullSafe(F.col("turn"))) & (F.lag("role").over(like) == F.col("role")) & (F.lag("turn_id").over(like) != F.col("turn_id"))
    out = materialize(turns.select("*", other.alias("tied"), F.row_number().over(like).alias("pos")), "turns")
    tied = out.filter("tied").select("conv_id", "turn", "role").distinct()
    if tied.isEmpty():
        return out.select("conv_id", "pos", "turn_id", "n_bytes")
    # turns of one place and role with different texts: only these need their texts for the order
    on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.role") == F.col("b.role"))
    texts = mine.alias("a").join(tied.alias("b"), on, "left_semi").select("conv_id", "turn", "role", "text", turn_key(F.col("role"), F.col("text")).alias("turn_id")).distinct()
    same = F.col("o.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("o.turn").eqNullSafe(F.col("t.turn")) & (F.col("o.turn_id") == F.col("t.turn_id"))
    told = out.alias("o").join(texts.alias("t"), same, "left").select("o.conv_id", "o.turn", "o.role", "t.text", "o.turn_id", "o.n_bytes")
    return told.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("pos"), "turn_id", "n_bytes")


def rebuilt(turns: DataFrame, stride: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_id, n_bytes) of the rebuilt conversations, and all conv_ids: the first h turns of conversation c - c % stride, then c's own after its first h; h = crc32(c) % most."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    every = turns.select("conv_id").distinct()
    own = turns.filter(F.col("pos") > h).withColumn("part", F.lit(1))
    heads = turns.filter((F.col("conv_id") % stride == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    users = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % stride).alias("base"), h.alias("h"))
    lent = users.join(heads, "base").filter("pos <= h").withColumn("part", F.lit(0)).select(*own.columns)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "pos"))
    return lent.unionByName(own).select("conv_id", place.alias("at"), "turn_id", "n_bytes").withColumnRenamed("at", "pos"), every


def with_tails(turns: DataFrame) -> DataFrame:
    """Adds rest (digest of this turn and all after it), rest_bytes (theirs), and length (turns of the conversation). One pass from the last turn to the first."""

    def run(batches):
        worker_state(None, None)
        conv, digest, total, length = None, b"", 0, 0
        for batch in batches:
            rests, sums, lengths = [], [], []
            for c, pos, key, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "turn_id", "n_bytes"))):
                if c != conv:
                    conv, digest, total, length = c, b"", 0, pos
                digest, total = hashlib.sha256(digest + key).digest(), total + n
                rests.append(digest)
                sums.append(total)
                lengths.append(length)
            more = [pa.array(rests, pa.binary()), pa.array(sums, pa.int64()), pa.array(lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rest", "rest_bytes", "length"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("pos").desc()).select("conv_id", "pos", "turn_id", "n_bytes")
    out = ordered_.mapInArrow(lambda batches: trimmed_steps(run(batches)), f"conv_id {kind}, pos int, turn_id binary, n_bytes long, rest binary, rest_bytes long, length int")
    return materialize(out.sortWithinPartitions("pos"), "turns")  # so that a level reads the row groups of its depth only


def ends_digest(ends: DataFrame) -> DataFrame:
    """ends: depth, node, conv_id. depth, node, ends_sha256: of the node's ids, ascending, joined by commas."""

    def runs(batches):
        at, held = None, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, held[0], ",".join(map(str, held))), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "first", "ids"])
        for batch in batches:
            for depth, node, conv in zip(*(batch.column(x).to_pylist() for x in ("depth", "node", "conv_id"))):
                if held and (at != (depth, node) or len(held) == RUN):
                    yield flush()
                    held = []
                at = (depth, node)
                held.append(conv)
        if held:
            yield flush()

    def digests(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "node", "ids"))):
                if at != (depth, node):
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (depth, node), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield done(out)
        if at:
            yield done([(*at, sha.hexdigest())])

    done = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.string()))], ["depth", "node", "ends_sha256"])
    parts = ends.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(runs, "depth int, node long, first long, ids string")
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").select("depth", "node", "ids").mapInArrow(digests, "depth int, node long, ends_sha256 string")


def build(turns: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), the ends (depth, node, conv_id), and the tables both still read.

    turns: of `with_tails`; every: all conv_ids.
    """
    first = turns.filter("pos = 1").select("conv_id", "length")
    live = materialize(every.join(first, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length")), "live")
    root = live.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.count_if(F.col("length") == 0).alias("ended")).first()
    used = [live]
    if root["n"] == 0:
        none = live.filter("false")
        return none.selectExpr("conv_id", "0 depth", "conv_id parent_conv_id", "0L n_convs", "0L n_children", "0L n_leaves", "0L saved_tokens"), none.selectExpr("0 depth", "conv_id node", "conv_id"), used
    spark = turns.sparkSession
    live = live.withColumn("node", F.lit(root["node"]).cast("long"))
    levels = [spark.createDataFrame([(root["node"], None, root["n"], 0, False, 0, 0)], "conv_id long, parent long, n long, n_bytes long, alike boolean, rest_bytes long, length int")]
    ends, depth, heads = [live.filter("length = 0").select(F.lit(0).alias("depth"), "node", "conv_id")], 0, []
    going = root["n"] - root["ended"]
    while going:  # live: the conversations with more turns, and their nodes at this depth
        step = materialize(live.filter(F.col("length") > depth).select("conv_id", "node").join(turns.filter(F.col("pos") == depth + 1), "conv_id").select("conv_id", "length", F.struct("node", "turn_id").alias("g"), "n_bytes", "rest", "rest_bytes"), "step")
        depth += 1
        agg = step.groupBy("g").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"), (F.min("rest") == F.max("rest")).alias("alike"), F.min_by("rest_bytes", "conv_id").alias("rest_bytes"), F.min_by("length", "conv_id").alias("length"))
        groups = materialize(agg, "nodes")
        levels.append(groups.select(F.col("child").alias("conv_id"), F.col("g.node").alias("parent"), "n", "n_bytes", "alike", "rest_bytes", "length"))
        live = materialize(spread_join(step.select("conv_id", "length", "g"), groups.select("g", F.col("child").alias("node"), "alike", "n"), "g", going).select("conv_id", "length", "node", "alike"), "live")
        discard(step)
        used += [groups, live]
        heads.append(groups.filter("alike").select(F.col("child").alias("conv_id"), F.lit(depth).alias("depth"), "n"))
        ends.append(live.filter(F.col("alike") | (F.col("length") == depth)).select(F.when(F.col("alike"), F.col("length")).otherwise(depth).alias("depth"), "node", "conv_id"))
        live = live.filter(~F.col("alike"))
        going = live.filter(F.col("length") > depth).count()
    nodes = _rolled_up(levels, used)
    chain = turns.join(_all(heads), "conv_id").filter(F.col("pos") > F.col("depth")) if heads else None
    if chain is not None:
        tail = chain.select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("pos") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest_bytes")).alias("saved_tokens"))
        nodes = nodes.unionByName(tail)
    return nodes, _all(ends), used


def _all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts. Many levels are written together, so that the plan of the result stays small."""
    while len(parts) > LEVELS:
        parts = [materialize(reduce(DataFrame.unionByName, parts[at : at + LEVELS]), "levels") for at in range(0, len(parts), LEVELS)]
    return reduce(DataFrame.unionByName, parts)


def _rolled_up(levels: list[DataFrame], used: list[DataFrame]) -> DataFrame:
    """From the deepest level to the root: each node's own figures and the sums of its children."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        own = (F.col("n") - 1) * F.when(F.col("alike"), F.col("rest_bytes")).otherwise(F.col("n_bytes"))
        if below is None:
            sums = here.select(F.col("conv_id").alias("of")).filter("false").selectExpr("of", "0L c", "0L l", "0L s")
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        chained = F.col("alike") & (F.col("length") > depth)
        joined = here.join(sums, F.col("conv_id") == F.col("of"), "left")
        children = F.coalesce("c", F.when(chained, 1).otherwise(0).cast("long"))
        row = joined.select("conv_id", F.lit(depth).alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), F.coalesce("l", F.lit(1).cast("long")).alias("n_leaves"), (own + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        below = materialize(row, "sums")
        used.append(below)
        out.append(below)
    return _all(out)


def trie_table(rows: DataFrame, stride: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    turns, every = rebuilt(ordered(rows.select(F.col("conv_id").cast("long"), "turn", "role", "text")), stride, most)
    every = materialize(every, "conversations")
    nodes, ends, _ = build(with_tails(turns), every)
    told = ends_digest(ends).select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.join(told, ["conv_id", "depth"], "left").select(*long, F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, list_reduce([xor(c & 255, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END))), 4294967295)"""

ORACLE_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS n FROM
  (SELECT c.conv_id, 0 AS part, t.* EXCLUDE (conv_id) FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT t.conv_id, 1, t.* EXCLUDE (conv_id) FROM t JOIN c USING (conv_id) WHERE pos > h)),
p AS (SELECT conv_id, 0::BIGINT AS pos, ''::VARCHAR AS path, 0::BIGINT AS n FROM c UNION ALL SELECT p.conv_id, r.pos, sha256(p.path || r.k), r.n FROM p JOIN r ON r.conv_id = p.conv_id AND r.pos = p.pos + 1),
m AS MATERIALIZED (SELECT p.*, pos = max(pos) OVER (PARTITION BY conv_id) AS ends, min(conv_id) OVER (PARTITION BY pos, path) AS node FROM p),
nodes AS MATERIALIZED (SELECT node, pos AS depth, count(*) AS n_convs, any_value(n) AS n, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ids FROM m GROUP BY node, pos),
links AS MATERIALIZED (SELECT DISTINCT b.node, b.pos AS depth, a.node AS parent FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.pos = a.pos + 1),
kids AS MATERIALIZED (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM links GROUP BY ALL),
tops AS (SELECT DISTINCT a.node, a.pos AS depth, b.node AS under, b.pos AS under_depth FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.pos >= a.pos),
sums AS (SELECT x.node, x.depth, sum((y.n_convs - 1) * y.n) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM tops x JOIN nodes y ON y.node = under AND y.depth = under_depth LEFT JOIN kids k ON k.node = under AND k.depth = under_depth GROUP BY ALL)
SELECT nodes.node::BIGINT AS conv_id, nodes.depth::BIGINT AS depth, links.parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN sums USING (node, depth) LEFT JOIN kids USING (node, depth) LEFT JOIN links USING (node, depth)
"""
