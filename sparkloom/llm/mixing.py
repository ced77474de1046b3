"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The token weight of each (source, language, topic) cell is raked in turn to the target marginal of
each column until all marginals are within `tolerance` of their targets, or until more rounds bring them
no nearer (targets that no weights meet); `rake` returns the gap that is left. The raked over the present
weight of a cell, scaled to the token budget and capped at 1 (what a capped cell cannot give is shared
among the others, until no further cell is capped), is the probability with which each of its documents is
drawn. A draw depends on the doc_id and the seed alone, so it is the same after a retry.

Topics are a column of the table if `topic` names one, or the classes of `topics`: from `learn_topics`, the most
frequent words of six or more letters a-z in the whole table stand for a topic each, and a document belongs to the one it
holds most often (the first in alphabetical order of equal ones), or to '(none)'. Without either they are coarse
classes of form, since learned words belong to one language each: their marginals then pull against those of
the languages, and raking ends far from both.

Targets: a dict value -> share for a margin, or None for the present shares to the power `alpha`.
Cells are rows of a table, not of the driver: sums over a margin are windows, and only totals come back.
Defined results: null margins are the class '(none)'; a value the targets leave out gets share 0;
documents without words weigh 0 tokens and follow the probability of their cell (1 in a cell
without tokens); a null doc_id draws by its text; repeated rows draw alike; an empty table gives an empty result;
other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, spread_join, words

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
TOPICS, TOPIC_WORD = 24, "^[a-z]{6,}$"
NONE = "(none)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form_of(text: Column) -> Column:
    """A class by form: table rows, mail or web addresses, code marks, or prose by length."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("://")), "contact")
        .when(F.contains(t, F.lit("{")) | F.contains(t, F.lit("=")), "code")
        .when(F.char_length(t) > 4000, "long prose")
        .otherwise("prose")
    )


def learn_topics(docs: DataFrame, topics: int = TOPICS) -> list[str]:
    """The most frequent words that match TOPIC_WORD, counted over the whole table; at most `topics` come to the driver."""
    every = docs.select(F.explode(words(F.col("text"))).alias("w")).filter(F.col("w").rlike(TOPIC_WORD))
    return [r.w for r in every.groupBy("w").count().orderBy(F.desc("count"), "w").limit(topics).collect()]


def topic_of(text: Column, topics: list[str]) -> Column:
    """The learned topic that a text holds most often."""
    if not topics:
        return F.lit(NONE)
    hits = F.filter(words(text), lambda w: w.isin(topics))
    best = lambda h: F.array_min(F.transform(F.array_distinct(h), lambda x: F.struct((-F.size(F.filter(h, lambda y: y == x))).alias("n"), x.alias("w"))))["w"]
    return F.coalesce(let(hits, best), F.lit(NONE))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def draw_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def with_targets(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict[str, float] | None] | None, alpha: float) -> tuple[DataFrame, float]:
    """cells with t_<margin>, the target share of each cell's class; and all tokens."""
    total = float(cells.agg(F.sum("w0")).first()[0] or 0)
    out = cells
    for m in margins:
        given = (targets or {}).get(m)
        if given is None:
            share = lambda part: F.pow(part / F.lit(max(total, 1.0)), F.lit(alpha))
            norm = cells.groupBy(m).agg(F.sum("w0").cast("double").alias("s")).agg(F.sum(share(F.col("s")))).first()[0] or 1.0
            out = out.withColumn(f"t_{m}", share(F.sum("w0").over(Window.partitionBy(m)).cast("double")) / F.lit(norm))
        else:
            all_ = sum(given.values())
            pairs = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(v / all_))))
            out = out.withColumn(f"t_{m}", F.coalesce(F.element_at(pairs, F.col(m)), F.lit(0.0)))
    return out, total


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, targets: dict[str, dict[str, float] | None] | None = None, alpha: float = 0.7, tolerance: float = 1e-10, rounds: int = 6, most: int = 20) -> tuple[DataFrame, float]:
    """cells: the margins and w0 (tokens), one row per cell. The cells with w, w0 raked to the target of each margin, and the largest gap between a class's share and its target.

    The gap is measured after each `rounds` rounds, `most` times at most.
    """
    aimed, total = with_targets(cells, margins, targets, alpha)
    now = materialize(aimed.withColumn("w", F.col("w0").cast("double")), "raked")
    gap = float("inf")
    for _ in range(most):
        out = now
        for _ in range(rounds):
            for m in margins:
                got = F.sum("w").over(Window.partitionBy(m))
                out = out.withColumn("w", F.when(got > 0, F.col("w") * F.col(f"t_{m}") * F.lit(total) / got).otherwise(0.0))
        now, before = materialize(out, "raked"), gap
        off = [now.groupBy(m).agg(F.abs(F.sum("w") / F.lit(max(total, 1.0)) - F.first(f"t_{m}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for m in margins]
        gap = max(off)
        if gap < tolerance or gap > 0.5 * before:
            break
    return now.select(*margins, "w0", "w", *(f"t_{m}" for m in margins)), gap


def probabilities(raked: DataFrame, keep: float, most: int = 50) -> DataFrame:
    """Adds p: the chance of each document of a cell, so that `keep` of all tokens is expected, as far as p <= 1 allows."""
    f = F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(F.lit(0.0))
    budget = float(raked.agg(F.sum("w0")).first()[0] or 0) * keep
    scale, capped = keep, -1
    for _ in range(most):  # cells once capped stay so, since the scale only grows
        full = f * F.lit(scale) >= 1
        sums = raked.agg(F.count_if(full), F.sum(F.when(full, F.col("w0"))), F.sum(F.when(~full, F.col("w0") * f))).first()
        if sums[0] == capped or not sums[2]:
            break
        capped, scale = sums[0], max(scale, (budget - (sums[1] or 0)) / sums[2])
    return raked.withColumn("p", F.when(F.col("w0") > 0, F.least(F.lit(1.0), f * F.lit(scale))).otherwise(F.lit(1.0)))


def with_margins(docs: DataFrame, more: list[Column], topic: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """The margins, n_tokens, cell (the margins as one key) and more, for each row."""
    text, none = F.col("text"), F.lit(NONE)
    of = F.coalesce(F.col(f"`{topic}`").cast("string"), none) if topic else form_of(text) if topics is None else topic_of(text, topics)
    out = docs.select(*more, F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), of.alias("topic"), n_words(text).alias("n_tokens"))
    return out.withColumn("cell", F.to_json(F.array(*MARGINS)))


def cells_of(rows: DataFrame) -> DataFrame:
    """rows of `with_margins`. The written cells: margins, cell, n (rows) and w0 (tokens)."""
    return materialize(rows.groupBy(*MARGINS, "cell").agg(F.sum("n_tokens").alias("w0"), F.count("*").alias("n")), "cells")


def join_cells(rows: DataFrame, chance: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with w0, w and p of their cells; few cells or hot ones are broadcast (see spread_join)."""
    facts = cells.select(*MARGINS, "cell", "n").join(chance.select(*MARGINS, "w0", "w", "p"), list(MARGINS)).select("cell", "n", "w0", "w", "p")
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    if count <= FEW_CELLS:
        return rows.join(F.broadcast(facts.drop("n")), "cell", "left").drop("cell")
    return spread_join(rows, materialize(facts, "chances"), "cell", total).drop("cell")


#: Cells that are broadcast as a whole; beyond, only the hot ones are.
FEW_CELLS = 50_000


def mixing_table(docs: DataFrame, keep: float = 0.5, targets=None, alpha: float = 0.7, seed: int = 7, topic: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """doc_id, margins, n_tokens, the raked weight of one token of its cell, prob and sampled, for each document."""
    rows = with_margins(docs, [F.col("doc_id"), draw_key(F.col("doc_id"), F.col("text")).alias("draw")], topic, topics)
    cells = cells_of(rows)
    joined = join_cells(rows, probabilities(rake(cells.drop("cell", "n"), MARGINS, targets, alpha)[0], keep), cells)
    return joined.select("doc_id", *MARGINS, "n_tokens", F.round(F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(0.0), 6).alias("weight"), F.round("p", 6).alias("prob"), (uniform(F.col("draw"), seed) < F.round("p", 6)).alias("sampled"))


def mixing_report(docs: DataFrame, targets=None, alpha: float = 0.7, topic: str | None = None) -> tuple[DataFrame, float]:
    """margin, value, present, target and raked share of each class, and the largest gap that raking left."""
    raked, gap = rake(cells_of(with_margins(docs, [], topic)).drop("cell", "n"), MARGINS, targets, alpha)
    every = raked.agg(F.sum("w0").alias("all0"), F.sum("w").alias("all"))
    parts = [raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("w0").alias("a"), F.first(f"t_{m}").alias("target"), F.sum("w").alias("b")) for m in MARGINS]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2]).crossJoin(F.broadcast(every))  # one row of totals
    return both.select("margin", "value", (F.col("a") / F.col("all0")).alias("present"), "target", (F.col("b") / F.col("all")).alias("raked")), gap


def sample_mixture(docs: DataFrame, keep: float = 0.8, targets=None, alpha: float = 0.7, seed: int = 7, topic: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """The drawn documents with all their columns: `keep` of all tokens is expected, in the raked shares.

    A cell whose raked weight is more than it has gives documents more than once: each p times, rounded
    down or up by the draw, so no cell is capped and none falls short. Cells without tokens give each document once.
    """
    held = with_margins(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")], topic, topics)
    cells = cells_of(held.drop("row"))
    raked = rake(cells.drop("cell", "n"), MARGINS, targets, alpha)[0]
    chance = raked.withColumn("p", F.when(F.col("w0") > 0, F.col("w") / F.col("w0") * keep).otherwise(F.lit(1.0)))
    joined = join_cells(held, chance, cells)
    whole = F.floor("p").cast("int")
    times = whole + F.coalesce(uniform(draw_key(F.col("row.doc_id"), F.col("row.text")), seed) < F.col("p") - whole, F.lit(False)).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def oracle_ctes(table: str, keep: float, alpha: float = 0.7, rounds: int = 30, cap_rounds: int = 12) -> str:
    """DuckDB CTEs that end in `chance` (the margins, w0, w, p) for the documents in `table`."""
    by = ", ".join(MARGINS)
    steps = [
        f"""mm AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS draw, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '://') THEN 'contact'
  WHEN contains(coalesce(text, ''), chr(123)) OR contains(coalesce(text, ''), '=') THEN 'code' WHEN length(coalesce(text, '')) > 4000 THEN 'long prose' ELSE 'prose' END AS topic,
  len([x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''])::BIGINT AS n_tokens FROM {table})""",
        f"cells AS (SELECT {by}, sum(n_tokens)::BIGINT AS w0 FROM mm GROUP BY {by})",
    ]
    shares = []
    for m in MARGINS:
        steps.append(f"r_{m} AS (SELECT {m}, pow(sum(w0)::DOUBLE / (SELECT sum(w0) FROM cells), {alpha}) AS r FROM cells GROUP BY {m})")
        shares.append(f"(SELECT r / (SELECT sum(r) FROM r_{m}) FROM r_{m} WHERE r_{m}.{m} = cells.{m}) AS t_{m}")
    steps.append(f"k0 AS MATERIALIZED (SELECT {by}, w0, w0::DOUBLE AS w, (SELECT sum(w0)::DOUBLE FROM cells) AS every, {', '.join(shares)} FROM cells)")
    k = 0
    keepers = ", ".join(["w0", "every", *(f"t_{m}" for m in MARGINS)])
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"k{k + 1} AS MATERIALIZED (SELECT {by}, {keepers}, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * t_{m} * every / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w FROM k{k})")
            k += 1
    steps.append(f"p0 AS (SELECT {by}, w0, w, every, CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END AS f, least(1.0, CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END * {keep}::DOUBLE) AS p FROM k{k})")
    for i in range(cap_rounds):
        steps.append(f"""c{i} AS MATERIALIZED (SELECT *, sum(CASE WHEN p >= 1 THEN w0 ELSE 0 END) OVER () AS filled, sum(CASE WHEN p < 1 THEN w0 * f ELSE 0.0 END) OVER () AS rest FROM p{i})""")
        steps.append(f"p{i + 1} AS (SELECT {by}, w0, w, every, f, CASE WHEN p >= 1 THEN 1.0 ELSE least(1.0, f * CASE WHEN rest > 0 THEN (every * {keep}::DOUBLE - filled) / rest ELSE 0 END) END AS p FROM c{i})")
    steps.append(f"chance AS (SELECT {by}, w0, w, CASE WHEN w0 > 0 THEN p ELSE 1.0 END AS p FROM p{cap_rounds})")
    return ",\n".join(steps)


def uniform_sql(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {key}::VARCHAR, '{seed}')), 1, 12))::BIGINT / {float(1 << 48)}::DOUBLE)"


ORACLE_SQL = f"""
WITH {oracle_ctes('documents', 0.5)}
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END, 6) AS weight, round(p, 6) AS prob, {uniform_sql('draw', 7)} < round(p, 6) AS sampled
FROM mm JOIN chance USING (source, lang, topic)
"""
