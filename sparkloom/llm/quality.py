"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Column over the measures of a document. `order_rules` draws rows by chance from the whole table
(`sample_rows`, about; they stay in Spark), measures every rule on them (its cost in
seconds, and the share it rejects) and sorts the rules by rejection per cost. `cascade` then
evaluates them in that order inside one CASE expression, so a document that an early rule rejects
never pays for the later ones. The order decides cost only: a document is kept exactly when no rule
rejects it. Where some measures are wanted anyway (`quality_table`), the rules read them, and the other measures (words by
frequency, kinds of lines) are only taken of documents that the base and the rules before let through.

Defined results: a null or empty text has no words and is rejected by `too_few_words`; repeated
rows each get their own result; an empty table gives an empty result; other columns never take
part, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, discard, let, materialize, words

SYMBOLS = r"[#*$%&|<>]"
POS_BITS = 28


def word_chars(w: Column) -> Column:
    """Code points in the words."""
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def worded_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


def lines(text: Column) -> Column:
    """struct of n, the lines with a word, and dups, those of them equal to an earlier one."""
    return let(worded_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))


def _beside(a: Column, same) -> Column:
    """The elements of a sorted array that agree with a neighbour."""
    return F.filter(a, lambda x, i: F.coalesce(same(x, F.get(a, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(a, i + 1)), F.lit(False)))


def n_repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text, the first included.

    Windows are hashed and packed with their position into one long each, so that a primitive sort
    brings equal windows together; windows whose hash has a neighbour are then compared by their
    words, so the count is exact.
    """
    mask = (1 << POS_BITS) - 1

    def packed(a: Column) -> Column:
        at = F.when(F.size(a) >= 3, F.sequence(F.lit(0), F.size(a) - 3)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(at, lambda i: F.shiftleft(F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)), POS_BITS).bitwiseOR(i.cast("long"))))

    def exact(a: Column, near: Column) -> Column:
        full = F.sort_array(F.transform(near, lambda p: let((p.bitwiseAND(F.lit(mask).cast("long"))).cast("int"), lambda i: F.struct(F.get(a, i).alias("a"), F.get(a, i + 1).alias("b"), F.get(a, i + 2).alias("c"), i.alias("p")))))
        return let(full, lambda s: F.transform(_beside(s, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2)))

    def of(a: Column) -> Column:
        near = let(packed(a), lambda s: _beside(s, lambda x, y: F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS)))
        return let(near, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(let(exact(a, c), covered)))

    return let(w, of).cast("long")


def top_word(w: Column) -> Column:
    """Occurrences of the most frequent word; 0 without words. Equal words are neighbours once sorted."""

    def longest(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.coalesce(F.get(a, i) == F.get(a, i - 1), F.lit(False)))
        return let(starts, lambda p: F.array_max(F.transform(p, lambda x, i: F.coalesce(F.get(p, i + 1), F.size(a)) - x)))

    return F.when(F.size(w) > 0, let(F.sort_array(w), longest)).otherwise(0).cast("long")


#: Lines that end in an ellipsis, and that begin with a bullet.
ELLIPSIS_LINE, BULLET_LINE = r"(?m)(?:\.\.\.|\u2026)[ \t\r]*$", r"(?m)^[ \t]*[-*\u2022\u2023\u00B7] "


def n_lines_like(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


class Measures:
    """The measures of a document, each an expression over its text and words unless a column already holds it."""

    def __init__(self, text: Column, words: Column, known: dict[str, Column] | None = None):
        self.text, self.words, self.known = text, words, known or {}

    def __getattr__(self, name: str) -> Column:
        made = {
            "n_words": lambda: F.size(self.words).cast("long"), "word_chars": lambda: word_chars(self.words), "n_symbols": lambda: n_symbols(self.text),
            "lines": lambda: lines(self.text), "n_repeat_words": lambda: n_repeat_words(self.words), "top_word": lambda: top_word(self.words),
            "n_ellipsis_lines": lambda: n_lines_like(self.text, ELLIPSIS_LINE), "n_bullet_lines": lambda: n_lines_like(self.text, BULLET_LINE),
        }
        if name not in made:
            raise AttributeError(name)
        return self.known[name] if name in self.known else made[name]()


#: Largest text, in bytes, that the sample takes; the order of rules needs no larger ones.
SAMPLE_BYTES = 256 << 10


@dataclass(frozen=True)
class Rule:
    """`rejects(measures)` is true for a document to be rejected."""

    name: str
    rejects: Callable[[Measures], Column]


def default_rules(min_words: int = 50, repeat_pct: int = 50, symbols_pct: int = 10, dup_lines_pct: int = 50, longest_mean: int = 15, shortest_mean: int = 2) -> list[Rule]:
    return [
        Rule("too_few_words", lambda m: m.n_words < min_words),
        Rule("repeated_words", lambda m: m.n_repeat_words * 100 > m.n_words * repeat_pct),
        Rule("symbols", lambda m: m.n_symbols * 100 > m.n_words * symbols_pct),
        Rule("duplicate_lines", lambda m: let(m.lines, lambda x: x["dups"] * 100 > x["n"] * dup_lines_pct)),
        Rule("long_words", lambda m: m.word_chars > m.n_words * longest_mean),
        Rule("short_words", lambda m: m.word_chars < m.n_words * shortest_mean),
    ]


def extra_rules(top_word_pct: int = 30, ellipsis_pct: int = 30, bullets_pct: int = 90) -> list[Rule]:
    """Rules whose measures no column of `quality_table` holds."""
    return [
        Rule("one_word", lambda m: m.top_word * 100 > m.n_words * top_word_pct),
        Rule("ellipsis_lines", lambda m: m.n_ellipsis_lines * 100 > m.lines["n"] * ellipsis_pct),
        Rule("bullet_lines", lambda m: m.n_bullet_lines * 100 > m.lines["n"] * bullets_pct),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejection per cost, estimated on about `sample_rows` rows drawn by chance (the only place that samples). The rows are written to the shared folder; the driver gets counts and times."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    total = docs.count()
    drawn = docs.select(t.alias("t")).filter((F.octet_length("t") <= SAMPLE_BYTES) & (F.rand(7) < min(1.0, sample_rows / max(1, total))))
    held = materialize(drawn, "sample")
    sample = held.coalesce(1).select("t", words(F.col("t")).alias("w")).cache()
    try:
        n = sample.count()
        every = Measures(F.col("t"), F.col("w"))

        def measure(hit: Column) -> tuple[float, int]:
            """The time of a run after the one that compiles, and the rows hit."""
            counted = sample.agg(F.count_if(hit))
            counted.first()
            began = time.perf_counter()
            got = counted.first()[0]
            return time.perf_counter() - began, got

        if not n:
            return list(rules)
        idle = measure(F.col("t").isNull())[0]
        rank = []
        for at, rule in enumerate(rules):
            took, got = measure(rule.rejects(every))
            rank.append((-(got / n) / max(took - idle, 1e-3), at))
        return [rules[at] for _, at in sorted(rank)]
    finally:
        sample.unpersist()
        discard(held)


def cascade(rules: list[Rule], measures: Measures) -> Column:
    """Name of the first rule, in the given order, that rejects the document; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(measures), F.lit(False)), rule.name).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The documents, with all their columns, that no rule rejects."""
    ordered = order_rules(docs, default_rules() if rules is None else rules, text, sample_rows)
    t, w, names = "__quality_text", "__quality_words", docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t)).withColumn(w, words(F.col(t)))
    return held.filter(cascade(ordered, Measures(F.col(t), F.col(w))).isNull()).select("row.*")


def quality_table(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each document. By default the rules are `default_rules` and `extra_rules`."""
    ordered = order_rules(docs, [r for r in (default_rules() + extra_rules() if rules is None else rules) if r.name not in BASE], "text", sample_rows)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    taken, names = Measures(F.col("t"), F.col("w")), ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")
    out = base.select("doc_id", "t", "w", *(getattr(taken, c).alias(c) for c in names))
    measures = Measures(F.col("t"), F.col("w"), {c: F.col(c) for c in names})
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = F.when(F.col("base_failed"), False).otherwise(cascade(ordered, measures).isNull())
    return out.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dups").alias("n_dup_lines"), "n_repeat_words", "base_failed", verdict.alias("kept"))


#: Rules that base_failed covers.
BASE = ("too_few_words", "repeated_words")

WORDS_SQL = r"[x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r, x),
ln AS (SELECT r, sum(n) AS lines, sum(n - 1) AS dups FROM l GROUP BY r),
tw AS (SELECT r, max(n) AS top FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
m AS (SELECT doc_id, coalesce(top, 0) AS top, len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t\r]*$')) AS dots, len(regexp_extract_all(t, '(?m)^[ \t]*[-*•‣·] ')) AS bullets, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0) AS lines
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r) LEFT JOIN tw USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 10 OR n_dup_lines * 100 > lines * 50 OR word_chars > n_words * 15 OR word_chars < n_words * 2
    OR top * 100 > n_words * 30 OR dots * 100 > lines * 30 OR bullets * 100 > lines * 90) AS kept
FROM b
"""
