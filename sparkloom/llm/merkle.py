"""Document fingerprints as Merkle trees, in DataFrame functions only.

Tree: root <- sections (ended by blank lines) <- paragraphs (ended by \\n) <- runs of up to
`run_words` words with the white space after them. The runs join to the text, so the root is
equal exactly for equal texts (up to hash collisions). Each level hashes the digests below it. The
fingerprint is the root's digest (64 hex digits), then "-", then the tree below it in units of 8 hex digits: the
first digits of each run's digest, a unit of zeros at the end of each paragraph and one more at the end of
each section. `branches` reads the tree back, with a digest for each section and paragraph; `differing`
descends from two differing roots through the branches that differ and gives the runs of the
first that the second hasn't there; `locate_edits` turns these into places in the text.

Likeness of two fingerprints: 1 if the roots agree, else the Dice coefficient of their sets of runs.
Defined results: a null text counts as empty, an empty text has one empty run; repeated rows each
keep their row, in order of text hash; null ids come first; an empty table gives an empty result; a table of one
row is followed by itself; other columns never take part. Ids have any type with an order, and are ordered as that type: strings as strings. Rows of one id
and text are in one block. `differing` of a null fingerprint is null; to `locate_edits` a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import let

RUN_WORDS = 4
UNIT = 8
#: The unit at the end of a paragraph or section, and what stands for a run whose digest begins with it.
MARK, FIRST = "0" * UNIT, "0" * (UNIT - 1) + "1"
#: Bounds that are looked up by binary search, and blocks whose first rows are broadcast, at most.
MOST_CUTS, MOST_BROADCAST = 8192, 65536
#: Sampled rows for each bound; blocks in a span.
OVERSAMPLE, SPAN = 10, 4096


def _runs(paragraph: Column, run_words: int) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(rf"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{1,{run_words}}}+|[\x20\x09-\x0D]++|^$"), F.lit(0))


def tree(text: Column, run_words: int = RUN_WORDS) -> Column:
    """array (sections) of array (paragraphs) of array (leaf digests, md5)."""
    t = F.coalesce(text, F.lit(""))
    return F.transform(F.split(t, r"(?<=\n\n)(?!\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), lambda p: F.transform(_runs(p, run_words), lambda x: F.md5(x))))


def root(nodes: Column) -> Column:
    sections = F.transform(nodes, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.md5(F.array_join(p, ","))), ";")))
    return F.sha2(F.array_join(sections, "|"), 256)


def packed(text: Column, run_words: int = RUN_WORDS) -> Column:
    """The fingerprint as binary, half as long."""

    def unit(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit(MARK)), F.lit(FIRST)).otherwise(F.substring(x, 1, UNIT))

    def of(nodes: Column) -> Column:
        paragraph = lambda p: F.concat(F.array_join(F.transform(p, unit), ""), F.lit(MARK))
        section = lambda s: F.concat(F.array_join(F.transform(s, paragraph), ""), F.lit(MARK))
        return F.unhex(F.concat(root(nodes), F.array_join(F.transform(nodes, section), "")))

    return let(tree(text, run_words), of)


def unpacked(raw: Column) -> Column:
    """The fingerprint of its binary form."""
    return let(F.lower(F.hex(raw)), lambda h: F.concat(F.substring(h, 1, 64), F.lit("-"), F.substring(h, 65, 1 << 30)))


def fingerprint(text: Column, run_words: int = RUN_WORDS) -> Column:
    return unpacked(packed(text, run_words))


def _units(print_: Column) -> Column:
    return F.regexp_extract_all(F.substring(print_, 66, 1 << 30), F.lit(f".{{{UNIT}}}"), F.lit(0))


def leaves(print_: Column) -> Column:
    """The distinct digests of runs in a fingerprint."""
    return F.array_remove(F.array_distinct(_units(print_)), MARK)


def branches(print_: Column) -> Column:
    """array (sections) of struct<digest, paragraphs: array of struct<digest, runs: array of digests>>, read from a fingerprint."""
    spelt = F.regexp_replace(F.array_join(_units(print_), ","), f"{MARK},{MARK}(,|$)", "/")  # sections end with /
    parts = lambda x, end: F.filter(F.split(x, end), lambda y: y != "")
    paragraph = lambda p: let(parts(p, ","), lambda runs: F.struct(F.md5(F.array_join(runs, ",")).alias("digest"), runs.alias("runs")))
    section = lambda s: let(F.transform(parts(s, f"{MARK}(?:,|$)"), paragraph), lambda ps: F.struct(F.md5(F.array_join(F.transform(ps, lambda p: p["digest"]), ";")).alias("digest"), ps.alias("paragraphs")))
    return F.transform(parts(spelt, "/"), section)


def differing(a: Column, b: Column) -> Column:
    """array of struct<section, paragraph, run> (from 0; run counts within its paragraph): the runs of fingerprint a that b lacks in the branches in which they differ."""

    def descend(x: Column, y: Column) -> Column:
        digests = lambda nodes: F.transform(nodes, lambda n: n["digest"])
        below = lambda sections: F.flatten(F.transform(sections, lambda s: s["paragraphs"]))
        open_y = lambda ys: F.filter(y, lambda s: ~F.array_contains(ys, s["digest"]))
        there = open_y(digests(x))  # sections of b that a hasn't
        lacking = F.filter(below(there), lambda p: ~F.array_contains(digests(below(x)), p["digest"]))
        runs = F.flatten(F.transform(lacking, lambda p: p["runs"]))

        def in_paragraph(p, si, pi):
            some = F.filter(F.transform(p["runs"], lambda r, i: F.struct(F.lit(si).alias("section"), F.lit(pi).alias("paragraph"), i.alias("run"), r.alias("digest"))), lambda r: ~F.array_contains(runs, r["digest"]))
            return F.when(F.array_contains(digests(below(there)), p["digest"]), F.filter(some, lambda r: F.lit(False))).otherwise(some)

        def in_section(s, si):
            found = F.flatten(F.transform(s["paragraphs"], lambda p, pi: in_paragraph(p, si, pi)))
            return F.when(F.array_contains(digests(y), s["digest"]), F.filter(found, lambda r: F.lit(False))).otherwise(found)

        return F.transform(F.flatten(F.transform(x, in_section)), lambda r: F.struct(r["section"].alias("section"), r["paragraph"].alias("paragraph"), r["run"].alias("run")))

    found = let(F.struct(branches(a).alias("a"), branches(b).alias("b")), lambda t: descend(t["a"], t["b"]))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.filter(found, lambda r: F.lit(False))).otherwise(found)


def locate_edits(pairs: DataFrame, text: str = "text", other: str = "other", run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of pairs with edits: array of struct<at, size>, the places (in code points) of the runs of `text` that the fingerprint of `other` lacks in differing branches."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sizes = F.transform(F.split(t, r"(?<=\n\n)(?!\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), lambda p: F.transform(_runs(p, run_words), F.char_length)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)

    def place(n: Column) -> Column:
        def of(d: Column) -> Column:
            section, paragraph = F.get(n, d["section"]), F.get(F.get(n, d["section"]), d["paragraph"])
            before = total(F.flatten(F.flatten(F.slice(n, F.lit(1), d["section"])))) + total(F.flatten(F.slice(section, F.lit(1), d["paragraph"]))) + total(F.slice(paragraph, F.lit(1), d["run"]))
            return F.struct(before.alias("at"), F.get(paragraph, d["run"]).alias("size"))

        return F.transform(differing(fingerprint(t, run_words), fingerprint(F.coalesce(F.col(f"`{other}`"), F.lit("")), run_words)), of)

    return pairs.withColumn("edits", let(sizes, place))


def _dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) > 0, F.size(F.array_intersect(a, b)) * 2.0 / (F.size(a) + F.size(b))).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(_dice(leaves(a), leaves(b)))


def _cuts(held: DataFrame, n: int, tops: int) -> tuple[list[str], Column]:
    """The bounds as JSON, and as an array of struct<i, h>: they part the rows into `tops` blocks of about one size, in the order of ids and text hashes. From a sample of OVERSAMPLE rows a block, drawn by hash."""
    share = int(min(1.0, OVERSAMPLE * tops / max(n, 1)) * (1 << 30))
    sample = held.filter(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(1 << 30)) < share).select(F.col("doc_id").alias("i"), "h")
    rows = sample.orderBy(F.col("i").asc_nulls_first(), "h").select(F.to_json(F.struct("i", "h")).alias("j")).collect() if tops > 1 else []  # OVERSAMPLE * tops, about
    some = list(dict.fromkeys(rows[len(rows) * k // tops]["j"] for k in range(1, tops))) if rows else []
    return some, F.from_json(F.lit("[" + ",".join(some) + "]"), f"array<struct<i:{held.schema['doc_id'].dataType.simpleString()},h:bigint>>")


def with_next(docs: DataFrame, values: dict[str, Column], block_rows: int = 1500, most_cuts: int = MOST_CUTS) -> DataFrame:
    """doc_id, the values of each row, and `next`: a struct of the values of the row after it by ascending doc_id, then text hash.

    After the last row comes the first; null ids come first. The order is that of the id's own type. Rows are dealt to blocks between bounds of (id, text
    hash), so rows of one id, or without one, can be in several blocks. There are `most_cuts` bounds at most; where a table has more rows than that makes
    blocks of `block_rows`, numeric ids are parted further, into equal ranges, and with other types blocks have more rows. Neighbours within a block
    come from a window, and the one row at each block's end gets its successor from the next block.
    """
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n = held.count()
    wanted = max(1, n // block_rows)
    tops = min(most_cuts, wanted)
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    parts = -(-wanted // tops) if numeric else 1
    found, cuts = _cuts(held, n, tops)
    here = F.struct(F.col("doc_id").alias("i"), F.col("h").alias("h"))
    block = F.lit(0).cast("long")
    if found:
        steps = F.array(*(F.lit(1 << k) for k in range(len(found).bit_length() - 1, -1, -1)))
        # the number of cuts not above the row, by binary search
        block = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.coalesce(F.get(cuts, acc + s - 1) <= here, F.lit(False)), acc + s).otherwise(acc)).cast("long")
    if parts > 1:
        low, high = (x if x is not None else 0 for x in held.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first())

        def within(t: Column) -> Column:
            begin, end = (F.coalesce(F.get(cuts, k)["i"].cast("double"), F.lit(x)) for k, x in ((t - 1, float(low)), (t, float(high) + 1)))
            part = F.floor((F.col("doc_id").cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)) * parts)
            return t * parts + F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))).cast("long")

        block = let(block, lambda t: within(t.cast("int")))
    held = held.withColumn("block", block)
    order = [F.col("doc_id").asc_nulls_first(), "h"]
    named = F.struct(*(c.alias(k) for k, c in values.items()))
    rows = held.select("doc_id", "h", "block", *(c.alias(k) for k, c in values.items())).withColumn("next", F.lead(F.struct(*values)).over(Window.partitionBy("block").orderBy(*order)))
    least = held.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("m")).select(F.col("block").alias("b"), "m")
    least = F.broadcast(least) if wanted <= MOST_BROADCAST else least  # one row per block
    hit = held.join(least, (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("h") == F.col("m.h")))
    firsts = hit.dropDuplicates(["b"]).select("b", named.alias("head"))
    heads = _after(firsts.select("b")).join(firsts.withColumnRenamed("b", "to"), "to").select("b", "head")
    return rows.join(heads, rows["block"] == heads["b"], "left").select("doc_id", *values, F.coalesce("next", "head").alias("next"))


def _after(blocks: DataFrame) -> DataFrame:
    """b, to: the next block of each, and the first after the last. Windows run over spans of block numbers; only a row for each span, that is for SPAN blocks, comes to one task."""
    spans = blocks.withColumn("span", F.expr(f"b div {SPAN}"))
    own = spans.withColumn("near", F.lead("b").over(Window.partitionBy("span").orderBy("b")))
    one = Window.partitionBy(F.lit(1)).orderBy("span")
    least = spans.groupBy("span").agg(F.min("b").alias("least"))
    far = least.select("span", F.coalesce(F.lead("least").over(one), F.first("least").over(one.rowsBetween(Window.unboundedPreceding, 0))).alias("far"))
    return own.join(far, "span").select("b", F.coalesce("near", "far").alias("to"))


def fingerprint_table(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced by the start of the next document), and their likeness."""
    text = F.coalesce("text", F.lit(""))
    rows = with_next(docs, {"body": text, "raw": packed(text, run_words)}).withColumn("n", F.char_length("body").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = rows.select("doc_id", "n", unpacked(F.col("raw")).alias("print"), unpacked(F.col("next.raw")).alias("next_print"), F.concat(F.substring("body", F.lit(1), (F.col("n") - half).cast("int")), F.substring(F.col("next.body"), F.lit(1), half)).alias("edited"))
    marked = edited.select("doc_id", "n", "print", "next_print", F.sha2("edited", 256).alias("sha"), fingerprint(F.col("edited"), run_words).alias("edited_print"))
    return marked.select(
        "doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
