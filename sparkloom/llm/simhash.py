"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into `segments` equal segments on a ring; as many as the number of fingerprints asks for, so that keys stay long enough to tell them apart (`segments_for`). If two differ in at most `most` bits,
there is a segment from which every chain of l consecutive segments differs in at most
l * most / segments bits (rounded down). Chains whose budget is 0 are the join key; the budgets of
the longer chains prune candidates before the full Hamming check.

Only distinct fingerprints are joined. A key that more than `bucket` of them share is not paired:
its fingerprints are instead linked through the values at one bit's distance (two fingerprints
within 2 bits share such a value, and at most 65 share any), which is exact and linear. Fingerprints
with 3 or more allowed bits have no such way, so `most` is at most 2.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; a null doc_id
is kept but never the id of a component that has another; repeated rows each keep their row.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import shingle_join
from .bpe import small_steps
from .common import arrow_batches, materialize, spread_join, trimmed_steps, worker_state
from .graph import components


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles, unsigned; ASCII letters are lower-cased first."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        worker_state(None, None)
        for batch in small_steps(batches, "text"):
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def budgets(segments: int, most: int) -> list[int]:
    """Bits in which chains of 1, 2, ... segments may differ."""
    return [n * most // segments for n in range(1, segments + 1)]


def key_bits(segments: int, most: int = 2) -> int:
    """Bits of a join key: of the longest chain without a budget."""
    return sum(1 for x in budgets(segments, most) if not x) * (64 // segments)


def segments_for(fingerprints: int, most: int = 2, bucket: int = 64) -> int:
    """The fewest segments, 8 at least, whose keys hold an eighth of `bucket` fingerprints each on average: 24 bits of key with 8, 28 with 16, 30 with 32, 31 with 64."""
    return next((s for s in (8, 16, 32) if fingerprints <= bucket / 8 * (1 << key_bits(s, most))), 64)


def links(fps: DataFrame, most: int = 2, segments: int | None = None, bucket: int = 64) -> DataFrame:
    """r, a, b: distinct fingerprints of one family (columns r, fp) that differ in 1 to `most` bits, or that are joined by a shared neighbour value."""
    total = fps.count()
    segments = segments or segments_for(total, most, bucket)
    if not 0 <= most <= 2 or 64 % segments:
        raise ValueError("most must be 0 to 2, and segments must divide 64")
    width, allowed = 64 // segments, budgets(segments, most)
    exact = sum(1 for x in allowed if not x)
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(_turned(F.col("fp"), i * width), 64 - exact * width).alias("key")) for i in range(segments)))
    keyed = fps.select("r", "fp", F.inline(keys)).select("r", "fp", F.struct("r", "i", "key").alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    met = spread_join(keyed, shared.withColumn("crowded", F.col("n") > bucket), "k", total * segments)  # rows of a crowded key stay where they are
    hot = met.filter("crowded").select("r", "fp").distinct()
    few = met.filter(~F.col("crowded")).groupBy("k").agg(F.collect_set("fp").alias("fps")).select("k.*", "fps").filter(F.size("fps") > 1)

    def chained(x: Column) -> Column:
        """x: the differing bits, turned so that the chain starts at the top."""
        ok = F.bit_count(x) <= most
        for n in range(segments - 1, exact, -1):
            if allowed[n - 1] < allowed[n]:  # a longer chain of the same budget says more
                ok = (F.bit_count(F.shiftrightunsigned(x, 64 - n * width)) <= allowed[n - 1]) & ok
        return ok

    turn = F.col("i") * width

    def near(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        y = F.call_function("shiftleft", x, turn).bitwiseOR(F.when(turn == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", x, F.lit(64) - turn)))
        return (a < b) & chained(y)

    pairs = few.select("r", F.inline(F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))))
    around = hot.select("r", "fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")) for k in range(64)))).alias("v"))
    beside = around.groupBy("r", "v").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = beside.select("r", "a", F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionAll(stars) if most == 2 else pairs.unionAll(stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))


def groups(docs: DataFrame, shingle: int = 3, seed: int = 42, most: int = 2, segments: int | None = None, bucket: int = 64) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links) of each row."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "values")
    many, total = fps.agg(F.count("*"), F.sum("n")).first()
    star = components(links(fps.select(F.lit(0).alias("r"), "fp"), most, segments, bucket))
    rooted = fps.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(rooted, least, "root", many).select("fp", "component_id", F.col("rows").alias("n"))
    return spread_join(marked, named, "fp", total or 0).select("doc_id", "fp", "component_id")


def near_dedup_table(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> set[bytes]:
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def similar(a: str | None, b: str | None, shingle: int = 5, least: float = 0.8) -> bool:
    """Jaccard similarity of the word shingles of at least `least`; two texts without words are alike."""
    return alike(shingle_set(a, shingle), shingle_set(b, shingle), least)


def alike(x: set, y: set, least: float) -> bool:
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


def candidates(docs: DataFrame, shingle: int = 5, seed: int = 42, most: int = 2, segments: int | None = None, bucket: int = 64) -> DataFrame:
    """u < v: documents (doc_id long) that may be near copies by their fingerprints: each with the least of its fingerprint, and the least of two that are linked."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")), "values")
    same = spread_join(marked, fps.filter("n > 1"), "fp", marked.count()).filter("u < doc_id").select("u", F.col("doc_id").alias("v"))
    near = links(fps.select(F.lit(0).alias("r"), "fp"), most, segments, bucket)
    a, b = fps.select(F.col("fp").alias("a"), F.col("u").alias("x")), fps.select(F.col("fp").alias("b"), F.col("u").alias("y"))
    both = near.join(a, "a").join(b, "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return same.unionAll(both).distinct()


#: Links that the components of near copies take in plain joins, at most: some 16 MB.
SMALL = 1_000_000
#: Bytes of a batch of pairs of texts that a Python worker gets at a time, about.
PAIR_BYTES = 16 << 20


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, star_rounds: int = 3, crowd: int = 64, crowded: int = shingle_join.CROWDED) -> DataFrame:
    """The documents, with all their columns, without copies and near copies: of each group the one of least doc_id stays.

    Texts that are equal are one text. Others are joined if the Jaccard similarity of their word shingles is
    at least `least`: first those whose fingerprints meet by pigeonring (`candidates`), each pair checked on its texts, then
    what fingerprints leave open, so that no pair is missed (see shingle_join). Rows without a doc_id stay as they are; rows
    that repeat a doc_id are one document, of which the row of least text hash stays; a null text counts as
    empty, and texts without words are alike only if equal; an empty table stays empty. Ids of other types than
    integers are numbered in their order first.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        numbers = materialize(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("__d")), "numbers")
        rows = docs.join(numbers, "doc_id", "left").select(F.col("__d").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
        return keep_one(rows, shingle, least, star_rounds, crowd, crowded).select("__row.*")
    text_hash = F.md5(F.coalesce("text", F.lit("")))
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn("__d", F.col("doc_id").cast("long"))
    hashes = materialize(known.groupBy(F.col("__d").alias("doc_id")).agg(F.min(text_hash).alias("th")), "texts")
    firsts = hashes.groupBy("th").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = materialize(spread_join(hashes, firsts.filter("n > 1"), "th", hashes.count()).filter("doc_id <> first").select("doc_id"), "copies")
    texts = known.select(F.col("__d").alias("doc_id"), "text")
    single = texts.join(copies, "doc_id", "left_anti")
    tokens = shingle_join.prefixes(single, shingle, least)
    used = tokens.select(F.col("d").alias("doc_id")).distinct()
    compared = materialize(texts.join(used, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", text_hash).alias("text")), "compared")

    def check(batches):
        worker_state(None, None)
        sets = lru_cache(16)(lambda text: shingle_set(text, shingle))
        for batch in (b for wide in small_steps(batches, "t") for b in small_steps([wide], "s")):
            ok = [alike(sets(x), sets(y), least) for x, y in zip(batch.column("t").to_pylist(), batch.column("s").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(compared.select(F.col("doc_id").alias("u"), F.col("text").alias("t")), "u").join(compared.select(F.col("doc_id").alias("v"), F.col("text").alias("s")), "v")
        return both.select("u", "v", "t", "s").mapInArrow(lambda batches: trimmed_steps(check(batches)), "a long, b long")

    with arrow_batches(docs.sparkSession, PAIR_BYTES):  # rows with two texts each
        largest, crowds = shingle_join.crowded_buckets(tokens, crowded)
        seen = materialize(candidates(single, shingle), "candidates")
        stars = components(checked(seen), SMALL)
        for salt in range(star_rounds if largest > crowd else 1):
            pairs = materialize(shingle_join.star_pairs(tokens, stars, least, salt, crowds).join(seen, ["u", "v"], "left_anti"), "candidates")
            seen = seen.unionAll(pairs)
            stars = components(checked(pairs).unionAll(stars), SMALL)
        rest = materialize(shingle_join.pairs_across(tokens, stars, least, crowds).join(seen, ["u", "v"], "left_anti"), "candidates")
        gone = components(checked(rest).unionAll(stars), SMALL).select(F.col("a").alias("__d"))
    # of rows that repeat an id, the one of least text hash stays; of equal ones, the first numbered
    once = Window.partitionBy("__d").orderBy(text_hash)
    kept = known.join(copies.select(F.col("doc_id").alias("__d")).unionAll(gone), "__d", "left_anti").withColumn("__n", F.row_number().over(once)).filter("__n = 1")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter(F.col("doc_id").isNull()))
