"""Which texts hold which patterns, without comparing each text with each pattern (JON10, JON11, TXT6, FLT17).

Few patterns (their size is checked) go to every worker as one automaton, which reads a text once for all of them. More are met through
anchors: a pattern's anchor is the run of GRAM characters of least hash within its first 2**j characters, the largest power of two that it has. A text
gives such an anchor for each window of that length, so whoever holds the pattern holds its anchor; runs of windows share theirs, so these are few.
Patterns shorter than GRAM are their own anchors. Pairs that share an anchor are then compared as texts, so hashes only choose.

Case and outer spaces don't count; blank texts and patterns hold nothing and are in nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import written

#: Characters of an anchor; characters of all patterns that an automaton is made of, at most.
GRAM, AUTOMATON = 8, 8_000_000


def _clean(column: str):
    return F.lower(F.trim(F.col(column)))


def _sized(rows: DataFrame, id: str, text: str) -> DataFrame:
    return rows.select(F.col(id).alias("id"), _clean(text).alias("t")).filter("t <> ''")


def contained(patterns: DataFrame, texts: DataFrame, pattern_id: str, pattern: str, text_id: str, text: str, most: int = AUTOMATON) -> DataFrame:
    """pattern_id, text_id of the patterns that a text holds, each pair once. Ids name rows: rows of one id count as one."""
    held = written(_sized(patterns, pattern_id, pattern), "patterns")
    distinct = held.select("t").distinct()
    size = distinct.agg(F.sum(F.char_length("t") + 16)).first()[0] or 0
    rows = _sized(texts, text_id, text)
    kind = rows.schema["id"].dataType.simpleString()
    found = _by_automaton(distinct, rows, kind) if size <= most else _by_anchors(distinct, rows, kind)
    return found.join(held, "t").select(F.col("id").alias(pattern_id), F.col("tid").alias(text_id)).distinct()


def either_way(a: DataFrame, b: DataFrame, a_id: str, a_text: str, b_id: str, b_text: str, most: int = AUTOMATON) -> DataFrame:
    """a_id, b_id where either text holds the other."""
    into = contained(a, b, a_id, a_text, b_id, b_text, most).select(a_id, b_id)
    return into.unionByName(contained(b, a, b_id, b_text, a_id, a_text, most).select(a_id, b_id)).distinct()


def _by_automaton(patterns: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """t, tid. patterns: at most AUTOMATON characters of distinct texts, which the driver brings to the workers."""
    every = sorted(r["t"] for r in patterns.collect())

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in every:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            hits = [(p, i) for i, t in enumerate(batch.column("t").to_pylist()) for p in {p for _, p in machine.iter(t)}] if every else []
            at = pa.array([i for _, i in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in hits], pa.string()), batch.column("id").take(at)], ["t", "tid"])

    return texts.mapInArrow(run, f"t string, tid {kind}")


def _hashes(text: str, n: int) -> np.ndarray:
    """64-bit hashes of the n characters from each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def level(size: int) -> int:
    """The length of the window that a text of this many characters is anchored in: its own below GRAM, else the largest power of two."""
    return size if size < GRAM else 1 << size.bit_length() - 1


def anchors(text: str, window: int) -> np.ndarray:
    """The distinct anchors of all windows of a text."""
    if window < GRAM:
        return np.unique(_hashes(text, window))
    h, n, size = _hashes(text, GRAM), window - GRAM + 1, 1
    if len(h) < n:
        return h[:0]
    while size * 2 <= n:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.unique(np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h)


def _by_anchors(patterns: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    def of_patterns(batches):
        for batch in batches:
            ts = batch.column("t").to_pylist()
            windows = [level(len(t)) for t in ts]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(windows, pa.int32()), pa.array([int(anchors(t[:w], w)[0].astype(np.int64)) for t, w in zip(ts, windows)], pa.int64())], ["t", "w", "h"])

    anchored = written(patterns.mapInArrow(of_patterns, "t string, w int, h long"), "anchors")
    windows = sorted(r["w"] for r in anchored.select("w").distinct().collect())  # one for each power of two

    def of_texts(batches):
        for batch in batches:
            for i, t in enumerate(batch.column("t").to_pylist()):
                for w in windows:
                    if w <= len(t):
                        h = anchors(t, w).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.full(len(h), i))), pa.array(np.full(len(h), w, np.int32)), pa.array(h)], ["tid", "w", "h"])

    there = texts.mapInArrow(of_texts, f"tid {kind}, w int, h long")
    maybe = anchored.join(there, ["w", "h"]).select("t", "tid")
    same = maybe.join(texts.select(F.col("id").alias("tid"), F.col("t").alias("text")), "tid")
    return same.filter(F.contains("text", "t")).select("t", "tid")
