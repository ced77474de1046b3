"""Model calls as columns and tables, with deterministic stand-ins: embeddings, verdicts with retries, classification, gate stepping.

A model is a function from a table of requests to the same rows with an answer, so a real one is a pandas UDF that calls
out, and the rules here stand in for it where none is there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import text as tx
from sparkloom.operators import review as rv
from sparkloom.storage import written

DIMENSIONS = 384
# --- fixed values ---------------------------------------------------------------
#: Calls and temperature by route.
CALLS = {"FAST_TRACK": (1, 0.0), "DEEP_REASON": (3, 0.3), "GAP_CONFIRM": (1, 0.0)}
RETRIES = 3
NO_CAPABILITY = "No matching D365 capability found in knowledge base."
PHASE_OF_GATE = {2: "RAG", 3: "Matching", 4: "Classification"}
# --------------------------------------------------------------------------------
#: Longest prompt that is sent, in characters.
PROMPT_LIMIT = 600_000


def hashed_words(texts: pd.Series, dimensions: int = DIMENSIONS) -> pd.Series:
    """A stand-in for an embedding model: counts of the lower-cased words by hash, of length 1; a text without words is the zero vector."""
    place: dict[str, int] = {}
    out = []
    for text in texts:
        v = np.zeros(dimensions)
        for w in re.findall(r"\w+", (text or "").lower()):
            if w not in place:
                place[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
            v[place[w]] += 1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32))
    return pd.Series(out)


def embedding(text: Column, encode: Callable[[pd.Series], pd.Series] = hashed_words) -> Column:
    """The vector of each text, in batches; `encode` maps a series of texts to a series of float lists (MDL9)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return encode(texts)

    return embed(text)


def embedded(text: Column, encode: Callable[[pd.Series], pd.Series] = hashed_words) -> Column:
    """struct<vec, error>: as `embedding`, but where the encoder fails on a batch its halves are tried, so that only the texts that it can't take have an error (SNK7)."""

    def attempt(texts: pd.Series) -> list[tuple]:
        try:
            got = list(encode(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return [(v, None) for v in got]
        except Exception as e:  # the text that fails is told, the others go on
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:200])]
            half = len(texts) // 2
            return attempt(texts[:half]) + attempt(texts[half:])

    @F.pandas_udf("struct<vec:array<float>,error:string>")
    def embed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(attempt(texts) if len(texts) else [], columns=["vec", "error"])

    return embed(text)


def write_back(verdicts: DataFrame, text: str, encode: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """The decisions that may be stored, with their embedding; a blank text, or one that the encoder fails on, gets none and is marked, and the others go on (SNK6, SNK7)."""
    rows = rv.writable(verdicts)
    filled = tx.strip(tx.text_or_empty(F.col(text))) != ""
    some = rows.filter(filled).withColumn("__e", embedded(F.col(text), encode)).withColumn("embedding", F.col("__e.vec")).withColumn("error", F.col("__e.error")).drop("__e")
    none = rows.filter(~filled).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("error", F.lit("no text to embed"))
    return some.unionByName(none)


def requests(rows: DataFrame) -> DataFrame:
    """One row per call: as many as the route asks for, at its temperature; none where there is no capability (MDL3). rows: atom_id, route, n_capabilities, prompt."""
    calls, heat = F.lit(1), F.lit(0.0)
    for route, (n, t) in CALLS.items():
        calls, heat = F.when(F.col("route") == route, n).otherwise(calls), F.when(F.col("route") == route, t).otherwise(heat)
    some = rows.filter("n_capabilities > 0").withColumn("temperature", heat)
    return some.withColumn("call_no", F.explode(F.sequence(F.lit(1), calls)))


def ask(calls: DataFrame, model: Callable[[DataFrame], DataFrame], retries: int = RETRIES, limit: int = PROMPT_LIMIT) -> DataFrame:
    """The calls with ok, verdict, confidence, rationale, error, attempts and wait_s (MDL10).

    model: adds ok, retryable, verdict, confidence, rationale to rows with `attempt`. A prompt of `limit` characters
    or more is refused and not sent. Failed calls that may be retried are sent again, at most `retries` times in all; wait_s is
    the back-off (1, 2, 4, ... seconds) that goes before the last attempt. Each attempt is written, so no call is made twice.
    """
    answer = ["ok", "verdict", "confidence", "rationale"]
    long = F.char_length("prompt") >= limit
    none = [F.lit(False).alias("ok"), *(F.lit(None).cast(t).alias(c) for c, t in zip(answer[1:], ("string", "double", "string")))]
    done = [calls.filter(long).select(*calls.columns, *none, F.lit("prompt too large").alias("error"), F.lit(0).alias("attempts"), F.lit(0).alias("wait_s"))]
    todo = calls.filter(~F.coalesce(long, F.lit(False)))
    for attempt in range(1, retries + 1):
        got = written(model(todo.withColumn("attempt", F.lit(attempt))), "answers")
        again = ~F.col("ok") & F.col("retryable") & F.lit(attempt < retries)
        error = F.when(~F.col("ok"), F.when(F.col("retryable"), "retries exhausted").otherwise("refused"))
        done.append(got.filter(~again).select(*calls.columns, *answer, error.alias("error"), F.lit(attempt).alias("attempts"), F.lit((1 << (attempt - 1)) - 1).alias("wait_s")))
        todo = got.filter(again).select(*calls.columns)
    return reduce(DataFrame.unionByName, done)


def classified(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows with classification, confidence, rationale, calls_used and caveats (PIP4).

    Without a capability a row is a GAP of confidence 0 and needs no call (DTJ11). One call: its verdict, else REVIEW_REQUIRED. Three:
    the verdict of two or more, with the confidence of the first call that gave it (AGG8). Personal data in the answer is
    noted in the caveats (TXT12), and the verdict is held against the best score (MTH12). rows: atom_id, route, n_capabilities, top_score.
    """
    each = answers.filter("ok").groupBy("atom_id").agg(F.array_sort(F.collect_list(F.struct("call_no", "verdict", "confidence", "rationale"))).alias("__good"))  # as many as calls
    good = F.coalesce(F.col("__good"), F.array().cast(each.schema["__good"].dataType))
    out = rows.join(each, "atom_id", "left").withColumn("__good", good)
    of = lambda v: F.filter("__good", lambda y: y["verdict"] == v)
    best = F.array_max(F.transform("__good", lambda x: F.struct(F.size(of(x["verdict"])).alias("n"), (-F.get(of(x["verdict"]), F.lit(0))["call_no"]).alias("c"), x["verdict"].alias("v"))))
    major = F.when(best["n"] >= 2, best["v"]).otherwise("REVIEW_REQUIRED")
    single = F.get(F.filter("__good", lambda y: y["call_no"] == 1), F.lit(0))["verdict"]
    verdict = F.when(F.col("n_capabilities") <= 0, "GAP").when(F.col("route") == "DEEP_REASON", F.coalesce(major, F.lit("REVIEW_REQUIRED"))).otherwise(F.coalesce(single, F.lit("REVIEW_REQUIRED")))
    out = out.withColumn("__verdict", verdict).withColumn("__said", F.get(of(F.col("__verdict")), F.lit(0))).withColumn("__votes", F.size("__good"))
    none = F.col("n_capabilities") <= 0
    said = F.when(none, NO_CAPABILITY).otherwise(F.col("__said.rationale"))
    found = F.map_filter(tx.pii_counts(said), lambda _, n: n > 0)
    caveat = F.when(F.size(found) > 0, F.concat(F.lit("G11: "), F.array_join(F.array_sort(F.map_keys(found)), ", ")))
    sane = F.when(none, F.col("__verdict")).otherwise(scores.sane_verdict(F.col("__verdict"), F.col("top_score")))
    return out.select(
        *rows.columns, sane.alias("classification"), F.when(none, 0.0).otherwise(F.coalesce("__said.confidence", F.lit(0.0))).alias("confidence"), said.alias("rationale"),
        F.coalesce("__votes", F.lit(0)).cast("long").alias("calls_used"), caveat.alias("caveats"),
    )


def classify(rows: DataFrame, model: Callable[[DataFrame], DataFrame], retries: int = RETRIES, limit: int = PROMPT_LIMIT) -> DataFrame:
    """Phase 4 over matched atoms: calls by route, retries, votes, checks (PIP4)."""
    return classified(rows, written(ask(requests(rows), model, retries, limit), "calls"))


def rule_model(calls: DataFrame) -> DataFrame:
    """A stand-in for the verdict model: decided by the hash of atom and call. A seventh of the calls is refused, a fifth of the others fails once."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("atom_id").cast("string"), F.col("call_no").cast("string"))), 1, 6), 16, 10).cast("long")
    refused, shaky = h % 7 == 0, (h % 5 == 0) & (F.col("attempt") == 1)
    verdict = F.element_at(F.array(F.lit("FIT"), F.lit("PARTIAL_FIT"), F.lit("GAP")), (h % 3 + 1).cast("int"))
    mail = F.when(h % 11 == 0, F.lit(" ask a.person@example.org")).otherwise("")
    return calls.withColumn("ok", ~refused & ~shaky).withColumn("retryable", ~refused).withColumn("verdict", verdict).withColumn("confidence", (h % 100) / 100).withColumn("rationale", F.concat(F.lit("by rule"), mail))


def step_gates(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Each batch that waits at a gate goes on by one phase (PIP7).

    batches: batch_id, status (gate_1 ... gate_4), n_flagged. rows: batch_id, one row per atom. After gates 1 to 3 the batch waits at the
    next one, whose event names the phase that ran and the atoms; after gate 4 it is complete, or in review where atoms are flagged.
    Batches with another status stay.
    """
    gate = F.regexp_extract("status", r"^gate_([1-4])$", 1).try_cast("int")
    atoms = rows.groupBy("batch_id").agg(F.count("*").alias("atoms_count"))
    out = batches.withColumn("__gate", gate).join(atoms, "batch_id", "left")
    after = F.when(F.col("__gate") < 4, F.concat(F.lit("gate_"), (F.col("__gate") + 1).cast("string"))).when(F.col("__gate") == 4, F.when(F.col("n_flagged") > 0, "review_required").otherwise("complete")).otherwise(F.col("status"))
    phase = F.element_at(F.create_map(*(F.lit(x) for kv in PHASE_OF_GATE.items() for x in kv)), F.col("__gate") + 1)
    return out.select("batch_id", "status", after.alias("status_after"), F.when(F.col("__gate") < 4, phase).alias("phase_name"), F.when(F.col("__gate") < 4, F.coalesce("atoms_count", F.lit(0))).cast("long").alias("atoms_count"))
