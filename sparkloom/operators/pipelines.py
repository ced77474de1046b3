"""Compositions of the operators: ingestion, matching, search dispatch, listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import text as tx
from sparkloom.functions.headers import token_set_ratio
from sparkloom.operators import dedup, pii, retrieval
from sparkloom.operators import relational as rel
from sparkloom.sources import files as files_

#: Confidence of a unified element by modality (fixed).
CONFIDENCE = {"TEXT": 1.0, "TABLE": 0.9, "IMAGE": 0.3}


def unify(text: DataFrame, tables: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """One stream of elements with modality and confidence (MDL5)."""
    one = lambda df, m: df.select(key, F.lit(m).alias("modality"), F.lit(CONFIDENCE[m]).alias("confidence"))
    return one(text, "TEXT").unionByName(one(tables, "TABLE")).unionByName(one(images, "IMAGE"))


def rule_atoms(rows: DataFrame, key: str, text: str, least: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """A rule in place of a model (MDL1, MDL2): each sentence of at least `least` characters is an atom; key, pos, atom, and the `keep` columns."""
    parts = rows.select(key, *keep, F.posexplode(F.split(F.col(text), r"\. ")).alias("p", "x"))
    return parts.select(key, *keep, (F.col("p") + 1).cast("long").alias("pos"), F.trim("x").alias("atom")).filter(F.char_length("atom") >= least)


def atomise(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[str]]], size: int = 10) -> DataFrame:
    """key, pos, atom, kind: what a model splits each text into, `size` texts a call (MDL1, MDL2).

    Where a call fails or answers for another number of texts, its texts are asked for one by one; a text that still fails is one
    FUNCTIONAL atom as it is.
    """
    kind = rows.schema[key].dataType.simpleString()

    def ask(texts: list[str]) -> list[tuple[list[str], str]]:
        try:
            got = model(texts)
            if len(got) == len(texts):
                return [(list(x), "MODEL") for x in got]
        except Exception:  # a failed call costs the batch, not the job
            pass
        return [([texts[0]], "FUNCTIONAL")] if len(texts) == 1 else [x for t in texts for x in ask([t])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, out = [t or "" for t in part["t"]], []
            for at in range(0, len(texts), size):
                for k, (atoms, how) in zip(part["k"][at : at + size], ask(texts[at : at + size])):
                    out += [(k, i, a, how) for i, a in enumerate(atoms, 1)]
            yield pd.DataFrame(out, columns=["k", "pos", "atom", "kind"])

    return rows.selectExpr(f"`{key}` k", f"`{text}` t").mapInPandas(run, f"k {kind}, pos long, atom string, kind string").withColumnRenamed("k", key)


def ingested(rows: DataFrame, key: str, text: str, module: Column | None = None, country: Column | None = None) -> DataFrame:
    """Injection scan, PII redaction, atoms, copies and the quality gate of each atom; blocked texts go (PIP1).

    Columns are carried from step to step, so each text is scanned and redacted once. An atom whose text an earlier atom
    has (by key, then place) is a duplicate.
    """
    of, land = F.lit("") if module is None else module, F.lit("") if country is None else country
    scanned = rows.select(key, text, of.alias("module"), land.alias("country"), tx.injection_action(tx.injection_hits(F.col(text))).alias("action")).filter("action <> 'BLOCK'")
    clean = pii.redact(scanned, key, text, keep=("module", "country", "action")).select(key, "redacted", "module", "country", "action", F.size("entities").alias("n_entities"))
    atoms = rule_atoms(clean, key, "redacted", keep=("module", "country", "action", "n_entities"))
    w = dedup.text_copies(atoms.withColumn("__place", F.struct(key, "pos")), "__place", "atom").withColumn("w", tx.tokens(F.col("atom")))
    gate = tx.quality_gate(F.col("is_copy"), tx.consistency_flag(F.col("atom"), F.col("module"), F.col("country")), tx.specificity(F.col("w")), tx.completeness(F.col("w"), F.col("module")), F.char_length("atom"))
    return w.select(key, "pos", "module", "action", "n_entities", F.coalesce(gate, F.lit("VALIDATED")).alias("gate"))


def ingested_files(files: DataFrame, module: Column | None = None, country: Column | None = None) -> DataFrame:
    """`ingested` over the requirement texts of accepted files; files that are refused give one row with the reason as gate (PIP1, FLT10)."""
    checked = files_.validated(files_.with_format(files))
    texts = files_.requirement_texts(files_.parsed(checked.filter("verdict = 'OK'"))).withColumn("ref", F.concat_ws("#", "path", "pos"))
    refused = checked.filter("verdict <> 'OK'").select(F.col("path").alias("ref"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("module"), F.lit("REJECTED").alias("action"), F.lit(0).alias("n_entities"), F.col("verdict").alias("gate"))
    return ingested(texts, "ref", "text", module, country).unionByName(refused)


def matched(pairs: DataFrame) -> DataFrame:
    """pairs: atom_id, the five signals, has_history, has_fit_prior. Best composite of each atom and its route (PIP3)."""
    c = F.round(scores.composite({k: F.col(k) for k in scores.WEIGHTS}, F.col("has_fit_prior")), 6)
    best = pairs.withColumn("c", c).groupBy("atom_id").agg(F.max("c").alias("composite"), F.max("has_history").alias("h"))
    return best.select("atom_id", "composite", scores.route(F.col("composite"), F.col("h")).alias("route"))


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """The candidates of each atom with their signals, best first, and the atom's route (PIP3).

    pairs: atom_id, cap_id, atom_vec, cap_vec, atom_text, cap_text, hints (array), historical_alignment, rerank_score, has_history, has_fit_prior.
    Of an atom's capabilities with one text only the best stays (WIN4, DED6); a high cosine with little overlap is told in `anomaly` (FLT13).
    """
    cosine, overlap = scores.cosine(F.col("atom_vec"), F.col("cap_vec")), tx.entity_overlap(F.col("hints"), F.col("cap_text"))
    signals = pairs.withColumn("embedding_cosine", cosine).withColumn("entity_overlap", overlap).withColumn("token_ratio", token_set_ratio("atom_text", "cap_text"))
    score = scores.composite({k: F.coalesce(F.col(k), F.lit(0.0)) for k in scores.WEIGHTS}, F.col("has_fit_prior"))
    rated = signals.withColumn("composite", F.round(score, 6)).withColumn("anomaly", scores.anomaly(F.col("embedding_cosine"), F.col("entity_overlap")))
    once = rel.first_by(rated, ["atom_id", "cap_text"], [F.col("composite").desc(), F.col("cap_id")])
    w = Window.partitionBy("atom_id").orderBy(F.col("composite").desc(), "cap_id")
    best = F.first("composite").over(w)
    history = F.max("has_history").over(Window.partitionBy("atom_id"))
    return once.withColumn("rank", F.row_number().over(w)).withColumn("route", scores.route(best, history)).select("atom_id", "cap_id", "rank", "embedding_cosine", "entity_overlap", "token_ratio", "composite", "anomaly", "route")


def kb_search(queries: DataFrame, base: DataFrame, k: int, module: str | None = None) -> DataFrame:
    """The k nearest items of a knowledge base, of one module if it is given (SRT17)."""
    return retrieval.nearest(queries, rel.matching(base, module=module), k, exclude_self=False)


def search(dense: DataFrame, sparse: DataFrame | None, k: int) -> DataFrame:
    """Hybrid where a sparse list is given, else dense (PIP10, SRT17)."""
    return retrieval.hybrid(dense, sparse, k) if sparse is not None else dense.filter(F.col("rank") <= k)


def listing(batches: DataFrame, uploads: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of batches, newest first, with file names and the number of all (PIP8)."""
    total = batches.agg(F.count("*").alias("total"))
    rows = batches.drop("total").join(uploads, "upload_id", "left").orderBy(F.col("created_at").desc(), "batch_id").offset(offset).limit(size)
    return rows.join(F.broadcast(total)).select("batch_id", F.coalesce("filename", F.lit("")).alias("filename"), "total")  # total has one row
