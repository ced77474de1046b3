"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever else the table has. `run` applies them in order, each to the written result of the one before.

Rows that are odd: a null or empty text has no words, so the quality rules reject it; for the later stages it is a text like
others. A null doc_id stays through near-dedup (it can't be told from others), and draws by its text in mixing. Rows that
repeat are judged alike by the rules, are one document in near-dedup, and repeats of each other in substring dedup. Null
lang and source are a class of their own in mixing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, quality, simhash, substring_trees
from sparkloom.llm.common import documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs, sf_dir):
    """The documents that no quality rule rejects."""
    return quality.keep_good(docs).select(*COLUMNS)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document, that of least doc_id, of each group of copies and near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs).select(*COLUMNS)


def substring_dedup(spark, docs, sf_dir):
    """The documents without the words of 35-word windows that occur again; those left without a word go.

    A text that loses nothing stays as it is; else its words are joined by a space. n_chars follows.
    """
    out = substring_trees.repeated_words(docs, extra=("lang", "source", "n_chars"), as_is=True)
    cut = F.size("spans") > 0
    n_chars = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(~cut | (F.col("kept") != "")).select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """Documents drawn so that tokens meet the tempered source, language and topic marginals, 0.9 of all tokens expected; small classes give documents more than once."""
    return mixing.sample_mixture(docs, keep=0.9).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.digest_table(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SimHash and BPE can't be put in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
