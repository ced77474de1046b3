"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, conversation_trie, delta_lloyd, language, lm, merkle, mixing, quality, simhash, substring_trees, suffix_array, token_counts, token_files
from .common import documents


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_dedup_table(documents(spark, sf_dir))


def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digest_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_id_files(spark, sf_dir):
    import public_tokenizers

    return token_files.token_file_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_count_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark, sf_dir):
    import public_tokenizers

    return language.language_table(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_rules(spark, sf_dir):
    return quality.quality_table(documents(spark, sf_dir))


def op7_substring_dedup(spark, sf_dir):
    return substring_trees.removal_table(documents(spark, sf_dir))


def op8_document_fingerprints(spark, sf_dir):
    return merkle.fingerprint_table(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark, sf_dir):
    return suffix_array.removal_table(documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mixing.mixing_table(documents(spark, sf_dir))


def op11_lm_scoring(spark, sf_dir):
    return lm.score_table(documents(spark, sf_dir))


def op12_delta_lloyd(spark, sf_dir):
    return delta_lloyd.cluster_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.trie_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_byte_bpe, op3_token_id_files, op4_token_counts, op5_language_id, op6_quality_rules, op7_substring_dedup, op8_document_fingerprints, op9_suffix_array_dedup, op10_mixing, op11_lm_scoring, op12_delta_lloyd, op13_conversation_trie)}
ORACLES = {"op6_quality_rules": quality.ORACLE_SQL, "op7_substring_dedup": substring_trees.ORACLE_SQL, "op9_suffix_array_dedup": suffix_array.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op12_delta_lloyd": delta_lloyd.ORACLE_SQL, "op13_conversation_trie": conversation_trie.ORACLE_SQL}
