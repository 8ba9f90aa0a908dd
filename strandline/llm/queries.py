"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import bisector, katz, kneser, langid, linedup, minhash, mixing, packing, rules, runs, sharding, tokenfile, topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row whose vec_id is divisible by 50 with its 5 best other rows. Vectors that are null or hold a null or
    non-finite component, and null ids, take no part; rows of one id are queries and candidates each by itself."""
    return topk.search_embeddings(read_table(spark, sf_dir, "embeddings"), 5, 50)


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its perplexity, its language's threshold and whether it is kept. Null and empty texts have no
    perplexity and are not kept; a null lang is a language of its own; repeated rows are answered alike."""
    return kneser.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's base and model score; ids of remainder 0 by 10 are held out. A null or empty text is its end alone; a
    null id is learnt from; repeated rows each count and are each scored."""
    return katz.score_documents(read_table(spark, sf_dir, "documents"), 10)


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's counts and verdict. Null and empty texts have no words and fail; a null lang is a language of its own;
    repeated rows are judged alike."""
    return rules.judge(read_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op5_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's size, its source's size and target, and the words the mix takes of it. A null text has size 0, a null
    source is one of its own, last in order; repeated rows are ordered rows."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in one of 40 shards by its key. A null text has size 16 and a null CRC, a null id counts as an empty key;
    repeated rows share a shard and have a slot each."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), [1.0] * 40)


def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's language. Texts that are null or have no letter are `und` with score 0; a null id is learnt from, a
    null lang is not; repeated rows are answered alike."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text without later copies of line runs of 50 words or more, and how many lines went. A null text stays
    null, an empty one empty; rows equal in id and text are treated alike."""
    return linedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_chars", "text")


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's component at 0.85. Null, empty and blank texts have an empty set and stand alone; a null id never names
    a component that has another; repeated rows are ordinary rows."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85).drop("text_key")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in a packed sequence. A null or empty text is its end alone; null ids and repeated rows are
    packed as they stand."""
    return packing.pack_sequences(read_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op11_bisector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components with its centroid after 5 rounds from 40. Other vectors have no row; a null id
    is clustered but starts no centroid; rows of one id are vectors each by itself."""
    return bisector.cluster_vectors(read_table(spark, sf_dir, "embeddings"), 40, 5, "2", 64)


def op12_dictionary_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in the token files and the CRC of its ids, read back from them. A null or empty text is its end
    id alone; null ids stand first, rows of one id by their texts' hashes."""
    import public_tokenizers

    return tokenfile.write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).read()


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's runs of period q of at least 6 and 4q words, and its text without their repetitions. A null, empty or
    blank text has none; a null id is not rewritten; repeated rows are answered alike."""
    return runs.periodic_runs(read_table(spark, sf_dir, "documents"), 6, 4, plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_block_top_k,
        op2_kneser_ney_quality,
        op3_katz_scores,
        op4_divergence_rules,
        op5_water_filling_mix,
        op6_rendezvous_shards,
        op7_rank_order_language,
        op8_line_run_dedup,
        op9_minhash_near_duplicates,
        op10_best_fit_packing,
        op11_bisector_centroids,
        op12_dictionary_token_files,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_block_top_k": topk.ORACLE_SQL,
        "op4_divergence_rules": rules.oracle_sql(),
        "op5_water_filling_mix": mixing.oracle_sql(),
        "op6_rendezvous_shards": sharding.ORACLE_SQL,
        "op11_bisector_centroids": bisector.oracle_sql(),
    }
