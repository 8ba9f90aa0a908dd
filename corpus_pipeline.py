"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import linedup, minhash, mixing, packing, rules
from strandline.llm.queries import tokenizer_path
from strandline.llm.words import WORD
from strandline.session import materialize, prepare, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution divergence reject go.

    Null and empty texts have no words, so they go; repeated rows are judged alike; a null lang is a language of
    its own. Other columns, whatever their names, are kept as they are; an empty table stays empty.
    """
    prepare(spark)
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; a document that loses every word goes too.

    Earlier is by doc_id, null last, then text hash. Null and empty texts have no lines and stay; rows equal in doc_id
    and text are one document and are treated alike; n_chars follows the text. Other columns, whatever their names, are
    kept; an empty table stays empty.
    """
    prepare(spark)
    lines, removed = "n_lines", "n_removed"
    while lines in docs.columns or removed in docs.columns:
        lines, removed = lines + "_", removed + "_"
    out = linedup.dedup_lines(docs, 50, (lines, removed))
    return out.where((F.col(removed) == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays.

    It is that of the least doc_id, a null one last; of equal ids that of the least text hash, once. Texts without words
    (null, empty) are near to nothing, so each of their rows stays. Other columns, whatever their names, are kept; an
    empty table stays empty.
    """
    prepare(spark)
    return minhash.keep_one(docs, 80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn, at most 3 epochs; each document stands as often as the mix takes it.

    A null source is one of its own, last in order; a source without words gives each document once; rows equal in
    doc_id, text and source together stand as often as the mix takes them. Other columns, whatever their names, are
    kept; an empty table stays empty.
    """
    prepare(spark)
    return mixing.expand_mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in packed sequences.

    A null or empty text is its end token alone; repeated rows and null ids are packed as they stand; other columns are
    left out; an empty table gives no rows.
    """
    prepare(spark)
    return packing.pack_sequences(docs, tokenizer_path(), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: Near-dedup is iterative and packing tokenises: tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
