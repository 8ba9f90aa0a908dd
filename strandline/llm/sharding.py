"""Rendezvous hashing of record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .numbering import number_within


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct<s, j>: the best score among shards numbered from `first`, and its shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(first + j).alias("j"), F.lit(float(w)).alias("w")) for j, w in enumerate(weights)])

    def score(s: Column) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat_ws(":", key, s["j"].cast("string"))), 1, 13), 16, 10)
        return F.struct((-F.ln((digits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))) / s["w"]).alias("s"), s["j"].alias("j"))

    return F.array_min(F.transform(shards, score))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) whose weighted score for `key` is best.

    Shard j draws u from the key and j alone and scores -ln(u)/w_j; the least score wins, ties go to
    the smaller shard. Adding a shard or raising its weight takes rows only into it; removing one
    moves only its own rows.
    """
    return _best(key, weights)["j"]


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Place every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16 (null text: 16, and a null text_crc32); slot numbers a
    shard's rows from 0 without gaps, in the order of the key's md5. A null doc_id counts as an empty
    key. Repeated rows share a shard and get a slot each. An empty table gives no rows.
    """
    grown_weights = [*weights, 1.0] if grown_weights is None else grown_weights
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        key.alias("_key"),
    )
    scored = placed.withColumn("_b", _best(F.col("_key"), weights))
    # Shards that only come after the others are scored beside their best.
    n = len(weights)
    more = F.array_min(F.array("_b", _best(F.col("_key"), grown_weights[n:], n))) if len(grown_weights) > n else F.col("_b")
    grown = more["j"] if list(grown_weights[:n]) == list(weights) else rendezvous(F.col("_key"), grown_weights)
    stored = materialize(scored.select("doc_id", "size", "text_crc32", "law", F.col("_b.j").alias("shard"), grown.alias("grown_shard")), "shards")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return number_within(stored, ["shard"], order, ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The CRC-32 of a text in DuckDB, which has no such function: a 256-entry table made by rule, then one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
ORACLE_SQL = f"""
WITH t AS (SELECT {_CRC_TABLE} AS tab),
d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
         CASE WHEN text IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
           list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) END AS text_crc32,
         coalesce(CAST(doc_id AS VARCHAR), '') AS k
  FROM documents, t),
u AS (
  SELECT d.*, j.range AS j,
         -ln((CAST(CAST('0x' || substr(md5(k || ':' || j.range), 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0) AS s
  FROM d, range(41) j),
g AS (
  SELECT doc_id, size, text_crc32, k, arg_min(j, (s, j)) FILTER (WHERE j < 40) AS shard, arg_min(j, (s, j)) AS grown
  FROM u GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, size) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM g
"""
