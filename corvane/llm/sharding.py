"""Rendezvous hashing of record keys over weighted shards, DataFrame functions only.

Each shard scores each key, score = -weight / ln(u) with u from a hash of key and shard; the
best score wins. One more shard takes only the keys it wins, and changing one weight moves
keys only from or to that shard. Slots number a shard's rows without gaps: rows are dealt
into a fixed number of cells by hashes of key and text, cells are counted (a table of
shards x CELLS x SUBCELLS rows), and rows are numbered inside their cell, so no task sees a whole shard and an id
that many rows share is split by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, CELLS, SUBCELLS = 24, 64, 16


def winner(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that wins the key; the smaller one on equal scores."""
    scores = []
    for i, w in enumerate(weights):
        u = (F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("s"), F.lit(-i).alias("i")))
    return -F.array_max(F.array(*scores))["i"]


def assign(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, cells: int = CELLS) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. The law is ``key``: doc_id and the
    shards decide alone, so repeated rows and null ids (all alike) share a shard.
    grown_shard: the shard if there were one more of weight 1. slot: from 0 in each shard,
    without gaps, in order of cell, doc_id, checksum and size. Null and empty texts have size 8; very long ones are only
    measured. An empty table gives none. Other columns are ignored.
    """
    weights = weights or [1.0] * shards
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # rows of one id with different texts fall into different cells; equal rows are told apart by nothing that lasts
    place = F.xxhash64(key, F.lit("cell"))
    part = F.pmod(F.xxhash64(key, F.crc32(text)), F.lit(SUBCELLS))
    cell = F.pmod(place, F.lit(cells)) * SUBCELLS + part
    placed = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        winner(key, weights).alias("shard"),
        winner(key, [*weights, 1.0]).alias("grown_shard"),
        cell.alias("cell"),
    )
    counts = docs.select(winner(key, weights).alias("shard"), cell.alias("cell")).groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(  # shards x cells x SUBCELLS rows at most
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
