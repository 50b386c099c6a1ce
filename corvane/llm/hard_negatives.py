"""Hard negatives of anchors, by blocked products of dense matrices.

Components become integers, so products in float64 are exact below 2^53 (a tile that could pass that bound is multiplied in 64-bit
integers instead). Anchors are cut into blocks of a bounded number of bytes; a block is broadcast and
every task multiplies its candidates with it, tile by tile. The first pass keeps each anchor's best candidates of its
own label, which are merged over all tasks; their scores give windows, and the second pass keeps the best candidates of
other labels inside each window. A block's result is written before the next block begins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.topk import Best, few
from corvane.llm.common import fresh_path, materialise

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Bytes of a block of anchors that goes to every task; rows of a tile on either side.
BLOCK_BYTES, ANCHORS, CANDIDATES = 16 << 20, 512, 1024
EXACT, LARGEST = 2.0**53, 2.0**62


def usable(vector: str = "embedding", label: str = "label") -> Column:
    """A label, and a vector of which every component is a finite number."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & ~bad


def rows_of(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v in whole numbers; see ``mine`` for those that don't."""
    good = table.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double")).alias("v"))
    good = good.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < LARGEST)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    good = good.where(F.size("v") == F.lit(most or 0))
    many = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    if many.isEmpty():
        return good
    first = good.join(many, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    return good.join(many, "vec_id", "left_anti").unionByName(first)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact."""
    bound = math.sqrt(float((a * a).sum(axis=1).max()) * float((b * b).sum(axis=1).max())) if len(a) and len(b) else 0.0
    if bound < EXACT / 2:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _tiles(batches):
    """(ids, labels, vectors) of at most ``CANDIDATES`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), _matrix(part.column(2))


def _positives(shared, top: int):
    """(anchor_id, positive_id, score): a task's best candidates of each anchor's label."""

    def run(batches):
        ids, labels, anchors = shared.value
        best = Best(len(ids), top, np.int64)
        where = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
        for own, of, vectors in _tiles(batches):
            for label in np.unique(of):
                asks, c = where.get(label, ()), np.flatnonzero(of == label)
                for at in range(0, len(asks), ANCHORS):
                    a = asks[at : at + ANCHORS]
                    scores = products(anchors[a], vectors[c])
                    ok = (ids[a][:, None] != own[c]) & (scores >= best.bar[a][:, None])
                    i, j = np.nonzero(few(scores, ok, top))
                    best.add(a[i], scores[i, j].astype(np.int64), own[c[j]])
        slot, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[slot]), pa.array(found), pa.array(score)], names=["anchor_id", "positive_id", "score"])

    return run


def _negatives(shared, top: int):
    """(anchor_id, nth, negative_id, score): a task's best candidates of other labels in the window of each anchor's nth positive."""

    def run(batches):
        ids, labels, anchors, low, high = shared.value
        width = low.shape[1]
        best = Best(len(ids) * width, top, np.int64)
        for own, of, vectors in _tiles(batches):
            for at in range(0, len(ids), ANCHORS):
                a = np.arange(at, min(at + ANCHORS, len(ids)))
                scores = products(anchors[a], vectors)
                other = labels[a][:, None] != of
                for k in range(width):
                    slot = a * width + k
                    ok = other & (scores >= np.maximum(low[a, k], best.bar[slot])[:, None]) & (scores <= high[a, k][:, None])
                    i, j = np.nonzero(few(scores, ok, top))
                    best.add(slot[i], scores[i, j].astype(np.int64), own[j])
        slot, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[slot // width]), pa.array(slot % width, pa.int32()), pa.array(found), pa.array(score)], names=["anchor_id", "nth", "negative_id", "score"])

    return run


def mine(table: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose vec_id is divisible by ``every``.

    A score is the inner product of floor(256 x). An anchor's positives are its best other rows of its label; the negatives of
    each are the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Ties go to the smaller vec_id.
    Rows without vec_id or label, with a null vector or a null or non-finite component take no part, nor do vectors of
    another length than most (the longer of two that are as frequent) and those whose squares sum to 2^62 or more, as their scores
    would not be long integers. Of rows that share a vec_id the one with the smallest (label, vector) counts. Zero vectors
    score 0. A label that a third of all rows have costs no more than others; copies of a vector tie and rank by id. An empty table gives none;
    other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    rows = materialise(rows_of(table), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not n["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # blocks by hash: half of the bytes on average, so that none is much over them
    size = n["n"] * 8 * max(1, n["d"])
    blocks = 1 if size <= block_bytes else math.ceil(2 * size / block_bytes)
    path = fresh_path(spark, "negatives")
    for block in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow().combine_chunks().sort_by("vec_id")
        if not got.num_rows:
            continue
        ids, labels = got.column(0).to_numpy(), got.column(1).to_numpy()
        anchors = _matrix(got.column(2).combine_chunks())
        sent = spark.sparkContext.broadcast((ids, labels, anchors))
        found = rows.mapInArrow(_positives(sent, positives), "anchor_id long, positive_id long, score long")
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
        near = materialise(found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < positives), "positives")
        # a block's positives: its anchors times ``positives`` rows
        of = near.toArrow()
        windows = np.full((2, len(ids), positives), np.nan)
        at = np.searchsorted(ids, of.column("anchor_id").to_numpy()), of.column("nth").to_numpy()
        best = of.column("score").to_pylist()
        exact = all(abs(p) < 2**52 for p in best)
        windows = windows if exact else np.stack([np.ones(windows.shape[1:], dtype=np.int64), np.zeros(windows.shape[1:], dtype=np.int64)])
        kind = float if exact else np.int64
        windows[(0, *at)] = np.array([-(-p * low // 100) for p in best], dtype=kind)
        windows[(1, *at)] = np.array([p * high // 100 for p in best], dtype=kind)
        asks = spark.sparkContext.broadcast((ids, labels, anchors, windows[0], windows[1]))
        met = rows.mapInArrow(_negatives(asks, negatives), "anchor_id long, nth int, negative_id long, score long")
        order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "negative_id")
        kept = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        pairs = kept.withColumnRenamed("score", "negative_score").join(near.withColumnRenamed("score", "positive_score"), ["anchor_id", "nth"])
        pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.unpersist()
        asks.unpersist()
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)
