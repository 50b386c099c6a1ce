"""Exact vector search of a query set, scores from distances, and vectors of articles.

Queries are cut into blocks of a bounded number of bytes. A block is sent to every task, which multiplies each Arrow batch of
vectors with it tile by tile and keeps a few rows of each query; Spark merges what the tasks kept. A set of one block is
one lazy pass over the vectors; a larger one is a pass for each block, whose results are written before the next.

Products are taken in single precision first. Only pairs that these can't rule out, given by how much they may be off, are
taken in double precision, and only that counts. Queries with a time are cut into blocks by it, and a block meets the vectors of its times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.topk import Best, few, sortable
from corvane.sources.storage import fresh_path, materialise

#: Queries looked at first; bytes of a block of queries; queries and vectors of a tile.
PEEK, BLOCK_BYTES, TILE_Q, TILE_V = 4096, 32 << 20, 1024, 2048
#: Pairs taken in double precision at once.
PAIRS = 1 << 15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _plain(vectors: DataFrame, key: str = "vec_id", *more: str) -> DataFrame:
    """(key, v, more) of rows that have a key and a vector; what is not finite goes in the tasks."""
    return vectors.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("v"), *more)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors at unit length), for each length of vectors; vectors with a null or non-finite component are left out, zero vectors stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    begin = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        v = flat.reshape(-1, n) if len(rows) == len(size) else flat[begin[rows][:, None] + np.arange(n)]
        fine = np.isfinite(v).all(axis=1)
        rows, v = rows[fine], v[fine]
        if len(rows):
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield rows, v / np.where(length > 0, length, 1.0)


class Block(NamedTuple):
    """A block of queries: whether it is the only one, and its first and last time if queries have one."""

    rows: pa.Table
    only: bool
    times: tuple[int, int] | None = None


def _blocks(asked: DataFrame, key: str, timed: bool = False) -> Iterator[Block]:
    """Blocks of at most about ``BLOCK_BYTES``; timed: by the column ``at``."""
    first = asked.limit(PEEK + 1).toArrow()
    if first.num_rows <= PEEK:
        yield Block(first, True)
        return
    wide = max(1, max(len(v) for v in first.column("v")))
    rows = max(PEEK // 4, BLOCK_BYTES // (8 * wide))
    asked = materialise(asked, "queries")

    def parts(some: DataFrame, many: int) -> Iterator[pa.Table]:
        n = math.ceil(1.25 * many / rows)  # dealt by hash, none is much over its bytes
        for k in range(n):
            part = some.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).toArrow()
            if part.num_rows:
                yield part

    if not timed:
        many = asked.count()
        for part in parts(asked, many):
            yield Block(part, 1.25 * many <= rows)
        return
    n = math.ceil(1.25 * asked.count() / rows)
    bounds = sorted(set(asked.approxQuantile("at", [k / n for k in range(1, n)], 0.01 / n))) if n > 1 else []
    span = sum((F.when(F.col("at") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    spans = asked.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()  # a row for each block
    for r in sorted(spans):
        for part in parts(asked.where(span == r["span"]), r["n"]):
            part = part.take(pa.array(np.argsort(part.column("at").to_numpy(), kind="stable")))  # those of a tile are near in time
            yield Block(part, n == 1, (r["low"], r["high"]))


def slack(size: int) -> float:
    """How far a product of unit vectors of so many components in single precision may be from the one in double precision to six places."""
    return 2e-6 + 2.4e-7 * size


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, to six places."""
    cut = range(0, len(i), PAIRS)
    return np.round(np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in cut)]), 6)


def first_near(rough: np.ndarray, least: float, off: float, sure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row of products in single precision the first column that exceeds ``least``, -1 for none.

    off: what the products may be off; sure(i, j): those of pairs in double precision.
    """
    out = np.full(len(rough), -1)
    near = rough > least - off
    met = np.flatnonzero(near.any(axis=1))
    if len(met):
        near = near[met]
        i, j = np.nonzero(near & (rough[met] <= least + off))
        near[i, j] = sure(met[i], j) > least
        out[met] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
    return out


class Tile(NamedTuple):
    """Places of queries, their products with rows of a batch in single precision, what these may be off, and those of pairs in double precision to six places."""

    places: np.ndarray
    rough: np.ndarray
    off: float
    sure: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rows: np.ndarray
    part: pa.RecordBatch


def _tiles(batches, own: dict[int, tuple[np.ndarray, np.ndarray]], seen=None) -> Iterator[Tile]:
    """A tile for some queries and vectors of one length; seen(places, rows, part): which of the rows any of the queries can see."""
    small = {size: units.astype(np.float32) for size, (_, units) in own.items()}
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_V):
            part = batch.slice(at, TILE_V)
            for rows, units in _by_size(part.column(1)):
                size = units.shape[1]
                places, matrix = own.get(size, (None, None))
                columns = units.astype(np.float32).T
                for first in range(0, 0 if places is None else len(places), TILE_Q):
                    some, own_rows, own_units, own_columns = matrix[first : first + TILE_Q], rows, units, columns
                    if seen is not None and not (kept := seen(places[first : first + TILE_Q], rows, part)).all():
                        if not kept.any():
                            continue
                        own_rows, own_units, own_columns = rows[kept], units[kept], columns[:, kept]
                    rough = small[size][first : first + TILE_Q] @ own_columns
                    yield Tile(places[first : first + TILE_Q], rough, slack(size), lambda i, j, a=some, b=own_units: exact(a, b, i, j), own_rows, part)


def _equal(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of equal ids."""
    if mine.dtype.kind != theirs.dtype.kind:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs, mine, side, sorter=order) for side in ("left", "right"))
    many = high - low
    return np.repeat(np.arange(len(mine)), many), order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]


def _held(block: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {units.shape[1]: (rows, units) for rows, units in _by_size(block.column("v"))}


def _times(part: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """since and until of rows."""
    since, until = (part.column(k).to_numpy(zero_copy_only=False)[rows] for k in (2, 3))
    return since, until


def _nearest(block: pa.Table, top: int, keep_self: bool, same: bool, timed: bool):
    """A task's best ``top`` vectors for each query of a block. The columns after the vector are those that queries and results
    share (same), or the time of a query and the times between which a vector is there (timed)."""

    def run(batches):
        own, ids = _held(block), block.column(0).combine_chunks()
        mine = sortable(ids)

        def seen(places, rows, part):
            since, until = _times(part, rows)
            return (since < at[places].max()) & (until >= at[places].min())

        group = np.array(block.column(2).to_pylist(), dtype=object) if same else None
        at = block.column(2).to_numpy() if timed else None
        best = Best(len(mine), top)
        kind = None
        for places, rough, off, sure, rows, part in _tiles(batches, own, seen if timed else None):
            kind = part.column(0).type
            theirs = sortable(part.column(0))[rows]
            if not keep_self:
                rough[_equal(mine[places], theirs)] = -np.inf
            if same:
                rough[group[places][:, None] != np.array(part.column(2).to_pylist(), dtype=object)[rows]] = -np.inf
            if timed:
                since, until = _times(part, rows)
                asked = at[places][:, None]
                some = np.flatnonzero((since >= asked.min()) | (until < asked.max()))  # all queries see the others
                rough[:, some] = np.where((since[some] < asked) & (asked <= until[some]), rough[:, some], -np.inf)
            high, low = rough.max(axis=1), np.maximum(best.bar[places] - off, -2.0).astype(np.float32)
            met = np.flatnonzero(high >= low)
            if not len(met):
                continue
            some = rough[met]
            if top == 1:
                ok = some >= np.maximum(low, high - 2 * off)[met][:, None]
            else:
                ok = few(some, some >= low[met][:, None], top, off)
            cell = np.flatnonzero(ok)
            i, j = met[cell // rough.shape[1]], cell % rough.shape[1]
            best.add(places[i], sure(i, j), theirs[j])
        slot, score, found = best.rows()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(slot)), pa.array(found.tolist(), kind), pa.array(score)], names=["query_id", "vec_id", "sim"])

    return run


def _each_block(rows: DataFrame, asked: DataFrame, key: str, schema: str, run, merged, timed: bool = False) -> DataFrame:
    """merged(rows of all tasks) for the blocks of queries, read from a table if there are several; then rows are written first, as they are read for each."""
    spark, path, kind, held = rows.sparkSession, None, None, rows
    for block, only, times in _blocks(asked, key, timed):
        if not block.num_rows:
            return merged(spark.createDataFrame([], schema))
        if not only and path is None:
            held, path = materialise(rows.sortWithinPartitions("since") if timed else rows, "vectors"), fresh_path(spark, "nearest")
        some = held if times is None else held.where((F.col("since") < times[1]) & (F.col("until") >= times[0]))
        found = merged(some.mapInArrow(run(block), schema))
        if only:
            return found
        kind = found.schema
        found.write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def search(vectors: DataFrame, queries: DataFrame, top: int, keep_self: bool = True, same: str | None = None, timed: bool = False) -> DataFrame:
    """(query_id, vec_id, sim, rnk): every query of the stated set against every vector, the nearest ``top`` kept.

    Ids are integers or strings. Ties go to the smaller vec_id. Null vectors and those with a null or non-finite component take no part,
    as a query as little as a vector; a vector meets the queries of its own length; zero vectors have similarity 0. ``same`` names
    a column that a query and its results must share (nulls share nothing). timed: queries have a time ``at`` (long), vectors ``since`` and
    ``until``, and a query sees what was there: since < at <= until. Queries that repeat an id count as one if they are equal.
    """
    more = [] if same is None else [same]
    narrow = (lambda df: df.where(F.col(same).isNotNull())) if same else (lambda df: df)
    rows = narrow(_plain(vectors, "vec_id", *more, *(["since", "until"] if timed else [])))
    asked = narrow(_plain(queries, "vec_id", *more, *(["at"] if timed else []))).distinct()
    kinds = [df.schema["vec_id"].dataType.simpleString() for df in (asked, rows)]
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, sim double"

    def merged(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
        each = found.select("query_id", "vec_id", F.round("sim", 6).alias("sim"))
        return each.withColumn("rnk", rank).where(F.col("rnk") <= top)

    return _each_block(rows, asked, "vec_id", schema, lambda block: _nearest(block, top, keep_self, same is not None, timed), merged, timed)


def _nearer(block: pa.Table, least: float):
    """The smallest vec_id of a task's vectors that is nearer to a query than ``least``."""

    def run(batches):
        own, ids = _held(block), block.column(0).combine_chunks()
        best = Best(len(ids), 1)
        kind = None
        for places, rough, off, sure, rows, part in _tiles(batches, own):
            kind = part.column(0).type
            theirs = sortable(part.column(0))[rows]
            order = np.argsort(theirs, kind="stable")
            if (order[1:] < order[:-1]).any():
                rough = rough[:, order]
            found = first_near(rough, least, off, lambda i, j, order=order, sure=sure: sure(i, order[j]))
            met = np.flatnonzero(found >= 0)
            best.add(places[met], np.zeros(len(met)), theirs[order[found[met]]])
        slot, _, found = best.rows()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(slot)), pa.array(found.tolist(), kind)], names=["query_id", "vec_id"])

    return run


def nearer_than(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, vec_id): of the vectors nearer to a query than ``least`` the one with the smallest id. Vectors and queries as in ``search``."""
    rows, asked = _plain(vectors), _plain(queries).distinct()
    kinds = [df.schema["vec_id"].dataType.simpleString() for df in (asked, rows)]
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}"
    return _each_block(rows, asked, "vec_id", schema, lambda block: _nearer(block, least), lambda found: found.groupBy("query_id").agg(F.min("vec_id").alias("vec_id")))


def min_max(found: DataFrame, value: str = "sim", key: str = "query_id") -> DataFrame:
    """score = (max distance - distance) / (max - min), clamped; all equal or alone gives 0."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    span = F.when(high == low, 1.0).otherwise(high - low)
    return found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / span)))


def article_index(chunks: DataFrame) -> DataFrame:
    """(article_id, doc_uid, title, section, n_chunks, chunk_ids) of chunks(article_id, doc_uid, chunk_id, index, section).

    Title and section are the first chunk's section. The lists of ids are an article's, not the corpus'.
    """
    first = F.min_by("section", F.struct("index", "chunk_id"))
    return chunks.groupBy("article_id").agg(
        F.min("doc_uid").alias("doc_uid"),
        first.alias("title"),
        first.alias("section"),
        F.countDistinct("chunk_id").alias("n_chunks"),
        F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"),
    )
