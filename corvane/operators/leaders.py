"""Leader clustering in order of insertion, by cosine, over any number of vectors.

A row is a leader if no earlier leader is nearer to it than the threshold, else it belongs to the first such leader. The first
rows that are undecided can be settled on their own, as everything before them is decided: a bounded batch of them gives new
leaders, which are sent to every task, and one pass over the rows that are left takes out those that belong to them. Rows that belong to
anybody never meet each other, so a group of copies costs one comparison a row. Before there is more than one
pass, rows are laid out by the nearest of a few pivots: vectors of a tile then lie close together, and a leader whose angle to a
tile's centre exceeds the tile's radius and the threshold's angle can't reach any of them.

The first batch is settled on the driver and takes out what large groups there are. Later batches are as wide as a block of vectors may be: tasks
find the first few earlier rows that each row of the batch is near to, which decides it unless none of them is a leader and there are more. A wide batch
ends before the first row that isn't decided; if that is too soon, the batches are small ones again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.frames import dealt
from corvane.functions.topk import sortable
from corvane.operators.vector import BLOCK_BYTES, _by_size, _held, _plain, exact, first_near, slack
from corvane.sources.storage import fresh_path, materialise

#: Rows that are settled on the driver at once; rows of a tile; pivots.
BATCH, TILE, PIVOTS = 8192, 512, 64
#: Leaders that a tile meets at once; near rows that are told of a row of a wide batch.
HEADS, NEAR = 2048, 16


def greedy(units: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the place of its leader, rows in order of insertion."""
    n = len(units)
    leader = np.full(n, -1)
    heads: list[int] = []
    for at in range(0, n, TILE):
        part = units[at : at + TILE]
        if heads:
            near = np.round(part @ units[heads].T, 6) > threshold
            met = near.any(axis=1)
            leader[at : at + TILE][met] = np.array(heads)[near[met].argmax(axis=1)]
        among = np.round(part @ part.T, 6) > threshold
        for i in range(len(part)):
            if leader[at + i] < 0:
                leader[at + i] = at + i
                heads.append(at + i)
                later = np.flatnonzero(among[i, i + 1 :]) + at + i + 1
                leader[later[leader[later] < 0]] = at + i
    return leader


def _first(units: np.ndarray, heads: np.ndarray, small: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of a tile the first leader that is nearer than the threshold, -1 for none. small: the leaders in single precision."""
    centre = units.sum(axis=0)
    size = np.sqrt((centre * centre).sum())
    some = np.arange(len(heads))
    if size > 0:
        radius = np.arccos(np.clip((units @ (centre / size)).min(), -1, 1))
        angle = np.arccos(np.clip(heads @ (centre / size), -1, 1))
        some = np.flatnonzero(angle <= radius + np.arccos(min(1.0, threshold)) + 1e-3)
    out, left, rough = np.full(len(units), -1), np.arange(len(units)), units.astype(np.float32)
    for at in range(0, len(some), HEADS):
        part = some[at : at + HEADS]
        found = first_near(rough[left] @ small[part].T, threshold, slack(units.shape[1]), lambda i, j, left=left, part=part: exact(units, heads, left[i], part[j]))
        out[left[found >= 0]] = part[found[found >= 0]]
        left = left[found < 0]
        if not len(left):
            break
    return out


def _take(block: pa.Table, threshold: float):
    """(id, v, leader) of each row: the leader of the block that it belongs to, if any. Rows without a usable vector go."""

    def run(batches):
        own, ids = _held(block), block.column(0).combine_chunks()
        small = {size: heads.astype(np.float32) for size, (_, heads) in own.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                found = np.full(part.num_rows, -1)
                usable = np.zeros(part.num_rows, dtype=bool)
                for rows, units in _by_size(part.column(1)):
                    usable[rows] = True
                    places, heads = own.get(units.shape[1], (None, None))
                    if places is not None:
                        which = _first(units, heads, small[units.shape[1]], threshold)
                        found[rows] = np.where(which >= 0, places[which], -1)
                at_leader = pa.array(found, pa.int32(), mask=found < 0)
                part = pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids.take(at_leader)], names=["id", "v", "leader"])
                yield part.filter(pa.array(usable))

    return run


def _earlier(block: pa.Table, threshold: float):
    """(place, near) of rows of a sorted block: places of the first earlier rows nearer than the threshold, one more than ``NEAR`` at most. Rows without any go."""

    def run(batches):
        own, mine = _held(block), sortable(block.column(0))
        small = {size: units.astype(np.float32) for size, (_, units) in own.items()}
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE):
                part = batch.slice(begin, TILE)
                at = np.searchsorted(mine, sortable(part.column(0)))
                for rows, units in _by_size(part.column(1)):
                    size, here, rough = units.shape[1], at[rows], units.astype(np.float32)
                    places, heads = own[size]
                    many, pairs, left = np.zeros(len(rows), dtype=np.int64), [], np.arange(len(rows))
                    for k in range(0, int(np.searchsorted(places, here.max())), HEADS):
                        i, j = np.nonzero(rough[left] @ small[size][k : k + HEADS].T > threshold - slack(size))
                        i, j = left[i], j + k
                        fine = places[j] < here[i]
                        i, j = i[fine], j[fine]
                        fine = exact(units, heads, i, j) > threshold
                        i, j = i[fine], j[fine]
                        pairs.append((i, places[j]))
                        many += np.bincount(i, minlength=len(rows))
                        left = left[many[left] <= NEAR]
                        if not len(left):
                            break
                    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
                    order = np.argsort(i, kind="stable")
                    i, j = i[order], j[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) <= NEAR
                    met, n = np.unique(i[kept], return_counts=True)
                    near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(j[kept], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(here[met], pa.int32()), near], names=["place", "near"])

    return run


def _settled(near: pa.Table, told: np.ndarray) -> int:
    """Sets the leaders of a sorted block from what ``_earlier`` gave, told being each row's own place or -1; how many rows at its begin are decided.

    A row is undecided if none of the first ``NEAR`` near ones is a leader and there are more.
    """
    places, lists = near.column("place").to_numpy(), near.column("near").to_pylist()
    for k in np.argsort(places):
        at = places[k]
        head = next((x for x in lists[k][:NEAR] if told[x] == x), None)
        if head is not None:
            told[at] = head
        elif len(lists[k]) > NEAR:
            return int(at)
    return len(told)


def _cells(pivots: pa.Table):
    def run(batches):
        own = _held(pivots)
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for rows, units in _by_size(batch.column(1)):
                places, matrix = own.get(units.shape[1], (None, None))
                if places is not None:
                    cell[rows] = places[(units @ matrix.T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["id", "v", "cell"])

    return run


def lead(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, leader): for each vector, in order of vec_id, the first leader whose cosine to it (to six places) exceeds the threshold, itself if there is none.

    Ids are integers or strings. Rows without id, vectors that are null, empty or hold a null or non-finite component take no part; zero
    vectors and vectors of different lengths are not near. Of rows that share an id the first in order of their vectors counts.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would make zero vectors near")
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = _plain(vectors).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v"))
    left = materialise(rows, "undecided")
    if left.count() > BATCH:
        pivots = left.orderBy(F.xxhash64("id")).limit(PIVOTS).toArrow()
        celled = left.mapInArrow(_cells(pivots), f"id {kind}, v array<double>, cell int")
        left = materialise(celled.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").drop("cell"), "undecided")
    path = fresh_path(spark, "leaders")
    schema = f"id {kind}, v array<double>, leader {kind}"
    wide = 0  # rows of a wide batch, 0 before the first batch, -1 if they are not worth it
    while True:
        first = left.select("id").orderBy("id").limit(max(BATCH, wide)).toArrow()
        if not first.num_rows:
            break
        cut = first.column(0)[-1].as_py()
        batch = left.where(F.col("id") <= F.lit(cut)).toArrow()
        ids = sortable(batch.column("id"))
        batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
        told, heads = np.full(batch.num_rows, -1), []
        if batch.num_rows > BATCH:
            for places, _ in _by_size(batch.column("v")):
                told[places] = places
            rows = dealt(left.where(F.col("id") <= F.lit(cut)), "id")
            decided = _settled(rows.mapInArrow(_earlier(batch, threshold), "place int, near array<int>").toArrow(), told)
            if decided < BATCH:
                wide = -1
                continue
            batch, told = batch.slice(0, decided), told[:decided]
            heads.append(np.flatnonzero(told == np.arange(decided)))
            cut = batch.column("id")[-1].as_py()
        else:
            for places, units in _by_size(batch.column("v")):
                told[places] = places[greedy(units, threshold)]
                heads.append(np.unique(told[places]))
        if not wide:
            wide = BLOCK_BYTES // (8 * max(1, max((len(v) for v in batch.column("v")), default=1)))
        names = batch.column("id").combine_chunks()
        known = np.flatnonzero(told >= 0)
        settled = pa.Table.from_arrays([names.take(pa.array(known)), names.take(pa.array(told[known]))], names=["vec_id", "leader"])
        spark.createDataFrame(settled, f"vec_id {kind}, leader {kind}").write.mode("append").parquet(path)
        block = batch.take(pa.array(np.sort(np.concatenate(heads)) if heads else np.empty(0, np.int64), pa.int64()))
        seen = materialise(left.where(F.col("id") > F.lit(cut)).mapInArrow(_take(block, threshold), schema), "undecided")
        seen.where("leader IS NOT NULL").select(F.col("id").alias("vec_id"), "leader").write.mode("append").parquet(path)
        left = seen.where("leader IS NULL").select("id", "v")
    spark.createDataFrame([], f"vec_id {kind}, leader {kind}").write.mode("append").parquet(path)  # there may have been no rows at all
    return spark.read.schema(f"vec_id {kind}, leader {kind}").parquet(path)
