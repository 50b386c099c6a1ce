"""Approximate nearest neighbours by cosine on shifted space-filling curves.

Vectors are scaled to unit length and projected on several random planes of a few dimensions. On each
projection, shifted by its own random offset, a Hilbert curve gives every vector a key. Keys are
cut into ranges of about equal size, however many vectors there are, by quantiles of a sample of keys (a few for each
range; only the cuts, 64 bytes for each range, are sent to the workers); a query visits its own
range and the ranges around it on every curve, is compared there with whole vectors, and
the best of all windows are merged and ranked by exact cosines.

How many ranges a window needs, and how many curves, depends on the data. It is measured: the true neighbours of a
bounded sample of queries, found by one pass over all vectors, tell how far away on the nearest
curve they lie. For each number of curves the window is the smallest that reaches ``RECALL`` of them; the number
that compares least is taken. Equal vectors are one class and cost one row; their ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import materialise

TOP, EVERY = 5, 50
CURVES, DIMS, BITS, SEED = 8, 6, 8, 3
#: Vectors in a range, about; ranges at least, so that curves tell something on small tables too; sampled keys for each range; vectors that planes are fitted on; sampled queries; queries compared at once.
RANGE, LEAST_RANGES, PER_RANGE, SAMPLE, PROBES, RECALL, TILE = 1024, 8, 8, 16_384, 256, 0.96, 256
#: Curves that are used at least, of ``CURVES``.
LEAST_CURVES = 2


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d), by turning axes into the transposed index."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[:, i] & q) > 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, d - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


@dataclass
class Curves:
    planes: np.ndarray  # (curves, vector size, dims)
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    cuts: np.ndarray | None = None  # (curves, ranges - 1)

    def keys(self, unit: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """(n, curves): keys, the lowest bits from ``spread`` so that ties can be cut."""
        out = np.empty((len(unit), len(self.planes)), dtype=np.int64)
        for c, plane in enumerate(self.planes):
            cell = np.clip(((unit @ plane - self.low[c]) / self.width[c] + self.shift[c]) / 2, 0, 1)
            out[:, c] = hilbert((cell * ((1 << BITS) - 1)).astype(np.int64), BITS) << 14 | (spread & 16383)
        return out

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[c], keys[:, c], side="right") for c in range(keys.shape[1])], axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(vector: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def classes(table: DataFrame, top: int = TOP) -> DataFrame:
    """(rep, v, ids): one row for each different vector; ids: its top + 1 smallest, rep the first."""
    rows = table.where(usable()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.where("vec_id IS NOT NULL").withColumn("nth", nth).where(F.col("nth") <= top + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def fit(sample: pd.DataFrame) -> Curves:
    """Planes and bounds from a bounded sample of vectors; the cuts are still to come."""
    vectors = _unit(np.stack(sample["v"].to_numpy()).astype(float))
    rng = np.random.default_rng(SEED)
    size = vectors.shape[1]
    dims = min(DIMS, size)
    planes = np.stack([np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(CURVES)])
    flat = np.einsum("ns,csd->cnd", vectors, planes)
    low, high = flat.min(axis=1), flat.max(axis=1)
    return Curves(planes, low, np.maximum(high - low, 1e-9), rng.uniform(0, 1, (CURVES, dims)))


def _keys(curves: Curves):
    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            keys = curves.keys(_unit(np.stack(f["v"].to_numpy()).astype(float)), f["rep"].to_numpy() * 40503)
            yield pd.DataFrame({f"k{c}": keys[:, c] for c in range(keys.shape[1])})

    return run


def cut(curves: Curves, found: DataFrame, n: int, size: int = RANGE) -> Curves:
    """curves with the cuts of n // size ranges, ``LEAST_RANGES`` at least, from about ``PER_RANGE`` keys for each range."""
    many = max(LEAST_RANGES, n // size)
    every = max(1, n // (PER_RANGE * many))
    some = found.where(F.pmod(F.xxhash64("rep", F.lit("cut")), F.lit(every)) == 0).select("rep", "v")
    schema = ", ".join(f"k{c} long" for c in range(len(curves.planes)))
    keys = np.sort(some.mapInPandas(_keys(curves), schema).toPandas().to_numpy(dtype=np.int64), axis=0)
    many = max(1, min(many, len(keys)))
    curves.cuts = keys[[len(keys) * i // many for i in range(1, many)]].T if many > 1 else np.empty((len(curves.planes), 0), dtype=np.int64)
    return curves


def _exact(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each computed alike wherever it is."""
    return (queries * base).sum(axis=1) / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((base * base).sum(axis=1)))


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, base: np.ndarray, units: np.ndarray, top: int) -> pd.DataFrame:
    """The top + 1 nearest classes of each query among base, with exact cosines, ``TILE`` queries after another."""
    tiles = [_tile(ids[at : at + TILE], q[at : at + TILE], own, base, units, top) for at in range(0, len(ids), TILE)]
    return pd.concat(tiles, ignore_index=True)


def _tile(ids: np.ndarray, q: np.ndarray, own: np.ndarray, base: np.ndarray, units: np.ndarray, top: int) -> pd.DataFrame:
    near = _unit(q) @ units.T
    k = min(top + 1, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    # all that tie with the last one, so that smaller ids can win
    last = np.take_along_axis(near, at, axis=1).min(axis=1)
    i, j = np.nonzero(near >= (last - 1e-12)[:, None])
    return pd.DataFrame({"query_id": ids[i], "rep": own[j], "score": _exact(q[i], base[j])})


def _nearest_all(probes: pd.DataFrame, top: int):
    q, ids = np.stack(probes["v"].to_numpy()).astype(float), probes["rep"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            base = np.stack(f["v"].to_numpy()).astype(float)
            found = _best(ids, q, f["rep"].to_numpy(), base, _unit(base), top)
            found = found[found["query_id"] != found["rep"]]
            vectors = dict(zip(f["rep"], f["v"], strict=True))
            yield found.assign(v=[vectors[r] for r in found["rep"]])

    return run


def window_for(found: DataFrame, probes: pd.DataFrame, curves: Curves, recall: float = RECALL, top: int = TOP) -> tuple[int, int]:
    """(curves to use, ranges to visit on either side) so that the probes' true neighbours are met with the given recall at the least cost."""
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    true = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= top).toPandas()  # PROBES x top rows
    least = min(LEAST_CURVES, len(curves.planes))
    if not len(true):
        return least, 0

    def ranges(reps, vs):
        return curves.ranges(curves.keys(_unit(np.stack(vs.to_numpy()).astype(float)), reps.to_numpy() * 40503))

    mine = pd.DataFrame(ranges(probes["rep"], probes["v"]), index=probes["rep"])
    apart = np.abs(ranges(true["rep"], true["v"]) - mine.loc[true["query_id"]].to_numpy())
    last = curves.cuts.shape[1]
    options = []
    for c in range(least, apart.shape[1] + 1):
        reach = int(np.quantile(apart[:, :c].min(axis=1), recall, method="higher"))
        options.append((c * min(2 * reach + 1, last + 1), c, reach))
    return min(options)[1:]


def _deal(curves: Curves, used: int, reach: int):
    """Each class to its range on every curve that is used, each query to the ranges around its own."""
    last = curves.cuts.shape[1]

    def run(frames: Iterator[pd.DataFrame]):
        for whole in frames:
            for at in range(0, len(whole), 256):
                f = whole.iloc[at : at + 256].reset_index(drop=True)
                keys = curves.keys(_unit(np.stack(f["v"].to_numpy()).astype(float)), f["rep"].to_numpy() * 40503)
                where = curves.ranges(keys)
                asks = f["query_ids"].map(len).to_numpy() > 0
                for c in range(used):
                    yield f.assign(cell=c * (last + 1) + where[:, c], asks=False)[["cell", "asks", "rep", "v"]]
                    q = f[asks]
                    for off in range(-reach, reach + 1):
                        to = where[asks, c] + off
                        ok = (to >= 0) & (to <= last)
                        if ok.any():
                            yield q[ok].assign(cell=c * (last + 1) + to[ok], asks=True)[["cell", "asks", "rep", "v"]]

    return run


def _search(top: int):
    def run(frames: Iterator[pd.DataFrame]):
        cell, own, base, units = None, [], [], None
        for f in frames:
            for (c, asks), g in f.groupby(["cell", "asks"], sort=True):
                vectors = np.stack(g["v"].to_numpy()).astype(float)
                if c != cell:
                    cell, own, base, units = c, [], [], None
                if not asks:
                    own.append(g["rep"].to_numpy())
                    base.append(vectors)
                    units = None
                elif own:
                    if units is None:
                        own, base = [np.concatenate(own)], [np.concatenate(base)]
                        units = _unit(base[0])
                    yield _best(g["rep"].to_numpy(), vectors, own[0], base[0], units, top)

    return run


def one_length(table: DataFrame) -> DataFrame:
    """The usable vectors that have the length most of them have (the greater one of two that are as frequent)."""
    good = table.where(usable())
    sizes = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return good.where(F.size("embedding") == F.lit(most or 0))


def nearest(table: DataFrame, every: int = EVERY, top: int = TOP, recall: float = RECALL, size: int = RANGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose vec_id is divisible by ``every``.

    Ranked by cosine, ties to the smaller vec_id; fewer rows if there are fewer candidates. Null or zero vectors and
    those with null or non-finite components take no part, nor do rows without vec_id and vectors of another length than
    most. Components may be as long a list as memory holds; an empty table gives none. Rows that repeat a
    vec_id with the same vector count once each as candidates of other queries. Other columns are ignored.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = one_length(table)
    found = materialise(classes(table, top), "classes")
    n = found.count()
    if not n:
        return empty
    asked = (
        table.where(usable() & (F.col("vec_id") % every == 0))
        .select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
        .distinct()
    )
    reps = materialise(asked.join(found.select("v", "rep"), "v").select("query_id", "rep"), "asked")
    one = reps.groupBy("rep").agg(F.array(F.min("query_id")).alias("query_ids"))
    all_rows = materialise(
        found.join(one, "rep", "left").select("rep", "v", F.coalesce("query_ids", F.array().cast("array<long>")).alias("query_ids")), "vectors"
    )
    sample = found.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "v").toPandas()
    curves = cut(fit(sample), found, n, size)
    probes = all_rows.where(F.size("query_ids") > 0).orderBy(F.xxhash64("rep"), "rep").limit(PROBES).select("rep", "v").toPandas()
    if not len(probes):
        return empty
    true = found.select("rep", "v").mapInPandas(_nearest_all(probes, top), "query_id long, rep long, score double, v array<double>")
    used, reach = window_for(true, probes, curves, recall, top)
    dealt = all_rows.mapInPandas(_deal(curves, used, reach), "cell int, asks boolean, rep long, v array<double>")
    cells = dealt.repartition("cell").sortWithinPartitions("cell", "asks")
    met = cells.mapInPandas(_search(top), "query_id long, rep long, score double").select(F.col("query_id").alias("q"), "rep", "score")
    kept = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = met.distinct().withColumn("n", F.dense_rank().over(kept)).where(F.col("n") <= top + 1)
    pairs = (
        reps.withColumnRenamed("rep", "q")
        .join(best, "q")
        .join(found.select("rep", "ids"), "rep")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("query_id <> vec_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
