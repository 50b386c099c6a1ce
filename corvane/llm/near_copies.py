"""One document of each group of near copies: five-word shingles, similarity 0.8 at least.

A document is the set of its shingles (XXH64 of each). Equal sets are one member. Two rounds link sets:

* SimHash: sets whose fingerprints differ in at most ``simhash.RADIUS`` bits meet by the Golay-code keys of the SimHash operator, and
  are linked if the shingles bear it out. Their components go into the second round.
* At similarity 0.8 two 64-bit fingerprints differ in some ten bits, and keys that allow so many are met by unrelated texts in every bucket. So the
  rest comes from MinHash: candidates share one of ``BANDS`` keys, each of ``ROWS`` MinHash values, and two sets of similarity 0.8 miss each
  other with probability (1 - 0.8^4)^20 = 0.00003, more similar ones less often. Keys that hold members of one component only are left out, and
  what SimHash has linked is not compared again.

Candidates are compared by the high 32 bits of the hashes, of which unlike shingles of a 400-word pair share one with probability 0.0001. Keys that
hold the same members are verified once; one with more than ``BLOCK_LIMIT`` members in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import byte_rows, every, materialise, small_batches, text_bytes, tidy
from corvane.llm.graph import components

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 4
#: Similar: shared / all shingles >= 4 / 5, in whole numbers.
SHARED, ALL = 4, 5
BLOCK_LIMIT, BLOCK_SIZE = 1024, 512

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, an empty one none."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if len(words) < SHINGLE:
        grams = {b" ".join(words)} if words else set()
    else:
        grams = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _body(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


@tidy
def _keys(batches):
    for part, texts in byte_rows(batches):
        sets = [shingles(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(map(_body, sets), pa.int64()),
                pa.array(np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)),
                pa.array(map(band_keys, sets), pa.list_(pa.int64())),
            ],
            names=["doc_id", "line", "body", "fp", "keys"],
        )


@tidy
def _sets(batches):
    for part, texts in byte_rows(batches):
        short = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(short, pa.binary())], names=["body", "hashes"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if ALL * min(len(a), len(b)) < SHARED * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return ALL * shared >= SHARED * (len(a) + len(b) - shared)


def linked(bodies: list[int], sets: list[np.ndarray], fps: list[int], roots: list[int], radius: int = 64) -> list[tuple[int, int]]:
    """A spanning forest of all similar pairs with at most ``radius`` differing bits: pairs inside one tree, and those of one root, need no comparison."""
    trees: list[tuple[set[int], list[int]]] = []
    edges = []
    for i, s in enumerate(sets):
        near, far = [], []
        for tree in trees:
            if roots[i] in tree[0]:
                near.append(tree)
                continue
            j = next((j for j in tree[1] if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius and similar(s, sets[j])), None)
            (far if j is None else near).append(tree)
            if j is not None:
                edges.append((bodies[i], bodies[j]))
        trees = [({roots[i]}.union(*(t[0] for t in near)), [*(k for t in near for k in t[1]), i]), *far]
    return edges


def _verify(radius: int):
    @tidy
    def run(batches):
        def out():
            edges = linked(bodies, sets, fps, roots, radius)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

        now, bodies, sets, fps, roots = None, [], [], [], []
        for batch in batches:
            for group, body, fp, root, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group != now:
                    if len(bodies) > 1:
                        yield out()
                    now, bodies, sets, fps, roots = group, [], [], [], []
                bodies.append(body)
                sets.append(np.frombuffer(hashes, dtype=np.uint32))
                fps.append(fp)
                roots.append(root)
        if len(bodies) > 1:
            yield out()

    return run


def _links(rows: DataFrame, found: DataFrame, keys: DataFrame, radius: int = 64) -> DataFrame:
    """(u, v) over the distinct sets: edges that connect what similar candidates of keys(key, body, fp, root) connect, beyond what has one root already."""
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("body").alias("x"), F.bit_xor(F.xxhash64("body")).alias("y"), F.min("root").alias("a"), F.max("root").alias("b"))
    once = groups.where("n > 1 AND a < b").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = (
        keys.join(once, "key")
        .withColumn("blocks", F.when(F.col("n") > BLOCK_LIMIT, F.ceil(F.col("n") / BLOCK_SIZE)).otherwise(1))
        .withColumn("own", F.pmod(F.xxhash64("body"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "body", "fp", "root")
    )
    members = materialise(members, "members")
    # the text of one row for each set that is asked for
    asked = found.join(members.select("body").distinct(), "body").groupBy("body").agg(F.min("line").alias("line"))
    sets = rows.join(asked, "line").select("body", "text").mapInArrow(_sets, "body long, hashes binary").dropDuplicates(["body"])
    met = members.join(sets, "body").select("group", "body", "fp", "root", "hashes")
    return met.repartition("group").sortWithinPartitions("group").mapInArrow(_verify(radius), "u long, v long")


def _simhash_round(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v): what SimHash links, by the keys of its operator."""
    keys = simhash.keyed(found.groupBy("body").agg(F.first("fp").alias("fp")).select("fp", F.col("body").alias("rep")))
    keys = materialise(keys.select("key", F.col("rep").alias("body"), "fp", F.col("rep").alias("root")), "golay-keys")
    return _links(rows, found, keys, simhash.RADIUS)


def _minhash_round(rows: DataFrame, found: DataFrame, linked: DataFrame) -> DataFrame:
    """(u, v): what else is similar, beyond the components linked(node, root)."""
    sets = found.select("body", "fp", "keys").dropDuplicates(["body"]).join(linked, F.col("body") == F.col("node"), "left")
    return _links(rows, found, sets.select(F.explode("keys").alias("key"), "body", "fp", F.coalesce("root", "body").alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group that links of similarity 0.8 connect: the one with the smallest doc_id, then hash of the text.

    Rows count one by one: rows that share a doc_id but no text stay or go each by its own group, and equal
    rows leave one: which of them is all the same but for the other columns, of which those of any one row stay.
    Rows without doc_id come last in their group. Texts without words (null, empty, blank) are one group. Very long
    texts are taken whole; a set of shingles is held by one task. An empty table gives none; other columns, whatever their names, stay.
    """
    small_batches(docs.sparkSession)
    line = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.select(F.col("doc_id").cast("long"), line.alias("line"), text_bytes().alias("text"))
    found = materialise(rows.mapInArrow(_keys, "doc_id long, line long, body long, fp long, keys array<long>"), "shingled")
    close = components(_simhash_round(rows, found))
    rest = _minhash_round(rows, found, close)
    roots = components(rest.unionByName(close.toDF("u", "v")))
    grouped = found.select("doc_id", "line", "body").join(roots, F.col("body") == F.col("node"), "left").withColumn("root", F.coalesce("root", "body"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line")).alias("first"))
    kept = first.select(F.col("first.line").alias("line"))
    whole = docs.select(line.alias("line"), F.struct(*every(docs)).alias("row"))  # so that no name of docs clashes with ours
    return whole.join(kept, "line", "left_semi").dropDuplicates(["line"]).select("row.*")
