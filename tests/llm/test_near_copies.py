"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import near_copies, simhash
from corvane.llm.graph import components


def _set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset({tuple(w)})


def _kept(rows):
    """Of (doc_id, text), by brute force: the first row of each component."""
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}


def test_near_copies_go(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:k], "other", *words[k + 1 :]])) for i, k in enumerate((0, 3, 50, 99))]
    rows += [(10, " ".join(words[:40])), (11, " ".join(words[:70])), (12, "a b"), (13, "a b"), (14, None), (15, " "), (16, "A  B")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == _kept(rows) == {0, 10, 11, 12, 14}


def test_rows_with_one_id_are_judged_one_by_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (2, "g h i j k l"), (None, "a b c d e f"), (None, "m n o")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "m n o"), (1, "a b c d e f"), (2, "g h i j k l")]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_small_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == _kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_simhash_links_come_first(spark):
    """Close fingerprints are linked by their Golay keys, and what they link is not compared again."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(["other", *words[1:]])), (4, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: near_copies.shingles(t.encode()) for d, t in rows}
    found = [(d, d, near_copies._body(s), int(np.uint64(simhash.majority(s)).view(np.int64)), near_copies.band_keys(s)) for d, s in sets.items()]
    fps = [simhash.majority(s) for s in sets.values()]
    assert {(fps[0] ^ f).bit_count() <= simhash.RADIUS for f in fps[1:3]} == {True}
    found = spark.createDataFrame(found, "doc_id long, line long, body long, fp long, keys array<long>")
    texts = docs.select(F.col("doc_id").alias("line"), F.encode("text", "utf-8").alias("text"))
    close = components(near_copies._simhash_round(texts, found))
    assert {r["node"] for r in close.collect()} | {r["root"] for r in close.collect()} == {near_copies._body(sets[d]) for d in (1, 2, 3)}
    assert near_copies._minhash_round(texts, found, close).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 4}
