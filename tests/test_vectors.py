"""Vector search, leader clustering and the cache against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import leaders, semcache, vector

VEC = "vec_id long, embedding array<double>, label string"


def rows(n, size=6, seed=0, copies=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    for i in range(copies, n, 7):
        base[i] = base[i % copies] * 2 + rng.normal(size=size) * 0.02 * (i % 3)
    return [(int(i), [float(x) for x in v], "abc"[i % 3]) for i, v in enumerate(base)]


BAD = [(900, None, "a"), (901, [math.nan] * 6, "a"), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a"), (903, [math.inf] * 6, "a"), (904, [1.0, 2.0], "a"), (905, [0.0] * 6, None), (None, [1.0] * 6, "a")]


def cos(a, b):
    if len(a) != len(b):
        return None
    x, y = math.sqrt(sum(p * p for p in a)), math.sqrt(sum(p * p for p in b))
    return round(sum(p * q for p, q in zip(a, b)) / (x * y), 6) if x and y else 0.0


def fine(v):
    return v is not None and v and all(x is not None and math.isfinite(x) for x in v)


def nearest(data, asked, top, keep_self, same=False):
    out = []
    for q, u, a in asked:
        if q is None or not fine(u):
            continue
        met = [(-s, i) for i, v, b in data if i is not None and fine(v) and (keep_self or i != q) and (not same or a == b and a is not None) and (s := cos(u, v)) is not None]
        out += [(q, i, -s, k) for k, (s, i) in enumerate(sorted(met)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("same", [None, "label"])
def test_search_against_a_loop(spark, monkeypatch, blocks, same):
    if blocks:
        monkeypatch.setattr(vector, "PEEK", 4)
        monkeypatch.setattr(vector, "BLOCK_BYTES", 500)
        monkeypatch.setattr(vector, "TILE_Q", 3)
        monkeypatch.setattr(vector, "TILE_V", 7)
    data = rows(120) + BAD
    asked = data[:30] + BAD
    got = vector.search(spark.createDataFrame(data, VEC), spark.createDataFrame(asked, VEC), 4, keep_self=False, same=same)
    assert sorted(map(tuple, got.select("query_id", "vec_id", "sim", "rnk").collect())) == nearest(data, asked, 4, False, bool(same))


def test_search_with_ids_of_any_kind(spark):
    data = [(f"{i}_chunk", v, x) for i, v, x in rows(40)]
    df = spark.createDataFrame(data, VEC.replace("long", "string"))
    got = vector.search(df, df.limit(9), 3)
    assert sorted(map(tuple, got.collect())) == nearest(data, [d for d in data if d[0] in {r[0] for r in got.select("query_id").collect()}], 3, True)


def test_one_bad_vector_takes_no_result_away(spark):
    data = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [math.nan, 1.0], "a"), (4, [0.8, 0.3], "a")]
    df = spark.createDataFrame(data, VEC).coalesce(1)
    assert [r["vec_id"] for r in vector.search(df, df.where("vec_id = 1"), 2, keep_self=False).orderBy("rnk").collect()] == [2, 4]


def led(data, threshold):
    """Leaders by one loop in order of ids."""
    heads, out = [], {}
    for i, v in sorted((i, v) for i, v, _ in data if i is not None and fine(v)):
        out[i] = next((h for h, u in heads if (s := cos(u, v)) is not None and s > threshold), i)
        if out[i] == i:
            heads.append((i, v))
    return out


@pytest.mark.parametrize("threshold", [0.98, 0.3])
@pytest.mark.parametrize("batch", [8192, 40])
def test_leaders_against_a_loop(spark, monkeypatch, threshold, batch):
    monkeypatch.setattr(leaders, "BATCH", batch)
    monkeypatch.setattr(leaders, "TILE", 16)
    data = rows(200, size=4, seed=3) + [(i, [0.5, 0.5, 0.1, 0.0], "x") for i in range(300, 360)] + BAD
    got = leaders.lead(spark.createDataFrame(data, VEC), threshold)
    assert {r["vec_id"]: r["leader"] for r in got.collect()} == led(data, threshold)


def test_leaders_of_nothing(spark):
    assert leaders.lead(spark.createDataFrame([], VEC), 0.9).count() == 0
    assert leaders.lead(spark.createDataFrame(BAD[:4], VEC), 0.9).count() == 0


def kept(entries, new, same):
    """A cache by a loop: entries (id, vector, answer, ts)."""
    held = [list(e) for e in sorted(entries)]
    for i, v, answer, ts in sorted(new):
        if len(answer.strip()) < 20 or not fine(v):
            continue
        first = next((e for e in held if cos(e[1], v) > same), None)
        if first:
            first[2:] = [answer, ts]
        else:
            held.append([i, v, answer, ts])
    return sorted((e[0], e[2], e[3]) for e in held)


@pytest.mark.parametrize("same", [0.98, 0.3])
def test_put_goes_one_after_another(spark, same):
    schema = "vec_id long, embedding array<double>, answer string, ts long"
    data = [(i, v, "short" if i % 11 == 5 else f"an answer that is long enough {i}", i * 10) for i, v, _ in rows(150, size=4, seed=8)]
    old, new = [d for d in data if d[0] < 20], [d for d in data if d[0] >= 20]
    got = semcache.put(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), same=same)
    assert sorted(map(tuple, got.select("vec_id", "answer", "ts").collect())) == kept(old, new, same)


def test_lookup_as_of_a_time(spark):
    rng = np.random.default_rng(4)
    base = rows(60, size=3, seed=5)
    writes = [(i, v, f"an answer that is long enough {i}", int(rng.integers(0, 300))) for i, v, _ in base]
    asks = [(1000 + i, v, int(rng.integers(0, 400))) for i, v, _ in rows(50, size=3, seed=6)] + [(2000, None, 5), (2001, [0.0, 1.0, 0.0], None)]
    ttl, same, least = 90, 0.95, 0.9
    want = {}
    for q, u, at in asks:
        held = []  # entry vector, version, time
        for t, i, v in sorted((t, i, v) for i, v, _, t in writes if at is not None and t < at):
            first = next((e for e in held if cos(e[0], v) > same), None)
            if first:
                first[1:] = [i, t]
            else:
                held.append([v, i, t])
        met = sorted((-cos(u, v), i) for v, i, t in held if u is not None and t + ttl >= at)
        want[q] = (met[0][1], -met[0][0], -met[0][0] >= least) if met else (None, None, False)
    w = spark.createDataFrame(writes, "vec_id long, embedding array<double>, answer string, t long").withColumn("ts", F.timestamp_seconds("t"))
    a = spark.createDataFrame(asks, "vec_id long, embedding array<double>, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = semcache.lookup_as_of(semcache.versions(w, ttl, same), a, least)
    assert {r["query_id"]: (r["version"], r["sim"], r["hit"]) for r in got.collect()} == want
    assert sum(x[2] for x in want.values()) > 3


@pytest.mark.parametrize("near", [1, 16])
def test_leaders_in_wide_batches(spark, monkeypatch, near):
    """After the first batch a pass over the rows settles many times as many, also where groups of near copies hold more than is told of a row."""
    monkeypatch.setattr(leaders, "BATCH", 20)
    monkeypatch.setattr(leaders, "NEAR", near)
    monkeypatch.setattr(leaders, "HEADS", 7)
    monkeypatch.setattr(leaders, "BLOCK_BYTES", 200 * 8 * 6)
    passes = []
    monkeypatch.setattr(leaders, "materialise", lambda df, name, f=leaders.materialise: passes.append(name) or f(df, name))
    data = rows(420, copies=40) + BAD
    got = leaders.lead(spark.createDataFrame(data, VEC), 0.98)
    assert {r["vec_id"]: r["leader"] for r in got.collect()} == led(data, 0.98)
    if near == 16:
        assert len(passes) <= 8


def test_timed_search_in_blocks_of_time(spark, monkeypatch):
    monkeypatch.setattr(vector, "PEEK", 8)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 400)
    monkeypatch.setattr(vector, "TILE_Q", 3)
    monkeypatch.setattr(vector, "TILE_V", 7)
    rng = np.random.default_rng(2)
    held = [(i, v, int(t), int(t) + 30) for (i, v, _), t in zip(rows(150, seed=1), rng.integers(0, 300, 150), strict=True)]
    asks = [(1000 + i, [x + 1e-7 * i for x in held[i][1]], int(t)) for i, t in enumerate(rng.integers(0, 300, 60))]
    want = set()
    for q, u, at in asks:
        met = sorted((-cos(u, v), i) for i, v, since, until in held if since < at <= until)
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(met[:2], 1)}
    vectors = spark.createDataFrame(held, "vec_id long, embedding array<double>, since long, until long")
    asked = spark.createDataFrame(asks, "vec_id long, embedding array<double>, at long")
    assert set(map(tuple, vector.search(vectors, asked, 2, timed=True).select("query_id", "vec_id", "sim", "rnk").collect())) == want
    times = [b.times for b in vector._blocks(vector._plain(asked, "vec_id", "at"), "vec_id", True)]
    assert len(set(times)) > 3
    assert all(a == b or a[1] < b[0] or b[1] < a[0] for a in times for b in times)


def test_pairs_at_the_threshold_are_judged_in_double_precision():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(40, 64))
    a /= np.sqrt((a * a).sum(axis=1, keepdims=True))
    b = a + rng.normal(size=a.shape) * 1e-2
    b /= np.sqrt((b * b).sum(axis=1, keepdims=True))
    least = float(np.round((a * b).sum(axis=1), 6)[5])
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    for at in (least, least - 1e-6):
        near = np.round(a @ b.T, 6) > at
        found = vector.first_near(rough, at, vector.slack(64), lambda i, j: vector.exact(a, b, i, j))
        assert (found == np.where(near.any(axis=1), near.argmax(axis=1), -1)).all()
