"""Document quality by random Fourier features, ridge regression and isotonic calibration.

A document is its statistics (ratios of ``quality_rules`` and logarithms of counts),
standardised. Cosines of random projections approximate a Gaussian kernel over them. Each
partition of the training sample adds up its share of the normal equations; the driver sums
a fixed number of them and solves for the ridge weights. A held back third of the sample
calibrates the scores by pooling adjacent violators. Labels, lang, source and doc_id are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_crc32, materialise
from corvane.llm.quality_rules import features, statistics

#: Labelled rows that the model is fitted on, at most (those with the smallest id hashes).
TRAIN_ROWS = 20_000
COSINES, RIDGE, PARTS, SEED, THRESHOLD = 256, 1e-3, 8, 5, 0.3
LOGS = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


def _inputs() -> list:
    ratios = [c.alias(f"x{i}") for i, (n, c) in enumerate(features().items()) if n != "n_words"]
    return ratios + [F.log1p(F.col(n).cast("double")).alias(f"l{i}") for i, n in enumerate(LOGS)]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        out = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.c_[out, np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        steps = np.interp(raw, *self.knots)
        # a little of the raw score keeps the order inside a calibrated step
        return np.clip(0.98 * steps + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least squares fit: block means of x and y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sums(model: Model, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]):
        d = len(model.phase) + 1
        left, right = np.zeros((d, d)), np.zeros(d)
        for f in frames:
            z = model.cosines(f[columns].to_numpy(dtype=float))
            left += z.T @ z
            right += z.T @ f["quality"].to_numpy(dtype=float)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """None without two kinds of labels. Only ids whose crc32 mod 5 is not 0 are learned from."""
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(id_crc32() % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    ids = F.broadcast(picked)  # at most ``rows`` ids
    some = statistics(docs.join(ids.select("doc_id"), "doc_id", "left_semi")).join(ids, "doc_id")
    # rows that share an id are rows of their own, but the bound holds for rows too
    order = [F.xxhash64("doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_upper"]
    some = some.orderBy(*order).limit(rows)
    table = materialise(some.select(*_inputs(), "quality", (F.xxhash64("doc_id") % 3 == 0).alias("held")), "labelled")
    columns = [c for c in table.columns if c not in ("quality", "held")]
    train = table.where("NOT held")
    seen = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("quality").alias("kinds"),
        *(F.avg(c).alias(f"m_{c}") for c in columns),
        *(F.stddev_pop(c).alias(f"s_{c}") for c in columns),
    ).first()
    if seen["kinds"] < 2:
        return None
    rng = np.random.default_rng(SEED)
    scale = np.array([seen[f"s_{c}"] for c in columns])
    model = Model(
        np.array([seen[f"m_{c}"] for c in columns]),
        np.where(scale > 0, scale, 1.0),
        rng.normal(size=(len(columns), COSINES)) / np.sqrt(len(columns)),
        rng.uniform(0, 2 * np.pi, COSINES),
        np.zeros(COSINES + 1),
    )
    sums = train.repartition(PARTS).mapInPandas(_sums(model, columns), "left binary, right binary").collect()
    d = COSINES + 1
    left = sum(np.frombuffer(r["left"]).reshape(d, d) for r in sums)
    model.weights = np.linalg.solve(left + RIDGE * seen["n"] / d * np.eye(d), sum(np.frombuffer(r["right"]) for r in sums))
    held = table.where("held").toPandas()  # a third of the sample
    if not len(held):
        held = train.toPandas()
    model.knots = isotonic(model.raw(held[columns].to_numpy(dtype=float)), held["quality"].to_numpy(dtype=float))
    return model


def _scores(model: Model | None, columns: list[str]):
    def run(batches):
        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns], axis=1) if b.num_rows else np.empty((0, len(columns)))
            s = model.score(x.astype(float)) if model else np.full(len(x), 0.5)
            told = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(told, names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (score at least 0.3).

    Null and empty texts have zero statistics and are scored like any other; equal texts score
    alike, repeated rows and ids included; very long texts are counted whole in one row. Without usable labels every score is
    0.5; an id labelled both ways counts as good. Null ids count as the empty string for held_out and come back null,
    ids of any size as they are. An empty table gives none; other columns are ignored.
    """
    model = fit(docs, labels, rows)
    found = statistics(docs).select(F.col("doc_id").cast("long"), (id_crc32() % 5 == 0).alias("held_out"), *_inputs())
    columns = found.columns[2:]
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return found.mapInArrow(_scores(model, columns), schema)
