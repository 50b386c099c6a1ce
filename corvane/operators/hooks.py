"""Places where a model or a service of the user's comes in: one way to call it for a column.

A hook is a plain function from a list of different values to a list of results. It is called in Arrow batches, once for each
different value of a batch of rows; rows get their result back by a join on the value's hash, so equal
values are sent out once in the whole table. Nothing is called unless a hook is given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.frames import bounded_batches

Hook = Callable[[list], list]


def apply(df: DataFrame, column: str, hook: Hook, out: str, kind: str, batch: int = 64) -> DataFrame:
    """df with ``out``: the hook's result for each value of ``column``, null for null."""
    key = F.md5(F.col(column).cast("binary"))
    asked = df.where(F.col(column).isNotNull()).select(key.alias("_key"), F.col(column).alias("_value")).dropDuplicates(["_key"])

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"_key": part["_key"].to_numpy(), out: list(hook(part["_value"].tolist()))})

    bounded_batches(df.sparkSession)
    found = asked.mapInPandas(run, f"_key string, `{out}` {kind}")
    return df.withColumn("_key", key).join(found, "_key", "left").drop("_key")


def encode(df: DataFrame, encoder: Hook, text: str = "text", out: str = "embedding") -> DataFrame:
    """df with the vectors of its texts; equal texts are encoded once."""
    return apply(df, text, encoder, out, "array<float>")


def rerank_logits(found: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], question: str = "question", text: str = "text", batch: int = 16) -> DataFrame:
    """found with ``logit``, a model's score of each pair of question and text; null where the model failed on a batch."""

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].copy()
                try:
                    part["logit"] = scorer(part[question].tolist(), part[text].tolist())
                except Exception:  # noqa: BLE001 - a failed model is the ranking's business, not the job's
                    part["logit"] = None
                yield part

    bounded_batches(found.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInPandas(run, f"{fields}, logit double")


class Retrying:
    """A hook around a service: three tries for each model with growing pauses, then the next model; after five
    failures in a row nothing is asked for a while. Each worker keeps its own count and its own interval."""

    def __init__(self, models: list[Callable[[str], str]], tries: int = 3, pause: float = 1.0, interval: float = 0.0, failures: int = 5, closed: float = 60.0):
        self.models, self.tries, self.pause, self.interval = models, tries, pause, interval
        self.failures, self.closed = failures, closed
        self.failed, self.until, self.last = 0, 0.0, 0.0

    def one(self, value: str) -> str | None:
        if time.monotonic() < self.until:
            return None
        for model in self.models:
            for n in range(self.tries):
                time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
                self.last = time.monotonic()
                try:
                    out = model(value)
                except Exception:  # noqa: BLE001 - counted below
                    time.sleep(self.pause * 2**n)
                else:
                    self.failed = 0
                    return out
        self.failed += 1
        if self.failed >= self.failures:
            self.failed, self.until = 0, time.monotonic() + self.closed
        return None

    def __call__(self, values: list[str]) -> list[str | None]:
        return [self.one(v) for v in values]
