"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are) and
normalised. The exponent is bisected so that the weights have a given entropy, or so that no
source is repeated more often than a limit. Weights times the token budget give each source's
number of epochs. Every document gets a pseudo-random place in its source's permutation; whole
epochs take all of it, the last one a prefix that meets the budget. Place and epoch name a
block of the mixed stream, so every block holds the sources in the target weights.

The text is never shuffled to decide this: words are counted once into a table of (source, words, place), of which per
source only totals, and ever smaller blocks of places around the end of the last epoch, are looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, discard, every, materialise

#: No source is read more often than this; with the default budget the least repeated is read once.
MAX_EPOCHS = 1.5
#: Blocks into which a part of a source's permutation is cut (a power of two), blocks of the
#: mixed stream, sources at most (they are names of data sets, and each has a row on the driver).
PLACES, BLOCKS, SEED, MOST_SOURCES = 1024, 256, 17, 100_000


@dataclass(frozen=True)
class Plan:
    exponent: float
    budget: float
    weights: dict[str | None, float]
    tokens: dict[str | None, int]

    def epochs(self, source: str | None) -> float:
        return self.budget * self.weights[source] / self.tokens[source] if self.tokens[source] else 1.0


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raised = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()}
    norm = sum(raised.values())
    return {s: r / norm for s, r in raised.items()}


def entropy(p: dict) -> float:
    return -sum(x * math.log(x) for x in p.values() if x > 0)


def _bisect(high_enough, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] for which the monotone test holds."""
    low, high = 0.0, 1.0
    if high_enough(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if high_enough(mid) else (mid, high)
    return high


def make_plan(tokens: dict, target_entropy: float | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> Plan:
    """Exponent, weights and budget. Without a budget the smallest one is taken that reads every
    source once at least. A target entropy out of reach gives the nearest exponent."""
    some = {s: t for s, t in tokens.items() if t}
    if not some:
        return Plan(1.0, 0.0, dict.fromkeys(tokens, 0.0), tokens)

    def repeats(a: float) -> float:
        per = [w / some[s] for s, w in weights(some, a).items()]
        return max(per) * budget if budget else max(per) / min(per)

    if target_entropy is not None:
        a = _bisect(lambda x: entropy(weights(some, x)) <= target_entropy)
    else:
        a = _bisect(lambda x: repeats(x) <= max_epochs)
    p = weights(some, a)
    return Plan(a, budget or max(some[s] / w for s, w in p.items()), {s: p.get(s, 0.0) for s in tokens}, tokens)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with _n (words) and _u, its place among 2**63 in its source's permutation, the same for equal ids."""
    return docs.select(
        F.struct(*every(docs)).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("_n"),
        F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id")), 1).alias("_u"),
    )


def _totals(slim: DataFrame) -> dict:
    found = slim.groupBy("source").agg(F.sum("_n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r["source"]: r["n"] for r in found}


def source_tokens(docs: DataFrame) -> dict:
    """Words of each source."""
    return _totals(_placed(docs))


def _ends(slim: DataFrame, plan: Plan) -> dict:
    """For each source the place at which its last, partial epoch ends.

    The permutation is cut into ``PLACES`` blocks, then the block in which the end lies, and so on, until it
    holds one place only. Every step is one sum by block, combined before the shuffle.
    """
    ends = dict.fromkeys(plan.tokens, 0)
    want = {s: (e - math.floor(e)) * plan.tokens[s] for s in plan.tokens if (e := plan.epochs(s)) - math.floor(e) > 1e-9}
    step, bits = int(math.log2(PLACES)), 63
    inside = {s: (0, 0) for s in want}  # the first place of the block, words before it
    while inside:
        bits = max(0, bits - step)
        low = slim.sparkSession.createDataFrame([(s, p) for s, (p, _) in inside.items()], "s string, low long")
        same = slim.source.eqNullSafe(low.s) & (slim._u >= low.low) & (slim._u - low.low < (1 << min(62, bits + step)))
        near = slim.join(F.broadcast(low), same) if bits + step < 63 else slim.join(F.broadcast(low), slim.source.eqNullSafe(low.s))
        block = F.shiftright(F.col("_u") - F.col("low"), bits)
        sums = near.groupBy("source", block.alias("b")).agg(F.sum("_n").alias("n"), F.min("_u").alias("first"), F.max("_u").alias("last"))
        found: dict = {}
        for r in sums.collect():  # PLACES rows a source at most
            found.setdefault(r["source"], []).append((r["b"], r["n"], r["first"], r["last"]))
        left = {}
        for s, (p, done) in inside.items():
            for b, n, first, last in sorted(found.get(s, [])):
                if done + n >= want[s]:
                    if first == last:
                        ends[s] = last + 1
                    else:
                        left[s] = (p + (b << bits), done)
                    break
                done += n
        inside = left
    return ends


def mix(docs: DataFrame, target_entropy: float | None = None, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(row, source, n_tokens, weight, epoch, block, rank): one row for each time a document is read.

    row: the document with all its columns. weight: of its source. epoch counts from 0; block
    is its block of the mixed stream, and rank orders a block. The document in which a
    budget ends is still read. Null sources are one source; documents without words
    (null, empty) cost nothing and are read once in each epoch begun; documents with the same
    id go together; an empty table gives none.
    """
    slim = materialise(_placed(docs).select("source", "_n", "_u"), "places")
    plan = make_plan(_totals(slim), target_entropy, max_epochs, budget)
    ends = _ends(slim, plan)
    discard(slim)
    table = docs.sparkSession.createDataFrame(
        [(s, plan.weights[s], float(plan.epochs(s)), int(math.floor(plan.epochs(s) + 1e-9)), int(ends[s])) for s in plan.tokens],
        "source string, weight double, epochs double, whole int, until long",
    )
    placed = _placed(docs)
    joined = placed.join(F.broadcast(table), placed.source.eqNullSafe(table.source)).select(
        "row", placed.source, "_n", "_u", "weight", "epochs", "whole", "until"
    )
    times = F.col("whole") + F.when(F.col("_u") < F.col("until"), 1).otherwise(0)
    read = joined.where(times > 0).select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    x = (F.col("epoch") + F.col("_u") / F.lit(float(2**63))) / F.greatest("epochs", F.lit(1e-12))
    return read.select(
        "row",
        "source",
        F.col("_n").alias("n_tokens"),
        "weight",
        "epoch",
        F.least(F.floor(x * BLOCKS), F.lit(BLOCKS - 1)).cast("int").alias("block"),
        F.xxhash64(F.lit(SEED + 1), "_u", "epoch").alias("rank"),
    )


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, rank of ``mix``, without texts."""
    return mix(docs, **how).select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "weight", "epoch", "block", "rank")


def realise(docs: DataFrame, **how) -> DataFrame:
    """The mixed stream itself: docs with the same columns, each as often as it is read, block after block."""
    found = mix(docs, **how)
    return found.repartitionByRange("block", "rank").sortWithinPartitions("block", "rank").select("row.*")
