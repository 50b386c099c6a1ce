"""Learned decision lists over document statistics, DataFrame functions only.

Statistics are built-in expressions of one row, so the main path has no shuffle at all: the
text is read once and each document yields its numbers in place. The rules come from a
bounded sample of labelled documents (``SAMPLE_ROWS``, the labelled ids with the smallest
hashes): sequential covering grows a conjunction of thresholds on two thirds of the sample
by information gain, prunes it on the rest, removes what it covers, and goes on until
no rule is precise enough. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WORD, every

#: Labelled rows that rules are learned from, at most; a smaller table is used whole.
SAMPLE_ROWS = 8192
#: A rule must be this precise on the rows held back for pruning, and cover this many there.
MIN_PRECISION, MIN_COVERED, MAX_RULES, MAX_TERMS, CUTS = 0.97, 5, 12, 3, 24
BLANK = r"[\x20\x09-\x0D]"
FEATURES = ("symbols_per_word", "chars_per_word", "dup_lines_per_line", "repeat_share", "upper_share", "bangs_per_word", "n_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document (null text: empty).

    n_words; word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``;
    n_lines and n_dup_lines, lines with a word and those equal to an earlier one;
    n_repeat_words, words inside three-word windows that occur twice or more; n_upper, A to
    Z; n_bangs. Windows are compared by chained 64-bit hashes of their words.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = base.select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    none = F.array().cast("array<bigint>")
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ).otherwise(none).alias("windows"),
    )
    plain = [c for c in counted.columns if c != "windows"]
    at = counted.select(
        *plain,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    twice = at.select(
        *plain,
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, k: (F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ).alias("at"),
    )
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("at", k - 1)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    row = F.struct(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # a generated row: filters on the counts stay above it instead of repeating their expressions below
    return twice.select(F.inline(F.array(row)))


def features() -> dict[str, Column]:
    """The ratios that rules test, as expressions over ``statistics``; zero where nothing is to divide by."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    ratios = (
        share("n_symbols", "n_words"),
        share("word_chars", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "word_chars"),
        share("n_bangs", "n_words"),
        F.col("n_words").cast("double"),
    )
    return dict(zip(FEATURES, ratios, strict=True))


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, exprs: dict[str, Column]) -> Column:
        return exprs[self.feature] > self.cut if self.above else exprs[self.feature] <= self.cut


def _covers(rule: list[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.mask(x)
    return out


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    if not p1:
        return -math.inf
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    rule: list[Term] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_TERMS and (~bad[inside]).any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, best_gain = None, 1e-9
        for f in FEATURES:
            cuts = np.unique(np.quantile(x[f][inside], np.linspace(0, 1, CUTS + 1)))
            for cut in (cuts[:-1] + cuts[1:]) / 2:
                for above in (True, False):
                    t = Term(f, above, float(cut))
                    hit = t.mask(x) & inside
                    p1 = int(bad[hit].sum())
                    if (g := _gain(p1, int(hit.sum()) - p1, p0, n0)) > best_gain:
                        best, best_gain = t, g
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return rule


def learn(rows: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Term]]:
    """Ordered rules for what to reject; empty where labels are missing or of one kind."""
    if not len(bad) or bad.all() or not bad.any():
        return []
    turn = np.arange(len(bad)) % 3 == 2  # the sample comes in hash order: any third is as good
    rules: list[list[Term]] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~turn, left & turn
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow({f: v[grow] for f, v in rows.items()}, bad[grow])
        held, marks = {f: v[prune] for f, v in rows.items()}, bad[prune]

        def worth(r: list[Term], held=held, marks=marks) -> tuple[float, int]:
            hit = _covers(r, held, len(marks))
            p, n = int(marks[hit].sum()), int(hit.sum())
            return ((2 * p - n) / n if n else -1.0), p

        options = [rule[:k] for k in range(1, len(rule) + 1)]
        if not options:
            break
        rule = max(options, key=worth)
        hit = _covers(rule, held, len(marks))
        if hit.sum() < MIN_COVERED or marks[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, rows, len(bad))
    return rules


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and marks (quality 0) of at most ``rows`` labelled rows, ordered by hashes of id and features.

    An id that is labelled both ways counts as bad (quality 0). Rows that share an id are rows of their own.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    ids = F.broadcast(picked)  # at most ``rows`` ids
    some = statistics(docs.join(ids.select("doc_id"), "doc_id", "left_semi")).join(ids, "doc_id")
    names = [f"f_{n}" for n in FEATURES]
    found = some.select("doc_id", "quality", *(c.alias(n) for c, n in zip(features().values(), names, strict=True)))
    # equal rows may come in any order; different ones never do
    got = found.orderBy(F.xxhash64("doc_id", F.lit("turn")), "doc_id", *names).limit(rows).collect()
    return {f: np.array([r[f"f_{f}"] for r in got], dtype=float) for f in FEATURES}, np.array([r["quality"] == 0 for r in got], dtype=bool)


def fired(rules: list[list[Term]]) -> Column:
    """One ordered conditional expression: the number of the first rule that holds, from 1, or 0."""
    exprs, out = features(), None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column(exprs)
        for t in rule[1:]:
            holds = holds & t.column(exprs)
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: its statistics, base_failed, rule (0: none) and kept.

    base_failed: under 50 words, or more than half of the words lie in repeated three-word
    windows. Null and empty texts have no words and fail. Without usable labels the list is
    empty and only base_failed decides. Equal texts get equal verdicts, repeated rows and ids included; very long texts
    are counted whole in one row. An empty table gives none. Columns other than doc_id and text are ignored, whatever
    their names.
    """
    rules = learn(*sample(docs, labels, rows))
    found = statistics(docs).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return found.withColumn("rule", fired(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the documents that ``judge`` rejects, all columns kept, whatever their names, in one pass.

    Null, empty and short texts go; repeated rows stay or go together; an empty table gives none.
    """
    rules = learn(*sample(docs, labels, rows))
    row = docs.select(F.struct(*every(docs)).alias("doc_id"), F.col("text"))
    found = statistics(row).where("NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)")
    return found.where(fired(rules) == 0).select("doc_id.*")
