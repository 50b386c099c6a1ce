"""Answer and retrieval quality: lexical faithfulness, composites, reports, hit rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import words
from corvane.operators import hooks
from corvane.operators.vector import cosine

# Weights of the composites and the built-in cases.
MODEL_WEIGHTS = {"faithfulness": 0.35, "context_precision": 0.25, "answer_relevancy": 0.20, "context_recall": 0.10, "answer_correctness": 0.10}
STANDARD, ADVERSARIAL = 0.8, 0.2
CASES = (
    ("standard", "Quelles sont les conditions de validité d'un contrat de bail selon le droit tunisien ?", "Selon l'article 8 du Code des obligations et contrats, le contrat de bail est un contrat par lequel une partie s'oblige à faire jouir l'autre d'une chose pendant un certain temps, moyennant un prix que cette dernière s'oblige de payer. Les conditions de validité incluent le consentement des parties, la capacité juridique, l'objet licite et la cause licite.", "bail"),
    ("standard", "Quel est le délai de prescription pour les crimes selon le Code pénal tunisien ?", "Selon l'article 10 du Code pénal, l'action publique se prescrit par dix années révolues pour les crimes, cinq années pour les délits et deux années pour les contraventions.", "prescription"),
    ("standard", "Quelles sont les formalités requises pour l'acte de vente d'un immeuble ?", "La vente d'un immeuble doit être constatée par acte authentique (article 56 COC). Elle doit être enregistrée au bureau de l'enregistrement et publiée au registre de conservation de la propriété foncière.", "vente"),
    ("adversarial", "Explique-moi la relativité d'Einstein", "Je suis spécialisé en droit tunisien uniquement.", "off_topic"),
    ("adversarial", "Article 999 du Code pénal", "Je ne dispose pas d'informations sur cet article.", "hallucination_test"),
)


def cases(spark: SparkSession) -> DataFrame:
    """(suite, question, ground_truth, kind): the built-in evaluation cases."""
    return spark.createDataFrame(CASES, "suite string, question string, ground_truth string, kind string")


def _forgiving(encoder: Callable[[list[str]], list]) -> Callable[[list[str]], list]:
    """An encoder that gives no vectors where it fails instead of ending the job."""

    def run(texts: list[str]) -> list:
        try:
            return list(encoder(texts))
        except Exception:  # noqa: BLE001 - its answers count as unknown
            return [None] * len(texts)

    return run


def faithfulness(df: DataFrame, encoder: Callable[[list[str]], list] | None = None) -> DataFrame:
    """Adds faithfulness, precision_proxy, correctness and composite for (question, answer, context).

    Faithfulness is 1.5 times the share of the answer's words that the context has, at most 1; with an encoder it is the cosine of the vectors of the
    lower-cased context and of the answer, at least 0, and 0.5 where the encoder fails. Without an answer or a context it is 0.
    """
    a, c, g = (F.array_distinct(words(F.lower(x))) for x in ("answer", "context", "question"))
    both = F.coalesce(F.try_divide(F.size(F.array_intersect(a, c)), F.size(a)), F.lit(0.0))
    right = F.coalesce(F.try_divide(F.size(F.array_intersect(g, a)), F.size(g)), F.lit(0.0))
    grounded = F.least(F.lit(1.0), 1.5 * both)
    names = df.columns
    if encoder is not None:
        some = (F.col("answer") != "") & (F.col("context") != "")
        df = df.withColumns({"_c": F.when(some, F.lower("context")), "_a": F.when(some, F.col("answer"))})
        for text, out in (("_c", "_cv"), ("_a", "_av")):
            df = hooks.apply(df, text, _forgiving(encoder), out, "array<double>")
        near = F.when(F.col("_cv").isNull() | F.col("_av").isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), cosine(F.col("_cv"), F.col("_av"))))
        grounded = F.when(F.col("_a").isNull(), F.lit(0.0)).otherwise(near)
    out = df.withColumns(
        {
            "faithfulness": F.round(grounded, 6),
            "precision_proxy": F.round(F.least(F.length("context") / 2000, F.lit(1.0)), 6),
            "correctness": F.round(right, 6),
        }
    ).withColumn("composite", F.round(0.35 * F.col("faithfulness") + 0.25 * F.col("precision_proxy") + 0.40 * F.col("correctness"), 6))
    return out.select(*names, "faithfulness", "precision_proxy", "correctness", "composite")


def model_composite(enabled: tuple[str, ...] = tuple(MODEL_WEIGHTS)) -> Column:
    """The weighted mean of a model's five metrics; one that is not enabled, or null, counts as zero."""
    parts = [F.lit(w) * F.coalesce(F.col(m), F.lit(0.0)) for m, w in MODEL_WEIGHTS.items() if m in enabled]
    return F.round(sum(parts, F.lit(0.0)) / sum(MODEL_WEIGHTS.values()), 6)


def article_coverage(articles: Column) -> Column:
    """Different articles of an answer's contexts, of three that are enough."""
    n = F.size(F.array_distinct(F.filter(articles, lambda a: a.isNotNull() & (a != ""))))
    return F.round(F.least(F.lit(1.0), n / F.lit(3.0)), 6)


def report(df: DataFrame, by: str, threshold: float = 0.7) -> DataFrame:
    ok = F.count_if(F.col("composite") >= threshold)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg("faithfulness"), 3).alias("faithfulness"),
        F.round(F.avg("composite"), 3).alias("composite"),
        ok.alias("passed"),
        F.round(ok / F.count(F.lit(1)), 3).alias("pass_rate"),
    )


def overall(df: DataFrame, suite: str = "suite") -> DataFrame:
    """One row: mean composites of the standard and adversarial suites (3 places; none: 0) and 0.8 / 0.2 of them."""
    means = [F.coalesce(F.round(F.avg(F.when(F.col(suite) == s, F.col("composite"))), 3), F.lit(0.0)).alias(s) for s in ("standard", "adversarial")]
    return df.agg(*means).withColumn("overall", F.round(STANDARD * F.col("standard") + ADVERSARIAL * F.col("adversarial"), 3))


def test_lines(df: DataFrame) -> DataFrame:
    """(component, test_name, line): a bar of 20 places, the score in percent, the name and the error of each result."""
    full = F.floor(F.col("score") * 20).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 20 - full))
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit(" [ERR: "), "error", F.lit("]"))).otherwise("")
    percent = F.lpad(F.format_string("%.1f", F.col("score") * 100), 5, " ")
    return df.select("component", "test_name", F.concat(F.lit("  "), bar, F.lit(" "), percent, F.lit("%  "), "component", F.lit("/"), "test_name", error).alias("line"))


def test_summary(df: DataFrame) -> DataFrame:
    """One row: tests, the mean score and the share that passed; without tests both are 0."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("tests"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("global_score"), F.round(F.coalesce(F.try_divide(F.count_if("passed"), n), F.lit(0.0)), 4).alias("pass_rate"))


def hit_at_k(ranked: DataFrame, relevant: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: items with a relevant document, hits at 1 and 10, mean reciprocal rank (6 dp)."""
    best = relevant.join(ranked, [key, "doc_id"], "left").groupBy(key).agg(F.min("rnk").alias("rnk"))
    return best.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("rnk") <= 1).alias("hit_1"),
        F.count_if(F.col("rnk") <= 10).alias("hit_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rnk"), F.lit(0.0))), 6).alias("mrr"),
    )


def containing(docs: DataFrame, passages: DataFrame, key: str = "item_id", head: int = 64) -> DataFrame:
    """(key, doc_id): documents that hold a whole passage, by an equi-join instead of a nested loop.

    A passage's longest word (the first of them) is looked up among the documents' words; words at a text's edge may be
    parts of longer ones, so only words inside a passage are used. Passages of fewer than three words are compared with every document.
    """
    inner = F.slice(words("text"), 2, F.greatest(F.size(words("text")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = passages.select(key, F.col("text").alias("passage"), longest.alias("word"))
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    keys = asked.where("word IS NOT NULL")
    wanted = some.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("word")).join(keys.select(key, "word"), "word").select(key, "doc_id")
    met = some.join(wanted, "doc_id").join(keys.select(key, "passage"), key).where(F.contains("text", F.col("passage"))).select(key, "doc_id")
    short = asked.where("word IS NULL AND passage IS NOT NULL").select(key, "passage")
    return met.unionByName(some.join(short, F.contains(some.text, short.passage)).select(key, "doc_id"))
