"""Entities by patterns, in order of first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.text import wide
from corvane.operators import hooks
from corvane.operators.classify import extractor_for, hits

# Patterns and cascades.
ARTICLE = wide(r"(?iu)(Art(?:icle)?\.?\s*\d+|(?<![\p{L}\p{N}_])(?:المادة|الفصل|الباب)\s*\d+)")
DATE = wide(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b")
AMOUNT = wide(r"(?iu)(\d[\d\s,.]*)\s*(?:TND|DT|دينار|dinars?)")
NUMBER = wide(r"(?iu)(?:Article|Art\.?|المادة|الفصل)\s*(?:n°|numéro|number|رقم)?\s*(\d+)")
HEADER = wide(r"(?iu)^((CHAPITRE|chapter|SECTION|TITRE|title)\s+[\p{L}\p{N}_]+|(ARTICLE|art\.?|المادة)\s+\d+|[\x{0600}-\x{06FF}]{3,20}\s*$)")
CP = wide(r"(?iu)Art\.?\s*(\d+)\s*du\s*Code\s*pénal")
CPP = wide(r"(?iu)Art\.?\s*(\d+)\s*du\s*Code\s*de\s*procédure\s*pénale")
TRIBUNAL = wide(r"(?iu)(Tribunal\s+(?:de\s+)?(?:Première\s+Instance|d'Instance|de\s+Sfax|Tunis|Ariana))")
PAGE = wide(r"(?i)\bPage\s+\d+\b")
MONEY = wide(r"\d[\d\s.,]*(?:DT|TND|دينار|dinars?)")
MONEY_PARTS = wide(r"(?iu)^(\d[\d\s.,]*)(DT|TND|دينار|dinars?)$")
PARTIES = (
    wide(r"(?iu)Entre\s*:?\s*([\p{L}\p{M}\p{N}_\s]+?)(?:,|et|;)"),
    wide(r"(?iu)(?:Promettant|Promettante)\s*:?\s*([^\n]+)"),
    wide(r"(?iu)(?:Vendeur|Acheteur|Locator|Preneur)\s*:?\s*([^\n,]+)"),
    wide(r"(?iu)الطرف\s+(?:الأول|الثاني)\s*:?\s*([^\n]+)"),
)
TRANSACTIONS = {
    "vente_immobiliere": ["vente", "بيع", "شراء", "acte authentique"],
    "bail": ["bail", "location", "إيجار", "كراء"],
    "societe": ["société", "capital", "أجل", "شركة", "مساهمة"],
    "pret": ["prêt", "قرض", "emprunt", "ضمان"],
    "travail": ["contrat de travail", "عقد عمل", "salarié"],
}
CITIES = ["Tunis", "Sfax", "Sousse", "Ariana", "Ezzahra", "تونس", "صفاقس", "سوسة"]
DUTY = wide(r"(?iu)(?:doit|s'engage|obligé| obliged|ملزم|يلتزم)\s+([^.]+)")
TELLING = wide(r"\d|DT|دينار|Article")
CONTRACT_DATE = wide(r"(?iu)(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s+\d{4})")
COC = wide(r"(?iu)Art\.?\s*(\d+)\s*(?:du\s+)?Code\s+(?:des\s+obligations|des\s+contrats|civil)")
GOODS = wide(r"(?iu)(appartement|terrain|immeuble|voiture|véhicule|معدات|bien\s+immobilier)")
DURATION = wide(r"(?iu)(\d+\s*(?:an|mois|jour|année|سنة|شهر|يوم)s?)")
PLAINTIFFS = (wide(r"(?iu)(?: demandeur|مطالب|المدعي)s?\s*:?\s*([^\n,]+)"), wide(r"(?iu)(?:appelant|طاعن)s?\s*:?\s*([^\n,]+)"))
DEFENDANTS = (wide(r"(?iu)(?:défendeur|مدعى\s+عليه|مطلوب\s+ضده)s?\s*:?\s*([^\n,]+)"), wide(r"(?iu)(?:intimé|معني|المحكوم\s+عليه)s?\s*:?\s*([^\n,]+)"))
FACTS = wide(r"(?isu)(?:Faits\s*et\s*procédure|وقائع|الوقائع|الحيثيات)(.*?)(?:Droit|En\s*droit|القانون|المنطوق|$)")
MEANS = r"(?isu)(?:Moyens|Means|الوسائل)(.*?)(?:Réponse|Réponses|الرد|$)"
HOLDING = wide(r"(?iu)(?:Dispositif|Par\s*ces\s*motifs|المنطوق|قررنا)")
HOLDING_TEXT = wide(r"(?isu)(?:Dispositif|Par\s*ces\s*motifs|المنطوق|قررنا)(.*)$")
PRINCIPLES = (wide(r"(?iu)(?:Attendu\s+que|Considérant\s+que|حيث\s+أن)([^.]+)"), wide(r"(?iu)(?:alors\s+que|بما\s+أن)([^.]+)"))
APPLIED = wide(r"(Articles?|Art\.)\s*(\d+[\s-]*\d*)\s*(?:du\s+)?(Code\s+[\p{L}\p{M}\p{N}_]+|loi\s+[\p{L}\p{M}\p{N}_]+)")
INCIDENTS = (
    ("Accident de la route", ("accident", "حادث", "دهس", "اصطدام")),
    ("Vol", ("vol", "سرقة", "اختلاس")),
    ("Agression", ("agression", "عنف", "ضرب")),
    ("Stupéfiants", ("drogue", "مخدرات", "stupéfiant", "zatla")),
)
GRAVITY = (
    ("Crime (Grave)", ("crime", "جناية", " homicide", "قتل")),
    ("Délit (Moyen)", ("délit", "جنحة")),
    ("Contravention (Léger)", ("contravention", "مخالفة")),
)
DECISIONS = (
    ("Arret_Cassation", ("cassation", "نقض", "قرار", "تقضي")),
    ("Jugement_TPI", ("jugement", "حكم", "محكمة")),
    ("Arret_Cour_Appel", ("appel", "استئناف")),
    ("Ordonnance", ("ordonnance", "أمر")),
)
DAY = wide(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})")
CASE_NUMBER = wide(r"(\d{1,5}[/\\-]\d{4})")
COURTS = (
    r"(?iu)(Cour de Cassation|محكمة النقض)",
    wide(r"(?iu)(Cour d'Appel de\s+[\p{L}\p{N}_]+|محكمة الاستئناف)"),
    wide(r"(?iu)(Tribunal de Première Instance de\s+[\p{L}\p{N}_]+|المحكمة الابتدائية)"),
    r"(?iu)(Tribunal Administratif|المحكمة الإدارية)",
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the pattern holds, match after match; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def every(text: Column, pattern: str, most: int | None = None) -> Column:
    """Different matches in order of first occurrence, all of them unless ``most`` is given."""
    out = F.array_distinct(found(text, pattern))
    return out if most is None else F.slice(out, 1, most)


def trimmed(items: Column, longer_than: int = 0) -> Column:
    out = F.transform(items, lambda x: F.trim(x, F.lit(" \t\n\r\f")))
    return F.filter(out, lambda x: F.length(x) > longer_than)


def cascade(text: Column, steps, otherwise: str) -> Column:
    """The first class of which a keyword occurs in the lower-cased text."""
    out = None
    for name, keys in steps:
        found = F.lower(text).rlike("|".join(keys))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(otherwise)


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    amounts = F.slice(F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(1)), 1, 3)
    return df.withColumns(
        {
            "articles": every(t, ARTICLE, 10),
            "dates": every(t, DATE, 5),
            "amounts": amounts,
            "article_number": F.nullif(F.regexp_extract(t, NUMBER, 1), F.lit("")),
            "is_header": F.trim(t).rlike(HEADER),
        }
    )


def penal(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.withColumns(
        {
            "articles_cp": every(t, CP),
            "articles_cpp": every(t, CPP),
            "courts": every(t, TRIBUNAL),
            "incident": cascade(t, INCIDENTS, "Non spécifié"),
            "gravity": cascade(t, GRAVITY, "Indéterminée"),
        }
    )


def decision(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    head = F.substring(t, 1, 500)
    courts = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in COURTS]
    date = F.concat_ws("-", *(F.regexp_extract(head, DAY, g) for g in (3, 2, 1)))
    return df.withColumns(
        {
            "decision": cascade(F.substring(t, 1, 1000), DECISIONS, "Decision_Judiciaire"),
            "court": F.coalesce(*courts),
            "case_number": F.nullif(F.regexp_extract(t, CASE_NUMBER, 1), F.lit("")),
            "decided": F.when(head.rlike(DAY), date),
        }
    )


def page_breaks(text: Column, pages: Column) -> Column:
    """Where ``Page N`` stands; with fewer marks than pages - 1, breaks at even distances."""
    marks = F.transform(T.matches(text, PAGE), lambda m: m["start"])
    step = F.when(pages > 1, F.floor(F.length(text) / pages)).otherwise(F.length(text)).cast("int")
    even = F.when(pages > 1, F.transform(F.sequence(F.lit(1), F.greatest(pages - 1, F.lit(1))), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(marks) < pages - 1, even).otherwise(marks)


def amounts(text: Column) -> Column:
    """(value without spaces, currency, 20 characters of context on either side) of every amount."""
    return F.transform(
        T.matches(text, "(?iu)" + MONEY),
        lambda m: F.struct(
            F.replace(F.regexp_extract(m["text"], MONEY_PARTS, 1), F.lit(" "), F.lit("")).alias("value"),
            F.regexp_extract(m["text"], MONEY_PARTS, 2).alias("currency"),
            F.trim(
                F.substring(text, F.greatest(m["start"] - 19, F.lit(1)), F.length(m["text"]) + 20 + F.least(m["start"], F.lit(20))), F.lit(" \t\n\r\f")
            ).alias("context"),
        ),
    )


def transaction(low: Column) -> Column:
    """The type of a lower-cased text with the most keywords, the one declared first among equals."""
    scored = [F.struct(hits(low, keys).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("t")) for i, (name, keys) in enumerate(TRANSACTIONS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["t"]).otherwise("non_identifie")


def contract(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what a contract holds: amounts, parties, dates, articles_coc, transaction, city, duties, goods, durations, snippets."""
    df = df.withColumn("_repaired", T.repair_numbers(F.coalesce(F.col(text), F.lit(""))))  # a column of its own, so that it is computed once
    df = df.withColumn("_lowered", F.lower("_repaired"))
    t = F.col("_repaired")
    parties = F.array_distinct(F.concat(*(trimmed(found(t, p), 3) for p in PARTIES)))
    city = F.coalesce(*(F.when(F.contains(t, F.lit(c)), F.lit(c)) for c in CITIES))
    return df.withColumns(
        {
            "amounts": amounts(t),
            "parties": F.slice(parties, 1, 10),
            "dates": every(t, CONTRACT_DATE),
            "articles_coc": every(t, COC),
            "transaction": transaction(F.col("_lowered")),
            "city": city,
            "duties": F.slice(trimmed(found(t, DUTY), -1), 1, 5),
            "goods": every(t, GOODS),
            "durations": every(t, DURATION),
            "snippets": F.slice(F.filter(F.split(t, "\n\n"), lambda p: p.rlike(TELLING)), 1, 3),
        }
    ).drop("_repaired", "_lowered")


def section(text: Column, pattern: str) -> Column:
    """The first match's text, at most 2000 characters and dots; null without a match."""
    body = F.trim(F.regexp_extract(text, pattern, 1), F.lit(" \t\n\r\f"))
    cut = F.when(F.length(body) > 2000, F.concat(F.substring(body, 1, 2000), F.lit("..."))).otherwise(body)
    return F.when(text.rlike(pattern), cut)


def ruling(df: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Adds plaintiffs, defendants, facts, means, holding, principles and applied (reference, number, code) to ``decision``.

    strict: the holding is empty wherever its heading occurs; otherwise it is what follows the heading.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole, number, code = (found(t, "(?iu)" + APPLIED, g) for g in (0, 2, 3))
    applied = F.transform(F.arrays_zip(whole.alias("r"), number.alias("n"), code.alias("c")), lambda x: F.struct(x["r"].alias("reference"), x["n"].alias("number"), x["c"].alias("code")))
    principles = F.concat(*(F.transform(F.filter(found(t, p), lambda x: F.length(x) > 20), lambda x: F.trim(x, F.lit(" \t\n\r\f"))) for p in PRINCIPLES))
    return decision(df, text).withColumns(
        {
            "plaintiffs": F.concat(*(trimmed(found(t, p), -1) for p in PLAINTIFFS)),
            "defendants": F.concat(*(trimmed(found(t, p), -1) for p in DEFENDANTS)),
            "facts": section(t, FACTS),
            "means": section(t, MEANS),
            "holding": F.when(t.rlike(HOLDING), F.lit("")) if strict else section(t, HOLDING_TEXT),
            "principles": F.slice(principles, 1, 10),
            "applied": applied,
        }
    )


def valid_contract(df: DataFrame) -> Column:
    """Two parties or an amount."""
    return (F.size("parties") >= 2) | (F.size("amounts") > 0)


def valid_ruling(df: DataFrame) -> Column:
    """A court or a section with text."""
    return F.col("court").isNotNull() | F.greatest(*(F.length(F.coalesce(c, F.lit(""))) for c in ("facts", "means", "holding"))).cast("boolean")


def valid_penal(df: DataFrame) -> Column:
    """An article or a known gravity."""
    return (F.size("articles_cp") > 0) | (F.size("articles_cpp") > 0) | (F.col("gravity") != "Indéterminée")


def dispatch(df: DataFrame, category: str = "category", text: str = "text") -> DataFrame:
    """(all columns of df, extractor, valid, entities as JSON): each document by the extractor of its category."""
    rows = df.withColumn("extractor", extractor_for(F.col(category)))
    out = None
    for name, read, valid in (("penal", penal, valid_penal), ("contract", contract, valid_contract), ("ruling", ruling, valid_ruling)):
        some = rows.where(F.col("extractor") == name)
        full = read(some, text)
        added = [c for c in full.columns if c not in rows.columns]
        part = full.select(*rows.columns, valid(full).alias("valid"), F.to_json(F.struct(*added)).alias("entities"))
        out = part if out is None else out.unionByName(part)
    return out


#: What a model is asked for.
STRUCTURE = "classification string, parties array<string>, articles_cites array<string>, dates_importantes array<string>, resume string, mots_cles array<string>"


def structured(df: DataFrame, hook=None, text: str = "text", path: str = "context_path", chars: int = 3000) -> DataFrame:
    """Adds structured (the six fields), from_model and classification: a model's JSON for the first characters of a text and its folder.

    hook gives JSON, fenced or not, for each of a list of prompts. Without a hook, or where it gives nothing, articles and dates come from
    ``entities`` and the classification is Inconnu.
    """
    prompt = F.concat(F.lit("Contexte: "), F.coalesce(path, F.lit("")), F.lit("\nTexte: "), F.substring(F.coalesce(text, F.lit("")), 1, chars))
    rows = df.withColumn("_prompt", prompt)
    rows = hooks.apply(rows, "_prompt", hook, "_told", "string") if hook else rows.withColumn("_told", F.lit(None).cast("string"))
    told = F.from_json(T.sanitise_json("_told"), STRUCTURE)
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    plain = F.struct(
        F.lit("Inconnu").alias("classification"), none.alias("parties"), every(t, ARTICLE, 10).alias("articles_cites"), every(t, DATE, 5).alias("dates_importantes"),
        F.lit("").alias("resume"), none.alias("mots_cles"),
    )
    out = rows.withColumn("_got", told).withColumn("from_model", F.coalesce(F.col("_got.classification").isNotNull(), F.lit(False)))
    out = out.withColumn("structured", F.when(F.col("from_model"), F.col("_got")).otherwise(plain))
    return out.withColumn("classification", F.col("structured.classification")).drop("_prompt", "_told", "_got")
