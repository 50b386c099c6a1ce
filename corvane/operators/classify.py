"""Questions and documents to classes: routing, triggers, weights, intents, document types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import language, wide, words

# Keyword and pattern lists of the classifiers.
COMPLEX = {
    "fr": [
        "relation", "lien", "lié", "interagit", "interagissent", "connecté", "rapport", "dépend", "influence", "impact",
        "compar", "différence", "similitude", "oppose", "versus", "tous les", "liste des", "ensemble", "cumul", "cumulatif",
        "en lien avec", "par rapport à", "concernant", "portant sur", "articles liés", "dispositions connexes",
        "textes relatifs", "pourquoi", "comment", "explique", "analyse", "synthèse",
    ],
    "ar": [
        "علاقة", "مرتبط", "متصل", "يتفاعل", "يؤثر", "تأثير", "فرق", "اختلاف", "تشابه", "مقارنة", "جميع", "كل", "قائمة",
        "مجموع", "تراكمي", "فيما يتعلق", "بخصوص", "لماذا", "كيف", "اشرح", "حلل", "تلخيص",
    ],
}
RELATIONAL = {
    "fr": [
        "relation", "lien", "lié", "interagit", "connecté", "rapport", "dépend", "influence", "impact", "compar",
        "différence", "similitude", "tous les", "liste des", "ensemble", "cumul", "articles liés", "dispositions connexes",
        "pourquoi", "comment", "analyse", "synthèse",
    ],
    "ar": [
        "علاقة", "مرتبط", "متصل", "يتفاعل", "يؤثر", "فرق", "اختلاف", "تشابه", "مقارنة", "جميع", "قائمة", "تراكمي",
        "لماذا", "كيف", "حلل", "تلخيص",
    ],
}
FACTUAL = wide(r"^(quel\s+est\s+l'article|article\s+\d+|définition|qu'est-ce|c'est\s+quoi|donne\s+moi|cite)")
MULTI_HOP = wide(r"article\s+\d+.+article\s+\d+|(code|loi).+(code|loi)|(bail|contrat|vente).+(obligations|pénal|civil)")
DEFINITION = r"^(qu'est-ce que|définition|c'est quoi|ما هو|تعريف)"
#: Questions that need no hypothetical answer, tested without punctuation.
GATE = wide(
    r"^(quel(le)?s?\s+est\s+(l[' ])?article|article\s+\d+|définition\s+de|qu[' ]est[- ]ce\s+que"
    r"|المادة\s+\d+|ما\s+هو\s+تعريف|من\s+هو|cite(z)?\s+|donne(z)?\s+moi)"
)
ARTICLE_REFERENCE = wide(r"(?:art\.?|article|المادة)\s*[.\-]?\s*(\d+)")
ARTICLE_COUNT = wide(r"art(?:icle)?[.\s]*\d+")
APPOINTMENT = r"(rdv|rendez-vous|appointment|date|réserver|book|fixer)"
MODE_TYPES = {"penal": ["articles_cp", "articles_cpp", "gravite", "peine"], "civil": ["articles_coc", "parties", "montants"]}
MODE_WORDS = {
    "penal": ["crime", "délit", "peine", "prison", "pénal", "جنائي", "جزاء"],
    "civil": ["bail", "contrat", "vente", "société", "coc", "civil", "كراء", "عقد"],
}
#: What in a file name speaks for a document type.
NAME_HINTS = {
    "Jugement": ["jugement", "حكم", "jugmt"],
    "Arrêt": ["arret", "arrêt", "قرار", "cassation"],
    "Contrat": ["contrat", "عقد", "convention"],
    "Bail": ["bail", "كراء", "location"],
    "PV": ["pv", "محضر", "proces"],
    "Code_de_loi": ["code", "مجلة", "loi"],
    "Acte_notarié": ["acte", "notaire", "حجة"],
    "Ordonnance": ["ordonnance", "أمر"],
}
PENAL_WORDS = ["جناية", "جنحة", "مخالفة", "crime", "délit", "contravention", "pénal", "pénale", "CPP", "code pénal"]
FOLDERS = (("Civil", ["civil", "مدني"]), ("Pénal", ["penal", "pénal", "جنائي"]), ("Administratif", ["admin", "إداري"]))
CASE_TYPES = (("Accident de circulation", ["حوادث", "accident", "مرور"]), ("Affaire de stupéfiants", ["مخدرات", "stupéfiant", "drogue"]))
PROCEDURAL = ["procédure", "délai", "délais", "compétence", "juridiction", "appel", "cassation", "pourvoi", "recours", "مسطرة", "أجل", "محكمة"]
GREETINGS = ["bonjour", "salut", "hello", "hi", "مرحبا", "أهلا"]
LEGAL = [
    "bail", "contrat", "jugement", "tribunal", "avocat", "droit", "loi", "article", "pénal", "civil", "divorce",
    "succession", "vente", "location", "كراء", "عقد", "محكمة", "حكم", "قانون", "جزاء", "جنائي",
]
#: Document type: (weight, category, French patterns, Arabic patterns), in order of declaration.
TYPES = {
    "Jugement": (1.0, "Général", [
        r"(?:au nom du peuple tunisien|tribunal)", r"(?:condamn[eé]|acquitté|relaxé)", r"(?:PAR CES MOTIFS|par ces motifs)",
        r"(?:jugement|JUGEMENT)\s+n[°o]?\s*\d+", r"(?:attendu que|considérant que)",
    ], [
        r"باسم الشعب التونسي", r"(?:المحكمة الابتدائية|محكمة)", r"(?:حكمت المحكمة|تقضي|قضت|بتحويز|إستعجاليا)",
        r"(?:لهذه الأسباب|لهذه الأسباب|وبناء عليه)", r"حكم\s+عدد\s*\d+", r"قضية\s+رقم\s*\d+",
    ]),
    "Arrêt": (1.0, "Général", [
        r"(?:cour de cassation|محكمة النقض)", r"(?:cour d.appel|محكمة الاستئناف)", r"(?:arrêt|ARRÊT)\s+n[°o]?\s*\d+", r"(?:la cour|statuant sur)",
    ], [r"(?:محكمة التعقيب|هيئة المحكمة)", r"قرار\s+عدد\s*\d+", r"(?:أصدرت محكمة الاستئناف|تقرر)"]),
    "Ordonnance": (0.9, "Général", [
        r"(?:ordonnance|ORDONNANCE)\s+n[°o]?\s*\d+", r"(?:juge d.instruction|référé)", r"(?:nous ordonnons|il est ordonné)",
    ], [r"أمر\s+عدد\s*\d+", r"(?:قاضي التحقيق|قضاء الأمور المستعجلة|قاضي الأسرة)", r"(?:نأمر|يُؤمر|أمر الانتزاع|انتزاع)"]),
    "Contrat": (0.9, "Civil", [
        r"(?:entre les soussignés|entre les parties)", r"(?:contrat|convention|accord)", r"(?:en foi de quoi|en foi de quoi les parties)",
        r"(?:article\s+\d+\s*[-:]\s*)", r"(?:d.une part|d.autre part)",
    ], [r"(?:بين الأطراف|المتعاقدان)", r"عقد\s+(?:بيع|كراء|عمل|شركة)", r"(?:الطرف الأول|الطرف الثاني)", r"(?:اتفق الطرفان|يلتزم)"]),
    "Bail": (0.95, "Civil", [
        r"(?:contrat de bail|bail d.habitation)", r"(?:bailleur|preneur|locataire)", r"(?:loyer mensuel|charges locatives)", r"(?:état des lieux)",
    ], [r"(?:عقد الكراء|عقد الإيجار)", r"(?:المؤجر|المستأجر)", r"(?:الكراء الشهري|قيمة الإيجار)"]),
    "PV": (0.9, "Pénal", [
        r"(?:procès.verbal|P\.V\.)", r"(?:officier de police judiciaire|OPJ)", r"(?:nous avons constaté|il a été constaté)", r"(?:en date du|à \d+ heures)",
    ], [r"(?:محضر|محضر ضبط)", r"(?:ضابط الحرس|ضابط الشرطة)", r"(?:تبين لنا|تحررنا)"]),
    "Code_de_loi": (0.85, "Général", [
        r"(?:code p[eé]nal|code des obligations|code civil)", r"(?:loi n[°o]?\s*\d+[/-]\d+)", r"(?:chapitre\s+\d+|section\s+\d+)", r"(?:article\s+premier|article\s+1er)",
    ], [r"(?:مجلة الجزاء|مجلة الالتزامات|مجلة المرافعات)", r"(?:قانون عدد\s*\d+)", r"(?:الفصل الأول|الباب الأول)"]),
    "Acte_notarié": (0.9, "Civil", [
        r"(?:par-devant nous|notaire|acte notarié)", r"(?:acte authentique|minute)", r"(?:taxe de publicité foncière)",
    ], [r"(?:العدل العام|عدل الإشهاد)", r"(?:حجة شرعية|وثيقة رسمية)", r"(?:التسجيل العقاري)"]),
    "Note_de_service": (0.7, "Administratif", [
        r"(?:note de service|circulaire|instruction)", r"(?:à l.attention de|objet\s*:)", r"(?:veuillez trouver|il vous est demandé)",
    ], [r"(?:مذكرة|منشور)", r"(?:بمناسبة|موضوع\s*:)", r"(?:يُرجى|نُحيطكم علماً)"]),
}


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in keywords])


def _which(text: Column, keywords: list[str]) -> Column:
    """The keywords that occur, in order of the list."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def _by_language(text: Column, lower: Column, lists: dict[str, list[str]]) -> Column:
    return F.when(language(text) == "ar", hits(lower, lists["ar"])).otherwise(hits(lower, lists["fr"]))


def _length_points(n: Column) -> Column:
    return F.when(n > 18, 1.0).when(n > 12, 0.5).otherwise(0.0)


def route(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds route_score, mode, top_k, confidence, use_hypothesis, use_graph and reason."""
    t, q = F.col(text), F.trim(F.lower(F.col(text)))
    articles, codes = F.regexp_count(q, F.lit(ARTICLE_COUNT)), F.regexp_count(q, F.lit("code|loi|décret"))
    points = _length_points(F.size(words(q))) + 1.5 * _by_language(t, q, COMPLEX)
    points = points + F.when((articles >= 2) | (codes >= 2), 1.0).when(articles >= 1, 0.3).otherwise(0.0)
    s, n = F.col("route_score"), F.size(words(q))
    found = F.when(language(t) == "ar", _which(q, COMPLEX["ar"])).otherwise(_which(q, COMPLEX["fr"]))
    reasons = F.concat_ws(
        "; ",
        F.when(n > 18, "long").when(n > 12, "medium"),
        F.when(F.size(found) > 0, F.concat(F.lit("keywords: "), F.array_join(F.slice(found, 1, 2), ", "))),
        F.when((articles >= 2) | (codes >= 2), "several references").when(articles >= 1, "one reference"),
    )
    reason = F.when(q.rlike(FACTUAL), "factual").when(reasons == "", "default").otherwise(reasons)
    return df.withColumn("route_score", F.when(q.rlike(FACTUAL), 0.0).otherwise(F.round(points, 6))).withColumns(
        {
            "mode": F.when(s >= 2, "complex").when(s >= 1, "intermediate").otherwise("simple"),
            "top_k": F.when(s >= 2, 50).when(s >= 1, 40).otherwise(30),
            "confidence": F.round(s / (s + 1), 6),
            "use_hypothesis": s >= 1,
            "use_graph": s >= 2,
            "reason": reason,
        }
    )


def route_stats(routed: DataFrame, order: str, last: int = 100) -> DataFrame:
    """One row over the last routed questions: n, shares of the modes and the mean confidence."""
    some = routed.orderBy(F.desc(order)).limit(last)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    share = [F.round(F.count_if(F.col("mode") == m) / n, 4).alias(m) for m in ("simple", "intermediate", "complex")]
    return some.agg(F.count(F.lit(1)).alias("n"), *share, F.round(F.avg("confidence"), 4).alias("confidence"))


def graph_trigger(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds trigger_score, use_graph, graph_mode and graph_confidence."""
    t, q = F.col(text), F.lower(F.col(text))
    points = 0.15 * _by_language(t, q, RELATIONAL) + _length_points(F.size(words(q)))
    points = points + F.when(q.rlike("article|chapitre"), 0.3).otherwise(0.0) + F.when(q.rlike(" et | ou |comparé| contre "), 0.25).otherwise(0.0)
    points = points + F.when(q.rlike(MULTI_HOP), 0.4).otherwise(0.0) - F.when(q.rlike(FACTUAL), 0.3).otherwise(0.0)
    s = F.col("trigger_score")
    mode = F.when(s > 0.7, "hybrid").when(s > 0.5, "local").when(s >= 0.5, "global").otherwise("disabled")
    return df.withColumn("trigger_score", F.round(points, 6)).withColumns(
        {"use_graph": s >= 0.5, "graph_mode": mode, "graph_confidence": F.round(F.least(s / 1.5, F.lit(1.0)), 6)}
    )


def analyse(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds lang, article_refs, n_words, is_definition, is_procedural, is_precise, strategy, alpha (the weight of BM25) and wants_graph."""
    t, q = F.col(text), F.lower(F.col(text))
    n = F.col("n_words")
    strategy = F.when(F.col("is_precise"), "bm25_heavy").when(F.col("is_definition"), "semantic").otherwise("hybrid")
    heavy, even = F.least(F.lit(0.9), 0.5 + 0.02 * n), F.least(F.lit(0.8), 0.4 + 0.02 * n)
    alpha = F.when(F.col("strategy") == "bm25_heavy", heavy).when(F.col("strategy") == "semantic", 0.4).otherwise(even)
    return (
        df.withColumns(
            {
                "lang": language(t),
                "article_refs": F.regexp_extract_all(t, F.lit("(?iu)" + ARTICLE_REFERENCE), F.lit(1)),
                "n_words": F.size(words(t)),
                "is_definition": q.rlike(DEFINITION),
                "is_procedural": hits(q, PROCEDURAL) > 0,
                "is_precise": t.rlike(wide(r"\d")) & q.rlike("art|المادة"),
            }
        )
        .withColumn("strategy", strategy)
        .withColumn("alpha", F.round(alpha, 6))
        .withColumn("wants_graph", F.col("is_procedural") | F.col("is_definition") | (hits(q, ["différence", "relation"]) > 0))
    )


def intent(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds intent, intent_confidence, is_legal and lang; a greeting counts as French."""
    q = F.lower(F.col(text))
    greets = (hits(q, GREETINGS) > 0) & (F.length(text) < 50)
    legal = ~greets & (hits(q, LEGAL) > 0)
    return df.withColumns(
        {
            "intent": F.when(greets, "greeting").when(legal, "legal_question").otherwise("discussion"),
            "intent_confidence": F.when(greets, 0.8).when(legal, 0.6).otherwise(0.3),
            "is_legal": legal,
            "lang": F.when(greets, "fr").otherwise(language(F.col(text))),
        }
    )


def wants_appointment(c: Column) -> Column:
    return c.rlike("(?iu)" + APPOINTMENT)


def legal_mode(entities: Column) -> Column:
    """penal, civil or general from an array of (type, value): the first entity of a telling type, else keywords of the values."""
    kinds = F.transform(
        entities, lambda e: F.when(e["type"].isin(MODE_TYPES["penal"]), "penal").when(e["type"].isin(MODE_TYPES["civil"]), "civil")
    )
    values = F.lower(F.array_join(F.transform(entities, lambda e: e["value"]), " "))
    by_words = F.when(hits(values, MODE_WORDS["penal"]) > 0, "penal").when(hits(values, MODE_WORDS["civil"]) > 0, "civil").otherwise("general")
    return F.coalesce(F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0)), by_words)


def skip_expansion(c: Column) -> Column:
    """Questions of under six words that ask for a fact, and those under five characters, are not expanded."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_ \t\n\r\f]", ""))
    return ((F.size(words(c)) < 6) & plain.rlike(GATE)) | (F.length(F.trim(c)) < 5)


def hypothesis(question: Column, answer: Column, mode: str = "combined") -> Column:
    """What is searched for with a hypothetical answer: it alone, question and answer, or the question alone."""
    has = F.coalesce(F.trim(answer), F.lit("")) != ""
    if mode == "query_only":
        return question
    joined = answer if mode == "hypo_only" else F.concat(question, F.lit("\n\n"), answer)
    return F.when(has & ~skip_expansion(question), joined).otherwise(question)


def valid_request(message: Column, top_k: Column, mode: Column, session: Column) -> Column:
    """3 to 3000 characters, 1 to 20 results, a known mode, a session name of 100 characters at most."""
    sized = F.length(message).between(3, 3000) & top_k.between(1, 20) & mode.isin("auto", "penal", "civil", "general")
    return F.coalesce(sized & (session.isNull() | (F.length(session) <= 100)), F.lit(False))


def valid_intent(name: Column, lang: Column, confidence: Column) -> Column:
    named = name.isin("legal_question", "greeting", "discussion", "error") & lang.isin("fr", "ar", "en", "mixed")
    return F.coalesce(named & confidence.between(0.0, 1.0), F.lit(False))


def request_language(c: Column) -> Column:
    """ar, en or fr from what a request names."""
    low = F.lower(F.trim(c))
    return F.when(low.startswith("ar") | (low == "عربية"), "ar").when(low.startswith("en"), "en").otherwise("fr")


def _points(kind: str, weight: float, patterns: list[str], met: list[Column], name: Column) -> tuple[Column, Column]:
    """Score and signals of one document type; met: which of its patterns occur."""
    found = [(hit, weight / len(patterns), p[:40]) for hit, p in zip(met, patterns, strict=True)]
    found += [(F.contains(name, F.lit(h)), 0.15, f"filename:{h}") for h in NAME_HINTS.get(kind, [])]
    score = reduce(lambda a, b: a + b, [F.when(hit, F.lit(w)).otherwise(F.lit(0.0)) for hit, w, _ in found])
    return F.least(F.lit(1.0), score), F.array_compact(F.array(*(F.when(hit, F.lit(s)) for hit, _, s in found)))


def needed(pattern: str) -> list[str]:
    """Lower-case pieces of which a text that the pattern matches in any case holds one, by ``folded``; none if that can't be told.

    Of each alternative of the group that the pattern begins with, or else of what stands before any group, the longest run of plain characters.
    """
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return []
    first = re.match(r"\(\?:([^()]*)\)(?![?*{])", pattern)
    parts = first[1].split("|") if first else [pattern.partition("(")[0]]
    plain = [max(re.split(r"(?:\[[^\]]*\]|\\.|\.)[?*+]?|.[?*]|[+^${}]", part), key=len).lower() for part in parts]
    return plain if all(plain) else []


def folded(text: Column) -> Column:
    """Lower case, where letters are the same if patterns of any case take them for the same: three have no such lower case of their own."""
    return F.lower(F.translate(text, "İıſ", "iis"))


def _occurs(head: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern matches in any case: most texts hold none of its pieces and need no search by it."""
    match = head.rlike("(?iu)" + wide(pattern))
    pieces = needed(pattern)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in dict.fromkeys(pieces)]) & match if pieces else match


def detect_type(df: DataFrame, text: str = "text", file_name: str | None = None) -> DataFrame:
    """Adds doc_type, type_confidence, category, doc_lang, signals (five at most) and type_scores.

    Weighted patterns of the first 3000 characters, and hints in the file name, make a type's score. Only the patterns of the
    text's language are tried, each once and only if a text holds a piece that it needs: scores and signals read the array of what occurs. Ties go to the type declared first; scores are rounded at the end only.
    A penal word in the first 2000 characters makes the category Pénal. Null texts count as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    head, lang = F.substring(t, 1, 3000), language(t, 0.3, 0.1)
    name = F.lower(F.coalesce(F.col(file_name), F.lit(""))) if file_name else F.lit("")
    french, arabic = ([p for kind in TYPES.values() for p in kind[k]] for k in (2, 3))
    met = [F.array(*(_occurs(F.col("_head"), F.col("_low"), p) for p in ps)) for ps in (arabic, french)]
    df = df.withColumn("_lang", lang).withColumn("_head", head).withColumn("_low", folded(F.col("_head"))).withColumn("_met", F.when(F.col("_lang") == "ar", met[0]).otherwise(met[1]))
    found, at = [], [0, 0]
    for i, (kind, (weight, category, fr, ar)) in enumerate(TYPES.items()):
        (a_score, a_signals), (f_score, f_signals) = (
            _points(kind, weight, ps, [F.get("_met", F.lit(begin + k)) for k in range(len(ps))], name) for ps, begin in zip((ar, fr), at, strict=True)
        )
        at = [at[0] + len(ar), at[1] + len(fr)]
        is_arabic = F.col("_lang") == "ar"
        score, signals = F.when(is_arabic, a_score).otherwise(f_score), F.when(is_arabic, a_signals).otherwise(f_signals)
        found.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(kind).alias("t"), F.lit(category).alias("c"), signals.alias("w")))
    out = df.withColumn("_all", F.array(*found)).withColumn("_best", F.array_max(F.transform("_all", lambda x: F.struct(x["s"], x["o"], x["t"], x["c"], x["w"]))))
    known = (F.col("_best.s") >= 0.1) & (t != "")
    penal = hits(F.lower(F.substring(t, 1, 2000)), PENAL_WORDS) > 0
    positive = F.transform(F.filter("_all", lambda x: x["s"] > 0), lambda x: F.struct(x["t"], F.round(x["s"], 3)))
    none = F.map_from_entries(F.array().cast("array<struct<t:string,s:double>>"))
    return out.withColumns(
        {
            "doc_type": F.when(known, F.col("_best.t")).otherwise("Inconnu"),
            "type_confidence": F.when(known, F.round("_best.s", 3)).otherwise(0.0),
            "category": F.when(known & penal, "Pénal").when(known, F.col("_best.c")).otherwise("Général"),
            "doc_lang": F.when(t == "", "fr").otherwise(F.col("_lang")),
            "signals": F.when(known, F.slice("_best.w", 1, 5)).when(t == "", F.array(F.lit("Texte vide"))).otherwise(F.array(F.lit("Aucun pattern trouvé"))),
            "type_scores": F.when(known, F.map_from_entries(positive)).otherwise(none),
        }
    ).drop("_all", "_best", "_lang", "_head", "_low", "_met")


def detector_accuracy(cases: DataFrame) -> DataFrame:
    """One row: n, n_right, percent of cases(text, file_name, expected)."""
    ok = F.count_if(F.col("doc_type") == F.col("expected"))
    n = F.count(F.lit(1))
    return detect_type(cases, file_name="file_name").agg(n.alias("n"), ok.alias("n_right"), F.round(100 * F.try_divide(ok, n), 1).alias("percent"))


def topology(df: DataFrame, path: str = "path", corpus: str = "corpus") -> DataFrame:
    """Adds hierarchy, context_path, category and subcategory of a file from the folders below the corpus folder.

    That is the first part of the path whose name contains ``corpus``, in any case, else the fourth part from the end.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    first = F.array_position(F.transform(parts, lambda p: F.contains(F.lower(p), F.lit(corpus.lower()))), True)
    pivot = F.when(first > 0, first).otherwise(F.greatest(F.lit(1), n - 3)).cast("int")
    out = df.withColumn("hierarchy", F.when(pivot < n, F.slice(parts, pivot + 1, F.greatest(n - pivot - 1, F.lit(0)))).otherwise(F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))))
    top = F.lower(F.get("hierarchy", F.lit(0)))
    category = F.lit(None).cast("string")
    for name, keys in reversed(FOLDERS):
        category = F.when(hits(top, keys) > 0, name).otherwise(category)
    return out.withColumns(
        {
            "context_path": F.when(F.size("hierarchy") > 0, F.array_join("hierarchy", " > ")).otherwise("racine"),
            "category": F.coalesce(category, F.lit("Général")),
            "subcategory": F.coalesce(F.get("hierarchy", F.lit(1)), F.get("hierarchy", F.lit(0)), F.lit("général")),
        }
    )


def nature(classified: Column, doc_type: Column, confidence: Column) -> Column:
    """A model's class, or the detected type where that is unknown and the detector is sure enough."""
    known = F.coalesce(classified, F.lit("Inconnu"))
    return F.when((known == "Inconnu") & (confidence >= 0.6), doc_type).otherwise(known)


def extractor_for(category: Column) -> Column:
    """penal, contract or ruling: which extractor reads a document of a category."""
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(c.isin("pénal", "penal", "pénale"), "penal").when(c == "civil", "contract").otherwise("ruling")


def case_type(context_path: Column) -> Column:
    """What a folder says about the case, or null."""
    out = F.lit(None).cast("string")
    for name, keys in reversed(CASE_TYPES):
        out = F.when(hits(context_path, keys) > 0, name).otherwise(out)
    return out


#: Words of up to so many letters are compared by what is left without some of them, longer ones by pieces that stay whole.
SHORT_WORD = 20


def _shortened(word: Column, most: int) -> Column:
    """The word and what is left of it without up to ``most`` of its letters."""
    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))))
        out = F.concat(out, last)
    return F.transform(F.array_distinct(out), lambda w: F.struct(F.lit(0).alias("length"), F.lit(0).alias("piece"), w.alias("part")))


def _pieces(word: Column, most: int, shifted: bool) -> Column:
    """(length, piece, part): a word's ``most`` + 1 pieces; shifted: what may stand in the place of the pieces of words of about this length."""
    n, pieces = F.length(word), most + 1
    lengths = F.sequence(n - most, n + most) if shifted else F.array(n)
    shifts = range(-most, most + 1) if shifted else (0,)

    def cut(m: Column) -> Column:
        found = []
        for i in range(pieces):
            begin, end = F.floor(m * i / pieces).cast("int"), F.floor(m * (i + 1) / pieces).cast("int")
            for shift in shifts:
                at = begin + 1 + shift
                inside = (at >= 1) & (at + end - begin - 1 <= n)
                found.append(F.when(inside, F.struct(m.alias("length"), F.lit(i).alias("piece"), F.substring(word, at, end - begin).alias("part"))))
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(lengths, cut)))


def near_words(asked: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(asked, word, n): pairs of asked(word) and dictionary(word) of at most ``most`` edits, found by equal keys.

    Two such words agree after some ``most`` letters of either are left out; of a longer word one of ``most`` + 1 pieces stays whole and
    moves by ``most`` places at most. Words whose keys agree are compared.
    """
    a, d = F.col("asked"), F.col("word")
    mine = asked.select(F.col("word").alias("asked")).distinct()
    theirs = dictionary.select("word").distinct()
    none = F.array().cast("array<struct<length:int,piece:int,part:string>>")
    keys_a = F.when(F.length(a) <= SHORT_WORD, _shortened(a, most)).otherwise(_pieces(a, most, True))
    keys_d = F.concat(F.when(F.length(d) <= SHORT_WORD + most, _shortened(d, most)).otherwise(none), F.when(F.length(d) > SHORT_WORD - most, _pieces(d, most, False)).otherwise(none))
    met = mine.select("asked", F.explode(keys_a).alias("_key")).join(theirs.select("word", F.explode(keys_d).alias("_key")), "_key").select("asked", "word").distinct()
    return met.withColumn("n", F.levenshtein("asked", "word", most)).where("n >= 0")


def correct_words(df: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "text", most: int = 2) -> DataFrame:
    """(key, text): every word that the dictionary(word) lacks becomes its nearest one of at most ``most`` edits, the first in order
    among equals; words without one stay. Different unknown words are few beside the texts and are looked up once each."""
    each = df.select(key, F.posexplode(words(text)).alias("_pos", "_w"))
    unknown = each.select(F.col("_w").alias("word")).distinct().join(dictionary.select("word"), "word", "left_anti")
    best = near_words(unknown, dictionary, most).groupBy(F.col("asked").alias("_w")).agg(F.min(F.struct("n", "word"))["word"].alias("_best"))
    fixed = each.join(best, "_w", "left").withColumn("_w", F.coalesce("_best", "_w"))
    lists = fixed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_w"))).alias("_ws"))
    out = F.array_join(F.transform("_ws", lambda x: x["_w"]), " ")
    return df.select(key).join(lists, key, "left").select(key, F.coalesce(out, F.lit("")).alias(text))
