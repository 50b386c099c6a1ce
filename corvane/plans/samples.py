"""Literal tables for operators whose input the driver's tables do not hold: questions, rulings, contracts, graph contexts, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.frames import dealt

QUESTIONS = (
    "Article 15", "c'est quoi un bail", "délai d'appel", "quelle différence entre vente et bail", "كيف", "Article 5", "bonjour",
    "pourquoi comment analyse synthèse article 3 et article 9 du code pénal et de la loi", "divorce et pension", "art. 198 du Code pénal",
    "contrat de bail d'habitation bailleur: Mohamed Ali locataire: Ahmed", "AU NOM DU PEUPLE TUNISIEN Le tribunal de première instance",
    "مجلة الجزاء التونسية الفصل الأول الباب الأول", "باسم الشعب التونسي تقضي المحكمة بإدانة المتهم", "procès-verbal dressé par l'officier de police judiciaire",
    "Arrêt 123/2023 du 5/3/2023 Cour de Cassation", "Article 3 Objet", "الفصل 12 من المجلة", "vol et agression, délit, amende 1 500,00 DT le 12/05/2021", "1 000 DT",
    "art5 de la loi", "art. 5", "art.5 du code", "quelle est l'article 9 ?", "Qu'est-ce que le dol ?", "qu'est ce que le dol", "المادة 5", "citez moi la loi",
    "Article\n5", "Article\u00a05 du code", "والفصل 7 ثم الفصل ٥", "Art. 7\ndu Code\npénal", "Tribunal de Première\nInstance", "payer 1 500\nDT puis 2\u00a0300 DT", "article\t12 et article\u00a013",
    "je voudrais un rdv demain", "112/05/20219 puis 12/05/2021", "dossier 44\\2021 et 45-2022", "pb de delai", "hi",
)

_FACTS = "Faits et procédure : le bailleur a saisi le tribunal le 3/4/2021. Il demande le paiement. Droit : Attendu que le contrat de bail oblige le preneur à payer le loyer convenu. "
RULINGS = (
    ("r1", "/data/corpus/Civil/Baux/bail_01.pdf", "Civil", "Entre : Mohamed Ali, bailleur et la société SOTU;\n\nVendeur : Ahmed Ben Salah, Preneur : Leila Trabelsi\n\nLe preneur doit payer 1 500,00 DT par mois à Sfax. Il s'engage à rendre les lieux. Fait le 12/05/2021 pour 3 ans.\n\nArt. 8 du Code des obligations. Appartement de 80 m. Caution de 3 000 dinars versée le 2 mars 2021.\n\nPage 1 contrat de location bail"),
    ("r2", "/data/Corpus_Tn/Pénal/jugement_77.pdf", "Pénal", "AU NOM DU PEUPLE TUNISIEN\n\nTribunal de Première Instance de Tunis. Jugement n° 77. Affaire 123/2023 du 5/3/2023.\n\nLe prévenu est poursuivi pour vol, délit puni par Art. 264 du Code pénal et Art. 265 du Code pénal et Art. 13 du Code de procédure pénale. amende de 500 DT"),
    ("r3", "/x/y/z/arret_9.pdf", "", _FACTS + "Moyens : le preneur soutient que le bail est nul. Réponse : Considérant que la nullité n'est pas démontrée par les pièces. Par ces motifs la cour rejette. appelant : Leila Trabelsi, intimé : Mohamed Ali\nArticle 12 du Code civil et Articles 14 loi bancaire. Cour d'Appel de Sousse. alors que le délai de recours était expiré depuis longtemps"),
    ("r4", "/a/b/corpus/admin/notes/2020/note.pdf", "Administratif", "Note de service\n\nObjet : congés. Veuillez trouver le calendrier. Page 1\n\nPage 2 suite\n\nPage 3 fin"),
    ("r5", "/corpus/مدني/عقد.pdf", "civil", "عقد كراء بين الطرف الأول: محمد علي\nالطرف الثاني: أحمد\n\nيلتزم المستأجر بدفع الكراء 500 دينار. تونس"),
    ("r6", "note.pdf", None, "CHAPITRE Premier\n\nArticle 1 Objet\n\nLa présente loi fixe le droit. " + "Le texte vise chaque contrat. " * 9 + "\n\nArticle 2 Champ\n\n" + "La règle vaut pour tous les baux. " * 12 + "\n\n" + "Phrase longue sans fin qui continue " * 40 + "."),
    ("r7", "/c/corpus/x.pdf", "pénale", ""),
)

#: Chunks of a small body of law: (chunk_id, article_id, doc_uid, section, dated, text).
LAW = (
    (1, "coc_8", "coc", "Bail", False, "Article 8. Le contrat de bail oblige le bailleur. Le bail est un contrat. La durée est libre."),
    (2, "coc_8", "coc", None, False, "Le contrat de bail oblige le bailleur. Le preneur paie le loyer chaque mois de l'année 2024."),
    (3, "coc_56", "coc", "Vente", True, "La vente d'un immeuble exige un acte authentique enregistré. Article 56 du code."),
    (4, "cp_198", "cp", None, False, "Art. 198 du Code pénal: le vol est puni de prison. Le délit de vol se prescrit par cinq ans."),
    (5, "cp_198", "cp", None, False, "Le code pénal punit le vol et la tentative. Court."),
    (6, "cp_10", "cp", "Prescription", False, "Le délai de prescription des crimes est de dix années révolues, celui des délits de cinq années."),
    (7, "csp_31", "csp", None, False, "Le divorce est prononcé par le juge. La pension alimentaire suit le divorce. Le juge fixe la pension en 2023."),
    (8, "cpc_4", "cpc", None, False, "L'appel est porté devant la cour. Le délai d'appel est de vingt jours. La cour statue."),
    (9, "cpc_4", "cpc", None, False, "L'appel est porté devant la cour. Le délai d'appel est de vingt jours. La cour statue."),
    (10, "cpc_5", "cpc", None, False, "Le pourvoi en cassation se forme dans les soixante jours."),
    (11, "coc_9", "coc", None, False, "bail"),
    (12, "misc", "x", None, False, "Le tribunal administratif siège à Tunis. Sa compétence est fixée par la loi de 1972."),
)

GRAPH_CONTEXTS = (
    (1, "FAITS:\n- Le bail lie le bailleur et le preneur\n- le bail lie le bailleur et le preneur!\nENTITÉS:\nBailleur\nPreneur\n- Locataire\nRELATIONS:\nbail -> loyer\nbail -> loyer\nrien ici du tout, une phrase assez longue\nEXTRAITS:\nArticle 8 du code"),
    (2, '{"facts": ["a", "b"], "entities": ["x"], "context": ["c1"]}'),
    (3, "Une phrase suffisamment longue pour compter. Courte. Une autre phrase bien assez longue ici."),
    (4, ""),
    (5, "- court\n* un fait sans titre mais long\n→ encore un autre élément"),
)

#: Accounts: (key, email, first_name, last_name, role, status, is_active).
ACCOUNTS = (
    (1, "a@x.tn", "Ali", "Ben", "client", "active", True), (2, "b@x.tn", "Mona", None, "premium", "pending", True), (3, "c@x.tn", "Sami", "Karoui", "lawyer", "active", True),
    (4, "d@x.tn", "Rym", "Zid", "admin", "active", True), (5, "e@x.tn", "Nour", "Sd", "lawyer", "suspended", True), (6, "f@x.tn", "Off", "Line", "admin", "active", False),
)

REQUESTS = (
    (1, 1, "2030-01-05T10:00:00+01:00"), (2, 1, "2030-01-05"), (3, 2, "2001-01-01T00:00:00"), (4, 2, "demain"), (5, 3, "2030-06-01T08:30:00Z"), (6, 3, None),
)

JSON_ANSWERS = ('{"a": 1}', 'Voici ```json\n{"b":\n  [1, 2]}\n``` fin', "rien", "x { y", "")
MARKDOWN = ("**gras** et *penché*", "a < b & c\nhttps://x.tn/p?q=1 fin", "__u__ _v_ 'q'", "plain")
TESTS = (("bm25", "range", 1.0, True, None), ("detector", "golden", 0.75, True, None), ("cache", "hit", 0.0, False, "timeout"))
MODES = ((1, "articles_cp", "198"), (2, "parties", "Ali"), (3, "autre", "contrat de bail"), (4, "autre", "rien"), (5, "autre", "délit"))


def _value(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, bool | int | float) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A common table expression with the rows; columns as Spark writes them (``a int, b string``)."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    fields = [c.split() for c in columns.split(", ")]
    typed = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
    body = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {typed} FROM (VALUES {body}) AS v({', '.join(n for n, _ in fields)}))"


SCHEMAS = {
    "rulings": ("id string, path string, category string, text string", RULINGS),
    "law": ("chunk_id long, article_id string, doc_uid string, section string, dated boolean, text string", LAW),
    "contexts": ("query_id long, raw string", GRAPH_CONTEXTS),
    "accounts": ("key long, email string, first_name string, last_name string, role string, status string, is_active boolean", ACCOUNTS),
    "requests": ("request long, client_id long, preferred string", REQUESTS),
    "answers": ("id long, text string", tuple(enumerate(JSON_ANSWERS))),
    "marked": ("id long, text string", tuple(enumerate(MARKDOWN))),
    "tests": ("component string, test_name string, score double, passed boolean, error string", TESTS),
    "modes": ("id long, type string, value string", MODES),
    "asks": ("query_id long, text string", tuple(enumerate(QUESTIONS))),
}


#: What the driver's tables give for these tables, beside the literals that meet every branch: (table, its rows in SQL that both engines read).
GIVEN = {
    "asks": ("conversations", "100000 + conv_id * 1000 + turn AS query_id, text"),
    "rulings": (
        "documents",
        "concat('d', CAST(doc_id AS STRING)) AS id, concat('/data/corpus/', coalesce(source, 'x'), '/', coalesce(lang, 'x'), '/doc_', CAST(doc_id AS STRING), '.pdf') AS path,"
        " CASE doc_id % 3 WHEN 0 THEN 'Civil' WHEN 1 THEN 'Pénal' END AS category, text",
    ),
    "contexts": ("conversations", "1000 + conv_id * 1000 + turn AS query_id, CASE turn % 3 WHEN 0 THEN concat('FAITS:\n- ', text, '\nENTITÉS:\n', role, '\nRELATIONS:\n', role, ' -> ', role) ELSE text END AS raw"),
    "accounts": (
        "customer",
        "1000 + c_custkey AS key, concat(lower(c_name), '@x.tn') AS email, c_name AS first_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS last_name,"
        " CASE c_custkey % 4 WHEN 0 THEN 'client' WHEN 1 THEN 'premium' WHEN 2 THEN 'lawyer' ELSE 'admin' END AS role, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'pending' ELSE 'suspended' END AS status, c_custkey % 7 <> 0 AS is_active",
    ),
    "requests": ("orders", "1000 + o_orderkey AS request, 1000 + o_custkey AS client_id, concat(CAST(CAST(CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 35 YEAR ELSE o_orderdate END AS DATE) AS STRING), CASE o_orderkey % 3 WHEN 0 THEN 'T10:00:00Z' WHEN 1 THEN '' ELSE 'T23:30:00+01:00' END) AS preferred"),
    "answers": ("conversations", "1000 + conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN concat('```json\n{\"turn\":\n  ', CAST(turn AS STRING), '}\n```') WHEN 1 THEN text ELSE concat(role, ' {\"a\": [', CAST(turn AS STRING), ']} ', role) END AS text"),
    "marked": ("conversations", "1000 + conv_id * 1000 + turn AS id, CASE turn % 2 WHEN 0 THEN concat('**', text, '** & _', role, '_') ELSE text END AS text"),
    "tests": ("events", "event_type AS component, concat('t', CAST(event_id AS STRING)) AS test_name, floor(least(value, 100)) / 100 AS score, value > 20 AS passed, CASE WHEN value > 90 THEN 'slow' END AS error"),
    "modes": ("conversations", "1000 + conv_id * 1000 + turn AS id, CASE turn % 4 WHEN 3 THEN 'parties' ELSE 'autre' END AS type, text AS value"),
}


def cte(name: str, given: bool = False) -> str:
    """The literals; given: and what the driver's tables give."""
    if not given:
        return values(name, *SCHEMAS[name])
    source, columns = GIVEN[name]
    told = columns.replace("AS STRING", "AS VARCHAR").replace("\\n", "' || chr(10) || '")
    return f"{values('l_' + name, *SCHEMAS[name])}, {name} AS (SELECT * FROM l_{name} UNION ALL SELECT {told} FROM {source})"


def table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """The literals; with a folder, and what the tables there give."""
    columns, rows = SCHEMAS[name]
    own = spark.createDataFrame(list(rows), columns)
    if folder is None:
        return own
    source, found = GIVEN[name]
    more = spark.sql(f"SELECT {found} FROM parquet.`{folder}/{source}.parquet`")
    if source == "documents":  # a file of few row groups would be few tasks, and what is asked of these texts costs much more than dealing them out
        more = dealt(more, "id")
    return own.unionByName(more.select(*(more[f.name].cast(f.dataType) for f in own.schema.fields)))
