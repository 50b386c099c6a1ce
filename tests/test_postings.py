"""Postings are counted in a document's own row."""

from collections import Counter

from corvane.operators import lexical


def test_postings_without_shuffle(spark):
    texts = {1: "bb aa bb cc bb", 2: "", 3: None, 4: "xx", 5: "aa " * 3000 + "Zz aa zz", 6: "..."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = lexical.postings(docs)
    assert [n for n, _ in found.dtypes] == ["doc_id", "dl", "term", "tf"]
    tokens = {r["doc_id"]: r["tokens"] for r in lexical.tokenised(docs).collect()}
    want = sorted((d, len(t), w, n) for d, t in tokens.items() for w, n in Counter(t).items())
    assert sorted(map(tuple, found.collect())) == want and len(want) > 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
