"""The kept index against the search that reads the texts."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import index, lexical

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select("item_id", "doc_id", "raw", "score", "rnk").collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def asks(spark):
    few = [(1000, "the the of and"), (1001, "nothing_like_this"), (1002, ""), (1003, None), (1004, "the"), (1005, "le la de")]
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet").unionByName(spark.createDataFrame(few, "item_id long, text string")).cache()


@pytest.fixture(scope="module")
def want(docs, asks):
    return rows(lexical.search(docs, asks, 10))


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    made = index.Index(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=8)
    made.append(docs)
    return made


@pytest.mark.parametrize("joined", [False, True])
def test_search_equals_the_search_of_texts(built, asks, want, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(lexical, "MATRIX_BYTES", 0)
    assert rows(built.search(asks, 10)) == want


def test_blocks_are_left_out_but_no_result(built, asks, docs):
    want = rows(lexical.search(docs, asks, 1))
    assert rows(built.search(asks, 1)) == want


def test_only_asked_buckets_are_read(spark, built):
    ask = spark.createDataFrame([(1, "the")], "item_id long, text string")
    plan = built.search(ask, 3)._jdf.queryExecution().toString()
    wanted = ask.select(index.bucket_of(F.lit("the"), 8)).first()[0]
    assert f"bucket#" in plan and f"= {wanted})" in plan.partition("PartitionFilters")[2][:200]


def test_figures(built, docs):
    got = {r["term"]: (r["df"], round(r["idf"], 9)) for r in built.figures().collect()}
    found = lexical.tokenised(docs)
    assert got == {r["term"]: (r["df"], round(r["idf"], 9)) for r in lexical.term_weights(found, found.count()).collect()}


def test_appends_equal_a_rebuild(spark, docs, asks, want, tmp_path, monkeypatch):
    made = index.Index(spark, f"file://{tmp_path}/i", buckets=4)
    third = F.col("doc_id") % 3 == 0
    made.append(docs.where(third).withColumn("text", F.concat(F.lit("older words the the "), F.reverse("text"))))
    made.append(docs.where(~third))
    made.append(docs.where(third))
    assert rows(made.search(asks, 10)) == want
    with monkeypatch.context() as m:
        m.setattr(lexical, "MATRIX_BYTES", 0)
        assert rows(made.search(asks, 10)) == want
    state = made.state()
    assert (state["n"], len(state["segments"])) == (docs.count(), 3)
    made.merge()
    assert len(made.state()["segments"]) == 1 and rows(made.search(asks, 10)) == want
    assert made.documents().count() == docs.count()
    # one that replaces after the merge, and one that is new
    more = spark.createDataFrame([(0, "a new text about the law"), (10**6, "the law of the land"), (10**6, "zebra"), (None, "nobody")], "doc_id long, text string")
    made.append(more)
    now = docs.where("doc_id <> 0").unionByName(more)
    assert rows(made.search(asks, 10)) == rows(lexical.search(now, asks, 10))


def test_what_waits_is_taken_in_before_a_search(spark, docs, asks, want, tmp_path):
    made = index.Index(spark, f"file://{tmp_path}/i", buckets=4)
    assert not made.defer(docs.where("doc_id < 50").withColumn("text", F.lit("older")))
    assert not made.defer(docs.where("doc_id < 90"))
    made.append(docs.where("doc_id >= 90"))
    assert made.state()["waiting"]
    assert rows(made.search(asks, 10)) == want
    assert not made.state()["waiting"]
    assert made.defer(docs, least=100)


def test_keys_of_any_kind_and_empty_indexes(spark, docs, asks, tmp_path):
    made = index.Index(spark, f"file://{tmp_path}/i", buckets=4)
    assert made.search(asks, 10).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk")))
    made.append(named)
    got = sorted(map(tuple, made.search(asks, 5).select("item_id", "doc_id", "score").collect()))
    assert got == sorted(map(tuple, lexical.search(named, asks, 5).select("item_id", "doc_id", "score").collect()))
    with pytest.raises(ValueError):
        made.append(docs)
    # a writer that is late does not overwrite what another wrote
    state = made.state()
    made.append(named.limit(1))
    with pytest.raises(RuntimeError):
        made._commit(state)


def test_postings_are_packed_where_documents_are_numbered(spark, built, docs):
    """Rows of (term, block) alone are shuffled: packing needs neither a row for each word nor a list of terms for each document."""
    import pyarrow as pa

    rows = [(64 * 5 + i, ["a", "b", "a"] if i % 2 else ["b"]) for i in range(3)] + [(64 * 7, []), (64 * 2 + 63, ["a"]), (64 * 3, ["a"])]
    batches = [pa.RecordBatch.from_pydict({"doc": [d for d, _ in part], "tokens": pa.array([t for _, t in part], pa.list_(pa.string()))}) for part in (rows[:2], rows[2:5], rows[5:])]
    got = sorted(tuple(r.values()) for b in index._packed(batches) for r in b.to_pylist())
    assert got == [("a", 2, [63, 1, 1]), ("a", 3, [0, 1, 1]), ("a", 5, [1, 2, 3]), ("b", 5, [0, 1, 2, 1, 1, 1, 1, 3, 1])]
    stored = index._unpacked(spark.createDataFrame(got, index.PACKED).withColumn("bucket", F.lit(0))).drop("bucket").orderBy("term", "block")
    assert [tuple(r) for r in stored.collect()] == [
        ("a", 2, -(2**63), 1, 1, [63], [1], [1]), ("a", 3, 1, 1, 1, [0], [1], [1]), ("a", 5, 2, 2, 3, [1], [2], [3]), ("b", 5, 7, 1, 1, [0, 1, 2], [1, 1, 1], [1, 3, 1]),
    ]
    segment = built.state()["segments"][0]
    assert "terms" not in spark.read.parquet(f"{built.folder}/{segment}/documents").columns
    kept = built._read("postings", [segment])
    assert kept.agg(F.sum(F.size("slots"))).first()[0] == lexical.postings(docs).count()
