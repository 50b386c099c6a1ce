"""What a retrieval over the library's own chunks reads and shuffles."""

from corvane.operators import retrieval
from corvane.plans import search


def test_documents_are_cut_once(spark):
    """Chunks and their vectors come from one stored table, not from the documents again."""
    _, chunks, vectors, _ = search.windows_of_documents(spark, "/root/testdata/sf0.001")
    for table in (chunks, vectors):
        assert not [f for f in table.inputFiles() if "documents" in f]


def test_named_chunks(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), (None, "n")], "chunk_id string, text string")
    wanted = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "chunk_id string")
    kept = retrieval.named(rows, wanted)
    assert sorted(r["text"] for r in kept.collect()) == ["y", "z"]
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().simpleString()
    assert retrieval.named(rows, wanted.limit(0)).isEmpty()
