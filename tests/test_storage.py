"""Tables that are replaced without ever being half written."""

import pytest
from pyspark.sql import functions as F

from corvane.sources import files
from corvane.sources.storage import StoredTable, write_beside

KV = "k long, ts long, v string"


def failing(df):
    """df, but its last row can't be computed."""
    return df.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, i, f"v{i}") for i in range(1, 5)], KV).repartition(4)


def test_a_failed_write_leaves_the_old_snapshot(spark, rows, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t")
    assert not table.exists()
    table.replace(rows)
    with pytest.raises(Exception, match="broken"):
        table.replace(failing(rows))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    folder = f"file://{tmp_path}/plain"
    files.write_documents(rows.withColumns({"category": F.lit("a"), "subcategory": F.lit("b")}), folder)
    with pytest.raises(Exception, match="broken"):
        files.write_documents(failing(rows).withColumns({"category": F.lit("a"), "subcategory": F.lit("b")}), folder)
    assert spark.read.json(folder).count() == 4


def test_a_table_is_rewritten_from_itself(spark, rows, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t", keep=2)
    for n in range(5):
        table.replace(rows if n == 0 else table.read().withColumn("ts", F.col("ts") + 1))
    assert table.log.version() == 5 and table.read().agg(F.min("ts")).first()[0] == 5
    assert table.read(4).agg(F.min("ts")).first()[0] == 4
    cache = f"file://{tmp_path}/cache"
    files.write_cache(rows.withColumns({"timestamp": F.col("ts") * 10, "ttl": F.lit(5)}), cache)
    files.write_cache(files.read_cache(spark, cache, 16), cache)
    assert files.read_cache(spark, cache, 0).count() == 3
    plain = f"file://{tmp_path}/plain"
    write_beside(rows, plain, lambda df, to: df.write.parquet(to))
    write_beside(spark.read.parquet(plain).where("k > 1"), plain, lambda df, to: df.write.parquet(to))
    assert spark.read.parquet(plain).count() == 3


def test_upserts_touch_only_their_buckets(spark, rows, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t", key="k", buckets=8)
    table.upsert(rows, "ts")
    before = table.log.get()["data"]
    table.upsert(spark.createDataFrame([(2, 9, "new"), (3, 0, "late"), (50, 1, "x"), (None, 1, "y")], KV), "ts")
    got = {r["k"]: (r["ts"], r["v"]) for r in table.read().collect()}
    assert got == {1: (1, "v1"), 2: (9, "new"), 3: (3, "v3"), 4: (4, "v4"), 50: (1, "x")}
    after = table.log.get()
    assert after["rows"] == 5 and any(after["data"].get(b) == p for b, p in before.items())
    with pytest.raises(ValueError):
        table.upsert(rows, "ts", expected=3)
    with pytest.raises(ValueError):
        table.replace(rows, expected=3)
    assert table.log.get() == after
    # ties are broken alike in any order of rows
    same = spark.createDataFrame([(1, 7, "a"), (1, 7, "b")], KV)
    table.upsert(same, "ts")
    one = table.read().where("k = 1").first()["v"]
    table.upsert(same.orderBy(F.desc("v")), "ts")
    assert table.read().where("k = 1").first()["v"] == one


def test_vectors_are_written_for_every_chunk_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    vectors = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1), ("c", [3.0], 1)], "chunk_id string, embedding array<float>, ingested int")
    with pytest.raises(ValueError):
        files.upsert_vectors(chunks, vectors.where("chunk_id <> 'b'"), folder)
    assert not StoredTable(spark, folder, "chunk_id").exists()
    files.upsert_vectors(chunks, vectors, folder)
    files.upsert_vectors(chunks.limit(1), vectors.withColumns({"embedding": F.array(F.lit(9.0).cast("float")), "ingested": F.lit(2)}), folder)
    assert {r["chunk_id"]: list(r["embedding"]) for r in StoredTable(spark, folder, "chunk_id").read().collect()} == {"a": [9.0], "b": [2.0]}


def test_two_writers(spark, rows, tmp_path):
    a = StoredTable(spark, f"file://{tmp_path}/t")
    a.replace(rows)
    with pytest.raises(RuntimeError):
        a.log.add({"data": {}}, 0)
    assert a.read().count() == 4
