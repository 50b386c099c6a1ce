"""Request limits of a stream: many users share a row of state, and every event gets the verdict that it has in a table."""

import datetime as dt

from corvane.operators import relational
from corvane.streaming import events as stream_events


def test_users_share_rows_of_state(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    shape = "event_id long, user_id long, ts timestamp"
    first = [(10 * u + k, u, day + dt.timedelta(minutes=7 * ((u * 5 + k * 11) % 40))) for u in range(60) for k in range(6)]
    first += [(None, 3, day), (9001, None, day), (9002, None, day + dt.timedelta(minutes=5)), (9003, 4, day + dt.timedelta(hours=9))]
    late = [(20_000 + u, u, day + dt.timedelta(minutes=u)) for u in range(60)]
    source = str(tmp_path / "source")
    for part in (first, late, [(-1, -1, dt.datetime(2100, 1, 1))]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
    found = stream_events.rate_limited(stream, 1800, "2 days", groups=4)
    asked = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    asked.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in asked.recentProgress) <= 4
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).where("user_id IS NULL OR user_id >= 0")
    want = relational.rate_limited(spark.createDataFrame(first + late, shape), 1800)

    def told(rows):
        return sorted(map(repr, rows.select("event_id", "user_id", "limited").collect()))

    assert told(got.where("user_id IS NOT NULL")) == told(want.where("user_id IS NOT NULL"))
    # events without user are one user's
    assert told(got.where("user_id IS NULL")) == ["Row(event_id=9001, user_id=None, limited=False)", "Row(event_id=9002, user_id=None, limited=True)"]
