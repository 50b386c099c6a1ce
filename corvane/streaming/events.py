"""Event streams: windowed counts with late data, sessions, and request limits in order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import relational


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    agg = rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    agg = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), "n")


#: Users are dealt to so many groups of the stream, as each group costs a call and a row of state however few events it has.
USER_GROUPS = 1024
#: What stands for a null event_id, which comes first among events of one time.
_NO_ID = -(1 << 63)


def _limit(seconds: int):
    """The events of a group of users: they wait until the watermark has passed them, so that late ones are judged in their place, and leave in a user's order of time.

    The state is the last event of each user that was let through, as rows (no_user, user_id, us), and the events that wait, as rows
    (no_user, user_id, us, event_id); a user goes when nothing of theirs waits and the last one limits nobody any more.
    """
    gap = seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, held = state.get if state.exists else (b"", b"")
        last = {(no, user): at for no, user, at in np.frombuffer(kept, dtype=np.int64).reshape(-1, 3).tolist()}
        parts = [np.frombuffer(held, dtype=np.int64).reshape(-1, 4)]
        if not state.hasTimedOut:
            parts += [f[["no_user", "user", "us", "id"]].to_numpy(dtype=np.int64) for f in frames]
        now = state.getCurrentWatermarkMs()
        rows = np.concatenate(parts)
        passed = rows[:, 2] < now * 1000
        waiting, rows = rows[~passed], rows[passed]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        limited = np.zeros(len(rows), dtype=bool)
        whose, before = None, None
        for i, (no, user, at, _) in enumerate(rows.tolist()):
            if (no, user) != whose:
                whose = no, user
                before = last.get(whose)
            if before is not None and at < before + gap:
                limited[i] = True
            else:
                last[whose] = before = at
        owed = set(map(tuple, np.unique(waiting[:, :2], axis=0).tolist()))
        last = {u: at for u, at in last.items() if u in owed or at + gap >= now * 1000}
        if len(waiting) or last:
            state.update((np.array([(*u, at) for u, at in last.items()], dtype=np.int64).tobytes(), np.ascontiguousarray(waiting).tobytes()))
            due = int(waiting[:, 2].min()) if len(waiting) else max(last.values()) + gap
            state.setTimeoutTimestamp(max(now, due // 1000) + 1)
        elif state.exists:
            state.remove()
        if len(rows):
            ids, users = (pd.Series(pd.arrays.IntegerArray(rows[:, c].copy(), gone)) for c, gone in ((3, rows[:, 3] == _NO_ID), (1, rows[:, 0] == 1)))
            yield pd.DataFrame({"event_id": ids, "user_id": users, "limited": limited})

    return run


def rate_limited(events: DataFrame, seconds: int, late: str = "1 hour", groups: int = USER_GROUPS) -> DataFrame:
    """(event_id, user_id, limited) as ``relational.rate_limited`` gives them for a table, of a stream too.

    An event of a stream is judged once the watermark, ``late`` behind the newest event, has passed it; what comes later than that is left
    out, and so is an event without time. groups: how many groups users are dealt to, which must not change while a stream's checkpoint is kept.
    """
    if not events.isStreaming:
        return relational.rate_limited(events, seconds)
    user = F.coalesce("user_id", F.lit(0)).cast("long")
    rows = events.withWatermark("ts", late).where("ts IS NOT NULL").select(
        F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("_group"),
        F.col("user_id").isNull().cast("long").alias("no_user"),
        user.alias("user"),
        "ts",
        F.unix_micros("ts").alias("us"),
        F.coalesce("event_id", F.lit(_NO_ID)).cast("long").alias("id"),
    )
    return rows.groupBy("_group").applyInPandasWithState(
        _limit(seconds), "event_id long, user_id long, limited boolean", "last binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is and reads what it wrote."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
