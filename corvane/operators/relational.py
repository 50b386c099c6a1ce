"""Users, conversations, messages, appointments and permissions as table transformations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What each role may do.
PERMISSIONS = {
    "client": ["use_chatbot", "request_appointment", "view_own_data"],
    "premium": ["use_chatbot", "request_appointment", "view_own_data", "view_own_history", "priority_support"],
    "lawyer": [
        "use_chatbot", "view_own_data", "view_own_history", "manage_appointments", "view_all_conversations", "manage_calendar", "view_analytics",
    ],
    "admin": [
        "use_chatbot", "request_appointment", "view_own_data", "view_own_history", "manage_appointments", "view_all_conversations",
        "manage_users", "system_admin", "view_analytics",
    ],
}


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role string, permission string")


def allowed(users: DataFrame) -> DataFrame:
    """(key, permission): active users have their role's, pending ones only the two that need no activation.

    With a column is_active, accounts that are switched off have none.
    """
    early = F.col("permission").isin("use_chatbot", "request_appointment") & (F.col("status") == "pending")
    on = users.where("is_active") if "is_active" in users.columns else users
    return on.join(F.broadcast(permissions(users.sparkSession)), "role").where((F.col("status") == "active") | early).select("key", "permission")


def gates(users: DataFrame) -> DataFrame:
    """(key, may_enter, is_admin, is_lawyer, is_premium, is_vip): what the role gates let through, for active and pending accounts."""
    enters = F.col("status").isin("active", "pending")

    def role(*names: str) -> Column:
        return enters & F.col("role").isin(*names)

    vip = F.col("role").isin("admin", "lawyer", "premium")
    return users.select("key", enters.alias("may_enter"), role("admin").alias("is_admin"), role("lawyer", "admin").alias("is_lawyer"), role("premium", "lawyer", "admin").alias("is_premium"), vip.alias("is_vip"))


def people(users: DataFrame) -> DataFrame:
    """(key, full_name, is_premium, can_access_admin): a user's computed properties; a missing name part is left out."""
    name = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return users.select("key", name.alias("full_name"), F.col("role").isin("premium", "lawyer", "admin").alias("is_premium"), (F.col("role") == "admin").alias("can_access_admin"))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n): how many rows each table has."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def conversations(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """(conv_id, user_id, created_at, updated_at, n_messages) of messages(conv_id, created_at) and owners(conv_id, user_id)."""
    last = messages.groupBy("conv_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))
    return owners.join(last, "conv_id", "left").select("conv_id", "user_id", "created_at", "updated_at", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def owned(convs: DataFrame, conv_id, user_id) -> DataFrame:
    """The conversation if it belongs to the user: one row or none."""
    return convs.where((F.col("conv_id") == conv_id) & (F.col("user_id") == user_id))


def get_or_create(convs: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, conv_id, created) of asked(request, conv_id, user_id): one's own conversation, else a new one named by the request."""
    mine = convs.select("conv_id", "user_id", F.lit(True).alias("_own"))
    met = asked.join(mine, ["conv_id", "user_id"], "left")
    new = F.concat(F.lit("new-"), F.col("request").cast("string"))
    return met.select("request", F.when(F.col("_own"), F.col("conv_id").cast("string")).otherwise(new).alias("conv_id"), F.col("_own").isNull().alias("created"))


def by_user(convs: DataFrame) -> DataFrame:
    """convs with rnk: a user's conversations, the one updated last first."""
    return convs.withColumn("rnk", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), "conv_id")))


def in_order(messages: DataFrame, order: str = "created_at") -> DataFrame:
    """messages with rnk: a conversation's messages, the oldest first."""
    return messages.withColumn("rnk", F.row_number().over(Window.partitionBy("conv_id").orderBy(order, "turn")))


def add_messages(messages: DataFrame, new: DataFrame, convs: DataFrame | None = None):
    """messages and new ones; with convs also these, updated_at moved to the last new message."""
    out = messages.unionByName(new)
    if convs is None:
        return out
    last = new.groupBy("conv_id").agg(F.max("created_at").alias("_last"))
    moved = convs.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")
    return out, moved


def delete_conversations(convs: DataFrame, messages: DataFrame, asked: DataFrame):
    """(convs, messages) without those asked(conv_id, user_id, is_admin) for by their owner or by an admin; messages go with them."""
    own = asked.join(convs.select("conv_id", F.col("user_id").alias("_owner")), "conv_id")
    gone = own.where(F.col("is_admin") | (F.col("user_id") == F.col("_owner"))).select("conv_id").distinct()
    return convs.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def loaded(convs: DataFrame, messages: DataFrame) -> DataFrame:
    """convs with messages: each conversation's (turn, role, text) in order; only those of the conversations asked for are read."""
    some = messages.join(convs.select("conv_id"), "conv_id", "left_semi")
    lists = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return convs.join(lists, "conv_id", "left")


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, transcript): lines ``[turn] ROLE: text`` in order, ``(lang|category)`` after the role if there are such columns."""
    tags = [c for c in ("lang", "category") if c in messages.columns]
    tag = F.concat(F.lit(" ("), F.concat_ws("|", *tags), F.lit(")")) if tags else F.lit("")
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.upper("role"), tag, F.lit(": "), "text")
    rows = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("transcript"))


def titles(messages: DataFrame) -> DataFrame:
    """The first non-blank user message, at most 30 characters and dots."""
    t = F.trim("text")
    said = messages.where((F.col("role") == "user") & (t != "")).groupBy("conv_id").agg(F.min_by(t, "turn").alias("t"))
    return said.select("conv_id", F.when(F.length("t") > 30, F.concat(F.substring("t", 1, 30), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def history(convs: DataFrame, most: int = 50) -> DataFrame:
    """The conversations saved last, the newest first."""
    return convs.orderBy(F.desc_nulls_last("updated_at"), "conv_id").limit(most)


def gaps(events: DataFrame, seconds: int) -> DataFrame:
    """Adds limited: less than ``seconds`` after the user's event before."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("limited", F.coalesce(F.col("ts") < last + F.make_dt_interval(secs=F.lit(seconds)), F.lit(False)))


def _accept(seconds: int):
    def run(frames: Iterator[pd.DataFrame]):
        chain, last = None, None
        for f in frames:
            told = []
            for key, ts in zip(zip(f["user_id"], f["_chain"], strict=True), f["_us"], strict=True):
                if key != chain or ts - last >= seconds * 1_000_000:
                    chain, last = key, ts
                    told.append(False)
                else:
                    told.append(True)
            yield pd.DataFrame({"event_id": f["event_id"], "user_id": f["user_id"], "limited": told})

    return run


def rate_limited(events: DataFrame, seconds: int) -> DataFrame:
    """(event_id, user_id, limited): less than ``seconds`` after the user's last event that was let through.

    An event that comes ``seconds`` or more after the one before it is always let through, so a user's events fall into
    chains that are judged on their own, in order; a busy user is many chains.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", "user_id", us.alias("_us"), "ts")
    fresh = F.coalesce(F.col("_us") - F.lag("_us").over(w) >= seconds * 1_000_000, F.lit(True))
    rows = rows.withColumn("_new", fresh.cast("long")).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.drop("_new", "ts").repartition("user_id", "_chain").sortWithinPartitions("user_id", "_chain", "_us", "event_id")
    return dealt.mapInPandas(_accept(seconds), "event_id long, user_id long, limited boolean")


def cancel(status: Column) -> Column:
    """An appointment's status after its owner cancels it: finished ones stay as they are."""
    return F.when(status.isin("completed", "cancelled"), status).otherwise("cancelled")


def cancel_own(appointments: DataFrame, asked: DataFrame) -> DataFrame:
    """appointments with status after requests asked(appointment_id, client_id): only one's own are cancelled."""
    mine = asked.select("appointment_id", "client_id").distinct().withColumn("_own", F.lit(True))
    out = appointments.join(mine, ["appointment_id", "client_id"], "left")
    return out.withColumn("status", F.when(F.col("_own"), cancel(F.col("status"))).otherwise(F.col("status"))).select(*appointments.columns)


def decide(appointments: DataFrame, decisions: DataFrame) -> DataFrame:
    """appointments after decisions(appointment_id, accept, lawyer_id): pending ones become confirmed or cancelled, others stay."""
    out = appointments.join(decisions, "appointment_id", "left")
    open_ = (F.col("status") == "pending") & F.col("accept").isNotNull()
    status = F.when(open_ & F.col("accept"), "confirmed").when(open_, "cancelled").otherwise(F.col("status"))
    return out.withColumns({"approved_by_lawyer": F.when(open_, F.col("accept")), "lawyer_id": F.when(open_ & F.col("accept"), F.col("lawyer_id")), "status": status})


def own_appointments(appointments: DataFrame, newest_first: bool = True) -> DataFrame:
    """appointments with rnk among a client's, by preferred date."""
    day = F.desc("preferred_date") if newest_first else F.asc("preferred_date")
    return appointments.withColumn("rnk", F.row_number().over(Window.partitionBy("client_id").orderBy(day, "appointment_id")))


def all_appointments(appointments: DataFrame, status: str | None = None) -> DataFrame:
    """Appointments, of one status if it is given, sorted by (preferred_date, created_at)."""
    some = appointments if status is None else appointments.where(F.col("status") == status)
    return some.orderBy("preferred_date", "created_at", "appointment_id")


def pending_for(appointments: DataFrame, users: DataFrame, reader) -> DataFrame:
    """Pending appointments by date, for a reader who may manage appointments; nothing for others."""
    may = allowed(users).where((F.col("key") == reader) & (F.col("permission") == "manage_appointments"))
    some = appointments.where("status = 'pending'").withColumn("key", F.lit(reader)).join(may.select("key"), "key", "left_semi")
    return some.drop("key").orderBy("preferred_date", "appointment_id")


def requests(asked: DataFrame, now) -> DataFrame:
    """asked(request, client_id, preferred) with preferred_date (UTC without a zone) and problem (bad_date, past or null).

    A date without a zone is UTC. Requests without a problem can be appended as pending appointments.
    """
    zoned = F.col("preferred").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.contains("preferred", F.lit("T"))
    text = F.when(zoned, F.col("preferred")).otherwise(F.concat("preferred", F.when(F.contains("preferred", F.lit("T")), "Z").otherwise("T00:00:00Z")))
    when = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    out = asked.withColumn("preferred_date", when.cast("timestamp_ntz"))
    problem = F.when(F.col("preferred_date").isNull(), "bad_date").when(F.col("preferred_date") <= F.lit(now).cast("timestamp_ntz"), "past")
    return out.withColumn("problem", problem)


def append_requests(appointments: DataFrame, checked: DataFrame) -> DataFrame:
    """appointments and the requests without a problem, pending."""
    new = checked.where("problem IS NULL").select(
        (-F.col("request")).alias("appointment_id"), "client_id", "preferred_date", F.lit("pending").alias("status"), F.col("preferred_date").alias("created_at")
    )
    return appointments.select(*new.columns).unionByName(new)


def seed(users: DataFrame, admin: DataFrame) -> DataFrame:
    """users with the seeded accounts: one per e-mail, a seed changing role and status of the account that has it."""
    known = users.join(admin.select("email", F.col("role").alias("_r"), F.col("status").alias("_s")), "email", "left")
    kept = known.withColumns({"role": F.coalesce("_r", "role"), "status": F.coalesce("_s", "status")}).select(*users.columns)
    return kept.unionByName(admin.join(users.select("email"), "email", "left_anti").select(*users.columns))


def grouped_counts(rows: DataFrame, by: list[str], how: str = "cube", distinct: str | None = None, mean: str | None = None) -> DataFrame:
    """(by, level, n, (n_distinct), (mean)): counts for the combinations of some columns and for their totals.

    how: cube for every combination of columns, rollup for each column within those before it. level tells which columns a row sums over,
    the last one as bit 1, so that a total is told from a null value. distinct and mean name a column of which different values are counted or the mean is taken.
    """
    grouped = {"cube": rows.cube, "rollup": rows.rollup}[how](*by)
    aggs = [F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n")]
    aggs += [F.countDistinct(distinct).alias("n_distinct")] if distinct else []
    aggs += [F.round(F.avg(mean), 6).alias("mean")] if mean else []
    return grouped.agg(*aggs)
