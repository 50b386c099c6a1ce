"""Accounts, conversations and appointments: literal accounts and, for volume, the driver's tables in their place.

orders stand for appointments (client o_custkey % 500), conversations for messages, with one hour between turns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import relational
from corvane.plans import samples
from corvane.plans.base import query
from corvane.plans.base import table as _t
from corvane.sources.storage import fresh_path
from corvane.streaming import events as stream_events

_ACC = f"WITH {samples.cte('accounts', True)}"
_PERMS = ", ".join(f"('{r}', '{p}')" for r, ps in relational.PERMISSIONS.items() for p in ps)


@query(f"{_ACC}, p(role, permission) AS (VALUES {_PERMS}) SELECT key, permission FROM accounts JOIN p USING (role) WHERE is_active AND (status = 'active' OR (status = 'pending' AND permission IN ('use_chatbot', 'request_appointment')))")
def account_permissions(spark, d):
    return relational.allowed(samples.table(spark, "accounts", d))


@query(
    f"""{_ACC}, e AS (SELECT *, status IN ('active', 'pending') AS may_enter FROM accounts)
    SELECT key, may_enter, may_enter AND role = 'admin' AS is_admin, may_enter AND role IN ('lawyer', 'admin') AS is_lawyer, may_enter AND role IN ('premium', 'lawyer', 'admin') AS is_premium, role IN ('admin', 'lawyer', 'premium') AS is_vip FROM e"""
)
def role_gates(spark, d):
    return relational.gates(samples.table(spark, "accounts", d))


@query(f"{_ACC} SELECT key, trim(concat_ws(' ', first_name, last_name)) AS full_name, role IN ('premium', 'lawyer', 'admin') AS is_premium, role = 'admin' AS can_access_admin FROM accounts")
def account_names(spark, d):
    return relational.people(samples.table(spark, "accounts", d))


@query(f"{_ACC}, s AS (SELECT * FROM (VALUES (9, 'd@x.tn', 'client', 'banned'), (10, 'z@x.tn', 'admin', 'active')) AS v(key, email, role, status)) SELECT a.key, a.email, coalesce(s.role, a.role) AS role, coalesce(s.status, a.status) AS status FROM accounts a LEFT JOIN s USING (email) UNION ALL SELECT key, email, role, status FROM s WHERE email NOT IN (SELECT email FROM accounts)")
def seeded_accounts(spark, d):
    admin = spark.createDataFrame([(9, "d@x.tn", "client", "banned"), (10, "z@x.tn", "admin", "active")], "key long, email string, role string, status string")
    return relational.seed(samples.table(spark, "accounts", d).select("key", "email", "role", "status"), admin)


_MSG = "m AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 50 + turn AS INT)) AS created_at FROM conversations), o AS (SELECT DISTINCT conv_id, conv_id % 7 AS user_id FROM conversations)"
_CONV = f"{_MSG}, c AS (SELECT o.conv_id, user_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(created_at) AS n_messages FROM o LEFT JOIN m ON m.conv_id = o.conv_id GROUP BY 1, 2)"


def _messages(spark, d):
    hours = F.make_dt_interval(hours=(F.col("conv_id") % 50 + F.col("turn")).cast("int"))
    return _t(spark, d, "conversations").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours)


def _conversations(spark, d):
    owners = _t(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 7).alias("user_id")).distinct()
    return relational.conversations(_messages(spark, d), owners)


@query(f"WITH {_CONV} SELECT conv_id, user_id, updated_at, n_messages, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id) AS INT) AS rnk FROM c")
def user_conversations(spark, d):
    return relational.by_user(_conversations(spark, d)).drop("created_at")


@query(f"WITH {_CONV} SELECT conv_id, user_id, n_messages FROM c WHERE conv_id = 3 AND user_id = 3")
def owned_conversation(spark, d):
    return relational.owned(_conversations(spark, d), 3, 3).select("conv_id", "user_id", "n_messages")


@query(f"WITH {_CONV}, q AS (SELECT * FROM (VALUES (1, 3, 3), (2, 3, 4), (3, 999999, 1)) AS v(request, conv_id, user_id)) SELECT CAST(request AS BIGINT) AS request, CASE WHEN c.conv_id IS NOT NULL THEN CAST(q.conv_id AS VARCHAR) ELSE 'new-' || request END AS conv_id, c.conv_id IS NULL AS created FROM q LEFT JOIN c USING (conv_id, user_id)")
def conversation_for_request(spark, d):
    asked = spark.createDataFrame([(1, 3, 3), (2, 3, 4), (3, 999999, 1)], "request long, conv_id long, user_id long")
    return relational.get_or_create(_conversations(spark, d), asked)


@query(f"WITH {_MSG} SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY created_at, turn) AS INT) AS rnk FROM m")
def ordered_messages(spark, d):
    return relational.in_order(_messages(spark, d)).select("conv_id", "turn", "role", "rnk")


@query(f"WITH {_CONV}, n AS (SELECT conv_id, max(created_at) + INTERVAL 2 HOUR AS last FROM m WHERE turn = 0 GROUP BY 1) SELECT c.conv_id, greatest(updated_at, coalesce(last, updated_at)) AS updated_at FROM c LEFT JOIN n USING (conv_id)")
def appended_messages(spark, d):
    rows = _messages(spark, d)
    new = rows.where("turn = 0").withColumn("created_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(2)))
    return relational.add_messages(rows, new, _conversations(spark, d))[1].select("conv_id", "updated_at")


@query(f"WITH {_CONV}, q AS (SELECT conv_id, user_id AS owner FROM o), g AS (SELECT conv_id FROM q WHERE conv_id % 3 = 0 AND (conv_id % 2 = 0 OR owner = 1)) SELECT count(*) AS left_conversations, (SELECT count(*) FROM m WHERE conv_id NOT IN (SELECT conv_id FROM g)) AS left_messages FROM c WHERE conv_id NOT IN (SELECT conv_id FROM g)")
def deleted_conversations(spark, d):
    convs = _conversations(spark, d)
    asked = convs.where("conv_id % 3 = 0").select("conv_id", F.lit(1).cast("long").alias("user_id"), (F.col("conv_id") % 2 == 0).alias("is_admin"))
    left, messages = relational.delete_conversations(convs, _messages(spark, d), asked)
    return left.agg(F.count(F.lit(1)).alias("left_conversations")).crossJoin(messages.agg(F.count(F.lit(1)).alias("left_messages")))


@query(f"WITH {_CONV} SELECT c.conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS messages FROM c JOIN m USING (conv_id) WHERE c.user_id = 2 GROUP BY 1")
def loaded_conversations(spark, d):
    found = relational.loaded(_conversations(spark, d).where("user_id = 2"), _messages(spark, d))
    return found.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"]).cast("string"))), "|").alias("messages"))


@query(f"WITH {_CONV} SELECT conv_id, updated_at FROM c ORDER BY updated_at DESC, conv_id LIMIT 50")
def saved_history(spark, d):
    return relational.history(_conversations(spark, d)).select("conv_id", "updated_at")


@query("WITH l AS (SELECT conv_id, turn, '[' || turn || '] ' || upper(role) || ' (fr|' || role || '): ' || text AS l FROM conversations) SELECT conv_id, md5(string_agg(l, chr(10) ORDER BY turn, l)) AS digest FROM l GROUP BY 1")
def tagged_transcript(spark, d):
    rows = _t(spark, d, "conversations").withColumns({"lang": F.lit("fr"), "category": F.col("role")})
    return relational.transcript(rows).select("conv_id", F.md5(F.col("transcript").cast("binary")).alias("digest"))


@query("SELECT 'conversations' AS name, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'appointments', count(*) FROM orders")
def total_counts(spark, d):
    return relational.totals(conversations=_t(spark, d, "conversations").select("conv_id").distinct(), appointments=_t(spark, d, "orders").select("o_orderkey"))


_APP = "a AS (SELECT o_orderkey AS appointment_id, o_custkey % 500 AS client_id, o_orderdate AS preferred_date, o_orderdate - INTERVAL 3 DAY AS created_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'confirmed' END AS status FROM orders)"


def _appointments(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("confirmed")
    day = F.col("o_orderdate")
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("appointment_id"), (F.col("o_custkey") % 500).alias("client_id"), day.alias("preferred_date"), (day - F.make_dt_interval(days=F.lit(3))).alias("created_at"), status.alias("status")
    )


@query(f"WITH {_APP} SELECT appointment_id, client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY preferred_date DESC, appointment_id) AS INT) AS newest, CAST(row_number() OVER (PARTITION BY client_id ORDER BY preferred_date, appointment_id) AS INT) AS oldest FROM a")
def own_appointments(spark, d):
    rows = _appointments(spark, d)
    newest = relational.own_appointments(rows).select("appointment_id", "client_id", F.col("rnk").alias("newest"))
    return newest.join(relational.own_appointments(rows, False).select("appointment_id", F.col("rnk").alias("oldest")), "appointment_id")


@query(f"WITH {_APP} SELECT appointment_id, preferred_date FROM a WHERE status = 'confirmed' ORDER BY preferred_date, created_at, appointment_id")
def appointments_by_status(spark, d):
    return relational.all_appointments(_appointments(spark, d), "confirmed").select("appointment_id", "preferred_date")


@query(f"{_ACC}, {_APP} SELECT appointment_id, client_id FROM a WHERE status = 'pending' ORDER BY preferred_date, appointment_id")
def pending_appointments(spark, d):
    return relational.pending_for(_appointments(spark, d), samples.table(spark, "accounts", d), 3).select("appointment_id", "client_id")


@query(f"{_ACC}, {_APP} SELECT appointment_id, client_id FROM a WHERE false")
def pending_without_permission(spark, d):
    return relational.pending_for(_appointments(spark, d), samples.table(spark, "accounts", d), 1).select("appointment_id", "client_id")


@query(f"WITH {_APP} SELECT status, count(*) AS n FROM (SELECT CASE WHEN appointment_id % 10 = 0 AND client_id % 2 = 0 AND status <> 'completed' THEN 'cancelled' ELSE status END AS status FROM a) GROUP BY 1")
def cancelled_by_owner(spark, d):
    rows = _appointments(spark, d)
    asked = rows.where("appointment_id % 10 = 0").select("appointment_id", F.when(F.col("client_id") % 2 == 0, F.col("client_id")).otherwise(F.col("client_id") + 1).alias("client_id"))
    return relational.counts(relational.cancel_own(rows, asked), "status")


@query(f"WITH {_APP}, u AS (SELECT *, appointment_id % 4 < 2 AS asked, appointment_id % 4 = 0 AS accept FROM a), x AS (SELECT CASE WHEN status = 'pending' AND asked AND accept THEN 'confirmed' WHEN status = 'pending' AND asked THEN 'cancelled' ELSE status END AS status, CASE WHEN status = 'pending' AND asked THEN accept END AS approved_by_lawyer FROM u) SELECT status, approved_by_lawyer, count(*) AS n FROM x GROUP BY 1, 2")
def decided_appointments(spark, d):
    rows = _appointments(spark, d)
    decisions = rows.where("appointment_id % 4 < 2").select("appointment_id", (F.col("appointment_id") % 4 == 0).alias("accept"), F.lit(3).cast("long").alias("lawyer_id"))
    found = relational.decide(rows, decisions)
    return found.groupBy("status", "approved_by_lawyer").agg(F.count(F.lit(1)).alias("n"))


_CHECKED = """SELECT * FROM (VALUES (1::BIGINT, '2030-01-05 09:00:00', NULL), (2, '2030-01-05 00:00:00', NULL), (3, '2001-01-01 00:00:00', 'past'), (4, NULL, 'bad_date'), (5, '2030-06-01 08:30:00', NULL), (6, NULL, 'bad_date')) AS v(request, preferred_date, problem)
    UNION ALL SELECT request, day || hour, CASE WHEN day || hour < '2025-01-01' THEN 'past' END FROM (SELECT 1000 + o_orderkey AS request, strftime(CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 35 YEAR ELSE o_orderdate END, '%Y-%m-%d') AS day, CASE o_orderkey % 3 WHEN 0 THEN ' 10:00:00' WHEN 1 THEN ' 00:00:00' ELSE ' 22:30:00' END AS hour FROM orders)"""


@query(_CHECKED)
def checked_requests(spark, d):
    found = relational.requests(samples.table(spark, "requests", d), "2025-01-01 00:00:00")
    return found.select("request", F.date_format("preferred_date", "yyyy-MM-dd HH:mm:ss").alias("preferred_date"), "problem")


@query(f"WITH {_APP}, x AS (SELECT count(*) AS more FROM ({_CHECKED}) WHERE problem IS NULL) SELECT count(*) + any_value(more) AS n, count(*) FILTER (status = 'pending') + any_value(more) AS pending FROM a, x")
def appended_requests(spark, d):
    checked = relational.requests(samples.table(spark, "requests", d), "2025-01-01 00:00:00")
    found = relational.append_requests(_appointments(spark, d), checked)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))


_ACCEPTED = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), a AS (SELECT user_id, k, ts FROM e WHERE k = 1 UNION ALL
    SELECT e.user_id, e.k, e.ts FROM a JOIN e ON e.user_id = a.user_id AND e.k = (SELECT min(f.k) FROM e f WHERE f.user_id = a.user_id AND f.k > a.k AND f.ts >= a.ts + INTERVAL 6 HOUR))
    SELECT e.user_id, count(*) AS n, count(*) - count(a.k) AS n_limited FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.k = e.k GROUP BY 1"""


@query(_ACCEPTED)
def rate_limit_accepted(spark, d):
    found = relational.rate_limited(_t(spark, d, "events"), 6 * 3600)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("limited").alias("n_limited"))


@query(f"{_ACC}, p(role, permission) AS (VALUES {_PERMS}), g AS (SELECT key, role, permission, status FROM accounts JOIN p USING (role) WHERE is_active AND (status = 'active' OR (status = 'pending' AND permission IN ('use_chatbot', 'request_appointment')))) SELECT permission, role, CAST(GROUPING_ID(permission, role) AS INT) AS level, count(*) AS n, count(DISTINCT key) AS n_distinct FROM g GROUP BY CUBE (permission, role)")
def permission_cube(spark, d):
    """How many accounts may do what, by permission, by role, by both and in all."""
    accounts = samples.table(spark, "accounts", d)
    rows = relational.allowed(accounts).join(accounts.select("key", "role"), "key")
    return relational.grouped_counts(rows, ["permission", "role"], distinct="key")


@query("SELECT suite, role, CAST(GROUPING_ID(suite, role) AS INT) AS level, count(*) AS n, count(DISTINCT conv_id) AS n_distinct, round(avg(length(text)), 6) AS mean FROM (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'adversarial' WHEN conv_id % 5 < 4 THEN 'standard' END AS suite FROM conversations) GROUP BY ROLLUP (suite, role)")
def evaluation_rollup(spark, d):
    """Turns, conversations and mean length by suite and role; a suite may be null."""
    suite = F.when(F.col("conv_id") % 5 == 0, "adversarial").when(F.col("conv_id") % 5 < 4, "standard")
    rows = _t(spark, d, "conversations").select("conv_id", "role", suite.alias("suite"), F.length("text").alias("chars"))
    return relational.grouped_counts(rows, ["suite", "role"], "rollup", "conv_id", "chars")


@query(_ACCEPTED)
def streamed_rate_limit(spark, d):
    """The same limits of a stream of files, a third of the month at a time, in which every fifth event comes with the third after its own."""
    events = _t(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    part = F.floor((F.dayofmonth("ts") - 1) / 10) + (F.col("event_id") % 5 == 0).cast("int")
    source, kept, state = (fresh_path(spark, n) for n in ("events", "limited", "state"))
    files = 1 + events.count() // 2_000_000  # of a third: as many are read at a time
    for k in range(5):  # one third after another: the file source goes by the files' times
        events.where(part == k).repartition(files).write.mode("append").parquet(source)
    # an event long after all others lets the watermark pass them
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
    found = stream_events.drained(stream_events.rate_limited(stream, 6 * 3600, "21 days"), kept, state).where("event_id >= 0")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("limited").alias("n_limited"))
