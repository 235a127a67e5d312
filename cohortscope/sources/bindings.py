"""Bindings: the driver tables bound to the logical tables the analyses are written for.

The analyses were written for an app's tables (users, votes, attendance lists, payments,
point history, friend requests, ...). The test data is a TPC-H-like star schema plus an
event log, so each logical table is derived from driver tables by a Spark expression.
``SQL_BINDINGS`` holds the same derivations as DuckDB SQL for the oracle; the two must be
kept in step.

Every binding is lazy: it is a DataFrame whose plan Catalyst merges with the operator
on top, so only the columns and rows an analysis needs are read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.plans.period import Period, restrict
from cohortscope.sources.layout import day_column, laid_out
from cohortscope.sources.rollup import COUNT, rolled_up, user_days
from cohortscope.sources.tables import read_table


def _k() -> F.Column:
    """The integer payload of an event: ``props`` is JSON like ``{"k": 17}``."""
    return F.get_json_object(F.col("props"), "$.k").try_cast("int")


STORED_DAYS = Period.half_open("1996-01-01", "1998-01-01")  # days of the stored lists


def _times(df: DataFrame, ts: str, name: str = "created_at") -> list[F.Column]:
    """The time column under its logical name, and its day where the table has folders by day."""
    day = day_column(ts)
    return [F.col(ts).alias(name), *([F.col(day).alias(day_column(name))] if day in df.columns else [])]


class Bindings:
    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir

    def table(self, name: str) -> DataFrame:
        """The table in the session's day layout where there is one, else the plain table."""
        found = laid_out(self.spark, name)
        return read_table(self.spark, self.base_dir, name) if found is None else found

    # -- raw tables --------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    def user_events(
        self, kind: str | None = None, period: Period | None = None, counts: bool = False,
    ) -> tuple[DataFrame, str | None]:
        """(rows with ``user_id``, name of their count or None): the events of a type in a
        period, for per-user questions.

        From the session's rollup where it answers the question exactly (``counts``: how many,
        else who); then a row stands for as many events as the count says. Else from the log.
        """
        rows, n = rolled_up(self.spark, period, counts), COUNT
        if rows is None:
            rows, n = restrict(self.events.select("user_id", "event_type", *_times(self.events, "ts")), period, "created_at"), None
        return (rows if kind is None else rows.filter(F.col("event_type") == kind)), n

    def event_rollup(self) -> DataFrame:
        """The rollup of the event log that ``user_events`` understands; ``earnings`` and
        ``earned`` count and add up the events that earn points."""
        earns = (F.col("event_type") != "purchase") & (_k() > 0)
        log = self.events.withColumns({"_one": F.when(earns, 1).otherwise(0), "_k": F.when(earns, _k())})
        return user_days(log, "user_id", "ts", by=["event_type"], sums={"earnings": "_one", "earned": "_k"})

    def voters(self, period: Period | None = None) -> DataFrame:
        """``user_id`` of everyone with a vote in the period (repeated)."""
        return self.user_events(period=period)[0].select("user_id")

    def earnings(self, period: Period) -> tuple[DataFrame, str | None]:
        """Facts that earn points, ``user_id`` and ``delta_point``: as ``user_events``."""
        rows = rolled_up(self.spark, period, counts=True)
        if rows is None:
            facts = restrict(self.point_history(), period, "created_at").filter(F.col("delta_point") > 0)
            return facts.select("user_id", "delta_point"), None
        rows = rows.filter(F.col("earnings") > 0)
        return rows.select("user_id", F.col("earned").alias("delta_point"), "earnings"), "earnings"

    # -- logical tables ----------------------------------------------------------
    def attendance(self) -> DataFrame:
        """user_id, attendance_date_list: per customer, the sorted distinct order days as
        JSON text. The collect_set is partially aggregated before the shuffle and holds
        at most one entry per calendar day, so a heavy customer stays bounded."""
        return self.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
            F.to_json(
                F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd")))
            ).alias("attendance_date_list")
        )

    def stored_attendance(self) -> DataFrame:
        """Every customer's list as an app stores it: NULL, empty, escaped and cut texts too.

        The list holds the order days of ``STORED_DAYS``. Customers without one have ``[]``, or
        NULL if they owe money. Of the others those who owe money have a text whose end is
        cut off (no JSON), and the BUILDING segment's quotes are escaped.
        """
        days = restrict(self.orders.select("o_custkey", *_times(self.orders, "o_orderdate")), STORED_DAYS, "created_at")
        lists = days.groupBy("o_custkey").agg(F.to_json(F.array_sort(
            F.collect_set(F.date_format("created_at", "yyyy-MM-dd")))).alias("t"))
        t, owes = F.col("t"), F.col("c_acctbal") < 0
        text = (
            F.when(t.isNull() & owes, F.lit(None).cast("string"))
            .when(t.isNull(), F.lit("[]"))
            .when(owes, F.left(t, F.length(t) - 1))
            .when(F.col("c_mktsegment") == "BUILDING", F.replace(t, F.lit('"'), F.lit('\\"')))
            .otherwise(t)
        )
        return self.table("customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").alias("user_id"), text.alias("attendance_date_list"))

    def first_actions(self) -> DataFrame:
        """The first-action log for retention and timing: finished orders."""
        return self.orders.filter(F.col("o_orderstatus") == "F").select(
            F.col("o_custkey").alias("user_id"), *_times(self.orders, "o_orderdate")
        )

    def second_actions(self) -> DataFrame:
        """The second-action log for timing: urgent orders."""
        return self.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_custkey").alias("user_id"), *_times(self.orders, "o_orderdate")
        )

    def votes(self) -> DataFrame:
        """Vote log: every event is a vote on question ``k``; status is the event type."""
        return self.events.select(
            F.col("user_id"),
            _k().alias("question_id"),
            F.col("event_id").alias("question_piece_id"),
            F.col("value").alias("opened_times"),
            F.col("event_type").alias("status"),
            *_times(self.events, "ts"),
        )

    def questions(self) -> DataFrame:
        """Parts; a question's time spreads over January 2024 by the part's number."""
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("question_text"),
            F.timestamp_add("HOUR", (F.col("p_partkey") % 720).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        )

    def payments(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("productId"),
            *_times(self.orders, "o_orderdate"),
        )

    def point_history(self) -> DataFrame:
        """Purchases spend ``k`` points, every other event earns ``k``."""
        k = _k()
        return self.events.select(
            F.col("user_id"),
            F.when(F.col("event_type") == "purchase", -k).otherwise(k).alias("delta_point"),
            *_times(self.events, "ts"),
        )

    def friend_requests(self) -> DataFrame:
        """Clicks are friend requests from the user to user ``k``."""
        return self.events.filter(F.col("event_type") == "click").select(
            F.col("user_id").alias("send_user_id"),
            _k().cast("long").alias("receive_user_id"),
            F.col("event_type").alias("status"),
            *_times(self.events, "ts"),
        )

    def event_receipts(self) -> DataFrame:
        return self.events.filter(F.col("event_type") == "signup").select(
            F.col("user_id"),
            F.col("event_id"),
            _k().alias("plus_point"),
            *_times(self.events, "ts"),
        )

    def attendance_times(self) -> DataFrame:
        """user_id, attendance_date_list with instants: per event user, the first event of
        every day as JSON text (bounded by the calendar like ``attendance``)."""
        first = self.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("at"))
        return first.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(
            F.date_format("at", "yyyy-M-d H:mm:ss")))).alias("attendance_date_list"))

    def voters_outer(self) -> DataFrame:
        """Every customer left-joined with the votes: ``user_id`` and ``created_at`` of the
        vote, NULL for a customer without one."""
        v = self.votes().select("user_id", "created_at")
        return self.table("customer").select("c_custkey").join(
            v, F.col("c_custkey") == F.col("user_id"), "left").select("user_id", "created_at")

    def payments_outer(self) -> DataFrame:
        """Payments with the voter's id instead of the payer's: NULL where the payer never
        voted, so a product may have no known user at all."""
        v = self.votes().select(F.col("user_id").alias("voter")).distinct()
        return self.payments().join(v, F.col("user_id") == F.col("voter"), "left").select(
            F.col("voter").alias("user_id"), F.concat("productId", F.lit(" "), F.date_format(
                "created_at", "yyyy-MM-dd")).alias("productId"), "created_at")

    def users(self, with_lists: bool = False) -> DataFrame:
        """Customers: class = whole square root of the id (so classes differ in size at any
        scale), segment = ban status, sign-up = first order time.

        ``with_lists`` adds ``friend_id_list``, a stored list per user in the analysed data
        model. Here it is the user's list of order days, which the calendar bounds; a list
        of all receivers of a hub's requests would not be bounded.
        """
        signup = self.orders.groupBy(F.col("o_custkey").alias("id")).agg(
            F.min("o_orderdate").alias("created_at")
        )
        users = (
            self.table("customer")
            .select(
                F.col("c_custkey").alias("id"),
                F.floor(F.sqrt("c_custkey")).alias("group_id"),
                F.col("c_mktsegment").alias("ban_status"),
            )
            .join(signup, "id", "left")
        )
        if with_lists:
            lists = self.attendance().select(
                F.col("user_id").alias("id"), F.col("attendance_date_list").alias("friend_id_list"))
            users = users.join(lists, "id", "left")
        return users

    def groups(self) -> DataFrame:
        """Classes: the users' classes, dealt over the regions (schools)."""
        group = F.floor(F.sqrt("c_custkey"))
        return self.table("customer").select(group.alias("id")).distinct().select(
            "id", F.pmod("id", F.lit(5)).cast("long").alias("school_id"))

    def schools(self) -> DataFrame:
        """Schools: regions; student_count = suppliers whose number ends in at least as many
        zeros as the region's number (NULL when none), so sizes differ at any scale."""
        zeros = F.length(F.regexp_extract(F.col("s_suppkey").cast("string"), "(0*)$", 1))
        per_region = (
            self.table("supplier")
            .select(F.explode(F.sequence(F.lit(0), zeros)).alias("r_regionkey"))
            .groupBy("r_regionkey")
            .agg(F.count(F.lit(1)).cast("int").alias("student_count"))
        )
        return (
            self.table("region")
            .join(per_region, "r_regionkey", "left")
            .select(
                F.col("r_regionkey").cast("long").alias("id"),
                F.col("r_name").alias("school_type"),
                F.col("r_name").alias("address"),
                F.col("student_count"),
            )
        )

    def question_pieces(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("question_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("is_skipped"),
            *_times(self.orders, "o_orderdate"),
        )

    def user_candidates(self) -> DataFrame:
        lines = self.table("lineitem")
        return lines.select(
            F.col("l_suppkey").alias("user_id"),
            F.col("l_orderkey").alias("question_piece_id"),
            *_times(lines, "l_shipdate"),
        )


_K_SQL = "TRY_CAST(props->>'$.k' AS INTEGER)"

# The same logical tables as DuckDB SQL (CTE bodies), for the oracle.
SQL_BINDINGS: dict[str, str] = {
    "attendance": (
        "SELECT o_custkey AS user_id, CAST(to_json(list_sort(list_distinct("
        "list(strftime(o_orderdate, '%Y-%m-%d'))))) AS VARCHAR) AS attendance_date_list "
        "FROM orders GROUP BY o_custkey"
    ),
    "stored_attendance": (
        "SELECT c.c_custkey AS user_id, CASE WHEN len(days) = 0 THEN CASE WHEN c.c_acctbal >= 0 THEN '[]' END "
        "WHEN c.c_acctbal < 0 THEN '[\"' || array_to_string(days, '\",\"') || '\"' "
        "WHEN c.c_mktsegment = 'BUILDING' THEN '[\\\"' || array_to_string(days, '\\\",\\\"') || '\\\"]' "
        "ELSE '[\"' || array_to_string(days, '\",\"') || '\"]' END AS attendance_date_list FROM "
        "(SELECT *, list_sort(list_distinct(ARRAY(SELECT strftime(o.o_orderdate, '%Y-%m-%d') FROM orders o "
        f"WHERE o.o_custkey = k.c_custkey AND {STORED_DAYS.sql('o.o_orderdate')}))) AS days FROM customer k) c"
    ),
    "stored_dates": (
        "SELECT user_id, TRY_CAST(trim(unnest(from_json(t, '[\"VARCHAR\"]'))) AS DATE) AS att_date FROM ("
        "SELECT user_id, CASE WHEN json_valid(x) THEN CASE WHEN json_type(x) = 'ARRAY' THEN x END END AS t FROM (SELECT user_id, "
        "replace(attendance_date_list, '\\\"', '\"') AS x FROM stored_attendance)) WHERE t IS NOT NULL"
    ),
    "first_actions": (
        "SELECT o_custkey AS user_id, o_orderdate AS created_at FROM orders "
        "WHERE o_orderstatus = 'F'"
    ),
    "second_actions": (
        "SELECT o_custkey AS user_id, o_orderdate AS created_at FROM orders "
        "WHERE o_orderpriority = '1-URGENT'"
    ),
    "votes": (
        f"SELECT user_id, {_K_SQL} AS question_id, event_id AS question_piece_id, "
        "value AS opened_times, event_type AS status, ts AS created_at FROM events"
    ),
    "questions": (
        "SELECT p_partkey AS id, p_name AS question_text, "
        "CAST('2024-01-01' AS TIMESTAMP) + to_hours(CAST(p_partkey % 720 AS INTEGER)) AS created_at FROM part"
    ),
    "payments": (
        "SELECT o_custkey AS user_id, o_orderpriority AS productId, "
        "o_orderdate AS created_at FROM orders"
    ),
    "point_history": (
        f"SELECT user_id, CASE WHEN event_type = 'purchase' THEN -{_K_SQL} ELSE {_K_SQL} END "
        "AS delta_point, ts AS created_at FROM events"
    ),
    "friend_requests": (
        f"SELECT user_id AS send_user_id, CAST({_K_SQL} AS BIGINT) AS receive_user_id, "
        "event_type AS status, ts AS created_at FROM events WHERE event_type = 'click'"
    ),
    "event_receipts": (
        f"SELECT user_id, event_id, {_K_SQL} AS plus_point, ts AS created_at FROM events "
        "WHERE event_type = 'signup'"
    ),
    "users": (
        "SELECT c.c_custkey AS id, CAST(floor(sqrt(c.c_custkey)) AS BIGINT) AS group_id, "
        "c.c_mktsegment AS ban_status, s.created_at FROM customer c "
        "LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders "
        "GROUP BY o_custkey) s ON s.o_custkey = c.c_custkey"
    ),
    "users_with_lists": (
        "SELECT u.*, a.attendance_date_list AS friend_id_list FROM users u "
        "LEFT JOIN attendance a ON a.user_id = u.id"
    ),
    "first_attendance_times": (
        "SELECT user_id, date_trunc('second', min(ts)) AS start_at FROM events GROUP BY user_id"
    ),
    "voters_outer": (
        "SELECT v.user_id, v.created_at FROM customer c LEFT JOIN votes v ON v.user_id = c.c_custkey"
    ),
    "payments_outer": (
        "SELECT (SELECT max(v.user_id) FROM votes v WHERE v.user_id = p.user_id) AS user_id, "
        "p.productId || ' ' || strftime(p.created_at, '%Y-%m-%d') AS productId, p.created_at FROM payments p"
    ),
    "groups": (
        "SELECT DISTINCT CAST(floor(sqrt(c_custkey)) AS BIGINT) AS id, "
        "CAST(floor(sqrt(c_custkey)) AS BIGINT) % 5 AS school_id FROM customer"
    ),
    "schools": (
        "SELECT CAST(r.r_regionkey AS BIGINT) AS id, r.r_name AS school_type, "
        "r.r_name AS address, c.student_count FROM region r LEFT JOIN ("
        "SELECT z.zeros AS n, CAST(count(*) AS INTEGER) AS student_count FROM supplier s "
        "JOIN (SELECT unnest(range(0, 12)) AS zeros) z "
        "ON length(regexp_extract(CAST(s.s_suppkey AS VARCHAR), '(0*)$', 1)) >= z.zeros "
        "GROUP BY z.zeros) c "
        "ON c.n = r.r_regionkey"
    ),
    "question_pieces": (
        "SELECT o_orderkey AS id, o_custkey AS question_id, "
        "CAST(o_orderstatus = 'F' AS INTEGER) AS is_skipped, o_orderdate AS created_at "
        "FROM orders"
    ),
    "user_candidates": (
        "SELECT l_suppkey AS user_id, l_orderkey AS question_piece_id, "
        "l_shipdate AS created_at FROM lineitem"
    ),
    "attendance_dates": (
        "SELECT user_id, TRY_CAST(trim(x) AS DATE) AS att_date FROM ("
        "SELECT user_id, unnest(from_json(replace(attendance_date_list, '\\\"', '\"'), "
        "'[\"VARCHAR\"]')) AS x FROM attendance)"
    ),
}

# Bindings that refer to other bindings.
SQL_BINDING_DEPS: dict[str, tuple[str, ...]] = {
    "users_with_lists": ("attendance", "users"),
    "voters_outer": ("votes",),
    "payments_outer": ("votes", "payments"),
    "attendance_dates": ("attendance",),
    "stored_dates": ("stored_attendance",),
}


def sql_with(body: str, *names: str, local: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and what they depend on), then the
    query's own ``local`` CTEs in the given order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in SQL_BINDING_DEPS.get(name, ()):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({SQL_BINDINGS[name]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in (local or {}).items()]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
