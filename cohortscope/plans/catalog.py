"""The named analyses: each is an operator applied to the bound driver tables, paired
with an independent DuckDB statement (the oracle) that computes the same result from
the raw tables.

Spark side: operators from ``cohortscope.operators`` over ``Bindings``; plans are
declarative so Catalyst pushes periods into the scans and prunes columns.
Oracle side: SQL over the driver tables with the bindings as CTEs, written from each
operator's definition (membership tests, per-user tables, filtered aggregates) and not from
the Spark plan, so it is an independent check.

Periods and thresholds are chosen for the driver tables (events span January 2024,
orders 1995 to 2001); see FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.functions.exprs import (
    CASE_ACCENT_INSENSITIVE,
    PCT_DECIMAL_KEEP,
    sql_days_between as sdays,
    sql_div,
    sql_dround,
    sql_mean,
    sql_pct,
    sql_pct_text,
)
from cohortscope.operators import (
    activity,
    cohort,
    eligibility,
    lists,
    profile,
    retention,
    segments,
    timing,
    topk,
)
from cohortscope.plans.period import Period, restrict
from cohortscope.session import configure_once
from cohortscope.sources.bindings import Bindings, sql_with
from cohortscope.sources.json_lists import explode_dates

# --- periods (fixed parameters of the analyses on the driver tables) -----------------
EVENTS_ALL = Period.half_open("2024-01-01", "2024-02-01")
VOTE_WINDOW = Period.between("2024-01-01", "2024-01-20")
VOTE_DAY = Period.half_open("2024-01-03", "2024-01-04")  # not every user votes on a given day
REQUEST_WINDOW = Period.half_open("2024-01-01", "2024-01-04")
RECEIPT_WINDOW = Period.half_open("2024-01-01", "2024-01-04")
# Two loads of each log, cut within a week and within a month.
EVENT_LOADS = (Period.half_open("2024-01-01", "2024-01-17"), Period.half_open("2024-01-17", "2024-02-01"))
ORDER_LOADS = (Period.half_open("1900-01-01", "1998-03-11"), Period.half_open("1998-03-11", "2100-01-01"))
POINT_WINDOW = Period.between("2024-01-01", "2024-01-31")
ORDERS_ALL = Period.half_open("1995-01-01", "2002-01-01")
ORDER_WINDOW = Period.between("1996-01-01", "1999-12-31")
SHIP_WINDOW = Period.half_open("1996-01-01", "1998-01-01")
RETENTION_WINDOW = Period.half_open("1996-01-01", "2000-01-01")
EARLY_F_ORDERS = Period.half_open("1995-01-01", "1996-06-01")
SIGNUP_WINDOW = Period.between("1995-01-01", "2024-01-31")
SIGNUP_PERIOD = Period.half_open("1996-01-01", "1999-01-01")
SIGNUP_VOTE_WINDOW = Period.between("2024-01-01", "2024-01-31")
QUESTION_WINDOW = Period.half_open("2024-01-01", "2024-01-21")
MIN_SCHOOL = 5
MIN_CLASS = 20
LOOKUP_USER = 42
LOOKUP_TYPE = "signup"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operator: str


REGISTRY: dict[str, Query] = {}


def register(name: str, operator: str, sql: str | None):
    def deco(fn: Callable[[Bindings], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure_once(spark)  # pinned zone / ANSI / AQE, the first time a session is used
            return fn(Bindings(spark, sf_dir))

        build.__name__ = name
        REGISTRY[name] = Query(name, build, sql, operator)
        return fn

    return deco


# ===================================================================== profiling (P)
@register("preview_payments", "P1", sql_with(
    "SELECT * FROM payments ORDER BY created_at, user_id, productId LIMIT 10", "payments"))
def _(b):
    return profile.preview(b.payments(), 10, order_by=["created_at", "user_id", "productId"])


@register("browse_payments", "P1", sql_with("SELECT * FROM payments", "payments"))
def _(b):
    return profile.browse(b.payments())


@register("malformed_lists", "P3", sql_with(
    "SELECT count(*) FILTER (WHERE CASE WHEN json_valid(x) THEN json_type(x) <> 'ARRAY' ELSE x IS NOT NULL END) AS malformed_cnt "
    "FROM (SELECT replace(attendance_date_list, '\\\"', '\"') AS x FROM stored_attendance)", "stored_attendance"))
def _(b):
    return profile.malformed_list_count(b.stored_attendance(), "attendance_date_list")


@register("malformed_props", "P3",
          "SELECT count(*) FILTER (WHERE CASE WHEN json_valid(props) THEN json_type(props) <> 'ARRAY' "
          "ELSE props IS NOT NULL END) AS malformed_cnt FROM events")
def _(b):
    # The event payload is a JSON object, so as a list every one of them is malformed.
    return profile.malformed_list_count(b.events, "props")


@register("completeness_payments", "P3", sql_with(
    "SELECT count(*) AS total_rows, "
    "CAST(sum(CASE WHEN created_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_created_at "
    "FROM payments", "payments"))
def _(b):
    return profile.completeness(b.payments(), ["created_at"])


@register("completeness_attendance", "P3", sql_with(
    "SELECT count(*) AS total_rows, CAST(sum(CASE WHEN attendance_date_list IS NULL "
    "THEN 1 ELSE 0 END) AS BIGINT) AS null_attendance_date_list FROM stored_attendance",
    "stored_attendance"))
def _(b):
    return profile.completeness(b.stored_attendance(), ["attendance_date_list"])


@register("empty_list_attendance", "P4", sql_with(
    "SELECT count(*) AS empty_attendance FROM stored_attendance WHERE attendance_date_list = '[]'",
    "stored_attendance"))
def _(b):
    return profile.empty_list_count(b.stored_attendance(), "attendance_date_list", "empty_attendance")


@register("count_large_schools", "P5", sql_with(
    f"SELECT count(id) AS cnt FROM schools WHERE student_count >= {MIN_SCHOOL}", "schools"))
def _(b):
    return profile.row_count(b.schools(), "id", F.col("student_count") >= MIN_SCHOOL)


@register("count_vote_rows", "P5", sql_with(
    "SELECT count(user_id) AS cnt FROM votes", "votes"))
def _(b):
    return profile.row_count(b.votes(), "user_id")


@register("distinct_payers", "P6", sql_with(
    "SELECT count(DISTINCT user_id) AS paying_users FROM payments", "payments"))
def _(b):
    return profile.distinct_count(b.payments(), {"paying_users": "user_id"})


@register("distinct_voters_in_period", "P6", sql_with(
    f"SELECT count(DISTINCT user_id) AS voters FROM votes WHERE {VOTE_WINDOW.sql('created_at')}",
    "votes"))
def _(b):
    return profile.distinct_count(b.votes(), {"voters": "user_id"}, VOTE_WINDOW)


@register("distinct_users_and_groups", "P6", sql_with(
    "SELECT count(DISTINCT id) AS total_cnt, count(DISTINCT group_id) AS group_cnt FROM users",
    "users"))
def _(b):
    return profile.distinct_count(b.users(), {"total_cnt": "id", "group_cnt": "group_id"})


@register("distinct_vote_status", "P7", sql_with("SELECT DISTINCT status FROM votes", "votes"))
def _(b):
    return profile.distinct_values(b.votes(), "status")


@register("distinct_products", "P7", sql_with(
    "SELECT DISTINCT productId FROM payments", "payments"))
def _(b):
    return profile.distinct_values(b.payments(), "productId")


@register("point_distribution", "P8", sql_with(
    "SELECT delta_point, count(*) AS cnt FROM point_history GROUP BY delta_point "
    "ORDER BY delta_point", "point_history"))
def _(b):
    return profile.value_counts(b.point_history(), "delta_point")


@register("point_earn_distribution", "P8", sql_with(
    "SELECT delta_point, count(*) AS cnt FROM point_history WHERE delta_point > 0 "
    "GROUP BY delta_point ORDER BY delta_point", "point_history"))
def _(b):
    return profile.value_counts(b.point_history(), "delta_point", where=F.col("delta_point") > 0)


@register("point_spend_distribution", "P8", sql_with(
    "SELECT delta_point, count(*) AS cnt FROM point_history WHERE delta_point < 0 "
    "GROUP BY delta_point ORDER BY delta_point", "point_history"))
def _(b):
    return profile.value_counts(b.point_history(), "delta_point", where=F.col("delta_point") < 0)


@register("status_counts", "P8", sql_with(
    "SELECT status, count(status) AS status_cnt FROM votes GROUP BY status", "votes"))
def _(b):
    return profile.value_counts(
        b.votes(), "status", count_col="status", name="status_cnt", order=None
    )


@register("status_counts_folded", "P8", sql_with(
    "SELECT min(status) AS status, count(status) AS status_cnt FROM votes "
    "GROUP BY lower(strip_accents(status))", "votes"))
def _(b):
    return profile.value_counts(
        b.votes(), "status", count_col="status", name="status_cnt",
        collation=CASE_ACCENT_INSENSITIVE, order=None,
    )


@register("segment_user_counts", "P8", sql_with(
    "SELECT ban_status, count(*) AS cnt FROM users GROUP BY ban_status", "users"))
def _(b):
    return profile.value_counts(b.users(), "ban_status", order=None)


@register("top_candidate_users", "P8", sql_with(
    "SELECT user_id, count(user_id) AS cnt FROM user_candidates GROUP BY user_id "
    "ORDER BY cnt DESC, user_id ASC NULLS FIRST LIMIT 10", "user_candidates"))
def _(b):
    return profile.value_counts(
        b.user_candidates(), "user_id", count_col="user_id", order="count", k=10
    )


@register("top_school_addresses", "P8", sql_with(
    "SELECT address, count(student_count) AS cnt FROM schools GROUP BY address "
    "ORDER BY cnt DESC, address ASC NULLS FIRST LIMIT 10", "schools"))
def _(b):
    return profile.value_counts(b.schools(), "address", count_col="student_count", order="count", k=10)


@register("top_school_addresses_by_students", "K2", sql_with(
    "SELECT address, CAST(sum(student_count) AS BIGINT) AS total FROM schools GROUP BY address "
    "ORDER BY total DESC NULLS LAST, address ASC NULLS FIRST LIMIT 10", "schools"))
def _(b):
    return profile.value_totals(b.schools(), "address", "student_count", k=10)


@register("lookup_event_type", "P9", f"SELECT * FROM events WHERE event_type = '{LOOKUP_TYPE}'")
def _(b):
    return profile.lookup(b.events, "event_type", LOOKUP_TYPE)


@register("lookup_event_type_folded", "P9",
          f"SELECT * FROM events WHERE lower(event_type) = '{LOOKUP_TYPE}'")
def _(b):
    return profile.lookup(b.events, "event_type", LOOKUP_TYPE.upper(), CASE_ACCENT_INSENSITIVE)


@register("lookup_user_by_text", "P9", f"SELECT * FROM events WHERE user_id = {LOOKUP_USER}")
def _(b):
    return profile.lookup(b.events, "user_id", str(LOOKUP_USER))


@register("lookup_user_events", "P9", f"SELECT * FROM events WHERE user_id = {LOOKUP_USER}")
def _(b):
    return profile.lookup(b.events, "user_id", LOOKUP_USER)


# ======================================================================== lists (L)
@register("attendance_dates", "L1", sql_with(
    "SELECT user_id, att_date FROM attendance_dates", "attendance_dates"))
def _(b):
    return explode_dates(b.attendance(), "user_id", "attendance_date_list")


# The same over stored lists: NULL, empty and malformed ones contribute nothing.
@register("stored_attendance_dates", "L1", sql_with(
    "SELECT user_id, att_date FROM stored_dates", "stored_dates"))
def _(b):
    return explode_dates(b.stored_attendance(), "user_id", "attendance_date_list")


@register("first_last_stored_attendance", "L2", sql_with(
    "SELECT user_id, min(att_date) AS first_attendance_date, max(att_date) AS last_attendance_date "
    "FROM stored_dates GROUP BY user_id", "stored_dates"))
def _(b):
    return lists.first_last_by_key(b.stored_attendance())


@register("monthly_stored_attendance", "L4", sql_with(
    "SELECT regexp_extract(tok, '^\\d{4}-\\d{2}') AS ym, count(*) AS attendance_cnt FROM (SELECT unnest("
    "regexp_extract_all(attendance_date_list, '\\d{4}-\\d{2}-\\d{2}')) AS tok FROM stored_attendance) "
    "GROUP BY 1 ORDER BY 1", "stored_attendance"))
def _(b):
    # The splitter reads the text, so the dates of a cut list count; only L1 to L3 need JSON.
    return lists.monthly_list_counts(b.stored_attendance())


@register("first_last_attendance_by_user", "L2", sql_with(
    "SELECT user_id, min(att_date) AS first_attendance_date, "
    "max(att_date) AS last_attendance_date FROM attendance_dates GROUP BY user_id",
    "attendance_dates"))
def _(b):
    return lists.first_last_by_key(b.attendance())


@register("first_last_attendance_overall", "L3", sql_with(
    "SELECT min(att_date) AS global_first_attendance_date, "
    "max(att_date) AS global_last_attendance_date FROM attendance_dates", "attendance_dates"))
def _(b):
    return lists.first_last_overall(b.attendance())


@register("monthly_attendance", "L4", sql_with(
    "SELECT strftime(TRY_CAST(tok AS DATE), '%Y-%m') AS ym, count(*) AS attendance_cnt FROM ("
    "SELECT trim(unnest(string_split(replace(replace(replace(replace(attendance_date_list, "
    "'\\\"', '\"'), '[', ''), ']', ''), '\"', ''), ','))) AS tok FROM attendance "
    "WHERE attendance_date_list IS NOT NULL) WHERE tok <> '' GROUP BY 1 ORDER BY 1",
    "attendance"))
def _(b):
    return lists.monthly_list_counts(b.attendance())


@register("friend_list_stats", "L5", sql_with(
    f"SELECT {sql_mean('n')} AS avg_friend_count, max(n) AS max_friend_count, "
    "min(n) AS min_friend_count FROM (SELECT CAST(json_array_length(u.friend_id_list) AS BIGINT) "
    f"AS n FROM users_with_lists u WHERE {SIGNUP_PERIOD.sql('u.created_at')} AND u.id IN ("
    f"SELECT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')}))",
    "users_with_lists", "votes"))
def _(b):
    members = cohort.cohort(b.voters(VOTE_DAY))
    return lists.list_length_stats(b.users(with_lists=True), members, user_period=SIGNUP_PERIOD)


@register("distinct_group_schools", "P6", sql_with(
    "SELECT count(DISTINCT school_id) AS school_cnt, count(DISTINCT id) AS group_cnt FROM groups",
    "groups"))
def _(b):
    return profile.distinct_count(b.groups(), {"school_cnt": "school_id", "group_cnt": "id"})


@register("distinct_voters_all_time", "P6", sql_with(
    "SELECT count(DISTINCT user_id) AS voters FROM votes", "votes"))
def _(b):
    return profile.distinct_count(b.votes(), {"voters": "user_id"})


@register("distinct_signups_in_period", "P6", sql_with(
    "SELECT count(DISTINCT id) AS signup_cnt FROM users "
    f"WHERE {SIGNUP_PERIOD.sql('created_at')}", "users"))
def _(b):
    return profile.distinct_count(b.users(), {"signup_cnt": "id"}, SIGNUP_PERIOD)


@register("distinct_candidate_users", "P6", sql_with(
    "SELECT count(DISTINCT user_id) AS candidate_users FROM user_candidates", "user_candidates"))
def _(b):
    return profile.distinct_count(b.user_candidates(), {"candidate_users": "user_id"})


@register("distinct_piece_ids", "P7", sql_with(
    "SELECT DISTINCT id FROM question_pieces", "question_pieces"))
def _(b):
    return profile.distinct_values(b.question_pieces(), "id")


@register("distinct_voter_ids", "P7", sql_with("SELECT DISTINCT user_id FROM votes", "votes"))
def _(b):
    return profile.distinct_values(b.votes(), "user_id")


@register("count_vote_pieces", "P5", sql_with(
    "SELECT count(question_piece_id) AS cnt FROM votes", "votes"))
def _(b):
    return profile.row_count(b.votes(), "question_piece_id")


@register("distinct_request_status", "P7", sql_with(
    "SELECT DISTINCT status FROM friend_requests", "friend_requests"))
def _(b):
    return profile.distinct_values(b.friend_requests(), "status")


@register("distinct_receipt_events", "P7", sql_with(
    "SELECT DISTINCT event_id FROM event_receipts", "event_receipts"))
def _(b):
    return profile.distinct_values(b.event_receipts(), "event_id")


@register("distinct_receipt_points", "P7", sql_with(
    "SELECT DISTINCT plus_point FROM event_receipts", "event_receipts"))
def _(b):
    return profile.distinct_values(b.event_receipts(), "plus_point")


@register("distinct_receipt_users", "P6", sql_with(
    "SELECT count(DISTINCT user_id) AS receipt_users FROM event_receipts", "event_receipts"))
def _(b):
    return profile.distinct_count(b.event_receipts(), {"receipt_users": "user_id"})


@register("distinct_questions", "P6", sql_with(
    "SELECT count(DISTINCT id) AS question_cnt, count(DISTINCT question_text) AS text_cnt "
    "FROM questions", "questions"))
def _(b):
    return profile.distinct_count(b.questions(), {"question_cnt": "id", "text_cnt": "question_text"})


# ===================================================================== activity (A)
@register("payment_totals", "A1", sql_with(
    "SELECT count(DISTINCT user_id) AS paying_users, count(*) AS total_payments FROM payments",
    "payments"))
def _(b):
    return activity.activity_totals(b.payments())


@register("payments_per_user", "A2", sql_with(
    f"SELECT {sql_div('count(*)', 'count(DISTINCT user_id)')} AS avg_payments_per_user "
    "FROM payments", "payments"))
def _(b):
    return activity.events_per_user(b.payments())


@register("monthly_payments", "A3", sql_with(
    "SELECT strftime(created_at, '%Y-%m') AS ym, count(*) AS payment_cnt, "
    "count(DISTINCT user_id) AS paying_users FROM payments GROUP BY 1 ORDER BY 1", "payments"))
def _(b):
    return activity.monthly_activity(b.payments())


@register("payment_frequency", "A4", sql_with(
    "SELECT payment_cnt, count(*) AS user_cnt FROM (SELECT user_id, count(*) AS payment_cnt "
    "FROM payments GROUP BY user_id) t GROUP BY payment_cnt ORDER BY payment_cnt", "payments"))
def _(b):
    return activity.frequency_histogram(b.payments())


@register("product_stats", "A5", sql_with(
    "SELECT productId, count(*) AS payment_cnt, count(DISTINCT user_id) AS users "
    "FROM payments GROUP BY productId ORDER BY payment_cnt DESC", "payments"))
def _(b):
    return activity.item_stats(b.payments())


@register("weekly_vote_intensity", "A6", sql_with(
    f"SELECT {sql_dround('avg(r)', 2)} AS avg_votes_per_week_per_user FROM ("
    f"SELECT user_id, {sql_div('sum(vote_cnt)', 'count(*)')} AS r FROM ("
    "SELECT user_id, isoyear(created_at) * 100 + week(created_at) AS year_week, "
    f"count(*) AS vote_cnt FROM votes WHERE {EVENTS_ALL.sql('created_at')} "
    "GROUP BY 1, 2) w GROUP BY user_id) u", "votes"))
def _(b):
    return activity.weekly_intensity(b.votes(), period=EVENTS_ALL)


@register("monthly_payments_of_loads", "A3", sql_with(
    "SELECT ym, CAST(sum(n) AS BIGINT) AS payment_cnt, count(*) AS paying_users FROM ("
    "SELECT strftime(created_at, '%Y-%m') AS ym, user_id, count(*) AS n FROM payments GROUP BY ALL) "
    "GROUP BY ym ORDER BY ym", "payments"))
def _(b):
    first, second = (activity.activity_state(b.payments(), "month", period=p) for p in ORDER_LOADS)
    return activity.monthly_activity_of(first.unionByName(second))


@register("weekly_vote_intensity_of_loads", "A6", sql_with(
    f"SELECT {sql_dround('avg(r)', 2)} AS avg_votes_per_week_per_user FROM (SELECT "
    f"{sql_div('count(*)', 'count(DISTINCT isoyear(created_at) * 100 + week(created_at))')} AS r "
    f"FROM votes WHERE {EVENTS_ALL.sql('created_at')} GROUP BY user_id)", "votes"))
def _(b):
    first, second = (activity.activity_state(b.votes(), "week", period=p) for p in EVENT_LOADS)
    return activity.weekly_intensity_of(first.unionByName(second))


@register("distinct_voters_and_pieces_of_loads", "P6", sql_with(
    "SELECT count(DISTINCT user_id) AS voters, count(DISTINCT question_piece_id) AS pieces FROM votes "
    f"WHERE {EVENTS_ALL.sql('created_at')}", "votes"))
def _(b):
    cols = {"voters": "user_id", "pieces": "question_piece_id"}
    first, second = (profile.distinct_bitmaps(restrict(b.votes(), p, "created_at"), cols) for p in EVENT_LOADS)
    return profile.count_bitmaps(profile.merge_bitmaps(first.unionByName(second)), list(cols))


@register("payment_user_rank", "A7", sql_with(
    "SELECT user_id, count(created_at) AS payment_cnt FROM payments GROUP BY user_id "
    "ORDER BY payment_cnt DESC", "payments"))
def _(b):
    return activity.rank_users(b.payments())


@register("candidate_piece_top_users", "A8", sql_with(
    "SELECT user_id, count(question_piece_id) AS question_piece_cnt FROM user_candidates "
    f"WHERE {SHIP_WINDOW.sql('created_at')} AND user_id IN (SELECT user_id FROM votes "
    f"WHERE {VOTE_DAY.sql('created_at')}) GROUP BY user_id "
    "ORDER BY question_piece_cnt DESC, user_id LIMIT 20", "user_candidates", "votes"))
def _(b):
    return activity.joined_item_counts(
        b.user_candidates(), b.votes(), k=20, facts_period=SHIP_WINDOW, cohort_period=VOTE_DAY,
    )


@register("candidate_piece_top_users_fanout", "A8", sql_with(
    "SELECT f.user_id, f.n * m.n AS question_piece_cnt FROM "
    "(SELECT user_id, count(question_piece_id) AS n FROM user_candidates "
    f"WHERE {SHIP_WINDOW.sql('created_at')} GROUP BY ALL) f, "
    "(SELECT user_id, count(*) AS n FROM votes "
    f"WHERE {VOTE_DAY.sql('created_at')} GROUP BY ALL) m WHERE f.user_id = m.user_id "
    "ORDER BY question_piece_cnt DESC, f.user_id LIMIT 20", "user_candidates", "votes"))
def _(b):
    return activity.joined_item_counts(
        b.user_candidates(), b.votes(), k=20, facts_period=SHIP_WINDOW, cohort_period=VOTE_DAY,
        fanout=True,
    )


# ======================================================================== top-k (K)
@register("top_voted_questions", "K1", sql_with(
    "SELECT v.question_id, q.question_text, count(*) AS vote_cnt FROM votes v "
    "JOIN questions q ON v.question_id = q.id GROUP BY v.question_id, q.question_text "
    "ORDER BY vote_cnt DESC, v.question_id, q.question_text LIMIT 10", "votes", "questions"))
def _(b):
    return topk.top_k_entities(b.votes(), b.questions())


@register("top_opened_questions", "K2", sql_with(
    "SELECT CAST(id AS INTEGER) AS question_id, question_text, total_opened_times, avg_opened_times, record_cnt "
    "FROM questions, LATERAL (SELECT "
    f"{sql_dround('CAST(sum(CAST(opened_times AS DECIMAL(28,8))) AS DOUBLE)', 4)} AS total_opened_times, "
    f"{sql_dround('CAST(sum(CAST(opened_times AS DECIMAL(28,8))) AS DOUBLE) / count(opened_times)', 4)} "
    "AS avg_opened_times, count(*) AS record_cnt FROM votes WHERE votes.question_id = questions.id) t "
    "WHERE record_cnt > 0 ORDER BY total_opened_times DESC, id, question_text LIMIT 10",
    "votes", "questions"))
def _(b):
    return topk.top_k_measures(b.votes(), b.questions())


@register("top_completed_questions", "K1", sql_with(
    "SELECT v.question_id, q.question_text, count(*) AS vote_cnt FROM votes v "
    "JOIN questions q ON q.id = v.question_id WHERE v.status = 'purchase' AND "
    f"{RECEIPT_WINDOW.sql('v.created_at')} GROUP BY v.question_id, q.question_text "
    "ORDER BY vote_cnt DESC, v.question_id, q.question_text LIMIT 10", "votes", "questions"))
def _(b):
    return topk.top_k_entities(
        b.votes(), b.questions(), where=F.col("status") == "purchase", facts_period=RECEIPT_WINDOW
    )


@register("top_voted_questions_in_periods", "K1", sql_with(
    "SELECT CAST(id AS INTEGER) AS question_id, question_text, vote_cnt FROM questions q, (SELECT question_id, "
    f"count(*) AS vote_cnt FROM votes WHERE {VOTE_WINDOW.sql('created_at')} GROUP BY question_id) t "
    f"WHERE t.question_id = q.id AND {QUESTION_WINDOW.sql('q.created_at')} "
    "ORDER BY vote_cnt DESC, id, question_text LIMIT 10", "votes", "questions"))
def _(b):
    return topk.top_k_entities(
        b.votes(), b.questions(), facts_period=VOTE_WINDOW, dim_period=QUESTION_WINDOW
    )


# ============================================================== cohorts, conversion (C)
@register("voters_in_period", "C1", sql_with(
    f"SELECT DISTINCT user_id FROM votes WHERE {VOTE_WINDOW.sql('created_at')}", "votes"))
def _(b):
    return cohort.cohort(b.votes(), period=VOTE_WINDOW)


@register("user_vote_conversion", "C2", sql_with(
    "SELECT count(DISTINCT u.id) AS total_users, count(DISTINCT r.user_id) AS voted_users, "
    f"{sql_pct('count(DISTINCT r.user_id)', 'count(DISTINCT u.id)')} AS voted_rate "
    "FROM users u LEFT JOIN votes r ON u.id = r.user_id "
    f"WHERE {ORDERS_ALL.sql('u.created_at')}", "users", "votes"))
def _(b):
    users = b.users().filter(ORDERS_ALL.mask("created_at"))
    return cohort.conversion_rate(
        users, b.votes(), base_key="id", base_name="total_users",
        converted_name="voted_users", rate_name="voted_rate",
    )


@register("attendance_vote_conversion", "C2", sql_with(
    "SELECT count(*) AS total_users, count(*) FILTER (WHERE voted) AS voted_users, "
    f"{sql_pct('count(*) FILTER (WHERE voted)', 'count(*)')} AS voted_rate FROM ("
    f"SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')}) "
    f"AS voted FROM attendance_dates WHERE {ORDER_WINDOW.sql('att_date', 'DATE')})",
    "attendance_dates", "votes"))
def _(b):
    days = explode_dates(b.attendance(), "user_id", "attendance_date_list")
    base = days.filter(ORDER_WINDOW.mask("att_date", as_type="date"))
    return cohort.conversion_rate(
        base, cohort.cohort(b.voters(VOTE_DAY)), base_name="total_users",
        converted_name="voted_users", rate_name="voted_rate",
    )


@register("payment_rate_all_users", "C2", sql_with(
    "SELECT count(DISTINCT p.user_id) AS paying_users, count(DISTINCT u.id) AS total_users, "
    f"{sql_dround('CAST(count(DISTINCT p.user_id) AS DOUBLE) / NULLIF(count(DISTINCT u.id), 0)', 4)}"
    " AS payment_rate FROM users u LEFT JOIN payments p ON u.id = p.user_id", "users", "payments"))
def _(b):
    return cohort.conversion_rate(
        b.users(), b.payments(), base_key="id", base_name="total_users",
        converted_name="paying_users", rate_name="payment_rate", rate="ratio",
    )


@register("payer_vote_conversion", "C2", sql_with(
    "SELECT count(DISTINCT p.user_id) AS payed_user_cnt, "
    "count(DISTINCT v.user_id) AS voted_user_cnt, "
    f"{sql_pct('count(DISTINCT v.user_id)', 'count(DISTINCT p.user_id)', keep=PCT_DECIMAL_KEEP)} "
    "AS voted_ratio "
    f"FROM (SELECT DISTINCT user_id FROM payments WHERE {ORDER_WINDOW.sql('created_at')}) p "
    f"LEFT JOIN (SELECT DISTINCT user_id FROM votes WHERE {VOTE_WINDOW.sql('created_at')}) v "
    "ON p.user_id = v.user_id", "payments", "votes"))
def _(b):
    return cohort.conversion_rate(
        cohort.cohort(b.payments(), period=ORDER_WINDOW),
        b.voters(VOTE_WINDOW),
        base_name="payed_user_cnt", converted_name="voted_user_cnt", rate_name="voted_ratio",
        keep=PCT_DECIMAL_KEEP,
    )


@register("payer_voter_totals", "C2", sql_with(
    "SELECT count(p.user_id) AS total_payed_user, count(v.user_id) AS total_voted_user "
    "FROM (SELECT user_id FROM payments GROUP BY user_id) p LEFT JOIN "
    "(SELECT user_id FROM votes GROUP BY user_id) v ON p.user_id = v.user_id",
    "payments", "votes"))
def _(b):
    return cohort.conversion_rate(
        b.payments(), b.votes(), base_name="total_payed_user",
        converted_name="total_voted_user", rate_name=None,
    )


@register("voter_sender_share", "C2", sql_with(
    "SELECT count(v.user_id) AS total_voters, count(s.send_user_id) AS sender_voters, "
    f"{sql_pct_text('count(s.send_user_id)', 'count(v.user_id)')} AS sender_rate "
    f"FROM (SELECT DISTINCT user_id FROM votes WHERE {VOTE_WINDOW.sql('created_at')}) v "
    "LEFT JOIN (SELECT DISTINCT send_user_id FROM friend_requests) s "
    "ON v.user_id = s.send_user_id", "votes", "friend_requests"))
def _(b):
    return cohort.conversion_rate(
        b.voters(VOTE_WINDOW), b.user_events("click")[0],
        base_name="total_voters", converted_name="sender_voters", rate_name="sender_rate", rate="text",
    )


_DAY_MEMBERS_SQL = f"SELECT DISTINCT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')}"


@register("friend_request_participation", "C3", sql_with(
    "SELECT count(v.user_id) AS total_voters, count(s.send_user_id) AS sender_cnt, "
    "count(r.receive_user_id) AS receiver_cnt, "
    f"{sql_pct_text('count(s.send_user_id)', 'count(v.user_id)')} AS sender_rate, "
    f"{sql_pct_text('count(r.receive_user_id)', 'count(v.user_id)')} AS receiver_rate "
    f"FROM ({_DAY_MEMBERS_SQL}) v "
    "LEFT JOIN (SELECT DISTINCT send_user_id FROM friend_requests "
    f"WHERE {REQUEST_WINDOW.sql('created_at')}) s ON v.user_id = s.send_user_id "
    "LEFT JOIN (SELECT DISTINCT receive_user_id FROM friend_requests "
    f"WHERE {REQUEST_WINDOW.sql('created_at')}) r ON v.user_id = r.receive_user_id",
    "votes", "friend_requests"))
def _(b):
    return cohort.two_way_participation(
        cohort.cohort(b.voters(VOTE_DAY)), b.friend_requests(),
        edge_period=REQUEST_WINDOW,
    )


def _per_member_sql(
    period: Period | None, members: str = _DAY_MEMBERS_SQL, tables: tuple[str, ...] = ("votes",)
) -> str:
    where = f"WHERE {period.sql('created_at')} " if period else ""
    return sql_with(
        f"SELECT count(v.user_id) AS total_voters, "
        f"{sql_dround(sql_mean('COALESCE(s.send_cnt, 0)'), 2)} AS avg_send_cnt, "
        "max(COALESCE(s.send_cnt, 0)) AS max_send_cnt, "
        "min(COALESCE(s.send_cnt, 0)) AS min_send_cnt "
        f"FROM ({members}) v LEFT JOIN (SELECT send_user_id, count(*) AS send_cnt "
        f"FROM friend_requests {where}GROUP BY send_user_id) s ON v.user_id = s.send_user_id",
        *tables, "friend_requests")


@register("friend_requests_per_voter", "C4", _per_member_sql(REQUEST_WINDOW))
def _(b):
    requests, n = b.user_events("click", REQUEST_WINDOW, counts=True)
    return cohort.per_member_activity(
        b.voters(VOTE_DAY), requests, fact_user="user_id", weight=n)


@register("friend_requests_per_voter_alltime", "C4", _per_member_sql(None))
def _(b):
    requests, n = b.user_events("click", counts=True)
    return cohort.per_member_activity(
        b.voters(VOTE_DAY), requests, fact_user="user_id", weight=n)


@register("friend_requests_per_voter_unknown", "C4", _per_member_sql(
    REQUEST_WINDOW, "SELECT DISTINCT user_id FROM voters_outer", ("voters_outer",)))
def _(b):
    # The outer join leaves one NULL member: it is in the mean but not in the member count.
    return cohort.per_member_activity(
        cohort.cohort(b.voters_outer()), b.friend_requests(), fact_period=REQUEST_WINDOW
    )


@register("event_participation_unknown", "C6", sql_with(
    "SELECT count(user_id) AS total_voted_users, count(n) AS event_participated_users, "
    f"{sql_pct('count(n)', 'count(user_id)')} AS event_participation_rate, "
    f"{sql_dround(sql_mean('n'), 2)} AS avg_event_cnt_per_participant FROM (SELECT DISTINCT o.user_id, "
    "(SELECT nullif(count(*), 0) FROM event_receipts e WHERE e.user_id = o.user_id AND "
    f"{RECEIPT_WINDOW.sql('e.created_at')}) AS n FROM voters_outer o)", "voters_outer", "event_receipts"))
def _(b):
    return cohort.participation_and_intensity(
        cohort.cohort(b.voters_outer()), b.event_receipts(), fact_period=RECEIPT_WINDOW
    )


@register("candidates_per_voter", "C4", sql_with(
    "SELECT count(v.user_id) AS voted_user_cnt, "
    f"{sql_dround(sql_mean('COALESCE(u.candidate_cnt, 0)'), 2)} AS avg_candidate_cnt_per_user "
    f"FROM (SELECT DISTINCT user_id FROM votes WHERE {VOTE_WINDOW.sql('created_at')}) v "
    "LEFT JOIN (SELECT user_id, count(*) AS candidate_cnt FROM user_candidates "
    f"WHERE {ORDER_WINDOW.sql('created_at')} GROUP BY user_id) u ON v.user_id = u.user_id",
    "votes", "user_candidates"))
def _(b):
    return cohort.per_member_activity(
        cohort.cohort(b.votes(), period=VOTE_WINDOW), b.user_candidates(),
        fact_user="user_id", fact_period=ORDER_WINDOW, prefix="candidate_cnt_per_user",
        members_name="voted_user_cnt", stats=("avg",),
    )


@register("voter_candidate_overlap", "C5", sql_with(
    "SELECT count(*) AS common_user_cnt FROM ("
    f"SELECT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')} INTERSECT "
    f"SELECT user_id FROM user_candidates WHERE {SHIP_WINDOW.sql('created_at')} AND question_piece_id IN "
    f"(SELECT id FROM question_pieces WHERE {ORDER_WINDOW.sql('created_at')}))",
    "votes", "user_candidates", "question_pieces"))
def _(b):
    pieces = restrict(b.question_pieces(), ORDER_WINDOW, "created_at")
    links = restrict(b.user_candidates(), SHIP_WINDOW, "created_at")
    return cohort.cohort_overlap([
        (b.voters(VOTE_DAY), "user_id"),
        (cohort.linked_members(links, pieces, distinct=False), "user_id"),
    ])


@register("candidate_voter_overlap", "C5", sql_with(
    "SELECT count(DISTINCT p.user_id) AS common_user_cnt FROM user_candidates p "
    "JOIN votes a ON p.user_id = a.user_id "
    f"WHERE {SHIP_WINDOW.sql('p.created_at')}", "user_candidates", "votes"))
def _(b):
    cands = restrict(b.user_candidates(), SHIP_WINDOW, "created_at")
    return cohort.cohort_overlap([(cands, "user_id"), (b.voters(), "user_id")])


@register("event_participation", "C6", sql_with(
    "SELECT count(v.user_id) AS total_voted_users, count(e.user_id) AS event_participated_users, "
    f"{sql_pct('count(e.user_id)', 'count(v.user_id)')} AS event_participation_rate, "
    f"{sql_dround(sql_mean('e.event_cnt'), 2)} AS avg_event_cnt_per_participant "
    f"FROM ({_DAY_MEMBERS_SQL}) v LEFT JOIN (SELECT user_id, count(*) AS event_cnt "
    f"FROM event_receipts WHERE {RECEIPT_WINDOW.sql('created_at')} GROUP BY user_id) e "
    "ON v.user_id = e.user_id", "votes", "event_receipts"))
def _(b):
    receipts, n = b.user_events("signup", RECEIPT_WINDOW, counts=True)
    return cohort.participation_and_intensity(b.voters(VOTE_DAY), receipts, weight=n)


@register("active_signup_range", "C7", sql_with(
    "SELECT min(u.created_at) AS min_created_at, max(u.created_at) AS max_created_at "
    "FROM users u JOIN votes r ON u.id = r.user_id", "users", "votes"))
def _(b):
    return cohort.overlap_range(b.users(), b.votes())


# ===================================================================== segments (S)
@register("point_segments", "S1", sql_with(
    "SELECT if(voted, 'voted', 'not_voted') AS vote_flag, count(user_id) AS user_cnt, "
    "CAST(sum(n) AS BIGINT) AS total_events, CAST(sum(points) AS BIGINT) AS total_point, "
    f"{sql_dround(sql_div('sum(n)', 'count(user_id)'), 2)} AS avg_events_per_user, "
    f"{sql_dround(sql_div('sum(points)', 'count(user_id)'), 2)} AS avg_point_per_user "
    "FROM (SELECT user_id, count(*) AS n, sum(delta_point) AS points, "
    f"user_id IN (SELECT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')}) AS voted "
    f"FROM point_history WHERE delta_point > 0 AND {POINT_WINDOW.sql('created_at')} "
    "GROUP BY user_id) GROUP BY 1", "point_history", "votes"))
def _(b):
    facts, n = b.earnings(POINT_WINDOW)
    return segments.compare_segments(facts, b.voters(VOTE_DAY), weight=n)


@register("segment_active_members", "S2", sql_with(
    "SELECT ban_status, count(id) AS ban_cnt FROM users "
    f"WHERE {ORDERS_ALL.sql('created_at')} AND id IN "
    f"(SELECT user_id FROM votes WHERE {EVENTS_ALL.sql('created_at')}) GROUP BY ban_status",
    "users", "votes"))
def _(b):
    return segments.segment_members(
        b.users(), b.voters(EVENTS_ALL), user_period=ORDERS_ALL
    )


@register("segment_completion", "S3", sql_with(
    "SELECT ban_status, CAST(sum(n) AS BIGINT) AS total_votes, CAST(sum(done) AS BIGINT) AS completed_votes, "
    f"{sql_pct('sum(done)', 'sum(n)')} AS completion_rate_pct FROM users, (SELECT user_id, count(*) AS n, "
    "count(*) FILTER (WHERE status = 'purchase') AS done FROM votes "
    f"WHERE {EVENTS_ALL.sql('created_at')} GROUP BY user_id) t "
    f"WHERE user_id = id AND {ORDERS_ALL.sql('users.created_at')} GROUP BY ban_status", "votes", "users"))
def _(b):
    return segments.segment_completion(
        b.votes(), b.users(), done_value="purchase", user_period=ORDERS_ALL,
        fact_period=EVENTS_ALL,
    )


@register("segment_non_members", "S4", sql_with(
    "SELECT u.ban_status, count(*) AS user_cnt FROM users u "
    f"WHERE {ORDERS_ALL.sql('u.created_at')} AND NOT EXISTS (SELECT 1 FROM first_actions r "
    f"WHERE r.user_id = u.id AND {EARLY_F_ORDERS.sql('r.created_at')}) "
    "GROUP BY u.ban_status ORDER BY user_cnt DESC", "users", "first_actions"))
def _(b):
    return segments.segment_non_members(
        b.users(), b.first_actions(), user_period=ORDERS_ALL, fact_period=EARLY_F_ORDERS
    )


@register("product_vote_conversion", "S5", sql_with(
    "SELECT productId, count(DISTINCT p.user_id) AS payed_cnt, "
    "count(DISTINCT v.user_id) AS voted_cnt, "
    f"{sql_pct('count(DISTINCT v.user_id)', 'count(DISTINCT p.user_id)', keep=PCT_DECIMAL_KEEP)} "
    "AS vote_rate FROM payments p LEFT JOIN votes v ON p.user_id = v.user_id "
    f"WHERE {ORDER_WINDOW.sql('p.created_at')} GROUP BY productId", "payments", "votes"))
def _(b):
    return segments.item_conversion(b.payments(), b.votes(), period=ORDER_WINDOW)


@register("product_day_vote_conversion_unknown", "S5", sql_with(
    "SELECT productId, count(u) AS payed_cnt, count(u) FILTER (WHERE voted) AS voted_cnt, "
    f"{sql_pct('count(u) FILTER (WHERE voted)', 'count(u)', keep=PCT_DECIMAL_KEEP)} AS vote_rate FROM ("
    "SELECT DISTINCT productId, user_id AS u, coalesce(user_id IN (SELECT user_id FROM votes "
    f"WHERE {VOTE_DAY.sql('created_at')}), false) AS voted FROM payments_outer) GROUP BY productId",
    "payments_outer", "votes"))
def _(b):
    # Most products of a day have no payer who ever voted: they stay with counts 0.
    return segments.item_conversion(b.payments_outer(), cohort.cohort(b.voters(VOTE_DAY)))


# Pieces in the period with the number of members linked to each.
_LINKED = {"linked": (
    "SELECT question_id, is_skipped, (SELECT count(DISTINCT user_id) FROM user_candidates k "
    f"WHERE k.question_piece_id = q.id AND {SHIP_WINDOW.sql('k.created_at')} AND k.user_id IN "
    f"(SELECT user_id FROM votes WHERE {VOTE_DAY.sql('created_at')})) AS w "
    f"FROM question_pieces q WHERE {ORDER_WINDOW.sql('created_at')}"
)}


@register("candidate_skip_rate", "S6", sql_with(
    "SELECT coalesce(CAST(sum(w) FILTER (WHERE question_id IS NOT NULL) AS BIGINT), 0) AS total_question_cnt, "
    "CAST(sum(w * is_skipped) AS BIGINT) AS skipped_question_cnt, "
    f"{sql_pct('sum(w * is_skipped)', 'sum(w)')} AS skip_rate_pct FROM linked", "user_candidates",
    "votes", "question_pieces", local=_LINKED))
def _(b):
    return segments.flag_rate(
        b.user_candidates(), cohort.cohort(b.voters(VOTE_DAY)), b.question_pieces(),
        link_period=SHIP_WINDOW, target_period=ORDER_WINDOW,
    )


@register("candidate_skip_rate_distinct_questions", "S6", sql_with(
    "SELECT count(*) AS total_cnt, CAST(sum(skips) AS BIGINT) AS skip_cnt, "
    f"{sql_pct('sum(skips)', 'count(*)')} AS skip_rate FROM (SELECT question_id, "
    "sum(w * is_skipped) AS skips FROM linked WHERE w > 0 GROUP BY question_id)", "user_candidates",
    "votes", "question_pieces", local=_LINKED))
def _(b):
    return segments.flag_rate(
        b.user_candidates(), cohort.cohort(b.voters(VOTE_DAY)), b.question_pieces(),
        denominator="distinct",
        names=("total_cnt", "skip_cnt", "skip_rate"),
        link_period=SHIP_WINDOW, target_period=ORDER_WINDOW,
    )


@register("candidate_skip_split", "S6", sql_with(
    "SELECT CAST(sum(w) - sum(w * is_skipped) AS BIGINT) AS skip_0_cnt, "
    "CAST(sum(w * is_skipped) AS BIGINT) AS skip_1_cnt FROM linked", "user_candidates", "votes",
    "question_pieces", local=_LINKED))
def _(b):
    return segments.flag_split(
        b.user_candidates(), cohort.cohort(b.voters(VOTE_DAY)), b.question_pieces(),
        link_period=SHIP_WINDOW, target_period=ORDER_WINDOW,
    )


# ================================================================ time to event (T)
def _timing_sql(starts: str, ends: str, unit: str, strict: bool, share: bool,
                avg_digits: int | None, names=("user_cnt", "avg_days", "min_days", "max_days")):
    op = ">" if strict else ">="
    avg = sql_mean("diff") if avg_digits is None else sql_dround(sql_mean("diff"), avg_digits)
    share_col = (
        f"{sql_pct('count(*)', '(SELECT count(*) FROM starts)')} AS user_ratio_pct, "
        if share else ""
    )
    return (
        f"starts AS ({starts}), ends AS ({ends}), d AS (SELECT "
        f"{sdays('s.start_at', 'e.end_at', unit)} AS diff FROM starts s JOIN ends e "
        f"ON s.user_id = e.user_id WHERE e.end_at {op} s.start_at) "
        f"SELECT count(*) AS {names[0]}, {share_col}{avg} AS {names[1]}, "
        f"min(diff) AS {names[2]}, max(diff) AS {names[3]} FROM d"
    )


def _with_local(body_with_ctes: str, *bindings: str) -> str:
    """``body_with_ctes`` starts with query-local CTE definitions."""
    return sql_with("", *bindings).rstrip("\n") + ",\n" + body_with_ctes


@register("time_first_to_second_action", "T1", _with_local(_timing_sql(
    "SELECT user_id, min(created_at) AS start_at FROM first_actions "
    f"WHERE {ORDERS_ALL.sql('created_at')} GROUP BY user_id",
    "SELECT user_id, min(created_at) AS end_at FROM second_actions "
    f"WHERE {ORDERS_ALL.sql('created_at')} GROUP BY user_id",
    "elapsed", strict=True, share=False, avg_digits=None), "first_actions", "second_actions"))
def _(b):
    return timing.time_to_event(
        timing.event_times(b.first_actions(), period=ORDERS_ALL),
        timing.event_times(b.second_actions(), period=ORDERS_ALL, name="end_at"),
        unit="elapsed", strict=True, avg_digits=None,
    )


_FIRST_ATTENDANCE_SQL = (
    "SELECT user_id, min(att_date) AS start_at FROM attendance_dates GROUP BY user_id"
)
_FIRST_SPEND_SQL = (
    "SELECT user_id, {expr} AS end_at FROM point_history WHERE delta_point < 0 {extra}"
    "GROUP BY user_id"
)


@register("time_attendance_to_spend_days", "T1", _with_local(_timing_sql(
    f"SELECT * FROM ({_FIRST_ATTENDANCE_SQL}) WHERE {ORDER_WINDOW.sql('start_at', 'DATE')}",
    _FIRST_SPEND_SQL.format(expr="CAST(min(created_at) AS DATE)", extra=""),
    "calendar", strict=False, share=False, avg_digits=2), "attendance_dates", "point_history"))
def _(b):
    return timing.time_to_event(
        lists.first_per_list(b.attendance()),
        timing.event_times(b.point_history(), where=F.col("delta_point") < 0, as_date=True,
                           name="end_at"),
        unit="calendar", first_start=ORDER_WINDOW.mask("start_at", as_type="date"),
    )


@register("time_attendance_to_spend_elapsed", "T1", _with_local(_timing_sql(
    "SELECT user_id, CAST(start_at AS TIMESTAMP) AS start_at FROM "
    f"({_FIRST_ATTENDANCE_SQL}) WHERE {ORDER_WINDOW.sql('CAST(start_at AS TIMESTAMP)')}",
    _FIRST_SPEND_SQL.format(expr="min(created_at)", extra=""),
    "elapsed", strict=False, share=True, avg_digits=2), "attendance_dates", "point_history"))
def _(b):
    first = lists.first_per_list(b.attendance())
    return timing.time_to_event(
        first.select("user_id", F.col("start_at").cast("timestamp_ntz").alias("start_at")),
        timing.event_times(b.point_history(), where=F.col("delta_point") < 0, name="end_at"),
        unit="elapsed", share=True, first_start=ORDER_WINDOW.mask("start_at"),
    )


@register("hours_attendance_to_spend", "T1", _with_local(_timing_sql(
    "SELECT user_id, start_at FROM first_attendance_times",
    _FIRST_SPEND_SQL.format(expr="min(created_at)", extra=""),
    "hours", strict=False, share=True, avg_digits=2,
    names=("user_cnt", "avg_hours", "min_hours", "max_hours")),
    "first_attendance_times", "point_history"))
def _(b):
    return timing.time_to_event(
        lists.first_per_list(b.attendance_times(), instants=True),
        timing.event_times(b.point_history(), where=F.col("delta_point") < 0, name="end_at"),
        unit="hours", share=True, names=("user_cnt", "avg_hours", "min_hours", "max_hours"),
    )


@register("time_vote_to_spend", "T1", _with_local(_timing_sql(
    "SELECT user_id, min(created_at) AS start_at FROM votes "
    f"WHERE {VOTE_WINDOW.sql('created_at')} GROUP BY user_id",
    _FIRST_SPEND_SQL.format(expr="min(created_at)",
                            extra=f"AND {VOTE_WINDOW.sql('created_at')} "),
    "calendar", strict=False, share=True, avg_digits=2), "votes", "point_history"))
def _(b):
    return timing.time_to_event(
        timing.event_times(b.votes(), period=VOTE_WINDOW),
        timing.event_times(b.point_history(), period=VOTE_WINDOW,
                           where=F.col("delta_point") < 0, name="end_at"),
        unit="calendar", share=True,
    )


@register("time_signup_to_vote", "T1", _with_local(_timing_sql(
    "SELECT DISTINCT id AS user_id, created_at AS start_at FROM users "
    f"WHERE {SIGNUP_WINDOW.sql('created_at')}",
    "SELECT user_id, min(created_at) AS end_at FROM votes "
    f"WHERE {SIGNUP_VOTE_WINDOW.sql('created_at')} GROUP BY user_id",
    "elapsed", strict=False, share=False, avg_digits=2), "users", "votes"))
def _(b):
    signups = (
        b.users().filter(SIGNUP_WINDOW.mask("created_at"))
        .select(F.col("id").alias("user_id"), F.col("created_at").alias("start_at"))
    )
    return timing.time_to_event(
        signups, timing.event_times(b.votes(), period=SIGNUP_VOTE_WINDOW, name="end_at"),
        unit="elapsed",
    )


# ==================================================================== retention (R)
def _retention_sql(period: Period, bands, any_visit: bool) -> str:
    """Each member's list as an array of days after the start; bands as tests on the array."""
    cols = []
    for lo, hi, name in bands:
        within = f"x >= {lo}" + ("" if hi is None else f" AND x <= {hi}")
        hit = (f"count(*) FILTER (WHERE len(list_filter(after, lambda x: {within})) > 0)" if any_visit
               else f"count(*) FILTER (WHERE {within.replace('x ', 'list_min(after) ')})")
        cols += [f"{hit} AS {name}", f"{sql_pct(hit, 'count(*)')} AS {name}_rate"]
    days = ("list_transform(coalesce(regexp_extract_all(attendance_date_list, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), []), "
            "lambda d: CAST(d AS DATE) - start_date)")
    return _with_local(
        "starts AS (SELECT user_id, min(CAST(created_at AS DATE)) AS start_date FROM first_actions "
        f"WHERE {period.sql('created_at')} GROUP BY ALL), windows AS (SELECT list_filter({days}, lambda x: x > 0) "
        "AS after FROM starts LEFT JOIN attendance USING (user_id)) "
        f"SELECT count(*) AS total_voted_users, {', '.join(cols)} FROM windows", "first_actions", "attendance")


@register("retention_interval", "R1",
          _retention_sql(RETENTION_WINDOW, retention.INTERVAL_BANDS, any_visit=False))
def _(b):
    starts = retention.start_days(b.first_actions(), period=RETENTION_WINDOW)
    return retention.retention_by_first_revisit(starts, b.attendance(), retention.INTERVAL_BANDS)


@register("retention_cumulative", "R2",
          _retention_sql(RETENTION_WINDOW, retention.CUMULATIVE_BANDS, any_visit=False))
def _(b):
    starts = retention.start_days(b.first_actions(), period=RETENTION_WINDOW)
    return retention.retention_by_first_revisit(starts, b.attendance(), retention.CUMULATIVE_BANDS)


@register("retention_any_visit", "R3",
          _retention_sql(RETENTION_WINDOW, retention.ANY_VISIT_BANDS, any_visit=True))
def _(b):
    starts = retention.start_days(b.first_actions(), period=RETENTION_WINDOW)
    return retention.retention_by_any_visit(starts, b.attendance(), retention.ANY_VISIT_BANDS)


def _rows_retention_sql(starts: str, visits: str, bands, any_visit: bool, *bindings: str) -> str:
    """Over visit rows: each member's visit days as a list, bands as tests on the list."""
    cols = []
    for lo, hi, name in bands:
        within = f"x >= {lo}" + ("" if hi is None else f" AND x <= {hi}")
        hit = (f"count(*) FILTER (WHERE len(list_filter(after, lambda x: {within})) > 0)" if any_visit
               else f"count(*) FILTER (WHERE {within.replace('x ', 'list_min(after) ')})")
        cols += [f"{hit} AS {name}", f"{sql_pct(hit, 'count(*)')} AS {name}_rate"]
    return _with_local(
        f"starts AS ({starts}), lists AS (SELECT user_id, list(DISTINCT CAST(created_at AS DATE)) AS days "
        f"FROM {visits} GROUP BY user_id), windows AS (SELECT list_filter(list_transform(coalesce(days, []), "
        "lambda d: d - start_date), lambda x: x > 0) AS after FROM starts LEFT JOIN lists USING (user_id)) "
        f"SELECT count(*) AS total_voted_users, {', '.join(cols)} FROM windows", *bindings)


_ACTION_STARTS = ("SELECT user_id, CAST(min(created_at) AS DATE) AS start_date FROM first_actions "
                  f"WHERE {RETENTION_WINDOW.sql('created_at')} GROUP BY user_id")
_VOTE_STARTS = ("SELECT user_id, CAST(min(created_at) AS DATE) AS start_date FROM votes "
                f"WHERE status = 'purchase' AND {EVENTS_ALL.sql('created_at')} GROUP BY user_id")
_ROW_RETENTION = {  # name: (SURVEY id, bands, any visit counts)
    "retention_interval": ("R1", retention.INTERVAL_BANDS, False),
    "retention_cumulative": ("R2", retention.CUMULATIVE_BANDS, False),
    "retention_any_visit": ("R3", retention.ANY_VISIT_BANDS, True),
}


def _retention_of_rows(starts: DataFrame, visits: DataFrame, bands, any_visit: bool) -> DataFrame:
    run = retention.retention_by_any_visit if any_visit else retention.retention_by_first_revisit
    return run(starts, visits, bands, visit_ts="created_at")


def _register_row_retention(name: str, operator: str, bands, any_visit: bool) -> None:
    # Visits as rows of the event log: the member starts with the first purchase.
    @register(f"{name}_events", operator, _rows_retention_sql(_VOTE_STARTS, "votes", bands, any_visit, "votes"))
    def _(b):
        starts = retention.start_days(b.votes().filter(F.col("status") == "purchase"), period=EVENTS_ALL)
        return _retention_of_rows(starts, b.votes(), bands, any_visit)

    # Visits as order rows: the same members and days as the JSON lists of `attendance`.
    @register(f"{name}_visits", operator, _rows_retention_sql(
        _ACTION_STARTS, "payments", bands, any_visit, "first_actions", "payments"))
    def _(b):
        starts = retention.start_days(b.first_actions(), period=RETENTION_WINDOW)
        return _retention_of_rows(starts, b.payments(), bands, any_visit)


for _name, _made in _ROW_RETENTION.items():
    _register_row_retention(_name, *_made)


# ================================================================== eligibility (E)
_CLASS_SQL = f"SELECT group_id FROM users GROUP BY group_id HAVING count(DISTINCT id) >= {MIN_CLASS}"
_SCHOOL_SQL = f"SELECT id AS school_id FROM schools WHERE student_count >= {MIN_SCHOOL}"
_IN_LARGE_SCHOOL = f"group_id IN (SELECT id FROM groups WHERE school_id IN ({_SCHOOL_SQL}))"
_ELIGIBLE_SQL = f"SELECT DISTINCT id AS user_id, group_id FROM users WHERE {_IN_LARGE_SCHOOL} AND group_id IN ({_CLASS_SQL})"


@register("qualified_classes", "E1", sql_with(
    f"SELECT group_id, count(DISTINCT id) AS member_cnt FROM users GROUP BY group_id "
    f"HAVING count(DISTINCT id) >= {MIN_CLASS}", "users"))
def _(b):
    return eligibility.qualified_groups(b.users(), min_members=MIN_CLASS)


@register("qualified_class_count", "E2", sql_with(
    f"SELECT count(*) AS class_cnt FROM ({_CLASS_SQL}) t", "users"))
def _(b):
    return eligibility.qualified_group_count(b.users(), min_members=MIN_CLASS)


@register("eligible_population", "E3", sql_with(
    "SELECT count(DISTINCT user_id) AS student_cnt, count(DISTINCT group_id) AS group_cnt "
    f"FROM ({_ELIGIBLE_SQL}) e", "users", "groups", "schools"))
def _(b):
    return eligibility.eligible_population(
        b.users(), b.groups(), b.schools(), min_school=MIN_SCHOOL, min_class=MIN_CLASS
    )


@register("eligible_conversion", "E4", sql_with(
    "SELECT count(*) AS eligible_student_cnt, count(*) FILTER (WHERE voted) AS voted_student_cnt, "
    f"{sql_pct('count(*) FILTER (WHERE voted)', 'count(*)', keep=PCT_DECIMAL_KEEP)} AS voted_ratio "
    f"FROM (SELECT DISTINCT user_id, user_id IN ({_DAY_MEMBERS_SQL}) AS voted FROM ({_ELIGIBLE_SQL}))",
    "users", "groups", "schools", "votes"))
def _(b):
    return eligibility.eligible_conversion(
        b.users(), b.groups(), b.schools(), b.votes(), min_school=MIN_SCHOOL, min_class=MIN_CLASS,
        voter_period=VOTE_DAY,
    )


@register("members_in_large_schools", "E5", sql_with(
    f"SELECT count(group_id) AS cnt FROM users WHERE {_IN_LARGE_SCHOOL}", "users", "groups", "schools"))
def _(b):
    return eligibility.members_in_large_parents(
        b.users(), b.groups(), b.schools(), min_school=MIN_SCHOOL
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
