"""Streaming jobs run to the end of the given events, as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators.search_index import INDEX_COLUMNS, SearchIndex
from jobweave.plans.fixtures import tokens_sql, with_
from jobweave.plans.registry import query
from jobweave.streaming import jobs as stream

K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def _events(t):
    return stream.read_events(t.spark, t.folder, "events.parquet")


def _job_id(props="props"):
    return F.regexp_extract(props, "([0-9]+)", 1).cast("bigint")


@query(
    "stream_view_counts",
    with_("jobs_part") + f""" SELECT {K_SQL} AS id, count(*) AS views FROM events WHERE event_type = 'view'
      AND {K_SQL} IN (SELECT id FROM jobs_part WHERE is_active = 1) GROUP BY 1""",
)
def stream_view_counts(t):
    views = _events(t).filter("event_type = 'view'").select(_job_id().alias("id"))
    return stream.count_views(views, t.jobs_part.filter("is_active = 1"), t.work_folder())


@query(
    "stream_daily_quota",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS search_count, count(*) >= 10 AS at_limit FROM events
    WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
)
def stream_daily_quota(t):
    searches = _events(t).filter("event_type IN ('click', 'view')").select("user_id", "ts")
    return stream.daily_quota(searches, t.work_folder()).withColumn("day", F.col("day").cast("string"))


@query(
    "stream_usage_log",
    """SELECT event_id AS usage_id, user_id, CASE WHEN event_type <> 'purchase' THEN event_type END AS search_keywords,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
)
def stream_usage_log(t):
    log = stream.append_usage_log(_events(t), t.work_folder())
    return log.select("usage_id", "user_id", "search_keywords", F.col("day").cast("string").alias("day"))


@query("stream_resume", "SELECT event_id, user_id, event_type FROM events")
def stream_resume(t):
    """Two runs over the same input: the second finds nothing new."""
    folder = t.work_folder()
    stream.only_new(_events(t), folder)
    return stream.only_new(_events(t), folder).select("event_id", "user_id", "event_type")


CHANGED = f"SELECT {K_SQL} AS id, max(event_id) AS last_event FROM events GROUP BY 1"


@query(
    "stream_index_refresh",
    with_("jobs_part") + f""", ch AS (SELECT {K_SQL} AS id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1),
      j AS (SELECT j.id, CASE WHEN ch.id IS NULL THEN job_title ELSE 'changed ' || ch.event_type END AS job_title,
        CASE WHEN ch.event_type = 'error' THEN 0 WHEN ch.id IS NULL THEN is_active ELSE 1 END AS is_active
        FROM jobs_part j LEFT JOIN ch ON ch.id = j.id)
    SELECT term, id, field, count(*) AS tf FROM (SELECT id, 'job_title' AS field, unnest({tokens_sql('job_title')}) AS term FROM j WHERE is_active = 1) x
    GROUP BY 1, 2, 3""",
)
def stream_index_refresh(t):
    """The index that searches read, after the changes of the stream."""
    folder = t.work_folder()
    SearchIndex.build(t.jobs_part, f"{folder}/index")
    fixed = {c: F.lit(None).cast("string") for c in (*INDEX_COLUMNS[1:], "org_location", "job_source")}
    flags = {c: F.lit(0) for c in ("exists_in_uk", "exists_in_london", "has_description")}
    changes = _events(t).select(
        _job_id().alias("id"),
        F.col("event_id").alias("change_no"),
        F.concat(F.lit("changed "), "event_type").alias("job_title"),
        (F.col("event_type") != "error").cast("int").alias("is_active"),
        *[value.alias(name) for name, value in (fixed | flags).items()],
    )
    index = stream.refresh_index(changes.filter("id IS NOT NULL"), folder)
    rows = index.places.filter("field = 'job_title'")
    return rows.select("term", "id", "field", F.col("tf").cast("bigint").alias("tf"))


PAID = """SELECT event_id, user_id, CAST(event_id % 3 + 1 AS BIGINT) AS tier, 'pi-' || CAST(event_id AS STRING) AS transaction_id,
  CAST(floor(value * 100) AS BIGINT) AS amount_total, ts AS event_time FROM {events} WHERE event_type = 'purchase'"""


@query(
    "stream_checkout_events",
    with_("users", "payments") + f""", c AS ({PAID.format(events='events')}),
      f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS a FROM c),
      pend AS (SELECT DISTINCT user_id FROM payments WHERE status = 'pending')
    SELECT p.payment_id, p.user_id, CAST(p.amount AS DOUBLE) AS amount,
      CASE WHEN p.status = 'pending' AND f.user_id IS NOT NULL THEN f.transaction_id ELSE p.transaction_id END AS transaction_id,
      CASE WHEN p.status = 'pending' AND f.user_id IS NOT NULL THEN 'success' ELSE p.status END AS status
    FROM payments p LEFT JOIN f ON f.user_id = p.user_id AND f.a = 1
    UNION ALL SELECT CAST(-1 AS BIGINT), user_id, CAST(round(amount_total / 100.0, 2) AS DOUBLE), transaction_id, 'success'
    FROM f WHERE NOT (a = 1 AND user_id IN (SELECT user_id FROM pend))""",
)
def stream_checkout_events(t):
    bought = _events(t).filter("event_type = 'purchase'")
    events = bought.select(
        "event_id", "user_id", (F.col("event_id") % 3 + 1).alias("tier"),
        F.concat(F.lit("pi-"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.floor(F.col("value").cast("double") * 100).alias("amount_total"),
        F.col("ts").alias("event_time"),
    )
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    _, payments = stream.apply_checkouts(twice, t.users, t.payments, t.work_folder())
    return payments.select(
        F.coalesce("payment_id", F.lit(-1).cast("bigint")).alias("payment_id"), "user_id",
        F.col("amount").cast("double").alias("amount"), "transaction_id", "status",
    )
