"""Usage analytics: search log, quotas, dashboards, saved jobs, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text
from jobweave.functions.skew import join_unique, top_k


def saved_rows(users: DataFrame) -> DataFrame:
    """(user_id, id) per entry of each user's saved list (JSON array of id texts), unreadable entries left out."""
    ids = F.from_json("saved_jobs", "array<string>")
    rows = users.select("user_id", F.explode(ids).alias("saved"))
    return rows.select("user_id", F.expr("try_cast(saved AS bigint)").alias("id")).filter("id IS NOT NULL").distinct()


def saved_jobs(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active saved jobs of each user, with the number of them."""
    wanted = [
        "id", "job_title", "organisation_name", "location", "org_location", "salary", "remote_type",
        "experience_level", "job_link", "company_url", "dateposted", "job_source",
    ]
    active = jobs.filter("is_active = 1").select(*[c for c in wanted if c in jobs.columns])
    rows = join_unique(saved_rows(users), active, ["id"])
    # The rows of a user come out of one cell, so the group is no larger than that.
    return rows.withColumn("saved_count", F.count("*").over(W.partitionBy("user_id")))


def apply_saves(users: DataFrame, events: DataFrame) -> DataFrame:
    """Saved pairs after add and remove events (user_id, job_id, action, event_time, event_id), one row per (user, job).

    The last event of a pair decides, so repeats change nothing.  The set stays as rows: one user may save without
    bound.
    """
    before = saved_rows(users).select("user_id", F.col("id").alias("job_id"), F.lit(True).alias("was_saved"))
    last = events.groupBy("user_id", "job_id").agg(F.max_by("action", F.struct("event_time", "event_id")).alias("action"))
    both = before.join(last, ["user_id", "job_id"], "full")
    keep = F.when(F.col("action").isNotNull(), F.col("action") == "add").otherwise(F.col("was_saved"))
    return both.filter(keep).select("user_id", "job_id")


def dashboard(users: DataFrame, usage: DataFrame) -> DataFrame:
    """Per user: logged rows, applications, saved jobs."""
    per_user = usage.groupBy("user_id").agg(
        F.count("*").alias("total_searches"), F.count("companies_applied").alias("total_applications")
    )
    size = F.coalesce(F.size(F.from_json("saved_jobs", "array<string>")), F.lit(0))
    people = users.select("user_id", F.greatest(size, F.lit(0)).cast("bigint").alias("saved_jobs"))
    joined = people.join(per_user, "user_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_searches", "total_applications")})


def daily_searches(usage: DataFrame, as_of: str) -> DataFrame:
    """Logged rows per user since the start of the day."""
    day = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    return usage.filter(F.col("date") >= day).groupBy("user_id").agg(F.count("*").alias("search_count"))


def quota_columns(count: Column, tier: Column, limit: int = fx.DAILY_SEARCHES) -> dict[str, Column]:
    paid = tier >= 1
    return {
        "limit": F.when(paid, -1).otherwise(limit),
        "remaining": F.when(paid, F.lit(-1).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), limit - count)),
        "is_premium": paid,
        "at_limit": ~paid & (count >= limit),
    }


def search_log(requests: DataFrame, at: Column) -> DataFrame:
    """Usage rows that a table of listing requests leaves: (user_id, search_keywords, filters_applied, date).

    A request without a user (null or 0) or with a blank text leaves none; filters are a JSON text in key order, null if none
    are given.  Repeated requests are logged as often as they come.
    """
    given = F.map_filter("filters", lambda k, v: text.strip(v) != "")
    in_order = F.map_from_entries(F.array_sort(F.map_entries(given)))
    typed = text.strip(text.value_or_blank(F.col("query")))
    return requests.filter((F.col("user_id") != 0) & (typed != "")).select(
        "user_id",
        typed.alias("search_keywords"),
        F.when(F.size(given) > 0, F.to_json(in_order)).alias("filters_applied"),
        at.alias("date"),
    )


def user_quota(users: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """Per user: today's count, limit, remaining searches; every paid tier is unlimited."""
    counts = daily_searches(usage, as_of)
    joined = users.select("user_id", "membership_status").join(counts, "user_id", "left")
    joined = joined.withColumn("search_count", F.coalesce("search_count", F.lit(0)))
    tier = F.coalesce("membership_status", F.lit(0))
    return joined.withColumns(quota_columns(F.col("search_count"), tier)).drop("membership_status")


def recent_activity(usage: DataFrame, limit: int = 50) -> DataFrame:
    """Latest rows of each user, JSON columns read; a company that is no JSON array counts as a list of one."""
    latest = top_k(
        usage, ["user_id"], [F.desc_nulls_last("date"), F.desc("usage_id")], limit, F.col("usage_id"), rank="recency"
    )
    raw = F.col("companies_applied")
    listed = F.from_json(raw, "array<string>")
    return latest.withColumns(
        {
            "filters_applied": F.coalesce(
                F.from_json("filters_applied", "map<string,string>"), F.create_map().cast("map<string,string>")
            ),
            "companies_applied": F.when(raw.startswith("["), listed)
            .when(raw != "", F.array(raw))
            .otherwise(F.array().cast("array<string>")),
        }
    )


def site_stats(
    jobs: DataFrame, users: DataFrame, active_companies: bool = False, approximate: bool = False
) -> DataFrame:
    """One row of counters, one pass per table.  Companies count over all jobs unless `active_companies`."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    company = F.when(F.col("is_active") == 1, F.col("organisation_name")) if active_companies else F.col("organisation_name")
    members = users.agg(F.count("*").alias("n")).scalar()
    return jobs.agg(
        F.count_if(F.col("is_active") == 1).alias("total_jobs"),
        distinct(company).alias("total_companies"),
    ).withColumns({"total_domains": F.col("total_companies"), "total_members": members})


def engine_share(searches: DataFrame) -> DataFrame:
    """Rows and percent per search engine."""
    counts = searches.groupBy("search_engine").agg(F.count("*").alias("searches"))
    total = counts.agg(F.sum("searches").alias("total")).scalar()
    return counts.withColumn("percent", F.round(F.col("searches") * 100.0 / total, 6))


def link_stats(org_links: DataFrame, slots: int = 5) -> DataFrame:
    """One row: organisations, links in all and on average, organisations with none and with a full set."""
    found = F.col("links_found")
    return org_links.agg(
        F.count("*").alias("organisations"),
        F.coalesce(F.sum(found), F.lit(0)).cast("bigint").alias("total_links"),
        F.round(F.avg(found), 6).alias("avg_links"),
        F.count_if(found == 0).alias("without_links"),
        F.count_if(found >= slots).alias("with_all_links"),
    )


def description_outcome(status: Column) -> Column:
    return (
        F.when(status == "success", "success")
        .when(status == "expired", "expired")
        .when(status.contains("blocked"), "blocked")
        .otherwise("other")
    )


def fetch_status(code: Column) -> Column:
    """Outcome text of a description fetch by HTTP status."""
    return (
        F.when(code == 200, "success")
        .when(code.isin(404, 410), "expired")
        .when(code.isin(403, 503), "blocked_by_bot_protection")
        .otherwise(F.concat(F.lit("http_error_"), code.cast("string")))
    )


def description_outcomes(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy(description_outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("fetches"))


def missing_descriptions(jobs: DataFrame) -> DataFrame:
    missing = F.col("job_description").isNull() | (F.col("job_description") == "")
    return jobs.agg(
        F.count_if((F.col("is_active") == 1) & missing).alias("missing"),
        F.count_if(F.col("is_active") == 1).alias("active"),
    )
