"""Data quality: liveness verdicts, health updates, duplicates, enrichment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text, urls
from jobweave.functions.skew import hot_keys, join_unique


def expired_reason(low: Column, phrases: Iterable[str] = fx.EXPIRED_PHRASES) -> Column:
    """First sign, in the given order, that the vacancy has closed; null if none.  Scans the whole lower-case body."""
    closed = F.lit(False)
    for flag in fx.POSTING_CLOSED_FLAGS:
        closed = closed | low.contains(flag)
    marks = [
        F.when(low.contains(fx.SESSION_EXPIRED), F.lit("expired_on_page: session expired")),
        F.when(closed, F.lit("expired_on_page: postingAvailable is false")),
    ]
    marks += [F.when(low.contains(p), F.lit(f'expired_on_page: "{p}"')) for p in phrases]
    return F.coalesce(*marks)


def _error_reason(error: Column, get_phase: Column) -> Column:
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, reason in fx.TRANSPORT_ERRORS.items():
        late = "timeout_get" if reason == "timeout" else reason
        out = out.when(error == name, F.when(get_phase, late).otherwise(reason))
    prefix = F.when(get_phase, "get_error: ").otherwise("head_error: ")
    return out.otherwise(F.concat(prefix, F.substring(error, 1, 80)))


def verdicts(fetch_log: DataFrame) -> DataFrame:
    """(job_id, is_alive, reason) per fetch-log row; the first rule that applies decides.

    A transport error counts for the HEAD request while `head_status` is null, else for the GET request.
    """
    link, head, get = F.col("job_link"), F.col("head_status"), F.col("get_status")
    stripped = F.col("stripped")
    head_error = F.col("error").isNotNull() & head.isNull()

    def http(code: Column) -> Column:
        return F.concat(F.lit("http_"), code.cast("string"))

    def lost(final: str) -> Column:
        moved = (F.col(final) != "") & (F.col(final) != link)
        return moved & urls.redirect_is_generic(link, F.col(final))

    reason = (
        F.when(link.isNull() | ~link.startswith("http"), "null_or_invalid_link")
        .when(head_error, _error_reason(F.col("error"), F.lit(False)))
        .when(head.isin(*fx.DEAD_STATUS), http(head))
        .when(~head.isin(*fx.HEAD_UNSUPPORTED) & lost("head_final_url"), "redirect_to_generic_page")
        .when(F.col("error").isNotNull(), _error_reason(F.col("error"), F.lit(True)))
        .when(get.isin(*fx.DEAD_STATUS) | (get != 200), http(get))
        .when(lost("final_url"), "redirect_to_generic_page")
        .when(stripped < fx.MIN_BODY_CHARS, F.concat(F.lit("tiny_page ("), stripped.cast("string"), F.lit(" chars)")))
        .otherwise(F.coalesce(expired_reason(F.col("low")), F.lit("alive")))
    )
    # Folding and trimming a body once, as columns, not once per rule.
    folded = fetch_log.withColumns({"low": F.lower("body"), "stripped": F.length(text.strip(F.col("body")))})
    judged = folded.select("job_id", reason.alias("reason"))
    return judged.select("job_id", (F.col("reason") == "alive").cast("int").alias("is_alive"), "reason")


def health_summary(judged: DataFrame) -> DataFrame:
    """Rows per reason, most frequent first, with alive and dead totals."""
    by_reason = judged.groupBy("reason").agg(
        F.count("*").alias("jobs"), F.sum("is_alive").cast("bigint").alias("alive")
    )
    return by_reason.withColumn("dead", F.col("jobs") - F.col("alive")).orderBy(F.col("jobs").desc(), "reason")


def apply_verdicts(jobs: DataFrame, judged: DataFrame, checked_at: str, dry_run: bool = False) -> DataFrame:
    """New snapshot of the jobs table: dead jobs inactive with a reason, checked jobs stamped.

    Job ids are unique on both sides.
    """
    if dry_run:
        return jobs
    marks = judged.select(F.col("job_id").alias("id"), "is_alive", "reason")
    joined = jobs.join(marks, "id", "left")
    dead = F.coalesce(F.col("is_alive") == 0, F.lit(False))
    stamp = F.lit(checked_at).cast("timestamp_ntz")
    return joined.withColumns(
        {
            "is_active": F.when(dead, 0).otherwise(F.col("is_active")),
            "deactivation_reason": F.when(dead, F.col("reason")).otherwise(F.col("deactivation_reason")),
            "last_health_check": F.when(F.col("is_alive").isNotNull(), stamp).otherwise(F.col("last_health_check")),
        }
    ).drop("is_alive", "reason")


def active_split(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("is_active").agg(F.count("*").alias("jobs"))


DUPLICATE_KEY = ("title_key", "org_key")


def _keyed(jobs: DataFrame) -> DataFrame:
    """Normalised title and organisation; missing values are equal to each other."""
    return jobs.withColumns(
        {
            "title_key": F.lower(F.trim("job_title")),
            "org_key": F.lower(F.trim("organisation_name")),
        }
    )


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """One row per job of a group with more than one job: group key, size, kept id and this id.

    The group's list of ids stays as rows: a third of the table may be one group.  Counts and kept ids are combined
    before the shuffle, and hot groups are joined in pieces (`join_unique`).
    """
    missing = "\u0000"
    keyed = _keyed(jobs).select("id", *(F.coalesce(k, F.lit(missing)).alias(k) for k in DUPLICATE_KEY))
    groups = keyed.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("copies"), F.min("id").alias("kept_id"))
    hot = hot_keys(groups, DUPLICATE_KEY, "copies")
    rows = join_unique(keyed, groups.filter("copies > 1"), DUPLICATE_KEY, hot)
    return rows.withColumns({k: F.nullif(k, F.lit(missing)) for k in DUPLICATE_KEY})


def keep_first(jobs: DataFrame, active_only: bool = False) -> DataFrame:
    """Flag all but the lowest id of each (title, organisation) inactive, with a reason.

    Only the kept ids are computed per group (a map-side minimum); rows then meet them on the unique id, so a huge
    group is never gathered anywhere.
    """
    pool = jobs.filter("is_active = 1") if active_only else jobs
    kept = _keyed(pool).groupBy(*DUPLICATE_KEY).agg(F.min("id").alias("id")).select("id", F.lit(1).alias("_kept"))
    joined = jobs.join(kept, "id", "left")
    copy = F.col("_kept").isNull() & (F.col("is_active") == 1)
    had_reason = F.col("deactivation_reason") if "deactivation_reason" in jobs.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "deactivation_reason": F.when(copy, "duplicate").otherwise(had_reason),
            "is_active": F.when(F.col("_kept").isNull(), 0).otherwise(F.col("is_active")),
        }
    ).drop("_kept")


def enrich_ids(
    jobs: DataFrame,
    categories: Sequence[tuple[str, int]] = fx.ENRICH_CATEGORIES,
    types: Sequence[tuple[str, int]] = fx.ENRICH_TYPES,
) -> DataFrame:
    """Category and type id from the title: the first word of the ordered list that the title holds."""
    title = text.value_or_blank(F.col("job_title"))
    return jobs.withColumns(
        {
            "job_category_id": text.first_of(title, categories, fx.OTHER_CATEGORY),
            "job_type_id": text.first_of(title, types, fx.DEFAULT_JOB_TYPE),
        }
    )


def uk_location(
    location: Column, places: Iterable[str] = fx.UK_PLACES, word_boundary: bool = False
) -> Column:
    """Does the text name a UK place?  Substrings count, so `uk` also hits `Ukraine`, unless `word_boundary`."""
    if word_boundary:
        pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(places) + r")(?![\p{L}\p{N}])"
        return F.coalesce(F.lower(location).rlike(pattern), F.lit(False))
    return F.coalesce(text.any_of(location, places), F.lit(False))


def tag_location(
    jobs: DataFrame,
    uk_places: Iterable[str] = fx.UK_PLACES,
    london_places: Iterable[str] = fx.LONDON_PLACES,
) -> DataFrame:
    place = F.col("location")
    return jobs.withColumns(
        {
            "exists_in_uk": uk_location(place, uk_places).cast("int"),
            "exists_in_london": uk_location(place, london_places).cast("int"),
        }
    )


def uk_or_unstated(jobs: DataFrame, places: Iterable[str] = fx.UK_PLACES) -> DataFrame:
    """Keep jobs with no location or a UK one."""
    place = text.value_or_blank(F.col("location"))
    return jobs.filter((place == "") | uk_location(place, places))
