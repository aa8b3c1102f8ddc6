"""Listings without a text query: browse, showcase, facets, paging, tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text
from jobweave.functions.skew import first_rows, is_small, salted_join, top_k
from jobweave.operators import filters as flt
from jobweave.sources import workdir


def sort_keys(sort_by: str = "relevance") -> list[Column]:
    """Total order of a browse: London, UK, then the mode's own keys, then id."""
    place = [F.desc_nulls_last("exists_in_london"), F.desc_nulls_last("exists_in_uk")]
    newest = F.desc_nulls_last("added_at")
    title = F.asc_nulls_first("job_title")
    viewed = F.desc_nulls_last("views_count")
    unpaid = F.when(F.col("salary") != "", 0).otherwise(1).asc()
    own = {
        "relevance": [F.desc_nulls_last("has_description"), newest, title, viewed, unpaid, F.desc("id")],
        "popular": [viewed, newest, F.asc("id")],
        "company": [F.asc_nulls_first("organisation_name"), newest, F.asc("id")],
    }
    return place + own.get(sort_by, [newest, title, F.asc("id")])


def quality_score(as_of: str) -> Column:
    """Recency, description, salary, views and remote work; unreadable dates add nothing."""
    posted = F.try_to_timestamp(F.col("dateposted"))
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(posted)) / 86400)
    zero = F.lit(0.0)
    recency = F.when(days < 7, 0.3).when(days < 30, 0.2).when(days < 60, 0.1).otherwise(zero)
    described = F.when(F.length("job_description") > 100, 0.2).otherwise(zero)
    paid = F.when(~F.col("salary").isin("Not Specified", ""), 0.15).otherwise(zero)
    views = F.coalesce(F.col("views_count"), F.lit(0))
    seen = F.when(views > 0, F.least(F.lit(0.15), views / 1000)).otherwise(zero)
    away = F.when(F.col("remote_type").isin("Remote", "Hybrid"), 0.1).otherwise(zero)
    return recency + described + paid + seen + away


def open_jobs(jobs: DataFrame) -> DataFrame:
    """What a browse may show: active, with a link, no course."""
    return flt.without_courses(flt.with_link(jobs))


def browse(
    jobs: DataFrame,
    as_of: str,
    filters: Mapping[str, str] | None = None,
    sort_by: str = "relevance",
    limit: int = 100,
    scope: str = "all",
) -> DataFrame:
    """First `limit` open jobs that meet the filters.

    The location scope may be applied before the limit: the order leads with the very flags it tests.
    """
    found = flt.location_scope(flt.apply_filters(open_jobs(jobs), filters or {}), scope)
    top = found.orderBy(*sort_keys(sort_by)).limit(limit)
    return top.withColumns({"hybrid_score": F.lit(1.0), "quality_score": quality_score(as_of)})


def grams(col: Column) -> Column:
    """Distinct two-character pieces of a lower-cased text."""
    low = F.lower(col)
    last = F.length(low) - 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(low, i, F.lit(2)))
    return F.array_distinct(F.when(last >= 1, pieces).otherwise(F.array().cast("array<string>")))


def containing(patterns: DataFrame, values: DataFrame, salts: int = 16) -> DataFrame:
    """(kind, pattern, value) where a value of the kind holds the pattern, whatever the case.

    Patterns are of 2 characters or more.  An equi-join on the pattern's rarest two-character piece, then the exact
    test, instead of comparing every pattern with every value.  Both inputs are distinct; a piece that many values share
    is cut by value.
    """
    keys = ["kind", "gram"]
    indexed = values.select("kind", "value", F.explode(grams(F.col("value"))).alias("gram"))
    sizes = indexed.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = patterns.filter(F.length("pattern") >= 2).select(
        "kind", "pattern", F.explode(grams(F.col("pattern"))).alias("gram")
    )
    rarest = (
        wanted.join(sizes, keys)
        .groupBy("kind", "pattern")
        .agg(F.count("*").alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        .filter(F.col("known") == F.size(grams(F.col("pattern"))))
        .drop("known")
    )
    pairs = salted_join(indexed, rarest, keys, F.col("value"), salts)
    return pairs.filter(F.lower("value").contains(F.lower("pattern"))).select("kind", "pattern", "value")


def suggest(queries: DataFrame, jobs: DataFrame, column: str, limit: int = 8) -> DataFrame:
    """Up to `limit` distinct titles (or locations) of active jobs that hold the query, per query of >= 2 characters."""
    typed = queries.select("query_id", text.strip(F.col("query")).alias("pattern")).filter(F.length("pattern") >= 2)
    values = jobs.filter("is_active = 1").select(F.col(column).alias("value")).dropna().distinct()
    kind = F.lit(column).alias("kind")
    pairs = containing(typed.select(kind, "pattern").distinct(), values.select(kind, "value")).drop("kind")
    best = top_k(pairs, ["pattern"], [F.asc("value")], limit, F.col("value"))
    return salted_join(typed, best, ["pattern"], F.col("query_id")).select("query_id", F.col("pattern").alias("query"), "value", "rank")


def sorted_filters(filters: Column) -> Column:
    """Filter map without blank entries, in key order, so that equal requests look equal."""
    given = F.map_filter(F.coalesce(filters, F.create_map().cast("map<string,string>")), lambda k, v: v != "")
    return F.map_from_entries(F.array_sort(F.map_entries(given)))


ANCHORS = (*flt.EXACT_FILTERS, *flt.SUBSTRING_FILTERS)


def browse_requests(requests: DataFrame, jobs: DataFrame, sort_by: str = "relevance") -> DataFrame:
    """Browse for a whole table of requests (query_id, filters, fetch): the first `fetch` jobs of each with their rank.

    `sort_by` is the order of all of them, as in `browse`.

    Equal filter maps are answered once.  Each filter map meets the jobs by one equality, its anchor: an exact filter,
    the location values that hold the wanted text, a search category, or, for none of these, the table as a whole; the
    other filters are tested on the joined rows.
    """
    asked = requests.select("query_id", "fetch", F.to_json(sorted_filters(F.col("filters"))).alias("shape"))
    shapes = asked.groupBy("shape").agg(F.max("fetch").alias("fetch"))
    shapes = shapes.withColumn("filters", F.from_json("shape", "map<string,string>"))

    category = text.strip(F.coalesce(F.try_element_at("filters", F.lit("category")), F.lit("")))
    by_category = category.isin(*fx.SEARCH_CATEGORIES)
    kind = F.coalesce(
        *[F.when(F.map_contains_key("filters", F.lit(c)), F.lit(c)) for c in ANCHORS],
        F.when(by_category, F.lit("category")),
        F.lit("all"),
    )
    wanted = F.when(F.col("kind") == "category", category).otherwise(
        F.coalesce(F.try_element_at("filters", F.col("kind")), F.lit(""))
    )
    shapes = shapes.withColumn("kind", kind).withColumn("wanted", wanted)

    fuzzy = F.col("kind").isin(*flt.SUBSTRING_FILTERS) & (F.length("wanted") >= 2)
    exact = shapes.filter(~fuzzy)
    # A one-character substring has no two-character piece; it falls back to the whole table and the row test.
    lone = F.col("kind").isin(*flt.SUBSTRING_FILTERS)
    exact = exact.withColumns(
        {"wanted": F.when(lone, "").otherwise(F.col("wanted")), "kind": F.when(lone, "all").otherwise(F.col("kind"))}
    )
    shown = open_jobs(jobs)
    texts = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in flt.SUBSTRING_FILTERS])
    # Values of all jobs will do: what may be shown is decided where the jobs are joined.
    values = jobs.select(F.inline(texts)).dropna().distinct()
    asked_texts = shapes.filter(fuzzy).select("shape", "kind", F.col("wanted").alias("pattern"))
    pairs = containing(asked_texts.select("kind", "pattern").distinct(), values)
    resolved = asked_texts.join(pairs, ["kind", "pattern"]).select("shape", "kind", "value")
    anchors = exact.select("shape", "kind", F.col("wanted").alias("value")).unionByName(resolved)
    anchors = workdir.cut(anchors.join(flt.with_wanted(shapes).select("shape", "fetch", *flt.WANTED), "shape"))

    own = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ANCHORS]
    own.append(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")))
    listed = F.split(F.trim(F.col("cats"), F.lit(",")), ",")
    tagged = shown.withColumn("low", F.lower("job_title")).withColumn("cats", flt.category_list(F.col("low")))
    of_category = F.transform(listed, lambda c: F.struct(F.lit("category").alias("kind"), c.alias("value")))
    narrow = tagged.select(
        "id", "exists_in_london", "exists_in_uk", "has_description", "added_at", "job_title", "views_count", "salary",
        *ANCHORS, "cats", F.explode(F.concat(F.array(*own), of_category)).alias("anchor"),
    ).select("*", "anchor.kind", "anchor.value").drop("anchor")
    # The anchor `all` is on every job, so the shuffled form needs its keys cut.
    if is_small(anchors):
        met = narrow.join(F.broadcast(anchors), ["kind", "value"])
    else:
        met = salted_join(narrow, anchors, ["kind", "value"], F.col("id"), salts=64)
    met = met.filter(flt.row_meets_request())
    most = requests.agg(F.max("fetch")).first()[0] or 0
    ranked = top_k(met, ["shape"], sort_keys(sort_by), int(most), F.col("id"))
    answers = ranked.filter(F.col("rank") <= F.col("fetch")).select("shape", "id", "rank")
    hits = salted_join(asked.select("query_id", "shape", "fetch"), answers, ["shape"], F.col("query_id"))
    return hits.filter(F.col("rank") <= F.col("fetch")).select("query_id", "id", "rank", F.lit(1.0).alias("hybrid_score"))


def featured(jobs: DataFrame, limit: int = 6) -> DataFrame:
    """Showcase: per title the newest, most viewed, lowest-id job; then newest, most viewed first.

    The best row per title is a map-side minimum, so a title on a third of all rows costs no more than another.
    """
    pool = flt.featured_places(jobs)
    order = [F.desc_nulls_last("dateposted"), F.desc_nulls_last("views_count"), F.asc("id")]
    sort_value = F.struct(
        F.coalesce(F.col("dateposted"), F.lit("")).alias("d"),
        F.coalesce(F.col("views_count"), F.lit(-1)).alias("v"),
        (-F.col("id")).alias("i"),
    )
    best = pool.groupBy("job_title").agg(F.max(F.struct(sort_value.alias("o"), *_shown(pool))).alias("b"))
    return best.select("job_title", "b.*").drop("o").orderBy(*order).limit(limit)


def _shown(pool: DataFrame) -> list[str]:
    wanted = (
        "id", "organisation_name", "location", "org_location", "salary", "remote_type", "experience_level", "job_link",
        "company_url", "dateposted", "views_count", "exists_in_uk",
    )
    return [c for c in wanted if c in pool.columns]


FACETS = ("location", "org_location", "remote_type", "experience_level", "job_source", "organisation_name")


def facets(jobs: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """Distinct values of the filter columns over active jobs, one row per value."""
    active = jobs.filter("is_active = 1").select(*columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return active.select(F.inline(pairs)).filter("value IS NOT NULL").distinct().orderBy("facet", "value")


def top_categories(jobs: DataFrame, limit: int = 8) -> DataFrame:
    active = jobs.filter("is_active = 1 AND job_category_id IS NOT NULL")
    counts = active.groupBy("job_category_id").agg(F.count("*").alias("jobs"))
    return counts.orderBy(F.desc("jobs"), "job_category_id").limit(limit)


def with_category_names(counts: DataFrame) -> DataFrame:
    """Names from an 11-entry table; unknown ids are Other."""
    names = F.create_map(*[F.lit(x) for pair in fx.CATEGORY_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, F.col("job_category_id").cast("int")), F.lit(fx.CATEGORY_NAMES[fx.OTHER_CATEGORY]))
    return counts.withColumn("name", name)


def related(jobs: DataFrame, take: int = 3) -> DataFrame:
    """Per active job, the listing's first `take` jobs of its search category without the job itself.

    The category's best jobs are ranked once (17 lists at most, so the broadcast is bounded by 18 * take rows); no two
    jobs of a category are paired otherwise.
    """
    shown = open_jobs(jobs).withColumn("low", F.lower("job_title"))
    shown = shown.withColumn("_cats", F.array_append(flt.categories_of(F.col("low")), F.lit("*")))
    lists = top_k(
        shown.withColumn("list", F.explode("_cats")), ["list"], sort_keys("relevance"), take, F.col("id"), rank="place"
    ).select("list", F.col("id").alias("related_id"), "place")
    own = F.col("job_category_id").cast("string")
    key = F.when(own.isin(*fx.SEARCH_CATEGORIES), own).otherwise("*")
    seekers = jobs.filter("is_active = 1").select("id", key.alias("list"))
    pairs = seekers.join(F.broadcast(lists), "list").filter(F.col("related_id") != F.col("id"))
    return pairs.select("id", F.col("list").alias("category"), "related_id", "place")


def _tier_value(tier: Column, table: Mapping[int, int], default: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, tier.cast("int")), F.lit(default))


def tier_fetch(tier: Column) -> Column:
    """Rows a tier may fetch: 200, 1000, and 3000 from tier 2 on."""
    return F.when(tier >= 2, 3000).otherwise(_tier_value(tier, fx.TIER_FETCH, 200))


def tier_cap(tier: Column) -> Column:
    return _tier_value(tier, fx.TIER_CAP, fx.FREE_CAP)


def tier_listing(tiers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per membership tier (`tier`, one row each) the browse rows it may see: fetch limit, then cap."""
    best = first_rows(open_jobs(jobs), sort_keys("relevance"), max(fx.TIER_FETCH.values())).select("id", "rank")
    shown = F.least(tier_fetch(F.col("tier")), tier_cap(F.col("tier")))
    places = tiers.withColumn("rank", F.explode(F.sequence(F.lit(1).cast("bigint"), shown.cast("bigint"))))
    return places.join(best, "rank").select("tier", "rank", "id")


def page_slice(ranked: DataFrame, keys: list[str], page: Column, size: Column) -> DataFrame:
    """Rows of one page of each ranked list, with the list's total and number of pages."""
    totals = ranked.groupBy(*keys).agg(F.count("*").alias("total"))
    first = (page - 1) * size
    rows = ranked.filter((F.col("rank") > first) & (F.col("rank") <= first + size))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    return rows.join(totals, keys).withColumn("total_pages", pages)


def page_window(lists: DataFrame, width: int = 10) -> DataFrame:
    """Page numbers shown around the current page: up to `width`, none for a single page."""
    first = F.greatest(F.lit(1), F.col("page") - 4)
    last = F.least(F.col("total_pages"), first + width - 1)
    first = F.when(last - first < width - 1, F.greatest(F.lit(1), last - width + 1)).otherwise(first)
    shown = lists.filter("total_pages > 1")
    return shown.withColumn("page_number", F.explode(F.sequence(first, last)))


def teaser_rows(pages: DataFrame, free_cap: int = fx.FREE_CAP, keep: Sequence[str] = ()) -> DataFrame:
    """Placeholder rows of the first page of a free request: min(size - shown, total - 3) of them.

    `pages` is (query_id, tier, page, size, shown, total), `total` before the cap; `keep` names further columns to
    carry along.
    """
    need = F.least(F.col("size") - F.col("shown"), F.col("total") - free_cap)
    due = pages.filter((F.col("tier") == 0) & (F.col("page") == 1) & (F.col("total") > free_cap) & (need > 0))
    number = F.explode(F.sequence(F.lit(0), (need - 1).cast("int")))
    return due.select("query_id", *keep, number.alias("n")).select(
        "query_id",
        *keep,
        F.concat(F.lit("dummy-"), F.col("n").cast("string")).alias("id"),
        F.lit("Premium Job Listing").alias("job_title"),
        F.lit("Unlock to View").alias("organisation_name"),
        F.lit("Hidden").alias("location"),
        F.lit(True).alias("is_blurred"),
    )
