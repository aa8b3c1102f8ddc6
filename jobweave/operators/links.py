"""Candidate links of organisations, and the crawl over stored links."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text, urls
from jobweave.functions.skew import hot_keys, join_unique, number_rows, top_k
from jobweave.operators import filters
from jobweave.sources import workdir

LINK_SLOTS = 5


def wide_to_long(org_links: DataFrame, slots: int = LINK_SLOTS) -> DataFrame:
    """link_1..n columns to one row per usable link; blank, null and `nan` links drop out."""
    links = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                F.trim(f"link_{i}_url").alias("url"),
                text.value_or_blank(F.trim(f"link_{i}_title")).alias("title"),
            )
            for i in range(1, slots + 1)
        ]
    )
    keep = [c for c in org_links.columns if not c.startswith("link_")]
    usable = F.filter(links, lambda x: x["url"].isNotNull() & ~F.lower(x["url"]).isin("", "nan"))
    return org_links.select(*keep, F.inline(usable))


def long_to_wide(links: DataFrame, key: str = "organisation_name", slots: int = LINK_SLOTS) -> DataFrame:
    """One row per link to link_1..n columns; empty slots are blank text.  Combined before the shuffle."""
    def slot(i: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("rank") == i, F.col(name))), F.lit("")).alias(f"link_{i}_{name}")

    columns = [slot(i, name) for i in range(1, slots + 1) for name in ("url", "title")]
    return links.groupBy(key).agg(*columns, F.count_if(F.col("rank") <= slots).alias("links_found"))


def top_links(
    links: DataFrame,
    domains: Iterable[str] = fx.BLOCKED_DOMAINS,
    keep: int = LINK_SLOTS,
    key: str = "organisation_name",
) -> DataFrame:
    """First usable links of each organisation in rank order, ranked anew."""
    usable = links.filter((F.col("url") != "") & ~filters.blocked_domain(F.col("url"), domains))
    return top_k(usable, [key], [F.col("rank"), F.col("url")], keep, F.col("url"), rank="slot")


def best_url(
    organisations: DataFrame,
    links: DataFrame,
    blacklist: Iterable[str] = fx.BLACKLIST_DOMAINS,
    key: str = "organisation_name",
) -> DataFrame:
    """Lowest ranked acceptable web link per organisation, else a REJECT row.

    The minimum is combined before the shuffle; afterwards the key is unique on both sides.
    """
    url = F.col("url")
    fine = ~text.any_of(urls.host(url), blacklist) & F.lower(url).startswith("http")
    best = links.filter(fine).groupBy(key).agg(F.min(F.struct("rank", "url")).alias("best"))
    joined = organisations.select(key).distinct().join(best, key, "left")
    return joined.select(key, *_validation(F.col("best.url"), F.col("best.rank")))


def _validation(url: Column, rank: Column) -> list[Column]:
    """Verdict of the rule on the best acceptable link of an organisation, null if it has none."""
    ok, words = url.isNotNull(), fx.LINK_VERDICTS
    before, after = words["passed"].split("{}")
    passed = F.concat(F.lit(before), rank.cast("string"), F.lit(after))
    return [
        ok.alias("is_valid"),
        url.alias("best_url"),
        F.when(ok, "ACCEPT").otherwise("REJECT").alias("decision"),
        F.when(ok, words["accepted"]).otherwise(words["missing"]).alias("category"),
        F.when(ok, passed).otherwise(words["failed"]).alias("reason"),
        F.when(ok, "Medium").otherwise("High").alias("confidence"),
    ]


def unique_links(links: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """First occurrence of each URL of an organisation, by the given order columns."""
    rest = [c for c in links.columns if c not in {key, "url", *order}]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return links.groupBy(key, "url").agg(first).select(key, "url", "first.*")


def titles_to_links(jobs: DataFrame, page_links: DataFrame) -> DataFrame:
    """Jobs without a link take the first link of their page whose text contains the title.

    `page_links` has one row per page with at most 50 job links, so each job looks into an array instead of meeting
    every link of the page as a row.
    """
    low = F.lower(F.col("job_title"))
    hit = F.filter("job_links", lambda x: F.lower(x["text"]).contains(low))
    missing = F.coalesce(F.col("job_link"), F.lit("")) == ""
    without = join_unique(jobs.filter(missing), page_links.select("page_id", "job_links"), ["page_id"], how="left")
    found = without.withColumn("job_link", F.try_element_at(hit, F.lit(1))["url"]).drop("job_links")
    return jobs.filter(~missing).unionByName(found)


def org_status(pages: DataFrame, key: str) -> DataFrame:
    """Per organisation: any job, else any form, else nothing."""
    seen = pages.groupBy(key).agg(
        F.max(F.col("has_job").cast("int")).alias("job"),
        F.max((F.col("has_form") | F.col("has_application_form")).cast("int")).alias("form"),
    )
    some = (F.col("job") == 1) | (F.col("form") == 1)
    return seen.select(
        key,
        F.when(F.col("job") == 1, "Job Openings")
        .when(F.col("form") == 1, "Only Form")
        .otherwise("No Jobs and No Form")
        .alias("application_type"),
        F.when(some, "Yes").otherwise("Yes (Validated) - No Data").alias("career_page_available"),
    )


def jobs_or_placeholder(organisations: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Every organisation with each of its jobs, or with one row without a job.

    Jobs meet their organisation by `join_unique`; organisations without jobs are found on distinct keys.
    """
    with_jobs = join_unique(jobs, organisations, [key]).withColumn("has_job", F.lit(1))
    empty = organisations.join(jobs.select(key).distinct(), key, "left_anti").withColumn("has_job", F.lit(0))
    rows = with_jobs.unionByName(empty, allowMissingColumns=True)
    return rows.withColumn("career_page_available", F.when(F.col("has_job") == 1, "Yes").otherwise("REJECT"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def crawl_frontier(
    starts: DataFrame,
    page_links: DataFrame,
    ats: Iterable[str] = fx.ATS_DOMAINS,
    max_depth: int | None = None,
    max_pages: int | None = None,
    links_per_page: int | None = None,
) -> DataFrame:
    """Breadth-first visit order over stored links: (org, url, depth, visit).

    `starts` is (org, url), `page_links` is (page_url, position, url).  One join per level, until a level finds nothing new
    or `max_depth` levels are done; `max_pages` bounds the pages of an organisation, `links_per_page` the links read of a
    page.  The links are written once, and each level before the next one is planned; levels are read back as one table.
    """
    links = page_links.select(F.col("page_url").alias("from_url"), "position", F.col("url").alias("to_url"))
    if links_per_page is not None:
        links = links.filter(F.col("position") <= links_per_page)
    spark = starts.sparkSession
    folder = workdir.shared_folder(spark)
    links = workdir.stored(links, f"{folder}/links")
    base = urls.host(F.col("url"))
    first = starts.select("org", "url", base.alias("base"), F.lit(0).alias("depth"), F.lit(1).alias("visit"))
    level = workdir.stored(first, f"{folder}/level_0")
    paths = [f"{folder}/level_0"]

    def visited() -> DataFrame:
        # One scan: small files of many levels share a task, so the number of tasks follows the rows, not the levels.
        return spark.read.schema(level.schema).parquet(*paths)

    for depth in range(1, max_depth) if max_depth is not None else count(1):
        found = join_links(level, links)
        link_host = urls.host(F.col("to_url"))
        same = (link_host == F.col("base")) | F.endswith(link_host, F.concat(F.lit("."), F.col("base")))
        found = found.filter(same | text.any_of(link_host, ats))
        first_seen = (
            found.groupBy("org", "base", F.col("to_url").alias("url"))
            .agg(F.min(F.struct(F.col("visit").alias("v"), F.col("position").alias("p"))).alias("seen"))
        )
        new = first_seen.join(visited().select("org", "url").hint("merge"), ["org", "url"], "left_anti")
        so_far = visited().groupBy("org").agg(F.max("visit").alias("so_far"))
        if max_pages is None:
            ranked = number_rows(new, ["org"], ["seen", "url"], "n")
        else:
            ranked = top_k(new, ["org"], [F.col("seen"), F.col("url")], max_pages, F.col("url"), rank="n")
        next_level = ranked.join(so_far, "org").withColumn("visit", (F.col("so_far") + F.col("n")).cast("int"))
        if max_pages is not None:
            next_level = next_level.filter(F.col("visit") <= max_pages)
        path = f"{folder}/level_{depth}"
        level = workdir.stored(next_level.select("org", "url", "base", F.lit(depth).alias("depth"), "visit"), path)
        if max_depth is None and level.isEmpty():
            break
        paths.append(path)
    return visited().select("org", "url", "depth", "visit")


def join_links(level: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the pages of a level.

    Only links of pages that the level opens are shuffled with it.  A page that very many organisations open has its links
    copied for each piece of those organisations; other links are not copied.
    """
    level = level.withColumnRenamed("url", "from_url")
    opened = level.groupBy("from_url").agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(opened, ["from_url"]))
    pieces = F.coalesce("_pieces", F.lit(1))
    cut = level.join(hot, "from_url", "left").withColumn("_salt", F.pmod(F.xxhash64("org"), pieces).cast("int")).drop("_pieces")
    wanted = links.join(opened.select("from_url"), "from_url", "left_semi").join(hot, "from_url", "left")
    copies = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return cut.join(copies, ["from_url", "_salt"]).drop("_salt")
