"""Joins, aggregations, windows, sorts, set operations and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import urls
from jobweave.functions.skew import first_rows, top_k
from jobweave.operators import billing, browse, links, liveness, usage
from jobweave.plans.fixtures import (
    DAY_AS_OF, duck, holds_any, host_sql, in_category_sql, in_list, path_sql, quoted, with_,
)
from jobweave.plans.registry import query
from jobweave.plans.source_queries import BLOCKED, P, PLACES, SAVED_SQL

OPEN_SQL = f"""is_active = 1 AND job_link <> '' AND NOT {holds_any('job_title', fx.COURSE_WORDS_BROWSE)}"""
ORDERS = {
    "relevance": """exists_in_london DESC, exists_in_uk DESC, has_description DESC, added_at DESC, job_title ASC,
      views_count DESC, CASE WHEN salary IS NOT NULL AND salary <> '' THEN 0 ELSE 1 END, id DESC""",
    "date": "exists_in_london DESC, exists_in_uk DESC, added_at DESC, job_title ASC, id ASC",
    "popular": "exists_in_london DESC, exists_in_uk DESC, views_count DESC, added_at DESC, id ASC",
    "company": "exists_in_london DESC, exists_in_uk DESC, organisation_name ASC, added_at DESC, id ASC",
}

# Joins --------------------------------------------------------------------------------------------------------------


@query(
    "join_saved_jobs",
    with_("jobs_part", "users") + f""", {SAVED_SQL}, r AS (SELECT s.user_id, j.id, j.job_title, j.salary
        FROM saved s JOIN jobs_part j ON j.id = s.id AND j.is_active = 1)
    SELECT r.*, count(*) OVER (PARTITION BY user_id) AS saved_count FROM r""",
)
def join_saved_jobs(t):
    return usage.saved_jobs(t.users, t.jobs_part).select("user_id", "id", "job_title", "salary", "saved_count")


NAMES_SQL = "CASE job_category_id " + " ".join(
    f"WHEN {k} THEN {quoted(v)}" for k, v in fx.CATEGORY_NAMES.items()
) + " ELSE 'Other' END"


@query(
    "join_category_dim",
    P + f""", c AS (SELECT CAST(id % 14 AS INTEGER) AS job_category_id, count(*) AS jobs FROM jobs_part WHERE is_active = 1 GROUP BY 1)
    SELECT job_category_id, jobs, {NAMES_SQL} AS name FROM c""",
)
def join_category_dim(t):
    jobs = t.jobs_part.withColumn("job_category_id", (F.col("id") % 14).cast("int"))
    return browse.with_category_names(browse.top_categories(jobs, limit=14))


@query(
    "join_org_jobs_or_placeholder",
    """SELECT s_suppkey AS org_id, s_name AS organisation_name, l_partkey AS job_id, CASE WHEN l_suppkey IS NULL THEN 0 ELSE 1 END AS has_job,
      CASE WHEN l_suppkey IS NULL THEN 'REJECT' ELSE 'Yes' END AS career_page_available
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_suppkey % 3 <> 0""",
)
def join_org_jobs_or_placeholder(t):
    orgs = t.supplier.select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("organisation_name"))
    jobs = t.lineitem.filter("l_returnflag = 'R' AND l_suppkey % 3 <> 0").select(
        F.col("l_suppkey").alias("org_id"), F.col("l_partkey").alias("job_id")
    )
    rows = links.jobs_or_placeholder(orgs, jobs, "org_id")
    return rows.select("org_id", "organisation_name", "job_id", "has_job", "career_page_available")


@query(
    "join_unprocessed",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN
      (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def join_unprocessed(t):
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return links.unprocessed(t.orders, done, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "join_location_tag",
    P + f""" SELECT id, location, CASE WHEN {holds_any('location', PLACES)} THEN 1 ELSE 0 END AS exists_in_uk,
      CASE WHEN {holds_any('location', ('nation_20',))} THEN 1 ELSE 0 END AS exists_in_london FROM jobs_part""",
)
def join_location_tag(t):
    tagged = liveness.tag_location(t.jobs_part, PLACES, ("nation_20",))
    return tagged.select("id", "location", "exists_in_uk", "exists_in_london")


DAY_SQL = f"""SELECT user_id, count(*) AS search_count FROM usage
    WHERE date >= date_trunc('day', TIMESTAMP '{DAY_AS_OF}') GROUP BY user_id"""


@query(
    "join_user_quota",
    with_("users", "usage") + f""", d AS ({DAY_SQL}), q AS (SELECT u.user_id, membership_status >= 1 AS is_premium,
        coalesce(search_count, 0) AS search_count FROM users u LEFT JOIN d ON d.user_id = u.user_id)
    SELECT user_id, search_count, CASE WHEN is_premium THEN -1 ELSE 10 END AS "limit",
      CASE WHEN is_premium THEN -1 ELSE greatest(0, 10 - search_count) END AS remaining, is_premium,
      NOT is_premium AND search_count >= 10 AS at_limit FROM q""",
)
def join_user_quota(t):
    return usage.user_quota(t.users, t.usage, DAY_AS_OF)


@query(
    "join_related",
    P + f""", o AS (SELECT * FROM jobs_part WHERE {OPEN_SQL}), k AS (
      SELECT '*' AS list, * FROM o """ + " ".join(
        f"UNION ALL SELECT '{c}', * FROM o WHERE {in_category_sql(c)}" for c in fx.SEARCH_CATEGORIES
    ) + f"""), r AS (SELECT list, id AS related_id, row_number() OVER (PARTITION BY list ORDER BY {ORDERS['relevance']}) AS place FROM k),
      s AS (SELECT id, CASE WHEN CAST(job_category_id AS VARCHAR) IN {in_list(fx.SEARCH_CATEGORIES)}
        THEN CAST(job_category_id AS VARCHAR) ELSE '*' END AS category FROM jobs_part WHERE is_active = 1)
    SELECT s.id, s.category, r.related_id, r.place FROM s JOIN r ON r.list = s.category AND r.place <= 3 AND r.related_id <> s.id""",
)
def join_related(t):
    return browse.related(t.jobs_part)


CHECKOUT_SQL = with_("users", "payments", "checkouts") + """,
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS a,
      row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS z FROM checkouts),
  pend AS (SELECT DISTINCT user_id FROM payments WHERE status = 'pending')"""


@query(
    "join_checkout_merge",
    CHECKOUT_SQL + """
    SELECT p.payment_id, p.user_id, CAST(p.amount AS DOUBLE) AS amount,
      CASE WHEN p.status = 'pending' AND f.user_id IS NOT NULL THEN f.transaction_id ELSE p.transaction_id END AS transaction_id,
      CASE WHEN p.status = 'pending' AND f.user_id IS NOT NULL THEN 'success' ELSE p.status END AS status
    FROM payments p LEFT JOIN f ON f.user_id = p.user_id AND f.a = 1
    UNION ALL SELECT CAST(-1 AS BIGINT), f.user_id, CAST(round(amount_total / 100.0, 2) AS DOUBLE), transaction_id, 'success'
    FROM f WHERE NOT (a = 1 AND user_id IN (SELECT user_id FROM pend))""",
)
def join_checkout_merge(t):
    _, payments = billing.apply_checkouts(t.users, t.payments, t.checkouts)
    return payments.select(
        F.coalesce("payment_id", F.lit(-1).cast("bigint")).alias("payment_id"), "user_id",
        F.col("amount").cast("double").alias("amount"), "transaction_id", "status",
    )


@query(
    "join_checkout_members",
    CHECKOUT_SQL + """ SELECT u.user_id, coalesce(f.tier, u.membership_status) AS membership_status
    FROM users u LEFT JOIN f ON f.user_id = u.user_id AND f.z = 1""",
)
def join_checkout_members(t):
    users, _ = billing.apply_checkouts(t.users, t.payments, t.checkouts)
    return users.select("user_id", "membership_status")


# Aggregations -------------------------------------------------------------------------------------------------------


@query(
    "agg_duplicate_groups",
    P + """ SELECT id, title_key, org_key, copies, kept_id FROM (SELECT id, lower(trim(job_title)) AS title_key,
        lower(trim(organisation_name)) AS org_key, count(*) OVER w AS copies, min(id) OVER w AS kept_id FROM jobs_part
        WINDOW w AS (PARTITION BY lower(trim(job_title)), lower(trim(organisation_name)))) x WHERE copies > 1""",
)
def agg_duplicate_groups(t):
    return liveness.duplicate_groups(t.jobs_part).select("id", "title_key", "org_key", "copies", "kept_id")


@query(
    "agg_top_categories",
    P + """ SELECT job_category_id, count(*) AS jobs FROM jobs_part WHERE is_active = 1 AND job_category_id IS NOT NULL
      GROUP BY 1 ORDER BY jobs DESC, job_category_id LIMIT 8""",
)
def agg_top_categories(t):
    return browse.top_categories(t.jobs_part)


@query(
    "agg_site_stats",
    P + """ SELECT count(*) FILTER (WHERE is_active = 1) AS total_jobs, count(DISTINCT organisation_name) AS total_companies,
      count(DISTINCT organisation_name) AS total_domains, (SELECT count(*) FROM customer) AS total_members FROM jobs_part""",
)
def agg_site_stats(t):
    return usage.site_stats(t.jobs_part, t.users)


@query(
    "agg_dashboard",
    with_("users", "usage") + """ SELECT u.user_id, CAST(len(regexp_extract_all(u.saved_jobs, '"[^"]*"')) AS BIGINT) AS saved_jobs,
      count(g.usage_id) AS total_searches, count(g.companies_applied) AS total_applications
    FROM users u LEFT JOIN usage g ON g.user_id = u.user_id GROUP BY u.user_id, u.saved_jobs""",
)
def agg_dashboard(t):
    return usage.dashboard(t.users, t.usage)


@query("agg_daily_searches", with_("usage") + " " + DAY_SQL)
def agg_daily_searches(t):
    return usage.daily_searches(t.usage, DAY_AS_OF)


@query(
    "agg_facets",
    P + " " + " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM jobs_part WHERE is_active = 1 AND {c} IS NOT NULL"
        for c in browse.FACETS
    ),
)
def agg_facets(t):
    return browse.facets(t.jobs_part)


@query(
    "agg_featured",
    P + """, r AS (SELECT *, row_number() OVER (PARTITION BY job_title ORDER BY dateposted DESC, views_count DESC, id) AS n
        FROM (SELECT * REPLACE (location || ', UK' AS location) FROM jobs_part) WHERE is_active = 1 AND exists_in_uk = 1)
    SELECT id, job_title, organisation_name, location, dateposted, views_count FROM r WHERE n = 1
    ORDER BY dateposted DESC, views_count DESC, id LIMIT 6""",
)
def agg_featured(t):
    jobs = t.jobs_part.withColumn("location", F.concat("location", F.lit(", UK")))
    return browse.featured(jobs).select("id", "job_title", "organisation_name", "location", "dateposted", "views_count")


def _verdict_sql() -> str:
    body = "lower(body)"
    expired = "CASE WHEN contains(" + body + ", 'session expired') THEN 'expired_on_page: session expired' WHEN " + " OR ".join(
        f"contains({body}, {quoted(f)})" for f in fx.POSTING_CLOSED_FLAGS
    ) + " THEN 'expired_on_page: postingAvailable is false' " + " ".join(
        f"WHEN contains({body}, {quoted(p)}) THEN {quoted(f'expired_on_page: {chr(34)}{p}{chr(34)}')}" for p in fx.EXPIRED_PHRASES
    ) + " END"

    def depth(col):
        return f"len(list_filter(string_split({path_sql(col)}, '/'), lambda x: x <> ''))"

    def generic(col):
        landing = f"lower(rtrim({path_sql(col)}, '/'))"
        return (
            f"({col} <> job_link AND ({host_sql(col)} <> {host_sql('job_link')} OR {depth(col)} < {depth('job_link')} - 1"
            f" OR {landing} IN {in_list(fx.GENERIC_PATHS)}))"
        )

    def error(late):
        return "CASE error WHEN 'ConnectionError' THEN 'connection_error' WHEN 'Timeout' THEN '" + late + "' END"

    return f"""SELECT job_id, CASE WHEN reason = 'alive' THEN 1 ELSE 0 END AS is_alive, reason FROM (SELECT job_id, CASE
      WHEN job_link IS NULL OR NOT starts_with(job_link, 'http') THEN 'null_or_invalid_link'
      WHEN error IS NOT NULL AND head_status IS NULL THEN {error('timeout')}
      WHEN head_status IN (404, 410, 403, 451) THEN 'http_' || CAST(head_status AS VARCHAR)
      WHEN head_status NOT IN (405, 501, 400) AND {generic('head_final_url')} THEN 'redirect_to_generic_page'
      WHEN error IS NOT NULL THEN {error('timeout_get')}
      WHEN get_status <> 200 THEN 'http_' || CAST(get_status AS VARCHAR)
      WHEN {generic('final_url')} THEN 'redirect_to_generic_page'
      WHEN length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) < 500
        THEN 'tiny_page (' || CAST(length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS VARCHAR) || ' chars)'
      ELSE coalesce({expired}, 'alive') END AS reason FROM fetch_log) x"""


VERDICTS = with_("fetch_log") + ", verdicts AS (" + _verdict_sql() + ")"


@query("cls_liveness", VERDICTS + " SELECT * FROM verdicts")
def cls_liveness(t):
    return liveness.verdicts(t.fetch_log)


@query(
    "agg_health_summary",
    VERDICTS + """ SELECT reason, count(*) AS jobs, CAST(sum(is_alive) AS BIGINT) AS alive,
      CAST(count(*) - sum(is_alive) AS BIGINT) AS dead FROM verdicts GROUP BY reason""",
)
def agg_health_summary(t):
    return liveness.health_summary(liveness.verdicts(t.fetch_log))


@query(
    "cls_expired",
    with_("fetch_log") + f""" SELECT job_id, coalesce(CASE WHEN contains(lower(body), 'session expired') THEN 'expired_on_page: session expired' """
    + " ".join(
        f"WHEN contains(lower(body), {quoted(p)}) THEN {quoted(f'expired_on_page: {chr(34)}{p}{chr(34)}')}" for p in fx.EXPIRED_PHRASES
    ) + " END, '') AS reason FROM fetch_log",
)
def cls_expired(t):
    folded = t.fetch_log.select("job_id", F.lower("body").alias("low"))
    return folded.select("job_id", F.coalesce(liveness.expired_reason(F.col("low")), F.lit("")).alias("reason"))


@query(
    "cls_redirect_generic",
    with_("fetch_log") + f""", d AS (SELECT job_id, {host_sql('job_link')} AS ho, {host_sql('final_url')} AS hf,
        len(list_filter(string_split({path_sql('job_link')}, '/'), lambda x: x <> '')) AS d0,
        len(list_filter(string_split({path_sql('final_url')}, '/'), lambda x: x <> '')) AS d1,
        lower(rtrim({path_sql('final_url')}, '/')) AS landing FROM fetch_log)
    SELECT job_id, (ho <> hf OR d1 < d0 - 1 OR landing IN {in_list(fx.GENERIC_PATHS)}) AS is_generic FROM d""",
)
def cls_redirect_generic(t):
    generic = urls.redirect_is_generic(F.col("job_link"), F.col("final_url"))
    return t.fetch_log.select("job_id", generic.alias("is_generic"))


CHECKED_AT = "2024-02-11 08:00:00"


@query(
    "upd_health",
    VERDICTS + """, j AS (SELECT id, is_active FROM """ + duck("jobs_part") + f""" x)
    SELECT id, CASE WHEN is_alive = 0 THEN 0 ELSE is_active END AS is_active,
      CASE WHEN is_alive = 0 THEN reason END AS deactivation_reason,
      CASE WHEN is_alive IS NOT NULL THEN '{CHECKED_AT}' END AS checked FROM j LEFT JOIN verdicts v ON v.job_id = j.id""",
)
def upd_health(t):
    from jobweave.sources import imports

    jobs = imports.with_columns(t.jobs_part, {"deactivation_reason": "string", "last_health_check": "timestamp_ntz"})
    after = liveness.apply_verdicts(jobs, liveness.verdicts(t.fetch_log), CHECKED_AT)
    checked = F.date_format("last_health_check", "yyyy-MM-dd HH:mm:ss").alias("checked")
    return after.select("id", "is_active", "deactivation_reason", checked)


@query("agg_active_split", P + " SELECT is_active, count(*) AS jobs FROM jobs_part GROUP BY is_active")
def agg_active_split(t):
    return liveness.active_split(t.jobs_part)


FOUND = "SELECT l_orderkey AS row_index, max(l_linenumber) - 1 AS links_found FROM {lineitem} GROUP BY l_orderkey"


@query(
    "agg_link_stats",
    f"""SELECT count(*) AS organisations, CAST(sum(links_found) AS BIGINT) AS total_links, round(avg(links_found), 6) AS avg_links,
      count(*) FILTER (WHERE links_found = 0) AS without_links, count(*) FILTER (WHERE links_found >= 5) AS with_all_links
    FROM ({FOUND.format(lineitem='lineitem')}) f""",
)
def agg_link_stats(t):
    return usage.link_stats(t.spark.sql(FOUND, lineitem=t.lineitem))


@query(
    "agg_engine_share",
    """SELECT event_type AS search_engine, count(*) AS searches,
      round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1""",
)
def agg_engine_share(t):
    return usage.engine_share(t.events.select(F.col("event_type").alias("search_engine")))


CODES = "SELECT CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 404 WHEN 'error' THEN 403 ELSE 500 END AS code FROM {events}"


@query(
    "agg_desc_outcomes",
    f"""SELECT CASE code WHEN 200 THEN 'success' WHEN 404 THEN 'expired' WHEN 403 THEN 'blocked' ELSE 'other' END AS outcome,
      count(*) AS fetches FROM ({CODES.format(events='events')}) c GROUP BY 1""",
)
def agg_desc_outcomes(t):
    fetched = t.spark.sql(CODES, events=t.events).withColumn("status", usage.fetch_status(F.col("code")))
    return usage.description_outcomes(fetched)


@query(
    "agg_missing_desc",
    with_("jobs_docs") + """ SELECT count(*) FILTER (WHERE is_active = 1 AND (job_description IS NULL OR job_description = '')) AS missing,
      count(*) FILTER (WHERE is_active = 1) AS active FROM jobs_docs""",
)
def agg_missing_desc(t):
    return usage.missing_descriptions(t.jobs_docs)


# Windows ------------------------------------------------------------------------------------------------------------


@query(
    "win_dedup_keep_first",
    P + """ SELECT id, CASE WHEN n = 1 THEN is_active ELSE 0 END AS is_active,
      CASE WHEN n > 1 AND is_active = 1 THEN 'duplicate' END AS deactivation_reason FROM (SELECT id, is_active,
        row_number() OVER (PARTITION BY lower(trim(job_title)), lower(trim(organisation_name)) ORDER BY id) AS n FROM jobs_part) x""",
)
def win_dedup_keep_first(t):
    return liveness.keep_first(t.jobs_part).select("id", "is_active", "deactivation_reason")


@query(
    "win_top_links",
    with_("candidate_links") + f""" SELECT organisation_name, rank, url, slot FROM (SELECT *, row_number() OVER
        (PARTITION BY organisation_name ORDER BY rank, url) AS slot FROM candidate_links WHERE NOT {holds_any('url', BLOCKED[:-1] + ('/es/',))}) x
    WHERE slot <= 5""",
)
def win_top_links(t):
    return links.top_links(t.candidate_links, BLOCKED[:-1] + ("/es/",)).select("organisation_name", "rank", "url", "slot")


@query(
    "win_recent_activity",
    with_("usage") + """ SELECT usage_id, user_id, recency, coalesce(regexp_extract(filters_applied, '"k": ([0-9]+)', 1), '') AS k,
      CASE WHEN companies_applied IS NULL THEN '' WHEN companies_applied = 'Acme' THEN 'Acme' ELSE 'Acme,Globex' END AS companies
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, usage_id DESC) AS recency FROM usage) x WHERE recency <= 50""",
)
def win_recent_activity(t):
    rows = usage.recent_activity(t.usage)
    return rows.select(
        "usage_id", "user_id", "recency",
        F.coalesce(F.try_element_at("filters_applied", F.lit("k")), F.lit("")).alias("k"),
        F.array_join("companies_applied", ",").alias("companies"),
    )


BLACK = fx.BLACKLIST_DOMAINS + ("example.com", "spam-farm")


@query(
    "win_best_url",
    with_("candidate_links") + f""", b AS (SELECT organisation_name, min(rank) AS rank, min_by(url, rank) AS url FROM candidate_links
        WHERE NOT {holds_any(host_sql('url'), BLACK)} AND lower(url) LIKE 'http%' GROUP BY 1)
    SELECT o.organisation_name, b.url IS NOT NULL AS is_valid, b.url AS best_url, CASE WHEN b.url IS NULL THEN 'REJECT' ELSE 'ACCEPT' END AS decision,
      CASE WHEN b.url IS NULL THEN 'Missing URL' ELSE 'Own Website (Fallback)' END AS category,
      CASE WHEN b.url IS NULL THEN 'All provided URLs are blacklisted or invalid'
        ELSE 'Passed rule-based validation (Rank ' || CAST(b.rank AS VARCHAR) || ')' END AS reason,
      CASE WHEN b.url IS NULL THEN 'High' ELSE 'Medium' END AS confidence
    FROM (SELECT DISTINCT organisation_name FROM candidate_links) o LEFT JOIN b ON b.organisation_name = o.organisation_name""",
)
def win_best_url(t):
    return links.best_url(t.candidate_links, t.candidate_links, BLACK)


# Sorts, limits, top-k -----------------------------------------------------------------------------------------------


@query(
    "sort_browse",
    P + " " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{mode}' AS mode, id, row_number() OVER (ORDER BY {order}) AS rank FROM jobs_part WHERE {OPEN_SQL}) {mode} WHERE rank <= 200"
        for mode, order in ORDERS.items()
    ),
)
def sort_browse(t):
    def part(mode):
        rows = first_rows(browse.open_jobs(t.jobs_part), browse.sort_keys(mode), 200)
        return rows.select(F.lit(mode).alias("mode"), "id", "rank")

    out = part("relevance")
    for mode in ("date", "popular", "company"):
        out = out.unionByName(part(mode))
    return out


@query(
    "topk_tier_cap",
    with_("jobs_part", "users") + f""", b AS (SELECT id, row_number() OVER (ORDER BY {ORDERS['relevance']}) AS rank FROM jobs_part WHERE {OPEN_SQL}),
      tr AS (SELECT CAST(c_custkey % 5 AS INTEGER) AS tier, count(*) AS users FROM customer GROUP BY 1)
    SELECT tier, users, rank, id FROM tr JOIN b ON rank <= CASE tier WHEN 0 THEN 3 WHEN 1 THEN 1000 WHEN 2 THEN 3000 WHEN 3 THEN 3000 ELSE 3 END""",
)
def topk_tier_cap(t):
    tiers = t.customer.groupBy((F.col("c_custkey") % 5).cast("int").alias("tier")).agg(F.count("*").alias("users"))
    seen = browse.tier_listing(tiers.select("tier"), t.jobs_part)
    return seen.join(tiers, "tier").select("tier", "users", "rank", "id")


RANKED_SQL = f"""SELECT org_location, id, row_number() OVER (PARTITION BY org_location ORDER BY {ORDERS['relevance']}) AS rank
    FROM jobs_part WHERE {OPEN_SQL}"""


@query(
    "page_slice",
    P + f""", r AS (SELECT * FROM ({RANKED_SQL}) q WHERE rank <= 1000), c AS (SELECT org_location, count(*) AS total FROM r GROUP BY 1)
    SELECT r.org_location, id, rank, total, CAST(greatest(1, ceil(total / 7.0)) AS BIGINT) AS total_pages
    FROM r JOIN c ON c.org_location = r.org_location WHERE rank BETWEEN 8 AND 14""",
)
def page_slice(t):
    ranked = top_k(
        browse.open_jobs(t.jobs_part), ["org_location"], browse.sort_keys(), 1000, F.col("id")
    ).select("org_location", "id", "rank")
    return browse.page_slice(ranked, ["org_location"], F.lit(2), F.lit(7))


LISTS = "SELECT o_custkey AS user_id, count(*) AS total_pages, CAST(o_custkey % 20 + 1 AS BIGINT) AS page FROM {orders} GROUP BY o_custkey"


@query(
    "page_window",
    f"""WITH l AS ({LISTS.format(orders='orders')}), s AS (SELECT user_id, total_pages, least(page, total_pages) AS page, greatest(1, least(page, total_pages) - 4) AS a FROM l WHERE total_pages > 1),
      e AS (SELECT *, least(total_pages, a + 9) AS b FROM s), w AS (SELECT *, CASE WHEN b - a < 9 THEN greatest(1, b - 9) ELSE a END AS c FROM e)
    SELECT user_id, page, total_pages, unnest(generate_series(c, b)) AS page_number FROM w WHERE c <= b""",
)
def page_window(t):
    lists = t.spark.sql(LISTS, orders=t.orders).withColumn("page", F.least("page", "total_pages"))
    shown = browse.page_window(lists)
    return shown.select("user_id", "page", "total_pages", "page_number")


@query(
    "sort_invoices",
    with_("payments") + """ SELECT user_id, payment_id, CAST(amount AS DOUBLE) AS amount, transaction_id, status,
      CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_day, 'Premium Plan' AS plan FROM payments
    ORDER BY user_id, created_at DESC, payment_id DESC""",
)
def sort_invoices(t):
    rows = billing.invoices(t.payments)
    return rows.select(
        "user_id", "payment_id", F.col("amount").cast("double").alias("amount"), "transaction_id", "status",
        F.to_date("created_at").cast("string").alias("created_day"), "plan",
    )


# Set operations -----------------------------------------------------------------------------------------------------

FREE_PAGES = """SELECT c_custkey AS query_id, c_custkey % 4 AS tier, CAST(c_custkey % 3 + 1 AS INTEGER) AS page, 10 AS size,
  least(3, c_custkey % 9) AS shown, c_custkey % 9 AS total FROM {customer}"""


@query(
    "set_teaser_rows",
    f"""SELECT query_id, 'dummy-' || CAST(n AS VARCHAR) AS id, 'Premium Job Listing' AS job_title, 'Unlock to View' AS organisation_name,
      'Hidden' AS location, TRUE AS is_blurred FROM (SELECT query_id, unnest(generate_series(0, least(size - shown, total - 3) - 1)) AS n
        FROM ({FREE_PAGES.format(customer='customer')}) p WHERE tier = 0 AND page = 1 AND total > 3) x""",
)
def set_teaser_rows(t):
    return browse.teaser_rows(t.spark.sql(FREE_PAGES, customer=t.customer))


@query(
    "set_unique_links",
    with_("page_urls") + """, l AS (SELECT organisation_name, page_id, i AS position, regexp_extract(url, '^(https?://[^/?#]+)', 1)
        || '/' || CAST((page_id * i) % 7 AS VARCHAR) AS url FROM page_urls, generate_series(1, 5) g(i))
    SELECT organisation_name, url, page_id, position FROM (SELECT *, row_number() OVER (PARTITION BY organisation_name, url
      ORDER BY page_id, position) AS n FROM l) x WHERE n = 1""",
)
def set_unique_links(t):
    found = t.page_urls.withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))))
    target = F.concat(urls.site(F.col("url")), F.lit("/"), ((F.col("page_id") * F.col("position")) % 7).cast("string"))
    found = found.select("organisation_name", "page_id", "position", target.alias("url"))
    return links.unique_links(found, "organisation_name", ["page_id", "position"])


SAVES = """SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS job_id, ts AS event_time, event_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'add' ELSE 'remove' END AS action FROM {events}"""


@query(
    "set_saved_add_remove",
    with_("users") + f""", {SAVED_SQL}, e AS ({SAVES.format(events='events')}),
      l AS (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY event_time DESC, event_id DESC) AS n FROM e)
    SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(l.job_id, s.id) AS job_id
    FROM (SELECT * FROM l WHERE n = 1) l FULL JOIN saved s ON s.user_id = l.user_id AND s.id = l.job_id
    WHERE l.action IS NULL OR l.action = 'add'""",
)
def set_saved_add_remove(t):
    return usage.apply_saves(t.users, t.spark.sql(SAVES, events=t.events))


# Classification -----------------------------------------------------------------------------------------------------


def _first_hit(col, pairs, default):
    return "CASE " + " ".join(f"WHEN contains(lower({col}), {quoted(k)}) THEN {v}" for k, v in pairs) + f" ELSE {default} END"


TITLED = """SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' Software Intern' WHEN 1 THEN ' HR admin (part-time)'
  WHEN 2 THEN ' nurse' WHEN 3 THEN ' UX contractor' WHEN 4 THEN ' Supply Chain' ELSE '' END AS job_title FROM {part}"""


@query(
    "cls_category_enrich",
    f"""SELECT id, job_title, {_first_hit('job_title', fx.ENRICH_CATEGORIES, 11)} AS job_category_id,
      {_first_hit('job_title', fx.ENRICH_TYPES, 1)} AS job_type_id FROM ({TITLED.format(part='part')}) t""",
)
def cls_category_enrich(t):
    return liveness.enrich_ids(t.spark.sql(TITLED, part=t.part))


@query(
    "cls_uk_location",
    f"""SELECT s_suppkey, place, {holds_any('place', fx.UK_PLACES)} AS is_uk FROM (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Kyiv, Ukraine'
      WHEN 1 THEN 'Greater London' WHEN 2 THEN 'New York' WHEN 3 THEN 'Berlin' WHEN 4 THEN '' ELSE s_name END AS place FROM supplier) s""",
)
def cls_uk_location(t):
    place = F.expr(
        "CASE s_suppkey % 6 WHEN 0 THEN 'Kyiv, Ukraine' WHEN 1 THEN 'Greater London' WHEN 2 THEN 'New York' "
        "WHEN 3 THEN 'Berlin' WHEN 4 THEN '' ELSE s_name END"
    )
    places = t.supplier.select("s_suppkey", place.alias("place"))
    return places.withColumn("is_uk", liveness.uk_location(F.col("place")))


@query(
    "flt_uk_jobs",
    P + f""", j AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN '' ELSE location END AS location FROM jobs_part)
    SELECT id, location FROM j WHERE location IS NULL OR location = '' OR {holds_any('location', PLACES)}""",
)
def flt_uk_jobs(t):
    place = F.when(F.col("id") % 6 == 1, "").when(F.col("id") % 6 != 0, F.col("location"))
    return liveness.uk_or_unstated(t.jobs_part.withColumn("location", place), PLACES).select("id", "location")
