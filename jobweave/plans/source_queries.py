"""Sources, sinks, filters and projections."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text, urls
from jobweave.operators import browse, filters, links, parsing, projections, usage
from jobweave.plans.fixtures import HOST_SQL, JOBS_AS_OF, duck, holds_any, in_category_sql, in_list, quoted, with_
from jobweave.plans.registry import query
from jobweave.sources import imports, workdir

P = with_("jobs_part")
PLACES = ("nation_1", "nation_20")
LONDON = ("nation_20",)

RAW_JOBS = """
SELECT CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS job_title,
  p_partkey AS id, n.n_name AS location,
  CASE p_partkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'true' WHEN 2 THEN 'FALSE' END AS is_active,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS views_count
FROM {part} JOIN {nation} n ON n.n_nationkey = p_partkey % 25
"""


@query(
    "src_jobs_import",
    f"""SELECT id, job_title, location, CASE WHEN upper(is_active) = 'TRUE' THEN 1 ELSE 0 END AS is_active,
      coalesce(CAST(views_count AS INTEGER), 0) AS views_count,
      CASE WHEN {holds_any('location', PLACES)} THEN 1 ELSE 0 END AS exists_in_uk,
      CASE WHEN {holds_any('location', LONDON)} THEN 1 ELSE 0 END AS exists_in_london
    FROM ({RAW_JOBS.format(part='part', nation='nation')}) raw WHERE trim(job_title) <> ''""",
)
def src_jobs_import(t):
    raw = t.spark.sql(RAW_JOBS, part=t.part, nation=t.nation)
    raw = raw.toDF(*[f" {c.upper()} " for c in raw.columns])
    return imports.import_jobs(raw, PLACES, LONDON)


@query(
    "src_import_mode",
    P + """ SELECT 'first' AS step, 1 AS wrote, count(*) AS jobs FROM jobs_part
    UNION ALL SELECT 'again', 0, count(*) FROM jobs_part
    UNION ALL SELECT 'forced', 1, count(*) FROM jobs_part WHERE is_active = 1""",
)
def src_import_mode(t):
    path = f"{t.work_folder()}/jobs"
    steps = []
    active = t.jobs_part.filter("is_active = 1")
    for name, rows, force in (("first", t.jobs_part, False), ("again", active, False), ("forced", active, True)):
        wrote = imports.write_jobs(rows, path, force)
        counted = t.spark.read.parquet(path).agg(F.count("*").alias("jobs"))
        steps.append(workdir.cut(counted.select(F.lit(name).alias("step"), F.lit(int(wrote)).alias("wrote"), "jobs")))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


REGISTER_SQL = with_("register") + """, parts AS (
  SELECT row_index, nullif(nullif(trim(organisation_name), 'nan'), '') AS organisation_name,
    nullif(nullif(trim(town), 'nan'), '') AS town, nullif(nullif(trim(county), 'nan'), '') AS county FROM register)
"""


@query(
    "src_org_register",
    REGISTER_SQL + """SELECT row_index, organisation_name, coalesce(town, '') AS town, coalesce(county, '') AS county,
      concat_ws(' ', organisation_name, town, county, 'careers') AS search_query,
      concat_ws(', ', town, county) AS org_location FROM parts WHERE organisation_name IS NOT NULL""",
)
def src_org_register(t):
    """The register goes through a CSV file and back, as it would arrive."""
    path = f"{t.work_folder()}/register"
    named = t.register.select(
        F.concat_ws("#", "row_index", "organisation_name").alias("Organisation Name"), F.col("town").alias("Town/City"),
        F.col("county").alias("County"),
    )
    named.write.option("header", True).csv(path)
    read = imports.read_register(t.spark, path)
    split = read.withColumns(
        {
            "row_index": F.split_part("organisation_name", F.lit("#"), F.lit(1)).cast("bigint"),
            "organisation_name": F.regexp_replace("organisation_name", "^[0-9]+#", ""),
        }
    )
    return imports.org_register(split)


@query(
    "src_tables",
    with_("jobs_part", "users", "usage", "payments") + """
    SELECT 'jobs' AS relation, count(*) AS row_count, CAST(sum(id) AS BIGINT) AS key_sum FROM jobs_part
    UNION ALL SELECT 'users', count(*), CAST(sum(user_id) AS BIGINT) FROM users
    UNION ALL SELECT 'usage', count(*), CAST(sum(usage_id) AS BIGINT) FROM usage
    UNION ALL SELECT 'payments', count(*), CAST(sum(payment_id) AS BIGINT) FROM payments""",
)
def src_tables(t):
    def line(name, rows, key):
        return rows.agg(F.count("*").alias("row_count"), F.sum(key).alias("key_sum")).withColumn("relation", F.lit(name))

    out = line("jobs", t.jobs_part, "id").unionByName(line("users", t.users, "user_id"))
    return out.unionByName(line("usage", t.usage, "usage_id")).unionByName(line("payments", t.payments, "payment_id"))


@query(
    "src_embedding_decode",
    """SELECT vec_id AS id, CASE WHEN vec_id % 7 <> 0 THEN len(embedding) END AS embedding_dimension,
      CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 5) END AS total FROM embeddings""",
)
def src_embedding_decode(t):
    def encode(batches):
        for batch in batches:
            coded = [base64.b64encode(np.asarray(v, dtype="<f4").tobytes()).decode() for v in batch["embedding"]]
            yield pd.DataFrame({"id": batch["vec_id"], "embedding_base64": coded})

    coded = t.embeddings.select("vec_id", "embedding").mapInPandas(encode, "id bigint, embedding_base64 string")
    bad = F.when(F.col("id") % 7 == 0, F.lit("not base64!")).otherwise(F.col("embedding_base64"))
    read = imports.decode_embeddings(coded.withColumn("embedding_base64", bad))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select("id", "embedding_dimension", F.round(total, 5).alias("total"))


@query(
    "sink_export_active",
    P + " SELECT id, job_title, organisation_name, salary FROM jobs_part WHERE is_active = 1",
)
def sink_export_active(t):
    path = f"{t.work_folder()}/export"
    with_vectors = t.jobs_part.join(t.vectors, "id", "left")
    imports.export_active(with_vectors, path)
    exported = t.spark.read.parquet(path)
    return exported.drop("embedding").select("id", "job_title", "organisation_name", "salary")


@query(
    "src_schema_evolve",
    P + """ SELECT id, job_title, CAST(NULL AS VARCHAR) AS deactivation_reason FROM jobs_part WHERE id % 2 = 0
    UNION ALL SELECT id, job_title, 'checked' FROM jobs_part WHERE id % 2 = 1""",
)
def src_schema_evolve(t):
    jobs = t.jobs_part.select("id", "job_title")
    old = jobs.filter("id % 2 = 0")
    new = jobs.filter("id % 2 = 1").withColumn("deactivation_reason", F.lit("checked"))
    wider = imports.with_columns(old, {"deactivation_reason": "string", "last_health_check": "timestamp_ntz"})
    return wider.unionByName(new, allowMissingColumns=True).drop("last_health_check")


@query(
    "src_schema_versions",
    P + """ SELECT CAST(id AS BIGINT) AS id, job_title, CAST(id % 100 AS BIGINT) AS views_count, CAST(NULL AS VARCHAR) AS deactivation_reason,
      CAST(NULL AS VARCHAR) AS note FROM jobs_part WHERE id % 2 = 0
    UNION ALL SELECT id, job_title, CAST(id AS BIGINT) * 4000000000, 'checked', NULL FROM jobs_part WHERE id % 2 = 1""",
)
def src_schema_versions(t):
    jobs, folder = t.jobs_part.select("id", "job_title"), workdir.shared_folder(t.spark)
    old = jobs.filter("id % 2 = 0").selectExpr("CAST(id AS INT) AS id", "job_title", "CAST(id % 100 AS INT) AS views_count")
    new = jobs.filter("id % 2 = 1").selectExpr("CAST(id AS BIGINT) AS id", "job_title", "id * 4000000000L AS views_count", "'checked' AS deactivation_reason")
    old.write.parquet(f"{folder}/v1")
    new.write.parquet(f"{folder}/v2")
    return imports.read_versions(t.spark, [f"{folder}/v1", f"{folder}/v2"], {"note": "string"})


@query(
    "src_links_wide_long",
    with_("org_links") + ", l AS (" + " UNION ALL ".join(
        f"SELECT organisation_name, {i} AS rank, trim(link_{i}_url) AS url, link_{i}_title AS title FROM org_links"
        for i in range(1, 6)
    ) + ") SELECT organisation_name, rank, url, coalesce(title, '') AS title FROM l "
    "WHERE url IS NOT NULL AND lower(url) NOT IN ('', 'nan')",
)
def src_links_wide_long(t):
    return links.wide_to_long(t.org_links)


@query(
    "src_links_long_wide",
    with_("ranked_links") + " SELECT organisation_name, " + ", ".join(
        f"coalesce(max(CASE WHEN rank = {i} THEN {c} END), '') AS link_{i}_{c}" for i in range(1, 6) for c in ("url", "title")
    ) + ", count(*) FILTER (WHERE rank <= 5) AS links_found FROM ranked_links GROUP BY organisation_name",
)
def src_links_long_wide(t):
    return links.long_to_wide(t.ranked_links)


@query(
    "src_postings_flatten",
    """WITH p AS (SELECT p_brand AS org, p_partkey // 500 AS feed_no, p_partkey,
        row_number() OVER (PARTITION BY p_brand, p_partkey // 500 ORDER BY p_partkey) - 1 AS position, p_name FROM part),
      kept AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY feed_no, position) AS posting_no FROM p
        WHERE p_partkey % 8 <> 0)
    SELECT org, feed_no, CAST(position AS INTEGER) AS position, p_name AS job_title,
      'https://' || lower(replace(org, '#', '')) || '.example.org/job/' || CAST(p_partkey AS VARCHAR) AS job_link,
      CASE WHEN p_partkey % 5 <> 0 THEN 'Leeds' END AS location, CAST(NULL AS VARCHAR) AS dateposted, posting_no
    FROM kept""",
)
def src_postings_flatten(t):
    """Feeds are pages of one brand's neighbouring parts, 500 keys wide."""
    item = F.struct(
        F.concat(F.lit(" "), "p_name").alias("title"),
        F.when(F.col("p_partkey") % 8 != 0, F.concat(F.lit("/job/"), F.col("p_partkey").cast("string")))
        .otherwise("").alias("externalPath"),
        F.when(F.col("p_partkey") % 5 != 0, "Leeds").otherwise("").alias("locationsText"),
    )
    sortable = F.struct("p_partkey", item.alias("item"))
    feeds = t.part.groupBy(F.col("p_brand").alias("org"), F.floor(F.col("p_partkey") / 500).alias("feed_no")).agg(
        F.transform(F.sort_array(F.collect_list(sortable)), lambda x: x["item"]).alias("jobPostings")
    )
    base = F.concat(F.lit("https://"), F.lower(F.replace("org", F.lit("#"), F.lit(""))), F.lit(".example.org"))
    payload = F.to_json(F.struct(F.size("jobPostings").alias("total"), "jobPostings"))
    return parsing.postings(feeds.select("org", "feed_no", base.alias("base_url"), payload.alias("payload")))


# Filters ------------------------------------------------------------------------------------------------------------

FILTERS = {"location": "Nation_1", "organisation_name": "brand#1", "remote_type": "Hybrid"}


@query(
    "flt_user_filters",
    P + """ SELECT id, location, organisation_name, remote_type FROM jobs_part WHERE contains(lower(location), 'nation_1')
      AND contains(lower(organisation_name), 'brand#1') AND remote_type = 'Hybrid'""",
)
def flt_user_filters(t):
    return filters.apply_filters(t.jobs_part, FILTERS).select("id", "location", "organisation_name", "remote_type")


@query(
    "flt_category",
    P + f""" SELECT 'c1' AS category, id, job_title FROM jobs_part WHERE {in_category_sql('1')}
    UNION ALL SELECT 'c14', id, job_title FROM jobs_part WHERE {in_category_sql('14')}
    UNION ALL SELECT 'unknown', id, job_title FROM jobs_part
    UNION ALL SELECT 'global', id, job_title FROM jobs_part WHERE exists_in_uk = 0""",
)
def flt_category(t):
    def part(label, category):
        return filters.in_category(t.jobs_part, category).select(F.lit(label).alias("category"), "id", "job_title")

    out = part("c1", "1").unionByName(part("c14", "14")).unionByName(part("unknown", "3"))
    return out.unionByName(part("global", "remote_global"))


DATA_COURSE_WORDS = ("widget", "ring")


@query(
    "flt_course_exclude",
    P + f""" SELECT 'browse' AS rule, id, job_title FROM jobs_part WHERE NOT {holds_any('job_title', fx.COURSE_WORDS_BROWSE)}
    UNION ALL SELECT 'custom', id, job_title FROM jobs_part WHERE NOT {holds_any('job_title', DATA_COURSE_WORDS)}
    UNION ALL SELECT 'search', id, job_title FROM jobs_part WHERE NOT {holds_any('job_title', fx.COURSE_WORDS)}""",
)
def flt_course_exclude(t):
    cols = ["id", "job_title"]
    out = filters.without_courses(t.jobs_part).select(F.lit("browse").alias("rule"), *cols)
    custom = filters.without_courses(t.jobs_part, DATA_COURSE_WORDS).select(F.lit("custom").alias("rule"), *cols)
    found = t.jobs_part.filter(~filters.is_course(F.col("job_title"))).select(F.lit("search").alias("rule"), *cols)
    return out.unionByName(custom).unionByName(found)


@query(
    "flt_has_link",
    P + " SELECT id, job_link FROM jobs_part WHERE is_active = 1 AND job_link IS NOT NULL AND job_link <> ''",
)
def flt_has_link(t):
    return filters.with_link(t.jobs_part).select("id", "job_link")


@query(
    "flt_location_scope",
    P + """ SELECT 'uk' AS scope, id FROM jobs_part WHERE exists_in_uk = 1
    UNION ALL SELECT 'london', id FROM jobs_part WHERE exists_in_london = 1 UNION ALL SELECT 'all', id FROM jobs_part""",
)
def flt_location_scope(t):
    def part(scope):
        return filters.location_scope(t.jobs_part, scope).select(F.lit(scope).alias("scope"), "id")

    return part("uk").unionByName(part("london")).unionByName(part("all"))


@query(
    "flt_featured_places",
    P + f""" SELECT id, location FROM jobs_part WHERE is_active = 1 AND exists_in_uk = 1
      AND {holds_any('location', PLACES + ('london', 'uk'))}""",
)
def flt_featured_places(t):
    return filters.featured_places(t.jobs_part, PLACES + ("London", "UK")).select("id", "location")


@query(
    "flt_no_link",
    """SELECT job_id AS id, 'no_job_link' AS deactivation_reason FROM """ + duck("fetch_log") + """ f
    WHERE job_link IS NULL OR job_link = '' OR lower(job_link) NOT LIKE 'http%'""",
)
def flt_no_link(t):
    jobs = t.fetch_log.select(F.col("job_id").alias("id"), "job_link", F.lit(1).alias("is_active"))
    return filters.without_usable_link(jobs).select("id", "deactivation_reason")


JUNK = ("red widget", "small ring")


@query(
    "flt_vague_title",
    P + f""", j AS (SELECT id, is_active, CASE WHEN id % 50 = 3 THEN 'IT' WHEN id % 50 = 7 THEN 'ab'
        WHEN id % 50 = 11 THEN 'My Testing Job Title 2' ELSE job_title END AS job_title FROM jobs_part)
    SELECT id, job_title, 'vague_or_test_title' AS deactivation_reason FROM j WHERE is_active = 1
      AND (lower(job_title) IN {in_list(fx.JUNK_TITLES + JUNK)} OR contains(lower(job_title), 'testing job title')
        OR (length(job_title) <= 2 AND upper(job_title) NOT IN {in_list(fx.SHORT_TITLES)}))""",
)
def flt_vague_title(t):
    title = (
        F.when(F.col("id") % 50 == 3, "IT").when(F.col("id") % 50 == 7, "ab")
        .when(F.col("id") % 50 == 11, "My Testing Job Title 2").otherwise(F.col("job_title"))
    )
    found = filters.with_vague_title(t.jobs_part.withColumn("job_title", title), junk=fx.JUNK_TITLES + JUNK)
    return found.select("id", "job_title", "deactivation_reason")


CHECKED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS last_health_check,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS is_active FROM {orders}"""


@query(
    "flt_stale_check",
    f"""SELECT id, CAST(last_health_check AS DATE)::VARCHAR AS last_day FROM ({CHECKED.format(orders='orders')}) o
    WHERE is_active = 1 AND (last_health_check IS NULL OR last_health_check < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 3 DAY)
    ORDER BY last_health_check ASC NULLS FIRST, id""",
)
def flt_stale_check(t):
    due = filters.due_for_check(t.spark.sql(CHECKED, orders=t.orders), "1998-06-01 00:00:00", 3)
    return due.select("id", F.to_date("last_health_check").cast("string").alias("last_day"))


@query(
    "flt_embed_backlog",
    with_("jobs_docs", "vectors") + """ SELECT id, organisation_name FROM jobs_docs WHERE is_active = 1
      AND id NOT IN (SELECT id FROM vectors) ORDER BY id""",
)
def flt_embed_backlog(t):
    return filters.embedding_backlog(t.jobs_docs, t.vectors).select("id", "organisation_name")


@query(
    "flt_desc_backlog",
    with_("jobs_docs") + """ SELECT id, job_link FROM jobs_docs WHERE job_link IS NOT NULL
      AND (job_description IS NULL OR job_description = '') ORDER BY id DESC""",
)
def flt_desc_backlog(t):
    return filters.description_backlog(t.jobs_docs).select("id", "job_link")


BLOCKED = fx.BLOCKED_DOMAINS + ("example.net", "spam-farm")


@query(
    "flt_blocked_domain",
    f"SELECT page_id, url, {holds_any('url', BLOCKED)} AS blocked FROM pages",
)
def flt_blocked_domain(t):
    return t.pages.select("page_id", "url", filters.blocked_domain(F.col("url"), BLOCKED).alias("blocked"))


# Projections --------------------------------------------------------------------------------------------------------


@query(
    "prj_listing",
    P + """ SELECT id, job_title, organisation_name, org_location, location, remote_type, experience_level, salary,
      dateposted, job_description, job_link, company_url, job_source, CAST(0.0 AS DOUBLE) AS hybrid_score, views_count,
      FALSE AS is_blurred FROM jobs_part""",
)
def prj_listing(t):
    return projections.listing(t.jobs_part)


VIEWS = """SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS id FROM {events}
  WHERE event_type = 'view'"""
SAVED_SQL = """saved AS (SELECT DISTINCT user_id, CAST(s AS BIGINT) AS id FROM (
    SELECT user_id, unnest(regexp_extract_all(saved_jobs, '[0-9]+')) AS s FROM users) u)"""


@query(
    "prj_detail",
    with_("jobs_part", "users") + f""", {SAVED_SQL},
      v AS (SELECT DISTINCT user_id, id FROM ({VIEWS.format(events='events')}) e)
    SELECT v.user_id, v.id, j.job_title, j.salary, j.views_count, s.id IS NOT NULL AS is_saved
    FROM v JOIN jobs_part j ON j.id = v.id AND j.is_active = 1
    LEFT JOIN saved s ON s.user_id = v.user_id AND s.id = v.id""",
)
def prj_detail(t):
    views = t.spark.sql(VIEWS, events=t.events)
    rows = projections.detail(views, t.jobs_part, usage.saved_rows(t.users))
    return rows.select("user_id", "id", "job_title", "salary", "views_count", "is_saved")


@query(
    "prj_embed_text",
    with_("jobs_docs") + """ SELECT id, md5(e) AS text_md5, length(e) AS chars FROM (
      SELECT id, regexp_replace(coalesce(job_title, '') || ' ' || coalesce(job_description, '') || ' '
        || coalesce(organisation_name, '') || ' ' || coalesce(location, '') || ' ' || coalesce(experience_level, '')
        || ' ' || coalesce(remote_type, ''), '^\\s+|\\s+$', '', 'g') AS e FROM jobs_docs) x WHERE length(e) >= 3""",
)
def prj_embed_text(t):
    made = projections.embedding_text(t.jobs_docs)
    return made.select("id", F.md5(F.col("embed_text").cast("binary")).alias("text_md5"),
                       F.length("embed_text").cast("bigint").alias("chars"))


@query(
    "prj_search_string",
    REGISTER_SQL + """SELECT row_index, concat_ws(' ', organisation_name, town, county, 'careers') AS search_query
      FROM parts WHERE organisation_name IS NOT NULL""",
)
def prj_search_string(t):
    return projections.search_string(t.register).select("row_index", "search_query")


@query(
    "prj_org_location",
    with_("register") + """, o AS (SELECT row_index, regexp_replace(town || ', ' || county, '^[, ]+|[, ]+$', '', 'g') AS org_location
        FROM register)
    SELECT row_index, org_location, CASE WHEN row_index % 3 = 0 THEN 'Leeds' ELSE nullif(trim(split_part(org_location, ',', 1)), '') END
      AS job_location FROM o""",
)
def prj_org_location(t):
    located = t.register.withColumn("org_location", projections.org_location(F.col("town"), F.col("county")))
    stated = F.when(F.col("row_index") % 3 == 0, " Leeds ").when(F.col("row_index") % 3 == 1, "not specified")
    return located.select(
        "row_index", "org_location", projections.job_location(stated, F.col("org_location")).alias("job_location")
    )


@query(
    "prj_card",
    P + f""", d AS (SELECT *, CASE WHEN dateposted <> 'soon' THEN CAST(floor(date_diff('second', CAST(nullif(dateposted, 'soon') AS TIMESTAMP),
        TIMESTAMP '{JOBS_AS_OF}') / 86400.0) AS BIGINT) END AS days FROM jobs_part)
    SELECT id, job_title, CASE WHEN days IS NULL THEN '' WHEN days = 0 THEN 'Today' WHEN days = 1 THEN '1 Day Ago'
        ELSE CAST(days AS VARCHAR) || ' Days Ago' END AS age_label,
      CASE WHEN salary <> 'Not Specified' THEN salary ELSE '' END AS display_salary, location AS display_location,
      remote_type AS display_type, CASE WHEN exists_in_uk = 0 THEN 'Remote / Global Job' ELSE '' END AS badge,
      coalesce(job_description, 'No description provided.') AS display_description,
      CASE WHEN id % 5 = 0 THEN 'mailto:jobs@example.org' ELSE job_link END AS apply_link FROM d""",
)
def prj_card(t):
    changed = t.jobs_part.withColumns(
        {
            "location": F.concat(F.lit("Locations: "), "location"),
            "job_link": F.when(F.col("id") % 5 == 0, "jobs@example.org").otherwise(F.col("job_link")),
        }
    )
    return projections.card(changed, JOBS_AS_OF)


@query(
    "prj_user_labels",
    """SELECT c_custkey AS user_id, c_name || ' ' || c_mktsegment AS full_name, lower(c_mktsegment) AS email_name,
      CASE c_custkey % 3 WHEN 0 THEN 'Remote' END AS remote_type, CASE c_custkey % 3 WHEN 1 THEN 'Senior' END AS level
    FROM customer""",
)
def prj_user_labels(t):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Remote Jobs", "Senior level", "other")]), F.col("c_custkey") % 3 + 1)
    remote, level = projections.filter_from_label(label)
    email = F.concat(F.lower("c_mktsegment"), F.lit("@example.org"))
    return t.customer.withColumn("c_custkey", F.col("c_custkey").cast("int")).select(
        F.col("c_custkey").cast("bigint").alias("user_id"),
        projections.full_name(F.col("c_name"), F.col("c_mktsegment")).alias("full_name"),
        projections.email_name(email).alias("email_name"),
        remote.alias("remote_type"),
        level.alias("level"),
    )


# URL and text clean-up ----------------------------------------------------------------------------------------------


@query(
    "url_sanitise",
    f"""SELECT page_id, CASE WHEN regexp_matches(lower(trim(u)), '^https?://') AND NOT {holds_any('u', fx.URL_GARBAGE)}
      AND contains({HOST_SQL.format('trim(u)')}, '.') THEN u END AS job_link FROM (
      SELECT page_id, CASE page_id % 6 WHEN 1 THEN '[Apply here]' WHEN 2 THEN 'ftp://x.example.org' WHEN 3 THEN 'https://localhost/a'
        ELSE url END AS u FROM pages) p""",
)
def url_sanitise(t):
    raw = (
        F.when(F.col("page_id") % 6 == 1, "[Apply here]").when(F.col("page_id") % 6 == 2, "ftp://x.example.org")
        .when(F.col("page_id") % 6 == 3, "https://localhost/a").otherwise(F.col("url"))
    )
    return t.pages.select("page_id", urls.sanitise(raw).alias("job_link"))


@query("url_clean_markdown", "SELECT page_id, url FROM pages")
def url_clean_markdown(t):
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" [link]("), "url", F.lit(")"))).otherwise(
        F.concat(F.lit("  "), "url", F.lit("\n"))
    )
    return t.pages.select("page_id", urls.unwrap_markdown(wrapped).alias("url"))


BARE = "regexp_replace(lower({0}), '^www\\.', '')"


@query(
    "url_in_scope",
    f"""WITH l AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://jobs.' || {HOST_SQL.format('url')} || '/x'
        WHEN 1 THEN 'https://acme.greenhouse.io/1' WHEN 2 THEN 'https://www.other.example.org/x' ELSE url END AS link FROM pages),
      h AS (SELECT page_id, link, {BARE.format(HOST_SQL.format('link'))} AS a, {BARE.format(HOST_SQL.format('url'))} AS b FROM l)
    SELECT page_id, (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a) OR {holds_any('a', fx.ATS_DOMAINS)}) AS in_scope FROM h""",
)
def url_in_scope(t):
    case = F.col("page_id") % 4
    link = (
        F.when(case == 0, F.concat(F.lit("https://jobs."), urls.host(F.col("url")), F.lit("/x")))
        .when(case == 1, "https://acme.greenhouse.io/1").when(case == 2, "https://www.other.example.org/x")
        .otherwise(F.col("url"))
    )
    return t.pages.select("page_id", urls.in_scope(link, F.col("url")).alias("in_scope"))


@query(
    "url_ats_api",
    """SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 'https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Site/job/' || CAST(page_id AS VARCHAR) END AS job_api,
      CASE WHEN page_id % 3 <> 2 THEN 'https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Site/jobs' END AS board_api FROM pages""",
)
def url_ats_api(t):
    number = F.col("page_id").cast("string")
    site = "https://acme.wd3.myworkdayjobs.com/"
    link = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(site + "en-GB/Site/job/"), number))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit(site + "Site/x/job/"), number))
        .otherwise(F.col("url"))
    )
    return t.pages.select("page_id", urls.ats_job_api(link).alias("job_api"), urls.ats_board_api(link).alias("board_api"))


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def _clean_sql(col: str) -> str:
    out = strip_sql(col)
    for phrase in fx.DESCRIPTION_BOILERPLATE:
        out = f"replace({out}, {quoted(phrase)}, '')"
    out = strip_sql(f"regexp_replace({out}, '^([^:]*):', '\\1')")
    return f"nullif({strip_sql(f'trim(trim({out}, chr(34)), chr(39))')}, '')"


def _written_sql(col: str) -> str:
    out = strip_sql(f"regexp_replace({strip_sql(col)}, '(?i)job description\\s*:', '', 'g')")
    return f"nullif({strip_sql(f'trim({out}, chr(34) || chr(39))')}, '')"


@query(
    "text_clean_description",
    f"""SELECT conv_id, turn, {_clean_sql('dressed')} AS description, {_written_sql('labelled')} AS written FROM (
      SELECT conv_id, turn, '"Here is ' || role || ': ''' || text || '''" ' AS dressed,
        'Job Description : "' || text || '"' AS labelled FROM conversations) c""",
)
def text_clean_description(t):
    dressed = F.concat(F.lit("\"Here is "), "role", F.lit(": '"), "text", F.lit("'\" "))
    labelled = F.concat(F.lit("Job Description : \""), "text", F.lit("\""))
    return t.conversations.select(
        "conv_id", "turn",
        projections.clean_description(dressed).alias("description"),
        projections.clean_written_description(labelled).alias("written"),
    )


@query(
    "txt_normalise_query",
    """SELECT item_id AS query_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))
      AS query FROM benchmark""",
)
def txt_normalise_query(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), text.normalise_query(F.col("text")).alias("query"))
