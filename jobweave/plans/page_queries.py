"""Stored pages, model outputs and the crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import urls
from jobweave.operators import links, pages, parsing
from jobweave.plans.fixtures import holds_any, host_sql, with_
from jobweave.plans.registry import query

# The given pages have links in their navigation only, so it is read along here; the operator's default leaves it out.
WITH_NAV = ("script", "style", "footer", "header")

LINKS_SQL = """raw AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
  lk AS (SELECT page_id, page_url, replace(unnest(hrefs), '&amp;', '&') AS href, trim(replace(unnest(texts), '&amp;', '&')) AS text,
    unnest(generate_series(1, len(hrefs))) AS position FROM raw),
  links AS (SELECT page_id, page_url, position, regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href AS url, text, href FROM lk)"""


def _unescape(col: str) -> str:
    # `&amp;` last, so that an escaped entity is not read twice.
    for entity, char in (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        col = f"replace({col}, '{entity}', '{char}')"
    return col


def _without(col: str, tags) -> str:
    for tag in tags:
        col = f"regexp_replace({col}, '<{tag}[^>]*>.*?</{tag}>', '', 'gs')"
    return col


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


SHOWN = _without("html", ("script", "style", "nav", "footer", "header"))
FLAT_SQL = _strip(_unescape(f"regexp_replace(regexp_replace({SHOWN}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"))


@query(
    "page_text",
    f"""SELECT page_id, url, {_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
      regexp_replace({FLAT_SQL}, '\\s+', ' ', 'g') AS text FROM pages""",
)
def page_text(t):
    return pages.page_text(t.pages)


@query(
    "page_main_text",
    f"""WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
      s AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda x: {_strip(_unescape('x'))}),
        lambda x: x <> ''), chr(10)) AS t FROM a),
      c AS (SELECT page_id, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM s)
    SELECT page_id, {_strip("t")} AS main_text, 'success' AS main_status FROM c""",
)
def page_main_text(t):
    return pages.page_main_text(t.pages)


FORMS = """SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN html || '<form action="/send"><input name="CV"></form>'
  WHEN 1 THEN html || '<form><input name="q"></form>' ELSE html END AS html FROM {pages}"""


@query(
    "page_forms",
    f"""SELECT page_id, regexp_matches(html, '<form') AS has_form, regexp_matches(regexp_extract(html, '<form.*</form>', 0, 's'),
      '(?i){'|'.join(fx.FORM_WORDS)}') AS has_application_form FROM ({FORMS.format(pages='pages')}) p""",
)
def page_forms(t):
    """The given pages have no forms; some get one appended."""
    return pages.page_forms(t.spark.sql(FORMS, pages=t.pages))


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, page_url, CAST(position AS INTEGER) AS position, url, text, href FROM links")
def page_links(t):
    return pages.page_links(t.pages, skip_tags=WITH_NAV)


JOB_WORDS = fx.JOB_LINK_WORDS + ("the",)


@query("cls_job_link", f"WITH {LINKS_SQL} SELECT page_id, href, text, {holds_any('href || chr(32) || text', JOB_WORDS)} AS is_job_link FROM links")
def cls_job_link(t):
    found = pages.page_links(t.pages, skip_tags=WITH_NAV)
    return found.select("page_id", "href", "text", pages.is_job_link(F.col("href"), F.col("text"), JOB_WORDS).alias("is_job_link"))


@query(
    "win_link_caps",
    f"""WITH {LINKS_SQL}, j AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY position) AS n FROM links
        WHERE {holds_any('href || chr(32) || text', JOB_WORDS)})
    SELECT page_id, 'job' AS kind, url FROM j WHERE n <= 2 UNION ALL SELECT page_id, 'all', url FROM links WHERE position <= 4""",
)
def win_link_caps(t):
    read = pages.read_pages(t.pages, skip_tags=WITH_NAV)
    capped = pages.link_caps(read, JOB_WORDS, job_links=2, all_links=4)
    jobs = capped.select("page_id", F.lit("job").alias("kind"), F.explode("job_links.url").alias("url"))
    return jobs.unionByName(capped.select("page_id", F.lit("all").alias("kind"), F.explode("all_links.url").alias("url")))


@query(
    "join_title_link",
    f"""WITH {LINKS_SQL}, jobs AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'th' WHEN 1 THEN 'DE' ELSE 'no such title' END AS job_title FROM pages),
      j AS (SELECT * FROM links WHERE {holds_any('href || chr(32) || text', JOB_WORDS)})
    SELECT jobs.page_id, job_title, (SELECT min_by(url, position) FROM j l WHERE l.page_id = jobs.page_id
      AND contains(lower(l.text), lower(job_title))) AS job_link FROM jobs""",
)
def join_title_link(t):
    title = F.when(F.col("page_id") % 3 == 0, "th").when(F.col("page_id") % 3 == 1, "DE").otherwise("no such title")
    jobs = t.pages.select("page_id", title.alias("job_title"), F.lit(None).cast("string").alias("job_link"))
    read = pages.link_caps(pages.read_pages(t.pages, skip_tags=WITH_NAV), JOB_WORDS)
    per_page = read.select("page_id", "job_links")
    return links.titles_to_links(jobs, per_page).select("page_id", "job_title", "job_link")


@query(
    "agg_org_status",
    f"""WITH shaped AS ({FORMS.format(pages='pages')}), {LINKS_SQL},
      f AS (SELECT page_id, {host_sql('url')} AS organisation_name, regexp_matches(html, '<form') AS form FROM shaped),
      j AS (SELECT DISTINCT page_id FROM links WHERE page_id % 5 = 0 AND {holds_any('href || chr(32) || text', JOB_WORDS)}),
      a AS (SELECT organisation_name, max(CASE WHEN j.page_id IS NULL THEN 0 ELSE 1 END) AS job, max(CASE WHEN form THEN 1 ELSE 0 END) AS form
        FROM f LEFT JOIN j ON j.page_id = f.page_id GROUP BY 1)
    SELECT organisation_name, CASE WHEN job = 1 THEN 'Job Openings' WHEN form = 1 THEN 'Only Form' ELSE 'No Jobs and No Form' END AS application_type,
      CASE WHEN job = 1 OR form = 1 THEN 'Yes' ELSE 'Yes (Validated) - No Data' END AS career_page_available FROM a""",
)
def agg_org_status(t):
    """Flags come from the parsed pages.  Their only links are in the navigation, which every fifth page is read with."""
    shaped = t.spark.sql(FORMS, pages=t.pages)
    read = [
        pages.link_caps(pages.read_pages(shaped.filter(rule), skip_tags=tags), JOB_WORDS)
        for rule, tags in (("page_id % 5 = 0", WITH_NAV), ("page_id % 5 <> 0", (*WITH_NAV, "nav")))
    ]
    flags = {"organisation_name": urls.host(F.col("url")), "has_job": F.size("job_links") > 0}
    return links.org_status(read[0].unionByName(read[1]).withColumns(flags), "organisation_name")


@query(
    "parse_job_lines",
    """SELECT p_partkey AS org_id, 0 AS line_no, p_name AS job_title, 'https://' || CASE WHEN p_partkey % 4 = 1 THEN 'www.jobs.example.org/jobs/'
        ELSE 'jobs.example.org/' END || CAST(p_partkey AS VARCHAR) AS job_link, 'London, UK' AS location, CAST(NULL AS VARCHAR) AS salary
      FROM part WHERE p_partkey % 4 IN (1, 2)
    UNION ALL SELECT p_partkey, 1, 'second ' || p_name, 'https://acme.lever.co/' || CAST(p_partkey AS VARCHAR), NULL, NULL FROM part""",
)
def parse_job_lines(t):
    return parsing.job_lines(t.model_outputs)


@query(
    "parse_validation",
    with_("review_outputs") + """ SELECT org, CASE WHEN raw LIKE '%REJECT%' THEN FALSE ELSE TRUE END AS is_valid,
      CASE WHEN raw LIKE '%REJECT%' THEN NULL WHEN raw LIKE 'best url%' THEN second_url ELSE first_url END AS best_url,
      CASE WHEN raw LIKE '%REJECT%' THEN 'REJECT' ELSE 'ACCEPT' END AS decision,
      CASE WHEN raw LIKE '%BEST_URL%' THEN 'Own Website' WHEN raw LIKE 'I am%' THEN 'Own Website (Fallback)' ELSE 'Unknown' END AS category,
      CASE WHEN raw LIKE '%BEST_URL%' THEN 'looks official' WHEN raw LIKE '%REJECT%' THEN 'job board' WHEN raw LIKE '%ACCEPT%' THEN 'only candidate'
        WHEN raw LIKE 'I am%' THEN 'Passed rule-based validation (Rank 1)' ELSE 'fine' END AS reason,
      CASE WHEN raw LIKE '%BEST_URL%' THEN 'High' WHEN raw LIKE '%REJECT%' OR raw LIKE 'I am%' THEN 'Medium' ELSE 'Low' END AS confidence
    FROM review_outputs""",
)
def parse_validation(t):
    listed = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("first_url").alias("url")),
        F.struct(F.lit(2).alias("rank"), F.col("second_url").alias("url")),
    )
    return parsing.validation(t.review_outputs.withColumn("urls", listed))


CRAWL_DOMAINS = ("example.net", "example.org")
# Levels that the SQL writes out; page numbers double with every level, so this is enough for 130,000 pages.
LEVELS = 18


def crawl_inputs(page_urls):
    """Start pages (lowest id per host) and a stored link table where page n links to pages 2n+1, 2n+2 and 3n+1."""
    starts = page_urls.groupBy(F.col("organisation_name").alias("org")).agg(F.min_by("url", "page_id").alias("url"))
    n = F.col("page_id")
    targets = F.array(2 * n + 1, 2 * n + 2, 3 * n + 1)
    wanted = page_urls.select(F.col("url").alias("page_url"), F.posexplode(targets).alias("position", "target"))
    to = page_urls.select(F.col("page_id").alias("target"), "url")
    return starts, wanted.join(to, "target").select("page_url", (F.col("position") + 1).alias("position"), "url")


def _crawl_sql() -> str:
    levels = [f"""s AS MATERIALIZED (SELECT organisation_name AS org, min_by(url, page_id) AS url FROM page_urls GROUP BY 1),
      k AS MATERIALIZED (SELECT p.url AS page_url, x.i AS position, q.url FROM page_urls p, (VALUES (1, 2, 1), (2, 2, 2), (3, 3, 1)) x(i, m, c)
        JOIN page_urls q ON q.page_id = p.page_id * x.m + x.c),
      l0 AS MATERIALIZED (SELECT org, url, {host_sql('url')} AS base, 0 AS depth, 1 AS visit FROM s)"""]
    for depth in range(1, LEVELS):
        seen = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth))
        levels.append(f"""v{depth} AS MATERIALIZED ({seen}),
      f{depth} AS MATERIALIZED (SELECT org, base, k.url, min(visit * 1000 + position) AS first FROM l{depth - 1} l JOIN k ON k.page_url = l.url
        WHERE {host_sql('k.url')} = base OR ends_with({host_sql('k.url')}, '.' || base) OR {holds_any(host_sql('k.url'), CRAWL_DOMAINS)} GROUP BY ALL),
      l{depth} AS MATERIALIZED (SELECT f.org, f.url, f.base, {depth} AS depth, CAST(m.top + row_number() OVER (PARTITION BY f.org ORDER BY f.first, f.url)
          AS INTEGER) AS visit FROM f{depth} f JOIN (SELECT org, max(visit) AS top FROM v{depth} GROUP BY 1) m ON m.org = f.org
          WHERE NOT EXISTS (SELECT 1 FROM v{depth} o WHERE o.org = f.org AND o.url = f.url))""")
    every = " UNION ALL ".join(f"SELECT org, url, depth, visit FROM l{d}" for d in range(LEVELS))
    return with_("page_urls") + ", " + ", ".join(levels) + " " + every


@query("crawl_frontier", _crawl_sql())
def crawl_frontier(t):
    starts, stored = crawl_inputs(t.page_urls)
    return links.crawl_frontier(starts, stored, ats=CRAWL_DOMAINS)
