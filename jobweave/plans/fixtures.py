"""Model tables derived from the given tables.

Each adapter is one SQL text that both Spark and DuckDB run; `{name}` stands for a given table or another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text
from jobweave.functions.skew import GROUP_LIMIT
from jobweave.operators.retrieval import SearchIndex
from jobweave.session import ship_package
from jobweave.sources import imports, workdir

# Tables whose rows are long texts, with their key.
HEAVY = {"documents": "doc_id", "pages": "page_id"}
INDEXES: dict[tuple[str, str, str], SearchIndex] = {}
JOBS_AS_OF = "2024-02-10 00:00:00"
DAY_AS_OF = "2024-01-20 12:00:00"

ADAPTERS = {
    "jobs_part": """
SELECT p.p_partkey AS id, p.p_name AS job_title, p.p_brand AS organisation_name, n.n_name AS location,
  r.r_name AS org_location,
  CASE p.p_size % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'Full Time' END AS remote_type,
  p.p_type AS experience_level, 'src' || CAST(p.p_partkey % 4 AS STRING) AS job_source,
  CASE WHEN p.p_partkey % 5 = 0 THEN '' WHEN p.p_partkey % 7 = 0 THEN NULL
       ELSE 'https://jobs.example.org/' || CAST(p.p_partkey AS STRING) END AS job_link,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL WHEN p.p_partkey % 9 = 0 THEN 'Not Specified'
       ELSE 'GBP ' || CAST(p.p_size AS STRING) END AS salary,
  CASE WHEN p.p_partkey % 17 = 0 THEN 'soon'
       ELSE CAST(DATE '2024-01-31' - CAST(p.p_size AS INTEGER) AS STRING) END AS dateposted,
  CAST(DATE '2024-01-01' + CAST(p.p_partkey % 28 AS INTEGER) AS STRING) AS added_at,
  CASE p.p_partkey % 3 WHEN 0 THEN repeat(p.p_name || ' ', 20) WHEN 1 THEN p.p_name END AS job_description,
  'https://' || lower(replace(p.p_brand, '#', '')) || '.example.org/' AS company_url,
  CAST(p.p_size * 10 AS INTEGER) AS views_count, CAST(p.p_partkey % 11 + 1 AS INTEGER) AS job_category_id,
  CASE WHEN p.p_partkey % 6 = 0 THEN 0 ELSE 1 END AS is_active,
  CASE WHEN n.n_nationkey = 0 THEN 1 ELSE 0 END AS exists_in_london,
  CASE WHEN n.n_regionkey = 0 THEN 1 ELSE 0 END AS exists_in_uk,
  CASE WHEN p.p_partkey % 3 = 0 THEN 1 ELSE 0 END AS has_description
FROM {part} p JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25 JOIN {region} r ON r.r_regionkey = n.n_regionkey
""",
    "jobs_docs": """
SELECT d.doc_id AS id, d.text AS job_title, d.source AS organisation_name, d.lang AS location,
  upper(d.lang) AS org_location, CASE WHEN l.doc_id IS NOT NULL THEN d.text END AS job_description,
  CASE d.doc_id % 2 WHEN 0 THEN 'Remote' ELSE 'Full Time' END AS remote_type,
  'Level ' || CAST(d.doc_id % 3 AS STRING) AS experience_level, d.source AS job_source,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 'https://docs.example.org/' || CAST(d.doc_id AS STRING) END AS job_link,
  CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'GBP 1' END AS salary,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 28 AS INTEGER) AS STRING) AS added_at,
  CAST(d.n_chars % 900 AS INTEGER) AS views_count,
  CASE WHEN d.doc_id % 10 = 9 THEN 0 ELSE 1 END AS is_active,
  CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS exists_in_uk,
  CASE WHEN d.lang = 'en' AND d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS exists_in_london,
  CAST(coalesce(l.quality, 0) AS INTEGER) AS has_description
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
""",
    "vectors": "SELECT vec_id AS id, embedding FROM {embeddings}",
    "requests": """
SELECT b.item_id AS query_id, CASE WHEN b.item_id % 10 = 9 THEN ' ' ELSE b.text END AS query,
  CASE WHEN b.item_id % 4 = 1 THEN 'EN' END AS f_location,
  CASE WHEN b.item_id % 6 = 2 THEN 'src1' END AS f_source,
  CASE WHEN b.item_id % 8 = 7 THEN '6' WHEN b.item_id % 8 = 3 THEN 'remote_global' END AS f_category,
  e.embedding AS query_embedding
FROM {benchmark} b LEFT JOIN {embeddings} e ON e.vec_id = b.item_id
""",
    "users": """
SELECT c_custkey AS user_id, c_name AS username, c_custkey % 4 AS membership_status,
  '["' || CAST(c_custkey % 180 AS STRING) || '", "' || CAST((c_custkey * 7) % 180 AS STRING) || '", "x"]' AS saved_jobs
FROM {customer}
""",
    "usage": """
SELECT event_id AS usage_id, user_id, ts AS date,
  CASE WHEN event_type <> 'purchase' THEN event_type END AS search_keywords,
  CASE WHEN event_type = 'view' THEN props END AS filters_applied,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'Acme'
       WHEN event_type = 'purchase' THEN '["Acme", "Globex"]' END AS companies_applied
FROM {events} WHERE event_type IN ('click', 'view', 'purchase')
""",
    "payments": """
SELECT o_orderkey AS payment_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
  CASE WHEN o_orderstatus <> 'P' THEN 'tx-' || CAST(o_orderkey AS STRING) END AS transaction_id,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'success' END AS status, o_orderdate AS created_at
FROM {orders} WHERE o_orderkey % 10 <> 0
""",
    "checkouts": """
SELECT o_orderkey AS event_id, o_custkey AS user_id, CAST(o_orderkey % 3 + 1 AS BIGINT) AS tier,
  'pi-' || CAST(o_orderkey AS STRING) AS transaction_id, CAST(floor(o_totalprice) AS BIGINT) AS amount_total,
  o_orderdate AS event_time
FROM {orders} WHERE o_orderkey % 10 = 0
""",
    "register": """
SELECT CASE WHEN s.s_suppkey % 10 = 3 THEN 'nan' WHEN s.s_suppkey % 10 = 7 THEN ' ' ELSE s.s_name END AS organisation_name,
  CASE WHEN s.s_suppkey % 5 = 0 THEN 'nan' ELSE n.n_name END AS town,
  CASE WHEN s.s_suppkey % 4 = 0 THEN '' ELSE r.r_name || ' ' END AS county, s.s_suppkey AS row_index
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
""",
    "page_urls": """
SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS organisation_name FROM {pages}
""",
    "candidate_links": """
SELECT organisation_name, CAST(page_id AS INTEGER) AS rank, url, 'page ' || CAST(page_id AS STRING) AS title
FROM {page_urls}
""",
    "ranked_links": """
SELECT organisation_name, rank, url, title FROM (SELECT organisation_name, url, title,
    CAST(row_number() OVER (PARTITION BY organisation_name ORDER BY rank) AS INTEGER) AS rank FROM {candidate_links}) x
WHERE rank <= 5
""",
    "org_links": """
SELECT organisation_name,
  max(CASE WHEN rank = 1 THEN url END) AS link_1_url, max(CASE WHEN rank = 1 THEN title END) AS link_1_title,
  max(CASE WHEN rank = 2 THEN url || ' ' END) AS link_2_url, max(CASE WHEN rank = 2 THEN title END) AS link_2_title,
  coalesce(max(CASE WHEN rank = 3 THEN url END), 'nan') AS link_3_url,
  max(CASE WHEN rank = 3 THEN title END) AS link_3_title,
  coalesce(max(CASE WHEN rank = 4 THEN url END), '') AS link_4_url,
  max(CASE WHEN rank = 4 THEN title END) AS link_4_title,
  max(CASE WHEN rank = 5 THEN url END) AS link_5_url, max(CASE WHEN rank = 5 THEN title END) AS link_5_title
FROM {ranked_links} GROUP BY organisation_name
""",
    "fetch_log": """
SELECT page_id AS job_id, CASE WHEN page_id % 17 = 0 THEN '' ELSE url END AS job_link,
  CASE WHEN page_id % 13 = 0 THEN 'ConnectionError' WHEN page_id % 29 = 0 THEN 'Timeout' END AS error,
  CASE WHEN page_id % 26 = 0 THEN NULL WHEN page_id % 9 = 1 THEN 404 WHEN page_id % 9 = 2 THEN 405
       WHEN page_id % 9 = 3 THEN 403 ELSE 200 END AS head_status,
  CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/careers' ELSE url END AS head_final_url,
  CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/careers'
       WHEN page_id % 19 = 0 THEN 'https://elsewhere.example.org/x/y/z' ELSE url END AS final_url,
  CASE WHEN page_id % 10 = 7 THEN 500 ELSE 200 END AS get_status,
  CASE WHEN page_id % 11 = 0 THEN '<p>gone</p>' WHEN page_id % 7 = 0 THEN html || ' This job has expired' ELSE html END
    AS body
FROM {pages}
""",
    "model_outputs": """
SELECT p_partkey AS org_id, 'https://www.jobs.example.org/careers' AS career_url,
  'Jobs found:' || chr(10) || '- ' || p_name || ' | ' || CASE WHEN p_partkey % 4 = 0 THEN 'n/a'
  WHEN p_partkey % 4 = 1 THEN '/jobs/' || CAST(p_partkey AS STRING)
  WHEN p_partkey % 4 = 2 THEN '[apply](https://jobs.example.org/' || CAST(p_partkey AS STRING) || ')'
  ELSE 'https://other.example.net/' || CAST(p_partkey AS STRING) END || ' | London, UK | Not Specified' || chr(10)
  || '- second ' || p_name || ' | https://acme.lever.co/' || CAST(p_partkey AS STRING) AS raw
FROM {part}
""",
    "review_outputs": """
SELECT organisation_name AS org, CASE min(page_id) % 5
  WHEN 0 THEN '**BEST_URL:** ' || min(url) || ',' || chr(10) || '**DECISION:** accept' || chr(10)
    || 'CATEGORY: Own Website.' || chr(10) || 'REASON: looks official.' || chr(10) || 'CONFIDENCE: high'
  WHEN 1 THEN 'DECISION: REJECT' || chr(10) || 'REASON: job board' || chr(10) || 'CONFIDENCE: Medium'
  WHEN 2 THEN 'DECISION: ACCEPT' || chr(10) || 'REASON: only candidate'
  WHEN 3 THEN 'I am not sure about these.'
  ELSE 'best url: ' || max(url) || chr(10) || 'reason: fine' END AS raw,
  min(url) AS first_url, max(url) AS second_url
FROM {page_urls} GROUP BY organisation_name
""",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


class Fixtures:
    """Given tables and adapters of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        ship_package(spark)
        # Let Spark cut the longest lists (3000 rows) before the shuffle too; the model's times are UTC.
        spark.conf.set(GROUP_LIMIT, "3000")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            rows = imports.read_table(self.spark, self.folder, name)
            return imports.spread(rows, HEAVY[name]) if name in HEAVY else rows
        sql = ADAPTERS[name]
        return self.spark.sql(sql, **{n: self.table(n) for n in _names(sql)})

    __getattr__ = table

    def index(self, jobs: str) -> SearchIndex:
        """Search index of an adapter, written once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, jobs)
        if key not in INDEXES:
            INDEXES[key] = SearchIndex.build(self.table(jobs), self.work_folder(), self.table("vectors"))
        return INDEXES[key]

    def requests_table(self) -> DataFrame:
        """Search requests with their filter map."""
        pairs = {"location": "f_location", "job_source": "f_source", "category": "f_category"}
        full = F.create_map(*[x for name, col in pairs.items() for x in (F.lit(name), F.col(col))])
        filled = F.map_filter(full, lambda k, v: v.isNotNull())
        return self.table("requests").withColumn("filters", filled).drop(*pairs.values())

    def work_folder(self) -> str:
        return workdir.shared_folder(self.spark)


def duck(name: str) -> str:
    """DuckDB sub-query of an adapter or table."""
    if name not in ADAPTERS:
        return name
    sql = ADAPTERS[name]
    return "(" + re.sub(r"\{(\w+)\}", lambda m: duck(m.group(1)), sql).strip() + ")"


def with_(*names: str) -> str:
    """`WITH` list of adapters, ending in a comma-free position."""
    return "WITH " + ",\n".join(f"{n} AS {duck(n)}" for n in names)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


def holds_any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {quoted(n.lower())})" for n in needles) + ")"


def tokens_sql(col: str) -> str:
    folded = f"translate(lower(coalesce({col}, '')), {quoted(text.FOLD_FROM)}, {quoted(text.FOLD_TO)})"
    return f"regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+')"


def in_category_sql(category: str, title: str = "job_title") -> str:
    return holds_any(title, fx.SEARCH_CATEGORIES[category])


HOST_SQL = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
PATH_SQL = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def host_sql(col: str) -> str:
    return HOST_SQL.format(col)


def path_sql(col: str) -> str:
    return PATH_SQL.format(col)
