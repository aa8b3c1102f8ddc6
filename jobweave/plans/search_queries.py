"""Retrieval and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import vectors
from jobweave.operators import browse, retrieval, usage
from jobweave.plans.fixtures import DAY_AS_OF, JOBS_AS_OF, holds_any, in_category_sql, tokens_sql, with_
from jobweave.plans.registry import query
from jobweave.plans.table_queries import OPEN_SQL, ORDERS, P

FIELDS = retrieval.INDEX_COLUMNS
DL_SQL = " + ".join(f"len({tokens_sql(c)})" for c in FIELDS)

D = with_("jobs_docs", "vectors", "requests")

CATEGORY_SQL = "CASE f_category WHEN '6' THEN " + in_category_sql("6") + " WHEN 'remote_global' THEN exists_in_uk = 0 ELSE TRUE END"
FILTER_SQL = f"""(f_location IS NULL OR contains(lower(location), lower(f_location))) AND (f_source IS NULL OR job_source = f_source)
  AND {CATEGORY_SQL}"""

NORM_SQL = "trim(regexp_replace(regexp_replace(lower(query), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"

INDEX_SQL = f""", act AS (SELECT *, {DL_SQL} AS dl FROM jobs_docs WHERE is_active = 1),
  cs AS (SELECT count(*) AS n, avg(dl) AS a FROM act),
  q AS (SELECT *, {NORM_SQL} AS norm FROM requests),
  qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({tokens_sql('norm')}) AS term FROM q) x GROUP BY 1, 2),
  tf AS (SELECT id, term, count(*) AS f FROM (SELECT id, unnest({tokens_sql('job_title')}) AS term FROM act) x
    WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS c FROM tf GROUP BY 1),
  w AS (SELECT term, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS idf, a FROM df, cs),
  sc AS (SELECT query_id, tf.id, round(sum(m * idf * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)))), 9) AS bm25_score
    FROM tf JOIN w ON w.term = tf.term JOIN qt ON qt.term = tf.term JOIN act ON act.id = tf.id GROUP BY 1, 2),
  bm AS (SELECT * FROM (SELECT sc.query_id, sc.id, bm25_score, row_number() OVER (PARTITION BY sc.query_id ORDER BY exists_in_london DESC,
      exists_in_uk DESC, CASE WHEN lower(job_title) = norm THEN 1 ELSE 0 END DESC, has_description DESC, bm25_score DESC, sc.id) AS rank
    FROM sc JOIN act ON act.id = sc.id JOIN q ON q.query_id = sc.query_id WHERE {FILTER_SQL}) x WHERE rank <= 50)"""

SEMANTIC_SQL = f""", sm AS (SELECT * FROM (SELECT query_id, id, semantic_score, row_number() OVER (PARTITION BY query_id
      ORDER BY semantic_score DESC, id) AS rank FROM (SELECT q.query_id, act.id, round(list_cosine_similarity(
        CAST(q.query_embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS semantic_score
      FROM act JOIN vectors v ON v.id = act.id, q WHERE q.query_embedding IS NOT NULL AND {FILTER_SQL}) y) x WHERE rank <= 50)"""

FUSE_SQL = """, fu AS (SELECT *, count(br) OVER (PARTITION BY query_id) AS nb, count(sr) OVER (PARTITION BY query_id) AS ns FROM (
    SELECT coalesce(bm.query_id, sm.query_id) AS query_id, coalesce(bm.id, sm.id) AS id, bm.rank AS br, sm.rank AS sr
    FROM bm FULL JOIN sm ON sm.query_id = bm.query_id AND sm.id = bm.id) x),
  hy AS (SELECT query_id, id, br, sr, round(CASE WHEN nb = 0 THEN 0.0::DOUBLE WHEN ns = 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END
      * (1.0::DOUBLE / (60 + coalesce(br, nb + 1))) + CASE WHEN nb = 0 THEN 1.0::DOUBLE WHEN ns = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END
      * (1.0::DOUBLE / (60 + coalesce(sr, ns + 1))), 12) AS hybrid_score FROM fu),
  pl AS (SELECT hy.*, job_title, row_number() OVER (PARTITION BY hy.query_id ORDER BY exists_in_london DESC, exists_in_uk DESC,
      CASE WHEN lower(trim(job_title)) = lower(trim(query)) THEN 1 ELSE 0 END DESC, has_description DESC, hybrid_score DESC, hy.id) AS place
    FROM hy JOIN act ON act.id = hy.id JOIN q ON q.query_id = hy.query_id)"""


@query(
    "idx_build",
    with_("jobs_docs") + ", act AS (SELECT * FROM jobs_docs WHERE is_active = 1) SELECT term, id, field, count(*) AS tf FROM (" + " UNION ALL ".join(
        f"SELECT id, '{c}' AS field, unnest({tokens_sql(c)}) AS term FROM act" for c in FIELDS
    ) + ") x GROUP BY 1, 2, 3",
)
def idx_build(t):
    """The index is written anew each time; its postings are the answer."""
    index = retrieval.SearchIndex.build(t.jobs_docs, t.work_folder())
    return index.places.select("term", "id", "field", F.col("tf").cast("bigint").alias("tf"))


@query(
    "agg_corpus_stats",
    with_("jobs_docs") + f""", act AS (SELECT *, {DL_SQL} AS dl FROM jobs_docs WHERE is_active = 1),
      d AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({tokens_sql('job_title')}) AS term FROM act) x GROUP BY 1)
    SELECT term, df, (SELECT count(*) FROM act) AS n, round((SELECT avg(dl) FROM act), 6) AS avgdl FROM d""",
)
def agg_corpus_stats(t):
    index = t.index("jobs_docs")
    terms = index.terms.filter(F.col("field") == "job_title").select("term", "df")
    return terms.withColumns({"n": index.corpus.select("n").scalar(), "avgdl": F.round(index.corpus.select("avgdl").scalar(), 6)})


@query(
    "join_index_jobs",
    with_("jobs_docs") + f""" SELECT x.id, x.term, count(*) AS tf, j.organisation_name, j.location FROM (SELECT id, unnest({tokens_sql('job_title')}) AS term
      FROM jobs_docs WHERE is_active = 1) x JOIN jobs_docs j ON j.id = x.id WHERE x.term IN ('the', 'de', 'thnd') GROUP BY ALL""",
)
def join_index_jobs(t):
    index = t.index("jobs_docs")
    found = index.of_terms(("the", "de", "thnd")).select("id", "term", F.col("tf").cast("bigint").alias("tf"))
    return found.join(index.docs.select("id", "organisation_name", "location"), "id")


@query("search_bm25", D + INDEX_SQL + " SELECT query_id, id, rank, round(bm25_score, 6) AS bm25_score FROM bm")
def search_bm25(t):
    found = retrieval.search_bm25(t.requests_table(), t.index("jobs_docs"))
    return found.select("query_id", "id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


CHANGED_SQL = """, changed AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 0 ELSE is_active END AS is_active) FROM jobs_docs)"""


def refreshed(t):
    """An index of two thirds of the jobs, some with titles of old, after two refreshes with all that is new, changed or gone."""
    now = t.jobs_docs.withColumn("is_active", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("is_active")))
    stale = F.when(F.col("id") % 7 == 0, F.concat(F.lit("the old title of data_"), "job_title")).otherwise(F.col("job_title"))
    index = retrieval.SearchIndex.build(t.jobs_docs.filter("id % 3 <> 0").withColumn("job_title", stale), t.work_folder(), t.vectors.filter("id % 5 <> 0"))
    changes = now.filter("id % 3 = 0 OR id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0")
    for half in (0, 1):
        index = index.refresh(changes.filter(F.col("id") % 2 == half), t.vectors)
    return index


@query(
    "search_bm25_refreshed",
    D + CHANGED_SQL + INDEX_SQL.replace("FROM jobs_docs", "FROM changed") + " SELECT query_id, id, rank, round(bm25_score, 6) AS bm25_score FROM bm",
)
def search_bm25_refreshed(t):
    found = retrieval.search_bm25(t.requests_table(), refreshed(t))
    return found.select("query_id", "id", "rank", F.round("bm25_score", 6).alias("bm25_score"))


@query(
    "search_semantic_refreshed",
    D + CHANGED_SQL + (INDEX_SQL + SEMANTIC_SQL).replace("FROM jobs_docs", "FROM changed")
    + " SELECT query_id, id, rank, round(semantic_score, 6) AS semantic_score FROM sm",
)
def search_semantic_refreshed(t):
    found = retrieval.search_semantic(t.requests_table(), refreshed(t))
    return found.select("query_id", "id", "rank", F.round("semantic_score", 6).alias("semantic_score"))


PHRASES = ((101, "the_old thnd"), (102, "de_the"), (103, "of_the the_of data"), (104, "in_the_city"))
PHRASE_SQL = f""", act AS (SELECT *, {DL_SQL} AS dl FROM jobs_docs WHERE is_active = 1),
  cs AS (SELECT count(*) AS n, avg(dl) AS a FROM act),
  toks AS (SELECT id, {tokens_sql('job_title')} AS x FROM act),
  q AS (SELECT query_id, unnest(string_split(query, ' ')) AS word FROM (VALUES {', '.join(f"(CAST({i} AS BIGINT), '{w}')" for i, w in PHRASES)}) v(query_id, query)),
  ws AS (SELECT DISTINCT word, string_split(word, '_') AS parts FROM q),
  tf AS (SELECT word, id, len(list_filter(range(1, len(x) + 1), lambda i: x[i:i + len(parts) - 1] = parts)) AS f FROM ws, toks),
  df AS (SELECT word, count(*) AS c FROM tf WHERE f > 0 GROUP BY 1),
  w AS (SELECT word, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS idf, a FROM df, cs),
  sc AS (SELECT query_id, tf.id, round(sum(idf * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)))), 9) AS bm25_score
    FROM q JOIN tf ON tf.word = q.word AND f > 0 JOIN w ON w.word = q.word JOIN act ON act.id = tf.id GROUP BY 1, 2)
  SELECT query_id, id, round(bm25_score, 6) AS bm25_score FROM sc"""


@query("search_phrases", with_("jobs_docs") + PHRASE_SQL)
def search_phrases(t):
    """Words with `_` are phrases; all hits of each request."""
    rows = [(i, q) for i, q in PHRASES]
    asked = t.spark.createDataFrame(rows, "query_id bigint, query string").withColumn("filters", F.create_map().cast("map<string,string>"))
    found = retrieval.search_bm25(asked, t.index("jobs_docs"), candidates=None)
    return found.select("query_id", "id", F.round("bm25_score", 6).alias("bm25_score"))


@query(
    "vec_cosine",
    """SELECT a.vec_id AS id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vec_cosine(t):
    a = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = t.embeddings.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("b"))
    both = a.join(b, F.col("other_id") == F.col("id") + 1)
    return both.select("id", "other_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(
    "search_semantic",
    D + INDEX_SQL + SEMANTIC_SQL + " SELECT query_id, id, rank, round(semantic_score, 6) AS semantic_score FROM sm",
)
def search_semantic(t):
    found = retrieval.search_semantic(t.requests_table(), t.index("jobs_docs"))
    return found.select("query_id", "id", "rank", F.round("semantic_score", 6).alias("semantic_score"))


PLAIN_SEMANTIC_SQL = """SELECT query_id, id, round(semantic_score, 6) AS semantic_score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY semantic_score DESC, id) AS rank FROM (SELECT r.query_id, v.id, round(list_cosine_similarity(
      CAST(r.query_embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS semantic_score FROM requests r, vectors v
      WHERE r.query_embedding IS NOT NULL) y) x WHERE rank <= 50"""


@query("join_query_vectors", with_("vectors", "requests") + " " + PLAIN_SEMANTIC_SQL)
def join_query_vectors(t):
    """Every query against every vector, by blocks: each task keeps its best 50 per query."""
    blank = {c: F.lit("") for c in retrieval.VECTOR_CARRIED}
    pool = t.vectors.withColumns({**blank, "exists_in_uk": F.lit(0)})
    asked = t.requests_table().withColumn("filters", F.create_map().cast("map<string,string>"))
    found = retrieval.nearest(asked, pool, max_broadcast_queries=0, block_queries=64, block_vectors=1024)
    return found.select("query_id", "id", F.round("semantic_score", 6).alias("semantic_score"), "rank")


def _lists(t):
    asked = t.requests_table()
    index = t.index("jobs_docs")
    return retrieval.search_bm25(asked, index), retrieval.search_semantic(asked, index)


HEAD = D + INDEX_SQL + SEMANTIC_SQL + FUSE_SQL


@query("join_rank_lists", HEAD + " SELECT query_id, id, br AS bm25_rank, sr AS semantic_rank, round(hybrid_score, 9) AS hybrid_score FROM hy")
def join_rank_lists(t):
    fused = retrieval.fuse(*_lists(t))
    return fused.select("query_id", "id", "bm25_rank", "semantic_rank", F.round("hybrid_score", 9).alias("hybrid_score"))


@query(
    "score_rrf",
    HEAD + " SELECT query_id, id, rank, round(1.0 / (60 + rank), 9) AS rrf FROM sm",
)
def score_rrf(t):
    found = retrieval.search_semantic(t.requests_table(), t.index("jobs_docs"))
    return found.select("query_id", "id", "rank", F.round(retrieval.score_rrf(F.col("rank")), 9).alias("rrf"))


@query("set_candidate_union", HEAD + " SELECT query_id, id FROM bm UNION SELECT query_id, id FROM sm")
def set_candidate_union(t):
    bm25, semantic = _lists(t)
    return bm25.select("query_id", "id").union(semantic.select("query_id", "id")).distinct()


@query(
    "win_rank",
    with_("jobs_docs") + """ SELECT * FROM (SELECT location, id, row_number() OVER (PARTITION BY location ORDER BY length(job_title) DESC, id) AS rank
      FROM jobs_docs WHERE is_active = 1) x WHERE rank <= 50""",
)
def win_rank(t):
    from jobweave.functions.skew import top_k

    scored = t.jobs_docs.filter("is_active = 1").select("location", "id", F.length("job_title").alias("score"))
    return top_k(scored, ["location"], [F.desc("score"), F.asc("id")], 50, F.col("id")).drop("score")


@query("sort_search", HEAD + " SELECT query_id, id, place FROM pl WHERE place <= 100")
def sort_search(t):
    found = retrieval.search_hybrid(t.requests_table(), t.index("jobs_docs"), limit=100, min_score=0.0)
    return found.select("query_id", "id", "place")


@query(
    "search_hybrid",
    HEAD + " SELECT query_id, id, place, br AS bm25_rank, sr AS semantic_rank, round(hybrid_score, 9) AS hybrid_score FROM pl WHERE place <= 20",
)
def search_hybrid(t):
    found = retrieval.search_hybrid(t.requests_table(), t.index("jobs_docs"))
    return found.select(
        "query_id", "id", "place", "bm25_rank", "semantic_rank", F.round("hybrid_score", 9).alias("hybrid_score")
    )


@query(
    "search",
    HEAD + f""", found AS (SELECT query_id, id, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank
        FROM pl WHERE place <= 40 AND NOT {holds_any('job_title', fx.COURSE_WORDS)}),
      br AS (SELECT query_id, j.id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDERS['relevance'].replace(' id ', ' j.id ')}) AS rank
        FROM q JOIN jobs_docs j ON trim(query) = '' AND {OPEN_SQL} AND {FILTER_SQL})
    SELECT f.query_id, id, rank, round(hybrid_score, 9) AS hybrid_score FROM found f JOIN q ON q.query_id = f.query_id
      WHERE rank <= 20 AND trim(query) <> ''
    UNION ALL SELECT query_id, id, rank, 1.0 FROM br WHERE rank <= 20""",
)
def search(t):
    found = retrieval.search(t.requests_table(), t.index("jobs_docs"), t.jobs_docs)
    return found.withColumn("hybrid_score", F.round("hybrid_score", 9))


QUALITY_SQL = f"""CASE WHEN days < 7 THEN 0.3 WHEN days < 30 THEN 0.2 WHEN days < 60 THEN 0.1 ELSE 0 END
  + CASE WHEN length(job_description) > 100 THEN 0.2 ELSE 0 END + CASE WHEN salary NOT IN ('Not Specified', '') THEN 0.15 ELSE 0 END
  + CASE WHEN views_count > 0 THEN least(0.15, views_count / 1000.0) ELSE 0 END + CASE WHEN remote_type IN ('Remote', 'Hybrid') THEN 0.1 ELSE 0 END"""
AGED_SQL = f"""SELECT *, floor(date_diff('second', TRY_CAST(dateposted AS TIMESTAMP), TIMESTAMP '{JOBS_AS_OF}') / 86400.0) AS days FROM jobs_part"""


@query(
    "browse",
    P + f""", a AS ({AGED_SQL}) SELECT id, job_title, exists_in_london, exists_in_uk, CAST(1.0 AS DOUBLE) AS hybrid_score,
      round(CAST({QUALITY_SQL} AS DOUBLE), 6) AS quality_score FROM a WHERE {OPEN_SQL} AND contains(lower(org_location), 'a')
      ORDER BY {ORDERS['relevance']} LIMIT 200""",
)
def browse_query(t):
    rows = browse.browse(t.jobs_part, JOBS_AS_OF, {"org_location": "A"}, limit=200)
    return rows.select(
        "id", "job_title", "exists_in_london", "exists_in_uk", "hybrid_score", F.round("quality_score", 6).alias("quality_score")
    )


@query("score_quality", P + f", a AS ({AGED_SQL}) SELECT id, round(CAST({QUALITY_SQL} AS DOUBLE), 6) AS quality_score FROM a")
def score_quality(t):
    return t.jobs_part.select("id", F.round(browse.quality_score(JOBS_AS_OF), 6).alias("quality_score"))


TYPED = """SELECT s_suppkey AS query_id, CASE s_suppkey % 6 WHEN 0 THEN ' Ring' WHEN 1 THEN 'WIDGET' WHEN 2 THEN 'e' WHEN 3 THEN 'l b'
  WHEN 4 THEN 'zzz' ELSE 're' END AS query FROM {supplier}"""
TYPED_PLACES = """SELECT s_suppkey AS query_id, 'nation_' || CAST(s_suppkey % 5 AS STRING) AS query FROM {supplier}"""


def _suggest_sql(typed: str, column: str) -> str:
    return f"""SELECT query_id, query, value, rank FROM (SELECT t.query_id, trim(t.query) AS query, v.value, row_number() OVER
      (PARTITION BY t.query_id ORDER BY v.value) AS rank FROM ({typed.format(supplier='supplier')}) t JOIN (SELECT DISTINCT {column} AS value
        FROM jobs_part WHERE is_active = 1) v ON contains(lower(v.value), lower(trim(t.query))) WHERE length(trim(t.query)) >= 2) x WHERE rank <= 8"""


@query(
    "suggest",
    P + f" SELECT 'title' AS kind, * FROM ({_suggest_sql(TYPED, 'job_title')}) a UNION ALL SELECT 'location', * FROM ({_suggest_sql(TYPED_PLACES, 'location')}) b",
)
def suggest(t):
    titles = browse.suggest(t.spark.sql(TYPED, supplier=t.supplier), t.jobs_part, "job_title")
    places = browse.suggest(t.spark.sql(TYPED_PLACES, supplier=t.supplier), t.jobs_part, "location")
    both = titles.withColumn("kind", F.lit("title")).unionByName(places.withColumn("kind", F.lit("location")))
    return both.select("kind", "query_id", "query", "value", "rank")


ASKED = """SELECT c_custkey AS query_id, c_custkey AS user_id, ' ' AS query, CAST(c_custkey % 3 + 1 AS INTEGER) AS page, 10 AS page_limit,
  CASE c_custkey % 5 WHEN 0 THEN 'uk' WHEN 1 THEN 'london' ELSE '' END AS location_filter,
  CASE c_custkey % 7 WHEN 1 THEN 'Remote' WHEN 2 THEN 'Hybrid' END AS f_remote,
  CASE c_custkey % 11 WHEN 1 THEN 'Nation_2' WHEN 2 THEN '1' END AS f_location,
  CASE c_custkey % 13 WHEN 1 THEN '14' WHEN 2 THEN 'remote_global' END AS f_category FROM {customer}"""


@query(
    "search_listing",
    with_("jobs_part", "users") + f""", r AS (SELECT a.*, u.membership_status AS tier FROM ({ASKED.format(customer='customer')}) a
        JOIN users u ON u.user_id = a.user_id),
      m AS (SELECT r.*, j.id, exists_in_uk, exists_in_london, row_number() OVER (PARTITION BY query_id
          ORDER BY {ORDERS['relevance'].replace(' id ', ' j.id ')}) AS n FROM r JOIN jobs_part j ON {OPEN_SQL}
          AND (f_remote IS NULL OR remote_type = f_remote) AND (f_location IS NULL OR contains(lower(j.location), lower(f_location)))
          AND CASE f_category WHEN '14' THEN {in_category_sql('14')} WHEN 'remote_global' THEN exists_in_uk = 0 ELSE TRUE END),
      s AS (SELECT query_id, id, tier, page, page_limit, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank, count(*) OVER (PARTITION BY query_id) AS found FROM m
        WHERE n <= CASE WHEN tier = 0 THEN 200 WHEN tier = 1 THEN 1000 ELSE 3000 END
          AND CASE location_filter WHEN 'uk' THEN exists_in_uk = 1 WHEN 'london' THEN exists_in_london = 1 ELSE TRUE END),
      c AS (SELECT r.query_id, tier, page, page_limit, coalesce(s.found, 0) AS found, least(coalesce(s.found, 0),
          CASE tier WHEN 0 THEN 3 WHEN 1 THEN 1000 WHEN 2 THEN 3000 ELSE 1000000 END) AS total
        FROM r LEFT JOIN (SELECT DISTINCT query_id, found FROM s) s ON s.query_id = r.query_id),
      p AS (SELECT query_id, total, CAST(greatest(1, ceil(total / CAST(page_limit AS DOUBLE))) AS BIGINT) AS total_pages, tier, page, page_limit, found FROM c)
    SELECT s.query_id, CAST(s.id AS VARCHAR) AS id, job_title, organisation_name, org_location, location, remote_type, experience_level, salary,
      dateposted, job_description, job_link, company_url, job_source, CAST(1.0 AS DOUBLE) AS hybrid_score, views_count, FALSE AS is_blurred, s.rank,
      p.total, p.total_pages
      FROM s JOIN p ON p.query_id = s.query_id JOIN jobs_part j ON j.id = s.id
      WHERE rank <= total AND rank > (s.page - 1) * s.page_limit AND rank <= s.page * s.page_limit
    UNION ALL SELECT query_id, 'dummy-' || CAST(k AS VARCHAR), 'Premium Job Listing', 'Unlock to View', NULL, 'Hidden', NULL, NULL, NULL,
      NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE, NULL, total, total_pages FROM (
      SELECT *, unnest(generate_series(0, least(page_limit - total, found - 3) - 1)) AS k FROM p WHERE tier = 0 AND page = 1 AND found > 3) d""",
)
def search_listing(t):
    asked = t.spark.sql(ASKED, customer=t.customer)
    pairs = {"remote_type": "f_remote", "location": "f_location", "category": "f_category"}
    full = F.create_map(*[x for name, col in pairs.items() for x in (F.lit(name), F.col(col))])
    asked = asked.withColumn("filters", F.map_filter(full, lambda k, v: v.isNotNull())).drop(*pairs.values())
    asked = asked.join(t.vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")
    return retrieval.search_listing(asked, t.users, t.index("jobs_part"), t.jobs_part)


LOG_SQL = """, lg AS (SELECT query_id % 50 AS user_id, trim(query) AS search_keywords, nullif('{' || concat_ws(',',
    '"category":"' || f_category || '"', '"job_source":"' || f_source || '"', '"location":"' || f_location || '"') || '}', '{}') AS filters_applied
  FROM requests WHERE query_id % 50 <> 0 AND trim(query) <> '')"""


def _logged(t):
    asked = t.requests_table().withColumn("user_id", F.col("query_id") % 50)
    return usage.search_log(asked, F.lit(DAY_AS_OF).cast("timestamp_ntz"))


@query("search_log", with_("requests") + LOG_SQL + f" SELECT *, TIMESTAMP '{DAY_AS_OF}' AS date FROM lg")
def search_log(t):
    """Usage rows that the requests leave."""
    return _logged(t)


@query(
    "search_quota",
    with_("requests", "users", "usage") + LOG_SQL + f""", d AS (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM lg
        UNION ALL SELECT user_id FROM usage WHERE date >= date_trunc('day', TIMESTAMP '{DAY_AS_OF}')) x GROUP BY 1)
    SELECT u.user_id, coalesce(n, 0) AS search_count, CASE WHEN membership_status >= 1 THEN -1 ELSE 10 END AS "limit",
      CASE WHEN membership_status >= 1 THEN -1 ELSE greatest(0, 10 - coalesce(n, 0)) END AS remaining, membership_status >= 1 AS is_premium,
      membership_status < 1 AND coalesce(n, 0) >= 10 AS at_limit FROM users u LEFT JOIN d ON d.user_id = u.user_id""",
)
def search_quota(t):
    """Quotas after the requests: their log rows count beside those that are there."""
    log = t.usage.unionByName(_logged(t), allowMissingColumns=True)
    return usage.user_quota(t.users, log, DAY_AS_OF)


FETCH_SQL = "CASE WHEN tier = 0 THEN 200 WHEN tier = 1 THEN 1000 ELSE 3000 END"
CAP_SQL = "CASE tier WHEN 0 THEN 3 WHEN 1 THEN 1000 WHEN 2 THEN 3000 ELSE 1000000 END"


@query(
    "search_listing_text",
    with_("jobs_docs", "vectors", "requests", "users") + INDEX_SQL + SEMANTIC_SQL + FUSE_SQL + f""",
      r AS (SELECT q.query_id, query, u.membership_status AS tier, CAST(1 + q.query_id % 2 AS INTEGER) AS page, 10 AS page_limit,
        CASE WHEN q.query_id % 3 = 0 THEN 'uk' ELSE '' END AS location_filter FROM q JOIN users u ON u.user_id = q.query_id),
      an AS (SELECT pl.query_id, id, row_number() OVER (PARTITION BY pl.query_id ORDER BY place) AS n FROM pl JOIN q ON q.query_id = pl.query_id
          WHERE trim(query) <> '' AND NOT {holds_any('job_title', fx.COURSE_WORDS)}
        UNION ALL SELECT query_id, j.id, row_number() OVER (PARTITION BY query_id ORDER BY {ORDERS['relevance'].replace(' id ', ' j.id ')})
          FROM q JOIN jobs_docs j ON trim(query) = '' AND {OPEN_SQL} AND {FILTER_SQL}),
      s AS (SELECT r.*, an.id, row_number() OVER (PARTITION BY r.query_id ORDER BY n) AS rank, count(*) OVER (PARTITION BY r.query_id) AS found
        FROM an JOIN r ON r.query_id = an.query_id JOIN jobs_docs j ON j.id = an.id
        WHERE n <= {FETCH_SQL} AND (location_filter <> 'uk' OR exists_in_uk = 1)),
      p AS (SELECT r.*, coalesce(f.found, 0) AS found, least(coalesce(f.found, 0), {CAP_SQL}) AS total FROM r
        LEFT JOIN (SELECT DISTINCT query_id, found FROM s) f ON f.query_id = r.query_id),
      z AS (SELECT *, CAST(greatest(1, ceil(total / CAST(page_limit AS DOUBLE))) AS BIGINT) AS total_pages FROM p)
    SELECT s.query_id, CAST(s.id AS VARCHAR) AS id, s.rank, FALSE AS is_blurred, z.total, z.total_pages FROM s JOIN z ON z.query_id = s.query_id
      WHERE rank <= total AND rank > (s.page - 1) * s.page_limit AND rank <= s.page * s.page_limit
    UNION ALL SELECT query_id, 'dummy-' || CAST(k AS VARCHAR), NULL, TRUE, total, total_pages FROM (
      SELECT *, unnest(generate_series(0, least(page_limit - total, found - 3) - 1)) AS k FROM z WHERE tier = 0 AND page = 1 AND found > 3) d""",
)
def search_listing_text(t):
    """Text and blank requests together, over the documents."""
    asked = t.requests_table().withColumns(
        {
            "user_id": F.col("query_id"),
            "page": (F.col("query_id") % 2 + 1).cast("int"),
            "page_limit": F.lit(10),
            "location_filter": F.when(F.col("query_id") % 3 == 0, "uk").otherwise(""),
        }
    )
    rows = retrieval.search_listing(asked, t.users, t.index("jobs_docs"), t.jobs_docs)
    return rows.select("query_id", "id", "rank", "is_blurred", "total", "total_pages")


def letter_counts(texts):
    """Stand-in for a model: how often each of a to z occurs."""
    return [[value.lower().count(letter) for letter in "abcdefghijklmnopqrstuvwxyz"] for value in texts]


@query(
    "embed_backfill",
    with_("jobs_docs", "vectors") + """ SELECT id, 26 AS embedding_dimension, CAST(length(regexp_replace(lower(concat_ws(' ', job_title,
      coalesce(job_description, ''), organisation_name, location, experience_level, remote_type)), '[^a-z]', '', 'g')) AS DOUBLE) AS total
    FROM jobs_docs WHERE is_active = 1 AND id NOT IN (SELECT id FROM vectors WHERE id % 2 = 0)""",
)
def embed_backfill(t):
    """Vectors with an odd id count as missing, so there is work in every data folder."""
    made = retrieval.embed_backlog(t.jobs_docs, t.vectors.filter("id % 2 = 0"), letter_counts)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select("id", "embedding_dimension", total.alias("total"))
