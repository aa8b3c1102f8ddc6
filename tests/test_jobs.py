import datetime

import pytest
from pyspark.sql import functions as F

from jobweave.functions import text, urls
from jobweave.functions.skew import GROUP_LIMIT, join_unique, salted_join, top_k
from jobweave.operators import browse, filters, liveness, projections, usage
from jobweave.sources import imports, schema

AS_OF = "2024-03-01 00:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_vague_titles(make_jobs):
    titles = ["Test", "IT", "it", "ab", "A", "My testing job title 3", "Tester", "HR", None, "Julia"]
    found = filters.with_vague_title(make_jobs(*[{"job_title": t} for t in titles]))
    assert ids(found) == [1, 4, 5, 6, 10]


def test_category_is_a_substring_test(make_jobs):
    jobs = make_jobs({"job_title": "Recruiter"}, {"job_title": "Chef"}, {"job_title": "SITE MANAGER", "exists_in_uk": 1})
    assert ids(filters.in_category(jobs, "1")) == [1, 3]
    assert ids(filters.in_category(jobs, "99")) == [1, 2, 3]
    assert ids(filters.in_category(jobs, "remote_global")) == [1, 2]


def test_literal_and_wildcard_filters(make_jobs):
    jobs = make_jobs({"location": "100% Remote"}, {"location": "100 miles"})
    assert ids(filters.apply_filters(jobs, {"location": "100% r"})) == [1]
    assert ids(filters.apply_filters(jobs, {"location": "0%m"}, wildcards=True)) == [1, 2]


def test_course_rules_treat_missing_titles_differently(make_jobs):
    jobs = make_jobs({"job_title": None}, {"job_title": "Student"}, {"job_title": "Bootcamp"}, {"job_title": "Nurse"})
    assert ids(filters.without_courses(jobs)) == [4]
    assert ids(jobs.filter(~filters.is_course(F.col("job_title")))) == [1, 3, 4]


@pytest.mark.parametrize(
    ("posted", "days"), [("2024-02-24", 0.3), ("2024-02-23", 0.2), ("2024-02-01", 0.2), ("2024-01-31", 0.1),
                         ("2024-01-02", 0.1), ("2024-01-01", 0.0), ("soon", 0.0), (None, 0.0)]
)
def test_quality_recency(make_jobs, posted, days):
    jobs = make_jobs({"dateposted": posted, "salary": "Not Specified"})
    assert jobs.select(browse.quality_score(AS_OF)).first()[0] == pytest.approx(days)


def test_quality_parts(make_jobs):
    jobs = make_jobs(
        {"views_count": 100, "remote_type": "Remote", "salary": "GBP 1", "job_description": "x" * 101},
        {"views_count": 1000}, {"views_count": 0, "salary": "", "job_description": "x" * 100},
    )
    scores = [r[0] for r in jobs.orderBy("id").select(browse.quality_score(AS_OF)).collect()]
    assert scores == pytest.approx([0.55, 0.15, 0.0])


def test_browse_orders_and_filters(make_jobs):
    jobs = make_jobs(
        {"job_title": "b", "added_at": "2024-01-02"},
        {"job_title": "a", "added_at": "2024-01-02"},
        {"job_title": "c", "added_at": None, "exists_in_uk": 1},
        {"job_title": "d", "job_link": ""},
        {"job_title": "e", "is_active": 0},
    )
    rows = browse.browse(jobs, AS_OF).collect()
    assert [r["id"] for r in rows] == [3, 2, 1]
    assert [r["id"] for r in browse.browse(jobs, AS_OF, scope="uk").collect()] == [3]
    assert [r["id"] for r in browse.browse(jobs, AS_OF, limit=1, sort_by="date").collect()] == [3]


def test_dedup_is_idempotent_and_keeps_lowest(make_jobs, values):
    jobs = make_jobs(
        {"job_title": " Nurse ", "organisation_name": "ACME", "is_active": 0},
        {"job_title": "nurse", "organisation_name": "Acme"},
        {"job_title": "nurse", "organisation_name": "acme "},
        {"job_title": "nurse", "organisation_name": None},
        {"job_title": "nurse", "organisation_name": None},
    )
    once = liveness.keep_first(jobs)
    assert values(once, "id", "is_active", "deactivation_reason") == [
        (1, 0, None), (2, 0, "duplicate"), (3, 0, "duplicate"), (4, 1, None), (5, 0, "duplicate"),
    ]
    assert values(liveness.keep_first(once), *once.columns) == values(once)
    assert values(liveness.keep_first(jobs, active_only=True), "id", "is_active")[:3] == [(1, 0), (2, 1), (3, 0)]
    groups = liveness.duplicate_groups(jobs)
    assert values(groups, "id", "kept_id", "copies") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)]


LOG = "job_id bigint, job_link string, head_status int, head_final_url string, get_status int, final_url string, body string, error string"
LINK = "https://a.co.uk/jobs/1"
LONG = "x" * 600


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((None, 200, None, 200, None, LONG, None), "null_or_invalid_link"),
        (("ftp://x", 200, None, 200, None, LONG, None), "null_or_invalid_link"),
        ((LINK, 404, None, 200, None, LONG, None), "http_404"),
        ((LINK, None, None, None, None, None, "SSLError"), "ssl_error"),
        ((LINK, None, None, None, None, None, "Timeout"), "timeout"),
        ((LINK, 200, LINK, None, None, None, "Timeout"), "timeout_get"),
        ((LINK, None, None, None, None, None, "boom " * 40), "head_error: " + ("boom " * 40)[:80]),
        ((LINK, 200, "https://a.co.uk/", 200, None, LONG, None), "redirect_to_generic_page"),
        ((LINK, 405, "https://a.co.uk/", 200, LINK, LONG, None), "alive"),
        ((LINK, 500, LINK, 500, LINK, LONG, None), "http_500"),
        ((LINK, 200, LINK, 200, "https://b.co.uk/jobs/1", LONG, None), "redirect_to_generic_page"),
        ((LINK, 200, LINK, 200, "https://a.co.uk/Careers/", LONG, None), "redirect_to_generic_page"),
        ((LINK, 200, LINK, 200, LINK, " " * 600 + "hi", None), "tiny_page (2 chars)"),
        ((LINK, 200, LINK, 200, LINK, LONG + "Job has EXPIRED, position filled", None), 'expired_on_page: "position filled"'),
        ((LINK, 200, LINK, 200, LINK, LONG + "session expired job closed", None), "expired_on_page: session expired"),
        ((LINK, 200, LINK, 200, LINK, LONG + '"postingAvailable": false', None), "expired_on_page: postingAvailable is false"),
        ((LINK, 200, LINK, 200, LINK, LONG, None), "alive"),
    ],
)
def test_verdicts(spark, row, reason):
    judged = liveness.verdicts(spark.createDataFrame([(1, *row)], LOG)).collect()
    assert [(r["reason"], r["is_alive"]) for r in judged] == [(reason, int(reason == "alive"))]


def test_apply_verdicts(spark, make_jobs, values):
    jobs = imports.with_columns(make_jobs({}, {}, {}), {"deactivation_reason": "string", "last_health_check": "timestamp_ntz"})
    judged = spark.createDataFrame([(1, 1, "alive"), (2, 0, "http_404")], "job_id bigint, is_alive int, reason string")
    after = liveness.apply_verdicts(jobs, judged, AS_OF).withColumn("seen", F.col("last_health_check").isNotNull())
    assert values(after, "id", "is_active", "deactivation_reason", "seen") == [
        (1, 1, None, True), (2, 0, "http_404", True), (3, 1, None, False),
    ]
    assert values(liveness.apply_verdicts(jobs, judged, AS_OF, dry_run=True)) == values(jobs)


def test_enrichment_takes_the_first_listed_word(make_jobs, values):
    titles = ["Support software", "HR admin (part-time intern)", "chef", None, "Contractor"]
    got = values(liveness.enrich_ids(make_jobs(*[{"job_title": t} for t in titles])), "id", "job_category_id", "job_type_id")
    assert got == [(1, 1, 1), (2, 6, 2), (3, 11, 1), (4, 11, 1), (5, 11, 3)]


def test_uk_places(spark):
    assert one(spark, liveness.uk_location(F.lit("Kyiv, Ukraine")))
    assert not one(spark, liveness.uk_location(F.lit("Kyiv, Ukraine"), word_boundary=True))
    assert one(spark, liveness.uk_location(F.lit("London, UK"), word_boundary=True))
    assert not one(spark, liveness.uk_location(F.lit(None).cast("string")))


def test_import(spark, values):
    raw = spark.createDataFrame(
        [("Nurse", "true", "3.0", "London, UK"), (" ", "TRUE", "1", "x"), (None, "TRUE", "1", "x"), ("Chef", None, None, None)],
        " ` JOB_TITLE` string, IS_ACTIVE string, `VIEWS_COUNT ` string, LOCATION string".strip(),
    )
    got = values(imports.import_jobs(raw), "job_title", "is_active", "views_count", "exists_in_uk", "exists_in_london")
    assert got == [("Chef", 0, 0, 0, 0), ("Nurse", 1, 3, 1, 1)]


def test_write_modes(make_jobs, spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert imports.write_jobs(make_jobs({}, {}), path)
    assert not imports.write_jobs(make_jobs({}), path)
    assert spark.read.parquet(path).count() == 2
    assert imports.write_jobs(make_jobs({}), path, force=True)
    assert spark.read.parquet(path).count() == 1


def test_urls(spark):
    def clean(url):
        return one(spark, urls.sanitise(F.lit(url)))

    assert clean("https://a.org/x") == "https://a.org/x"
    assert clean("https://example.com/x") is None and clean("a.org") is None and clean("http://localhost/") is None
    assert one(spark, urls.unwrap_markdown(F.lit(" [x](https://a.org/1) "))) == "https://a.org/1"
    job = "https://acme.wd1.myworkdayjobs.com/en-US/Site/job/London/Nurse_R1"
    api = "https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Site/job/London/Nurse_R1"
    assert one(spark, urls.ats_job_api(F.lit(job))) == api
    assert one(spark, urls.ats_job_api(F.lit("https://a.org"))) is None
    assert one(spark, urls.in_scope(F.lit("https://www.a.org/1"), F.lit("https://jobs.a.org")))
    assert not one(spark, urls.in_scope(F.lit("https://ba.org/1"), F.lit("https://a.org")))


def test_text(spark):
    assert one(spark, text.normalise_query(F.lit(" C++ /  Über_dev! "))) == "c über_dev"
    assert one(spark, text.tokens(F.lit("Éa_b, c2 ZÜRICH"))) == ["ea", "b", "c2", "zurich"]
    made = projections.clean_description(F.lit("Here is Option 1: \"a: b\" "))
    assert one(spark, made) == "a: b"
    assert one(spark, projections.org_location(F.lit(""), F.lit("Kent"))) == "Kent"
    assert one(spark, projections.age_label(F.lit("2024-02-29"), AS_OF)) == "1 Day Ago"
    assert one(spark, projections.age_label(F.lit("2024-03-01"), AS_OF)) == "Today"
    assert one(spark, projections.age_label(F.lit("soon"), AS_OF)) == ""


def test_featured_takes_newest_then_most_viewed(make_jobs):
    shown = {"location": "London", "exists_in_uk": 1}
    jobs = make_jobs(
        {"job_title": "a", "dateposted": "2024-01-01", "views_count": 9, **shown},
        {"job_title": "a", "dateposted": "2024-01-02", "views_count": 1, **shown},
        {"job_title": "b", "dateposted": "2024-01-02", "views_count": 5, **shown},
        {"job_title": "b", "dateposted": "2024-01-02", "views_count": 5, **shown},
        {"job_title": "c", "location": "Paris", "exists_in_uk": 1},
    )
    assert [r["id"] for r in browse.featured(jobs).collect()] == [3, 2]


@pytest.mark.parametrize(
    ("page", "total", "shown"), [(1, 1, []), (1, 5, [1, 2, 3, 4, 5]), (10, 30, list(range(6, 16))), (30, 30, list(range(21, 31)))]
)
def test_page_window(spark, page, total, shown):
    lists = spark.createDataFrame([(page, total)], "page bigint, total_pages bigint")
    assert sorted(r["page_number"] for r in browse.page_window(lists).collect()) == shown


def test_quota_limits(spark, values):
    users = spark.createDataFrame([(9, 0), (10, 0), (11, 0), (12, 2), (13, None)], "user_id bigint, membership_status int")
    rows = [(u, "2024-03-01 00:00:00") for u in (9, 10, 11, 12) for _ in range(u)] + [(13, "2024-02-29 23:59:59")]
    log = spark.createDataFrame(rows, "user_id bigint, date string").withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = values(usage.user_quota(users, log, "2024-03-01 12:00:00"), "user_id", "remaining", "at_limit", "search_count")
    assert got == [(10, 0, True, 10), (11, 0, True, 11), (12, -1, False, 12), (13, 10, False, 0), (9, 1, False, 9)]


def test_saved_jobs_skip_bad_entries(spark, make_jobs, values):
    users = spark.createDataFrame([(1, '["1", "x", "2", "1"]'), (2, None), (3, "oops")], "user_id bigint, saved_jobs string")
    got = values(usage.saved_jobs(users, make_jobs({}, {"is_active": 0})), "user_id", "id", "saved_count")
    assert got == [(1, 1, 1)]


def test_suggest_matches_substrings(spark, make_jobs, values):
    jobs = make_jobs(*[{"job_title": t} for t in ("Nurse", "Night nurse", "Driver", "Ünur", None)], {"job_title": "nurse x", "is_active": 0})
    asked = spark.createDataFrame([(1, "NUR"), (2, "n"), (3, "ght n"), (4, "zz"), (5, " er ")], "query_id bigint, query string")
    got = values(browse.suggest(asked, jobs, "job_title"), "query_id", "value", "rank")
    assert got == [(1, "Night nurse", 1), (1, "Nurse", 2), (1, "Ünur", 3), (3, "Night nurse", 1), (5, "Driver", 1)]


def test_browse_requests_equals_single_browse(spark, make_jobs):
    rows = [
        {"job_title": f"{'nurse' if i % 3 else 'Recruiter'} {i}", "location": ["London", "Leeds, UK", None][i % 3],
         "remote_type": ["Remote", "Hybrid"][i % 2], "exists_in_uk": i % 2, "added_at": f"2024-01-{i % 9 + 1:02d}",
         "organisation_name": f"Org{i % 5}"}
        for i in range(60)
    ]
    jobs = make_jobs(*rows)
    wanted = [None, {}, {"location": "lon"}, {"location": "L"}, {"remote_type": "Hybrid", "location": "uk"}, {"category": "7"},
              {"category": "remote_global"}, {"category": "nope"}, {"organisation_name": "org1", "category": "1"}, {"location": "zz"}]
    asked = spark.createDataFrame([(i, f, 7 + i) for i, f in enumerate(wanted)], "query_id bigint, filters map<string,string>, fetch int")
    got = {}
    for r in browse.browse_requests(asked, jobs).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i, f in enumerate(wanted):
        assert got.get(i, []) == [r["id"] for r in browse.browse(jobs, AS_OF, f, limit=7 + i).collect()], f


def test_related_leaves_the_job_out(make_jobs, values):
    jobs = make_jobs(*[{"job_title": f"nurse {i}", "job_category_id": 7, "added_at": f"2024-01-0{i}"} for i in range(1, 6)])
    got = values(browse.related(jobs), "id", "related_id")
    assert got == [(1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 3), (4, 5), (5, 3), (5, 4)]


def test_skewed_joins_keep_every_row(spark, values):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([(7, 70)], "k bigint, v bigint")
    )
    plain = rows.join(lookup, "k")
    assert values(join_unique(rows, lookup, ["k"]), "k", "id", "v") == values(plain, "k", "id", "v")
    gaps = rows.withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))
    got = values(join_unique(gaps, lookup, ["k"], how="left"), "k", "id", "v")
    assert got == values(gaps.join(lookup, "k", "left"), "k", "id", "v")
    assert values(salted_join(rows, lookup, ["k"], F.col("id")), "k", "id", "v") == values(plain, "k", "id", "v")
    assert values(join_unique(rows, lookup, ["k"], piece_rows=100), "k", "id", "v") == values(plain, "k", "id", "v")


def test_no_task_holds_a_hot_key(spark):
    """A key on a third of the rows, equal rows and null keys: the largest partition of the join."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        base = spark.range(0, 30_000, 1, 16)
        third = base.select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
        equal = base.select(F.lit(-1).cast("bigint").alias("k"))
        empty = base.select(F.lit(None).cast("bigint").alias("k"), "id")
        lookup = spark.range(-1, 30_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        for rows in (third, equal, empty):
            joined = join_unique(rows, lookup, ["k"], piece_rows=500, how="left")
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 30_000 and max(sizes) < 6_000
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_import_survives_bad_cells(spark, values):
    cells = ["nan", "inf", "1e20", "-1", "12.7", " ", None, "7"]
    raw = spark.createDataFrame([(f"t{i}", "Leeds", c) for i, c in enumerate(cells)], "job_title string, location string, views_count string")
    assert values(imports.import_jobs(raw), "job_title", "views_count") == [(f"t{i}", n) for i, n in enumerate([0, 0, 0, -1, 12, 0, 0, 7])]


def test_fetch_has_no_ceiling(spark, make_jobs):
    jobs = make_jobs({"job_title": "Nurse"}).drop("id").crossJoin(spark.range(4000).select("id"))
    requests = spark.createDataFrame([(1, {}, 3500), (2, {}, 10)], "query_id bigint, filters map<string,string>, fetch int")
    got = {r["query_id"]: r["count"] for r in browse.browse_requests(requests, jobs.select(*make_jobs({}).columns)).groupBy("query_id").count().collect()}
    assert got == {1: 3500, 2: 10}


@pytest.mark.parametrize("k", [5, 1500])
def test_top_k_equals_plain_ranking(spark, values, k):
    spark.conf.set(GROUP_LIMIT, "1000")
    rows = spark.range(9000).select((F.col("id") % 2 * F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(99)).alias("s"), "id")
    ranked = top_k(rows, ["g"], [F.desc("s"), F.asc("id")], k, F.col("id"))
    want = []
    for g in (0, 1, 2):
        group = sorted(((-r["s"], r["id"]) for r in rows.filter(F.col("g") == g).collect()))[:k]
        want += [(g, i, n) for n, (_, i) in enumerate(group, 1)]
    assert values(ranked, "g", "id", "rank") == sorted(want, key=repr)


def test_declared_columns(spark, make_jobs, tmp_path):
    path = str(tmp_path / "jobs")
    make_jobs({"job_title": "Nurse"}).select("id", "job_title").write.parquet(path)
    row = schema.read_model(spark, path, "jobs").first()
    assert (row["job_title"], row["deactivation_reason"]) == ("Nurse", None)
    for name, columns in schema.SCHEMAS.items():
        assert spark.createDataFrame([], columns).columns, name


@pytest.mark.parametrize("mode", ["relevance", "popular", "company", "newest", "date"])
def test_requests_are_sorted_like_one_browse(spark, make_jobs, mode):
    jobs = make_jobs(*[
        {"job_title": f"t{i % 7}", "organisation_name": f"o{i % 5}", "views_count": i * 7 % 11, "added_at": f"2024-01-{i % 9 + 1:02d}",
         "has_description": i % 2, "remote_type": "Remote" if i % 3 else "Hybrid", "salary": "1" if i % 4 else ""} for i in range(60)
    ])
    requests = spark.createDataFrame([(1, {"remote_type": "Remote"}, 25), (2, {}, 50)], "query_id bigint, filters map<string,string>, fetch int")
    got = browse.browse_requests(requests, jobs, mode).orderBy("query_id", "rank").collect()
    for query, filters, n in ((1, {"remote_type": "Remote"}, 25), (2, {}, 50)):
        want = [r["id"] for r in browse.browse(jobs, AS_OF, filters, mode, n).collect()]
        assert [r["id"] for r in got if r["query_id"] == query] == want


def test_versions_of_a_table_are_read_together(spark, tmp_path):
    versions = [
        ("v1", "1 AS id, CAST(1.5 AS FLOAT) AS score, DATE'2024-01-02' AS seen, 'a' AS title"),
        ("v2", "3000000000 AS id, 0.1D AS score, TIMESTAMP_NTZ'2024-05-06 07:08:09' AS seen, 'kept' AS reason"),
    ]
    for name, columns in versions:
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}")
    rows = imports.read_versions(spark, [f"{tmp_path}/v1", f"{tmp_path}/v2"], {"note": "string", "title": "string"})
    assert rows.dtypes == [("id", "bigint"), ("score", "double"), ("seen", "timestamp_ntz"), ("title", "string"), ("reason", "string"), ("note", "string")]
    first, second = sorted(tuple(r) for r in rows.collect())
    assert first == (1, 1.5, datetime.datetime(2024, 1, 2), "a", None, None)
    assert second == (3_000_000_000, 0.1, datetime.datetime(2024, 5, 6, 7, 8, 9), None, "kept", None)
    plan = rows.filter("id > 5").select("reason")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThan(id,5)" in plan and "score" not in plan
    assert rows.filter("id > 5").select("reason").collect() == [("kept",)]


def test_clashing_versions_are_an_error(spark, tmp_path):
    for name, columns in [("v1", "1 AS id, 'x' AS title"), ("v2", "1 AS ID, 5 AS Title")]:
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="title"):
        imports.read_versions(spark, [f"{tmp_path}/v1", f"{tmp_path}/v2"])
    assert imports.read_versions(spark, [f"{tmp_path}/v1"]).collect() == [(1, "x")]
