import time
from collections import deque
from urllib.parse import urlparse

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions.skew import number_rows
from jobweave.operators import links, pages, parsing

PAGE = """<!DOCTYPE html><html><head><title>Jobs &amp; more</title><style>p{}</style><script>var t="</p><a href='/no'>";</script></head>
<body><nav><a href="/nav">nav</a></nav><header>top</header>
<div class="Job-Description wide"><p>Nurse <b>wanted</b><!-- x -->now</p><p></p>
<a href="/jobs/1"> Apply <i>here</i></a><a href="">self</a><a>none</a><a href="//b.org/x">other</a></div>
<form action="/go"><input name="CV"></form><form><input name="q"></form></body>"""


@pytest.fixture(scope="module")
def read(spark):
    rows = [
        (1, "https://a.org/start", PAGE),
        (2, "https://a.org/two", "<p>open <div>plain <form><input></form>"),
        (3, "https://a.org/three", None),
        (4, "https://a.org/four", "<html><body><article>" + "word " * 1500 + "</article></body></html>"),
        (5, "https://a.org/five", "<body><article>art</article><main>one<br>two</main></body>"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r for r in pages.read_pages(frame, main_chars=5000).collect()}


def test_text_and_title(read):
    assert read[1]["text"] == "Jobs & more Nurse wanted now Apply here self none other"
    assert read[1]["title"] == "Jobs & more"
    assert read[2]["text"] == "open plain" and read[3]["text"] == ""


def test_main_text(read):
    assert read[1]["main_text"] == "Nurse\nwanted\nnow\nApply\nhere\nself\nnone\nother"
    assert (read[3]["main_text"], read[3]["main_status"]) == (None, "missing_main_container")
    assert read[4]["main_text"].endswith(fx.TRUNCATED_SUFFIX) and len(read[4]["main_text"]) == 5000 + len(fx.TRUNCATED_SUFFIX)
    assert read[5]["main_text"] == "one\ntwo"


def test_links_and_forms(read):
    found = [(x["position"], x["url"], x["text"], x["href"]) for x in read[1]["links"]]
    assert found == [(1, "https://a.org/jobs/1", "Applyhere", "/jobs/1"), (2, "https://b.org/x", "other", "//b.org/x")]
    assert (read[1]["has_form"], read[1]["has_application_form"]) == (True, True)
    assert (read[2]["has_form"], read[2]["has_application_form"]) == (True, False)
    assert (read[5]["has_form"], read[5]["has_application_form"]) == (False, False)


def test_title_takes_the_first_matching_link(spark, values):
    jobs = spark.createDataFrame(
        [(1, "Nurse", None), (1, "Chef", ""), (1, "Cook", "https://x"), (9, "Nurse", None)],
        "page_id bigint, job_title string, job_link string",
    )
    per_page = spark.createDataFrame(
        [(1, [("https://a/1", "Night NURSE"), ("https://a/2", "nurse")])],
        "page_id bigint, job_links array<struct<url:string,text:string>>",
    )
    assert values(links.titles_to_links(jobs, per_page), "job_title", "job_link") == [
        ("Chef", None), ("Cook", "https://x"), ("Nurse", "https://a/1"), ("Nurse", None),
    ]


def test_job_lines(spark, values):
    raw = """Found:
- **Nurse** | https://a.org/111 | Leeds | not specified
  - Chef | [link](https://jobs.a.org/long/2) | nan
- Cook | /jobs/3
- Far | https://b.org/12345
- Known | https://x.greenhouse.io/1
- Linked
- Fake | https://company.com/apply
- Short | http://a.b
not a line | https://a.org/9"""
    schema = "org_id bigint, career_url string, raw string, job_links array<struct<url:string,text:string>>"
    found = [("https://a.org/from-page", "see LINKED job")]
    rows = [(1, "https://www.a.org/careers", raw, found), (2, "https://a.org", "no_jobs_found\n- x | https://a.org/1", [])]
    got = values(parsing.job_lines(spark.createDataFrame(rows, schema)), "job_title", "job_link", "location", "salary")
    assert got == [
        ("**Nurse**", "https://a.org/111", "Leeds", None),
        ("Chef", "https://jobs.a.org/long/2", None, None),
        ("Cook", "https://www.a.org/jobs/3", None, None),
        ("Known", "https://x.greenhouse.io/1", None, None),
        ("Linked", "https://a.org/from-page", None, None),
    ]


def test_validation(spark):
    listed = [(1, "https://www.facebook.com/x"), (2, "https://a.org")]
    raws = {
        "bold": "Sure!\n**BEST_URL:** https://a.org/jobs).\n**DECISION:** Accept\nCATEGORY: Own site.\nREASON: fine,\nCONFIDENCE: HIGH",
        "reject": "DECISION: REJECT\nREASON: board",
        "no url": "DECISION: ACCEPT\nREASON: ok",
        "unreadable": "who knows BEST URL: https://b.org",
    }
    frame = spark.createDataFrame(
        [(k, v, listed) for k, v in raws.items()], "org string, raw string, urls array<struct<rank:int,url:string>>"
    )
    got = {r["org"]: tuple(r)[1:] for r in parsing.validation(frame).collect()}
    assert got == {
        "bold": (True, "https://a.org/jobs", "ACCEPT", "Own site", "fine", "High"),
        "reject": (False, None, "REJECT", "Unknown", "board", "Low"),
        "no url": (True, "https://www.facebook.com/x", "ACCEPT", "Unknown", "ok", "Low"),
        "unreadable": (True, "https://a.org", "ACCEPT", "Own Website (Fallback)", "Passed rule-based validation (Rank 2)", "Medium"),
    }


def breadth_first(start, edges, ats, max_depth=4, max_pages=20):
    base, seen, queue, out = urlparse(start).netloc, set(), deque([(start, 0)]), []
    while queue and len(seen) < max_pages:
        url, depth = queue.popleft()
        if url in seen or depth >= max_depth:
            continue
        seen.add(url)
        out.append((url, depth, len(seen)))
        if depth == max_depth - 1:
            continue
        for target in edges.get(url, []):
            host = urlparse(target).netloc
            if host == base or host.endswith("." + base) or any(a in host for a in ats):
                queue.append((target, depth + 1))
    return out


def test_crawl_equals_breadth_first_search(spark):
    def url(n):
        return f"https://{'jobs.' if n % 3 else ''}{'a.org' if n % 5 else 'b.org'}/{n}"

    edges = {url(n): [url(n * k % 97 + k) for k in range(1, 9)] for n in range(97)}
    rows = [(u, i, t) for u, targets in edges.items() for i, t in enumerate(targets, 1)]
    stored = spark.createDataFrame(rows, "page_url string, position int, url string")
    starts = spark.createDataFrame([(f"org{n}", url(n)) for n in (0, 3, 6, 11)], "org string, url string")
    got = {}
    for r in links.crawl_frontier(starts, stored, ats=("never.org",), max_depth=4, max_pages=20, links_per_page=100).collect():
        got.setdefault(r["org"], []).append((r["url"], r["depth"], r["visit"]))
    for n in (0, 3, 6, 11):
        assert sorted(got[f"org{n}"], key=lambda x: x[2]) == breadth_first(url(n), edges, ("never.org",))
    whole = links.crawl_frontier(starts.filter("org = 'org3'"), stored, ats=("never.org",)).collect()
    assert sorted((r["url"], r["depth"]) for r in whole) == sorted(x[:2] for x in breadth_first(url(3), edges, ("never.org",), 99, 999))


def test_links_wide_and_long(spark, values):
    wide = spark.createDataFrame(
        [("A", " https://a/1 ", "t", "nan", None, None, None, "https://a/4", None, "", "x")],
        "organisation_name string, " + ", ".join(f"link_{i}_url string, link_{i}_title string" for i in range(1, 6)),
    )
    long = links.wide_to_long(wide)
    assert values(long, "rank", "url", "title") == [(1, "https://a/1", "t"), (4, "https://a/4", "")]
    back = links.long_to_wide(long).first()
    assert (back["link_1_url"], back["link_2_url"], back["link_4_url"], back["links_found"]) == ("https://a/1", "", "https://a/4", 2)


def test_best_url_and_status(spark, values):
    rows = [("A", 1, "https://www.gov.uk/x"), ("A", 2, "https://a.org"), ("A", 3, "https://a.net"), ("B", 1, "https://x.linkedin.com/b"),
            ("B", 2, "mailto:b@b.org")]
    found = spark.createDataFrame(rows, "organisation_name string, rank int, url string")
    assert values(links.best_url(found, found), "organisation_name", "best_url", "decision") == [("A", "https://a.org", "ACCEPT"), ("B", None, "REJECT")]
    seen = spark.createDataFrame(
        [("A", False, True, False), ("A", True, False, False), ("B", False, False, True), ("C", False, False, False)],
        "org string, has_job boolean, has_form boolean, has_application_form boolean",
    )
    assert values(links.org_status(seen, "org"), "org", "application_type") == [("A", "Job Openings"), ("B", "Only Form"), ("C", "No Jobs and No Form")]


def test_postings_cap(spark):
    import json

    feed = json.dumps({"total": 300, "jobPostings": [{"title": f" t{i}", "externalPath": f"/job/{i}" if i % 2 else ""} for i in range(500)]})
    feeds = spark.createDataFrame([("A", 0, "https://a.org", feed), ("A", 1, "https://a.org", "broken")], "org string, feed_no int, base_url string, payload string")
    rows = parsing.postings(feeds, cap=200).orderBy("posting_no").collect()
    assert len(rows) == 200 and parsing.postings(feeds).count() == 250
    assert (rows[0]["job_title"], rows[0]["job_link"], rows[199]["job_link"]) == ("t1", "https://a.org/job/1", "https://a.org/job/399")


def test_numbers_of_hot_keys_come_from_pieces(spark):
    """Numbers equal one window over all, and no task numbers more of a key than one range."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("org"),
                                      (F.col("id") * 7919 % 20_011).alias("at"), "id")
    got = number_rows(rows.repartition(5), ["org"], ["at", "id"], "n")
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("org").orderBy("at", "id")))
    assert got.columns == ["org", "at", "id", "n"]
    assert got.exceptAll(want.withColumn("n", F.col("n").cast("bigint"))).count() == 0 and got.count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(org" in plan and "_piece" in plan.split("windowspecdefinition(", 1)[1][:60]
    assert number_rows(rows.limit(0), ["org"], ["at"], "n").count() == 0


@pytest.mark.parametrize("part", ['<a href="/x">', "<div>", "<form>", "<p>", "<main>", "</b><b>", "<title>"])
def test_large_broken_pages_take_linear_time(part):
    start = time.process_time()
    page = pages._Reader("https://a.org", fx.TEXT_SKIP_TAGS, fx.MAIN_SKIP_TAGS).read((part + "word ") * (1_000_000 // (len(part) + 5)))
    page.main_text(None)
    assert time.process_time() - start < 10


def test_whole_texts_by_default(spark):
    html = "<body><article>" + "word " * 5000 + '</article><a href="/1">one<a href="/2">two</a></body>'
    row = pages.read_pages(spark.createDataFrame([(1, "https://a.org", html)], "page_id bigint, url string, html string")).first()
    assert len(row["main_text"]) == 24_999 and len(row["text"]) > 24_999
    assert [(x["url"], x["text"]) for x in row["links"]] == [("https://a.org/1", "one"), ("https://a.org/2", "two")]


def test_parsed_pages_leave_the_worker_in_small_batches(spark, monkeypatch):
    """A worker holds the texts and links of a hundred pages, not those of a whole Arrow batch."""
    taken = []

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pylist([{"page_id": i, "url": "http://a/", "html": "<p>x</p><a href='/b'>y</a>"} for i in range(250)])
            taken.extend(b.num_rows for b in run(iter([batch])))

    pages.read_pages(Rows())
    assert taken == [100, 100, 50]


def test_crawl_reads_its_levels_as_one_table(spark):
    """The plan of a level does not grow with the levels before it."""
    at = [f"http://a.org/{i}" for i in range(7)]
    starts = spark.createDataFrame([("a", at[0])], "org string, url string")
    stored = spark.createDataFrame([(one, 1, two) for one, two in zip(at, at[1:])], "page_url string, position int, url string")
    found = links.crawl_frontier(starts, stored, ats=("jobs.example",))
    assert "Union" not in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.orderBy("depth").collect()] == [("a", url, i, i + 1) for i, url in enumerate(at)]
