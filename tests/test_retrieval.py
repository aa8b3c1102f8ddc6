import os
import random
import sqlite3
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text
from jobweave.operators import filters as flt
from jobweave.operators import projections, retrieval, search_index, usage


def hashing_embedder(size):
    """Deterministic stand-in for a model: signed word hashes, unit length."""

    def embed(texts):
        out = np.zeros((len(texts), size), dtype="float32")
        for row, value in enumerate(texts):
            for word in value.lower().split():
                code = zlib.crc32(word.encode())
                out[row, code % size] += 1.0 if code & 0x10000 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


WORDS = ["python", "developer", "senior", "café", "cafe", "data", "data_engineer", "engineer", "nurse", "Über", "uber",
         "c", "lead", "of", "the", "night", "shift"]


def requests(spark, *rows):
    schema = "query_id bigint, query string, filters map<string,string>, query_embedding array<float>"
    return spark.createDataFrame([(i, q, f, v) for i, (q, f, v) in enumerate(rows, 1)], schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        title = " ".join(rng.choices(WORDS, k=rng.randint(1, 7)))
        rows.append(
            {
                "job_title": title,
                "organisation_name": rng.choice(["Acme Ltd", "Globex", None]),
                "location": rng.choice(["London, UK", "New York", "Leeds"]),
                "remote_type": rng.choice(["Remote", "Hybrid", ""]),
                "experience_level": rng.choice(["Senior", None]),
                "is_active": 0 if rng.random() < 0.1 else 1,
            }
        )
    return rows


@pytest.fixture(scope="module")
def index(spark, make_jobs, corpus, tmp_path_factory):
    vectors = spark.range(1, 121).select("id", F.array(*[(F.col("id") % k).cast("float") for k in (2, 3, 5)]).alias("embedding"))
    return retrieval.SearchIndex.build(make_jobs(*corpus), str(tmp_path_factory.mktemp("index")), vectors, parts=3)


QUERIES = ["python developer", "CAFÉ", "data_engineer", "the night shift data", "uber uber", "nothing here", "c++ lead!"]


def test_bm25_equals_fts5(spark, corpus, index, make_jobs):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(job_title, organisation_name, location, remote_type, experience_level)")
    for i, row in enumerate(corpus, 1):
        if row["is_active"]:
            cells = [row[c] for c in retrieval.INDEX_COLUMNS]
            db.execute("INSERT INTO f(rowid, job_title, organisation_name, location, remote_type, experience_level) "
                       "VALUES (?, ?, ?, ?, ?, ?)", [i, *cells])
    asked = requests(spark, *[(q, {}, None) for q in QUERIES])
    got = {}
    for row in retrieval.search_bm25(asked, index, candidates=500).collect():
        got.setdefault(row["query_id"], {})[row["id"]] = row["bm25_score"]
    for number, query in enumerate(QUERIES, 1):
        plain = "".join(c if c.isalnum() or c in "_ " else " " for c in query.lower()).split()
        match = "job_title : (" + " OR ".join(plain) + ")"
        want = {i: -s for i, s in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", [match])}
        assert got.get(number, {}) == pytest.approx(want, abs=1e-6), query


def test_index_counts_terms(index, spark):
    spread = index.docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    title = index.postings.filter("field = 'job_title'")
    both = title.join(spread, ["id", "term"], "full")
    assert both.filter("tf IS NULL OR n IS NULL OR tf <> n").count() == 0
    df = title.groupBy("term").agg(F.countDistinct("id").alias("n")).join(index.terms.filter("field = 'job_title'"), "term", "full")
    assert df.filter("df IS NULL OR n IS NULL OR df <> n").count() == 0
    places = title.join(index.docs.select("id", "terms"), "id")
    assert places.filter(~F.forall("at", lambda p: F.get("terms", p - 1) == F.col("term")) | (F.size("at") != F.col("tf"))).count() == 0


def test_phrases_do_not_read_documents(spark, index):
    asked = requests(spark, ("data_engineer night_shift", {}, None), ("of_the_night", {}, None))
    found, _ = retrieval.hits(index, retrieval.query_words(asked), True)
    assert "terms" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["word"], r["id"]): r["tf"] for r in found.collect()}
    want = {}
    for r in index.docs.select("id", "terms").collect():
        for word in ("data_engineer", "night_shift", "of_the_night"):
            parts = word.split("_")
            n = sum(r["terms"][i : i + len(parts)] == parts for i in range(len(r["terms"])))
            if n:
                want[word, r["id"]] = n
    assert rows == want
    more, _ = retrieval.hits(index, retrieval.query_words(asked), False)
    assert {(r["word"], r["id"]): r["tf"] for r in more.collect()} == want


def contents(index):
    docs = sorted(map(tuple, index.docs.select(sorted(index.docs.columns)).collect()), key=repr)
    rows = index.postings.select("field", "term", "id", "tf", "at", "dl", "title_is", "location", "cats")
    vectors = index.vectors.select(sorted(index.vectors.columns))
    return docs, *(sorted(map(tuple, t.collect()), key=repr) for t in (rows, index.terms.select("field", "term", "df"), vectors, index.corpus))


def files(folder):
    return {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_refresh_equals_a_new_index(spark, make_jobs, corpus, tmp_path):
    vectors = spark.range(1, 121).select("id", F.array(*[(F.col("id") % k).cast("float") for k in (2, 3, 5)]).alias("embedding"))
    now = [dict(r) for r in corpus]
    for i in range(0, 120, 7):
        now[i]["job_title"] = "brand new title " + now[i]["job_title"]
    for i in range(0, 120, 11):
        now[i]["is_active"] = 0
    for i in range(3, 120, 25):
        now[i]["location"] = "Paris"
    changed = [i for i in range(120) if now[i] != corpus[i]] + [110]
    index = retrieval.SearchIndex.build(make_jobs(*corpus[:110]), f"{tmp_path}/a", vectors, parts=5)
    before, seen = contents(index), files(tmp_path)
    every = make_jobs(*now)
    fresh = vectors.withColumn("embedding", F.array(*[F.lit(float(k)).cast("float") for k in (1, 2, 3)])).filter("id % 2 = 0")
    after = index.refresh(every.filter(F.col("id").isin([i + 1 for i in changed]) | (F.col("id") > 110)), fresh)
    touched = {i + 1 for i in changed} | set(range(111, 121))
    mixed = vectors.filter(~(F.col("id").isin(list(touched)) & (F.col("id") % 2 == 0)) & ((F.col("id") <= 110))).unionByName(fresh.filter(F.col("id").isin(list(touched))))
    assert contents(after) == contents(retrieval.SearchIndex.build(every, f"{tmp_path}/b", mixed, parts=5))
    assert contents(index) == before and seen <= files(tmp_path), "an open reader keeps its version"
    assert contents(retrieval.SearchIndex(spark, f"{tmp_path}/a")) == contents(after)
    again = after.refresh(every.filter("id = 4"))
    assert contents(again) == contents(after)
    assert contents(again.refresh(every.filter("id < 0"))) == contents(after)


def test_refresh_writes_only_touched_folders(spark, make_jobs, corpus, tmp_path):
    index = retrieval.SearchIndex.build(make_jobs(*corpus), str(tmp_path), parts=64)
    one = make_jobs({"job_title": "zebra", "organisation_name": None, "location": "", "remote_type": "", "experience_level": None})
    index.refresh(one.withColumn("id", F.lit(500).cast("bigint")))
    written = {os.path.relpath(f, tmp_path) for f in files(tmp_path) if "version=1" in f}
    assert len({os.path.dirname(f) for f in written if f.startswith("postings")}) == 1
    assert len({os.path.dirname(f) for f in written if f.startswith("docs")}) == 1


def test_empty_index(spark, make_jobs, tmp_path):
    index = retrieval.SearchIndex.build(make_jobs({"is_active": 0, "job_title": "x"}), str(tmp_path))
    assert retrieval.search_bm25(requests(spark, ("x", {}, None)), index).count() == 0
    full = index.refresh(make_jobs({"job_title": "x"}))
    assert [r["id"] for r in retrieval.search_bm25(requests(spark, ("x", {}, None)), full).collect()] == [1]


def test_bm25_orders_by_place_before_score(spark, make_jobs, tmp_path):
    jobs = make_jobs(
        {"job_title": "nurse nurse nurse"},
        {"job_title": "nurse of the night", "exists_in_uk": 1},
        {"job_title": "a nurse of the very long title", "exists_in_uk": 1, "exists_in_london": 1},
        {"job_title": "Nurse", "exists_in_uk": 1},
        {"job_title": None},
        {"job_title": "nurse", "is_active": 0},
    )
    built = retrieval.SearchIndex.build(jobs, str(tmp_path), parts=2)
    found = retrieval.search_bm25(requests(spark, ("nurse", {}, None)), built).orderBy("rank").collect()
    assert [r["id"] for r in found] == [3, 4, 2, 1]


def test_filters_apply_to_both_lists(spark, index):
    wanted = {"location": "london", "remote_type": "Remote", "organisation_name": "ACME"}
    asked = requests(spark, ("data engineer", wanted, [1.0, 0.5, 0.2]), ("data", {"category": "7"}, [1.0, 1.0, 1.0]))
    docs = {r["id"]: r for r in index.docs.collect()}
    for found in (retrieval.search_bm25(asked, index), retrieval.search_semantic(asked, index)):
        rows = found.collect()
        assert rows
        for row in rows:
            doc = docs[row["id"]]
            if row["query_id"] == 1:
                assert doc["location"] == "London, UK" and doc["remote_type"] == "Remote"
                assert doc["organisation_name"] == "Acme Ltd"
            else:
                assert ",7," in doc["cats"]


@pytest.mark.parametrize("limit", [0, 2048])
def test_nearest_equals_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    table, asked = rng.normal(size=(300, 8)).astype("float32"), rng.normal(size=(7, 8)).astype("float32")
    table[5] = 0
    rows = [(i, [float(x) for x in v], "Leeds" if i % 2 else "London") for i, v in enumerate(table)]
    pool = spark.createDataFrame(rows, "id bigint, embedding array<float>, location string")
    for name in retrieval.VECTOR_CARRIED:
        if name != "location":
            pool = pool.withColumn(name, F.lit(0) if name.startswith(("exists", "has")) else F.lit(""))
    filters = [{"location": "leeds"} if i % 2 else None for i in range(7)]
    queries = requests(spark, *[("q", f, [float(x) for x in v]) for f, v in zip(filters, asked)])
    found = retrieval.nearest(queries, pool, 10, limit, block_queries=3, block_vectors=50).collect()
    got = {(r["query_id"], r["rank"]): r["id"] for r in found}
    size = np.linalg.norm(table, axis=1)
    for i, vector in enumerate(asked.astype("float64")):
        scores = np.round(table.astype("float64") @ vector / np.where(size > 0, size, 1) / np.linalg.norm(vector), 9)
        keep = [j for j in range(300) if filters[i] is None or j % 2]
        want = sorted(keep, key=lambda j: (-scores[j], j))[:10]
        assert [got[i + 1, r] for r in range(1, 11)] == want


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, rank bigint, score double")


def fused(spark, bm25, semantic):
    left = lists(spark, bm25).withColumnRenamed("score", "bm25_score")
    right = lists(spark, semantic).withColumnRenamed("score", "semantic_score")
    return {r["id"]: r["hybrid_score"] for r in retrieval.fuse(left, right).collect()}


def test_fusion_weights_and_missing_ranks(spark):
    both = fused(spark, [(1, 10, 1, 2.0), (1, 11, 2, 1.0)], [(1, 11, 1, 0.9)])
    assert both[10] == pytest.approx(0.3 / 61 + 0.7 / 62)
    assert both[11] == pytest.approx(0.3 / 62 + 0.7 / 61)
    assert fused(spark, [], [(1, 11, 1, 0.9)])[11] == pytest.approx(1 / 61)
    assert fused(spark, [(1, 11, 3, 0.9)], [])[11] == pytest.approx(1 / 63)


def test_threshold_falls_back_to_all_candidates(spark, index):
    asked = requests(spark, ("python developer senior data", {}, [1.0, 2.0, 1.0]), ("python", {}, [1.0, 2.0, 1.0]))
    strict = retrieval.search_hybrid(asked, index, 20, 0.9).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in strict} == {1: 20, 2: 20}
    some = retrieval.search_hybrid(asked, index, 200, 0.0148).collect()
    assert {r["query_id"] for r in some} == {1, 2}
    assert all(r["hybrid_score"] >= 0.0148 for r in some if r["query_id"] == 1)
    assert any(r["hybrid_score"] < 0.0148 for r in some if r["query_id"] == 2)


def test_search_drops_courses_and_browses_blank(spark, make_jobs, tmp_path):
    jobs = make_jobs(
        {"job_title": "Nurse training course", "exists_in_uk": 1},
        {"job_title": "Nurse"},
        {"job_title": "Bootcamp nurse"},
        {"job_title": None},
        {"job_title": "Nurse without link", "job_link": ""},
    )
    built = retrieval.SearchIndex.build(jobs, str(tmp_path), parts=2)
    asked = requests(spark, ("nurse", {}, None), ("  ", {}, None), (None, {"category": "7"}, None), ("", {"location": "x"}, None))
    rows = retrieval.search(asked, built, jobs).orderBy("query_id", "rank").collect()
    got = {}
    for row in rows:
        got.setdefault(row["query_id"], []).append(row["id"])
    assert got == {1: [2, 3, 5], 2: [2], 3: [2]}


def test_embed_backlog_fills_only_gaps(spark, make_jobs):
    jobs = make_jobs({"job_title": "Nurse"}, {"job_title": "Driver"}, {"job_title": ""}, {"job_title": "Old", "is_active": 0})
    vectors = spark.createDataFrame([(1, [1.0])], "id bigint, embedding array<float>")
    made = retrieval.embed_backlog(jobs, vectors, hashing_embedder(16)).collect()
    assert [(r["id"], r["embedding_dimension"]) for r in made] == [(2, 16)]
    assert np.linalg.norm(made[0]["embedding"]) == pytest.approx(1.0, abs=1e-5)


def test_listing_tiers_pages_and_teasers(spark, make_jobs, tmp_path):
    titles = [f"nurse {i:02d}" for i in range(12)] + ["driver"]
    jobs = make_jobs(*[{"job_title": t, "exists_in_uk": int(i % 2), "added_at": "2024-01-01"} for i, t in enumerate(titles)])
    built = retrieval.SearchIndex.build(jobs, str(tmp_path), parts=2)
    users = spark.createDataFrame([(1, 0), (2, 1)], "user_id bigint, membership_status int")
    asked = spark.createDataFrame(
        [(1, " ", None, 1, 1, 5, ""), (2, " ", None, 2, 2, 5, ""), (3, None, None, 1, 2, 2, "uk"), (4, "nurse", None, 2, 2, 5, "uk"),
         (5, "nurse", None, None, 1, 5, ""), (6, "nothing", None, 2, 1, 5, ""), (7, "", {"location": "x"}, 1, 1, 5, "")],
        "query_id bigint, query string, filters map<string,string>, user_id bigint, page int, page_limit int, location_filter string",
    ).withColumn("query_embedding", F.lit(None).cast("array<float>"))
    got = {}
    for r in retrieval.search_listing(asked, users, built, jobs).collect():
        got.setdefault(r["query_id"], []).append(r)

    def shown(number):
        return [r["id"] for r in sorted(got[number], key=lambda r: (r["is_blurred"], r["rank"] or 0))]

    browse_order = [2, 4, 6, 8, 10, 12, 13, 1, 3, 5, 7, 9, 11]
    assert shown(1) == ["2", "4", "6", "dummy-0", "dummy-1"]
    assert shown(2) == [str(i) for i in browse_order[5:10]]
    assert shown(3) == ["6"]
    assert shown(4) == ["12"]
    assert shown(5)[:3] == ["2", "4", "6"] and shown(5)[3:] == ["dummy-0", "dummy-1"]
    assert 6 not in got and 7 not in got
    assert {(r["total"], r["total_pages"]) for r in got[2]} == {(13, 3)}
    assert {(r["total"], r["total_pages"]) for r in got[1]} == {(3, 1)}
    assert {(r["total"], r["total_pages"]) for r in got[4]} == {(6, 2)}
    assert set(got[1][0].asDict()) == {"query_id", *projections.LISTING, "rank", "total", "total_pages"}
    assert {r["job_link"] is None for r in got[1] if r["is_blurred"]} == {True}
    assert [r["hybrid_score"] for r in got[2]] == [1.0] * 5 and all(0 < r["hybrid_score"] < 1 for r in got[4])


def test_search_log(spark):
    asked = spark.createDataFrame(
        [(1, " nurse ", {"location": "x", "category": "6"}), (1, "nurse", {"location": " "}), (1, " ", {"location": "x"}), (None, "nurse", None),
         (0, "nurse", None), (2, None, None), (2, "cook", None), (2, "cook", None)],
        "user_id bigint, query string, filters map<string,string>",
    )
    rows = usage.search_log(asked, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    got = sorted((r["user_id"], r["search_keywords"], r["filters_applied"] or "") for r in rows.collect())
    assert got == [(1, "nurse", ""), (1, "nurse", '{"category":"6","location":"x"}'), (2, "cook", ""), (2, "cook", "")]
    assert {r["user_id"]: r["search_count"] for r in usage.daily_searches(rows, "2024-01-20 15:00:00").collect()} == {1: 2, 2: 2}


def test_postings_hold_places_only(spark, corpus, make_jobs, tmp_path):
    """What ranking needs lies in the documents once, not in each row of the postings."""
    retrieval.SearchIndex.build(make_jobs(*corpus), str(tmp_path), parts=3)
    assert set(spark.read.parquet(f"{tmp_path}/postings").columns) == {"id", "copy", "term", "tf", "at", "field", "part", "version"}


def test_block_scores_equal_joins(spark, corpus, make_jobs, tmp_path, monkeypatch):
    """Blocks of few jobs, jobs without or with a repeated id, filters and a repeated request: as by joins of rows."""
    jobs = make_jobs(*corpus)
    jobs = jobs.unionByName(jobs.filter("id < 9")).unionByName(jobs.filter("id < 40").withColumn("id", F.lit(None).cast("bigint")))
    built = retrieval.SearchIndex.build(jobs, str(tmp_path), parts=2)
    asked = requests(spark, ("data engineer", {}, None), ("the night shift data", {"location": "LON"}, None), ("night_shift the", {}, None))
    asked = asked.unionByName(asked.filter("query_id = 1"))

    def found(**few):
        rows = retrieval.search_bm25(asked, built, candidates=7).orderBy("query_id", "rank").collect()
        return [(r["query_id"], r["id"], r["rank"], round(r["bm25_score"], 6)) for r in rows]

    monkeypatch.setattr(retrieval.BlockScores, "CELLS", 5)
    blocks = found()
    monkeypatch.setattr(retrieval, "is_small", lambda *a: False)
    assert blocks == found() and len(blocks) > 14


def test_bm25_of_all_hits(spark, index, monkeypatch):
    """Without a limit no hit is left out and ranks go on, by blocks of few jobs and by joins."""
    asked = requests(spark, *((q, {}, None) for q in QUERIES), ("the", {"location": "LON"}, None))
    monkeypatch.setattr(retrieval.BlockScores, "CELLS", 20)

    def found(candidates):
        rows = retrieval.search_bm25(asked, index, candidates).select("query_id", "id", "rank", F.round("bm25_score", 6)).collect()
        return sorted(map(tuple, rows))

    whole = found(None)
    assert whole == found(1000) and len(whole) > len(found(50)) > 0
    monkeypatch.setattr(retrieval, "is_small", lambda *a: False)
    assert whole == found(None)


def test_phrase_query_asks_for_all_hits(spark, index, monkeypatch):
    """No number of candidates, however large, stands between the hits and the answer."""
    from types import SimpleNamespace

    from jobweave.plans import search_queries

    real, asked_for = retrieval.search_bm25, []

    def search(queries, built, candidates=fx.CANDIDATES):
        asked_for.append(candidates)
        return real(queries, built, candidates)

    monkeypatch.setattr(retrieval, "search_bm25", search)
    search_queries.search_phrases(SimpleNamespace(spark=spark, index=lambda jobs: index)).collect()
    assert asked_for == [None]


def test_categories_of_many_texts_equal_the_plain_tests(spark):
    """All needles, cut and joined in odd ways, over several chunks."""
    needles = [n for found in fx.SEARCH_CATEGORIES.values() for n in found]
    low = [" ", "", "x  y", "日本 straße", *needles, *(n[:-1] for n in needles), *(f"a{n}s  {m}" for n, m in zip(needles, needles[7:]))]
    low = [x.lower() for x in low]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in low], "low string").select(flt.category_list(F.col("low"))).collect()]
    for most in (1, 300, 1 << 20):
        assert flt.category_lists(pa.array(low), most).to_pylist() == want
    assert len(flt.category_lists(pa.array([], pa.string()))) == 0


def test_postings_are_counted_in_pieces_and_files_are_sorted(spark, make_jobs, tmp_path):
    words = [["b", "a", "b"], ["日本", "a"], ["z"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array([0, 7, 0]), pa.array(["f", "g", "f"]), pa.array(words)], ["id", "copy", "field", "words"])
    for most in (1, 4, 100):
        rows = [r for made in search_index.counted_terms(batch, most) for r in made.to_pylist()]
        assert sorted((r["copy"], r["id"] or 0, r["field"], r["term"], r["tf"], tuple(r["at"])) for r in rows) == [
            (0, 1, "f", "a", 1, (2,)), (0, 1, "f", "b", 2, (1, 3)), (0, 3, "f", "z", 5, (1, 2, 3, 4, 5)), (7, 0, "g", "a", 1, (2,)), (7, 0, "g", "日本", 1, (1,))]
    titles = ["engineering engineers", "éa engineer", "engineer data 日本", "engineerin zz"]
    jobs = make_jobs(*({"job_title": titles[i % 4], "location": "here"} for i in range(40)))
    retrieval.SearchIndex.build(jobs, str(tmp_path / "index"), parts=2)
    for file in (tmp_path / "index" / "postings").rglob("*.parquet"):
        rows = pq.read_table(file, partitioning=None).select(["term", "id"]).to_pylist()
        keys = [(r["term"].encode(), r["id"]) for r in rows]
        assert keys == sorted(keys)


def test_postings_travel_in_lists(spark, make_jobs, monkeypatch):
    """A worker packs its postings by part, piece and field; unpacked they are those counted one by one, sorted, null ids too."""
    titles = ["the data of the nurse", "", "日本 nurse é", None, "the the", "z"]
    jobs = make_jobs(*({"id": None if i == 7 else 10_000_000_000 - i, "job_title": titles[i % 6], "location": f"here {i % 2}"} for i in range(30)))
    docs = search_index.searchable(jobs.unionByName(jobs.filter("id % 2 = 0"))).cache()
    rows = search_index.packed_terms(docs, 3, 2)
    want = sorted(search_index.term_counts(docs).withColumn("part", search_index.part_of(F.col("term"), 3)).collect(), key=repr)
    got = search_index.merged(rows).collect()
    assert sorted((r.asDict() for r in got), key=repr) == sorted((r.asDict() for r in want), key=repr)
    whole = pa.Table.from_pylist([r.asDict() for r in rows.collect()], pa.schema({
        "part": pa.int32(), "piece": pa.int32(), "field": pa.string(), "terms": pa.list_(pa.string()), "docs": pa.list_(pa.int32()),
        "ids": pa.list_(pa.int64()), "copies": pa.list_(pa.int64()), "tfs": pa.list_(pa.int32()), "places": pa.list_(pa.int32())}))
    assert len(whole) < len(want) / 2
    for most in (1, 7, 1000):
        made = [r for batch in search_index.unpacked(whole, most) for r in batch.to_pylist()]
        keys = [(r["field"], r["part"], r["term"].encode(), r["id"] or 0) for r in made]
        assert keys == sorted(keys) and len(made) == len(want)
    monkeypatch.setattr(search_index, "BATCH_WORDS", 3)
    assert sorted((r.asDict() for r in search_index.merged(search_index.packed_terms(docs, 3, 2)).collect()), key=repr) == sorted((r.asDict() for r in want), key=repr)


def test_refresh_copies_what_stays(spark, corpus, make_jobs, tmp_path, monkeypatch):
    """Postings that stay are not shuffled, but for the version that sorts all of them; both hold the same rows."""
    every = make_jobs(*corpus)
    changed = every.filter("id % 5 = 0").withColumn("job_title", F.concat(F.lit("fresh "), "job_title"))
    now = every.filter("id % 5 <> 0").unionByName(changed)
    sorted_rows = []
    real = search_index.in_pieces
    monkeypatch.setattr(search_index, "in_pieces", lambda rows: sorted_rows.append(1) or real(rows))

    def rows(index):
        return sorted(map(repr, index.places.collect())), sorted(map(repr, index.terms.collect())), sorted(map(repr, index.docs.collect()))

    want = rows(retrieval.SearchIndex.build(now, str(tmp_path / "now"), parts=2))
    for every_so_often, times in ((search_index.SORTED_EVERY, 0), (1, 1)):
        monkeypatch.setattr(search_index, "SORTED_EVERY", every_so_often)
        index = retrieval.SearchIndex.build(every, str(tmp_path / str(times)), parts=2)
        assert rows(index.refresh(changed)) == want and len(sorted_rows) == times


def test_title_marks_and_trim_equal_the_plain_rules(spark):
    needles = [*fx.COURSE_WORDS, *(n for found in fx.SEARCH_CATEGORIES.values() for n in found)]
    low = ["", " ", "a  b", *needles, *(f"{n[:-1]}" for n in needles), *(f"x {n}y z" for n in needles), *(n.replace(" ", "  ") for n in needles)]
    rows = spark.createDataFrame([(x.lower(),) for x in low], "low string")
    want = [tuple(r) for r in rows.select(flt.category_list(F.col("low")), flt.is_course(F.col("low"))).collect()]
    for most in (1, 300, 1 << 20):
        assert [tuple(r.values()) for r in flt.title_marks(pa.array([x.lower() for x in low]), most).to_pylist()] == want
    odd = [None, "", "a", *(f"{b}x {b} y{c}{b}{c}" for b in (" ", "\t\r\n", "\x0b\x0c", "\u00a0") for c in ("", "\u0085", "\u2028", "\u2029", "\n", "\u200a"))]
    rows = spark.createDataFrame([(x,) for x in odd], "x string")
    assert [r[0] == r[1] for r in rows.select(text.strip(F.col("x")), F.regexp_replace("x", r"^\s+|\s+$", "")).collect()[1:]] == [True] * (len(odd) - 1)


def test_hits_carry_one_text_instead_of_all_facts(spark, make_jobs, tmp_path):
    """Rows of hits stay narrow; facts with nulls, quotes and line ends come back as they were, once for equal rows."""
    odd = ['a "b"', "x\\y\n{z}", None, "Stra\u00dfe \u65e5\u672c"]
    jobs = make_jobs(*({"job_title": f"data {'nurse ' * (i % 3)}", "location": odd[i % 4], "job_source": odd[(i + 1) % 4]} for i in range(24)))
    built = retrieval.SearchIndex.build(jobs.unionByName(jobs.filter("id < 7")), str(tmp_path), parts=2)
    hit = spark.createDataFrame([(1, 0, 0, 2)], "id bigint, copy bigint, code int, tf int")
    assert sorted(retrieval.with_facts(hit, built).columns) == ["code", "copy", "facts", "id", "tf"]
    asked = [(i, "data nurse", {"location": place, "job_source": source}) for i, (place, source) in enumerate([
        (None, None), ('A "B"', None), ("y\n{", odd[2]), ("STRASSE", None), ("\u65e5", odd[0]), ("", odd[1])])]
    asked = spark.createDataFrame(asked, "query_id bigint, query string, filters map<string,string>").withColumn("filters", F.map_filter("filters", lambda k, v: v.isNotNull()))
    blocks = retrieval.search_bm25(asked, built)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(retrieval, "is_small", lambda *a: False)
        joined = retrieval.search_bm25(asked, built)
    both = [sorted((r["query_id"], r["id"], r["rank"], round(r["bm25_score"], 6)) for r in rows.collect()) for rows in (blocks, joined)]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {0, 1, 2, 4, 5}
