from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobweave.operators import billing, retrieval, search_index
from jobweave.streaming import jobs as stream


def write_events(spark, folder, rows):
    frame = spark.createDataFrame(rows, stream.EVENTS_SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def event(number, user, kind, value=1.0, day=1, key=0):
    at = datetime(2024, 1, day, 12) + timedelta(seconds=number)
    return (number, at, user, kind, value, f'{{"k": {key}}}')


@pytest.fixture
def folders(tmp_path):
    source, work = tmp_path / "events", tmp_path / "work"
    return source, str(work)


def test_resume_reads_only_new_files(spark, folders, values):
    source, work = folders
    write_events(spark, source, [event(1, 1, "view")])
    assert stream.only_new(stream.read_events(spark, str(source)), work).count() == 1
    write_events(spark, source, [event(2, 1, "view")])
    again = stream.only_new(stream.read_events(spark, str(source)), work)
    assert values(again, "event_id") == [(1,), (2,)]


def test_view_counts_over_restarts(spark, folders, values, make_jobs):
    source, work = folders
    active = make_jobs({}, {}, {"is_active": 0}).filter("is_active = 1")

    def run():
        views = stream.read_events(spark, str(source)).select(F.get_json_object("props", "$.k").cast("bigint").alias("id"))
        return stream.count_views(views, active, work)

    write_events(spark, source, [event(i, 1, "view", key=i % 3 + 1) for i in range(9)])
    assert values(run()) == [(1, 3), (2, 3)]
    write_events(spark, source, [event(20, 1, "view", key=2)])
    assert values(run()) == [(1, 3), (2, 4)]
    assert values(run()) == [(1, 3), (2, 4)]


def test_daily_quota_equals_batch(spark, folders, values):
    source, work = folders
    rows = [event(i, i % 4, "click", day=i // 40 + 1) for i in range(100)]
    write_events(spark, source, rows[:60])
    stream.daily_quota(stream.read_events(spark, str(source)).select("user_id", "ts"), work)
    write_events(spark, source, rows[60:])
    got = stream.daily_quota(stream.read_events(spark, str(source)).select("user_id", "ts"), work)
    batch = spark.createDataFrame(rows, stream.EVENTS_SCHEMA).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    assert values(got, "user_id", "day", "search_count") == values(batch)
    assert all(r["at_limit"] == (r["search_count"] >= 10) for r in got.collect())


def test_usage_log_is_partitioned_by_day(spark, folders, values):
    source, work = folders
    write_events(spark, source, [event(1, 1, "view", day=1), event(2, 1, "purchase", day=2), event(3, 1, "error", day=2)])
    log = stream.append_usage_log(stream.read_events(spark, str(source)), work)
    assert values(log.select("usage_id", F.col("day").cast("string"))) == [(1, "2024-01-01"), (2, "2024-01-02")]


def changed_jobs(spark, source):
    others = [c for c in retrieval.INDEX_COLUMNS[1:]] + ["org_location", "job_source"]
    return stream.read_events(spark, str(source)).select(
        F.get_json_object("props", "$.k").cast("bigint").alias("id"), F.col("event_id").alias("change_no"),
        F.col("event_type").alias("job_title"), F.col("value").cast("int").alias("is_active"),
        *[F.lit(None).cast("string").alias(c) for c in others],
        *[F.lit(0).alias(c) for c in ("exists_in_uk", "exists_in_london", "has_description")],
    )


def test_index_follows_changes(spark, folders, values, make_jobs):
    source, work = folders
    retrieval.SearchIndex.build(make_jobs({"job_title": "nurse nurse"}, {"job_title": "chef"}, {"job_title": "cook"}), f"{work}/index", parts=3)

    def run():
        index = stream.refresh_index(changed_jobs(spark, source), work)
        return values(index.postings.filter("field = 'job_title'"), "term", "id", "tf")

    write_events(spark, source, [event(1, 0, "old", key=1), event(2, 0, "night nurse", key=1), event(3, 0, "gone", 0.0, key=2)])
    assert run() == [("cook", 3, 1), ("night", 1, 1), ("nurse", 1, 1)]
    write_events(spark, source, [event(4, 0, "new job", key=9)])
    assert run() == [("cook", 3, 1), ("job", 9, 1), ("new", 9, 1), ("night", 1, 1), ("nurse", 1, 1)]


class Broken(Exception):
    pass


def broken_once(monkeypatch, module, name, after):
    """Let a function fail once: before it does anything, or after it is done."""
    real, left = getattr(module, name), [1]

    def run(*args, **how):
        if left and not after:
            left.pop()
            raise Broken
        out = real(*args, **how)
        if left:
            left.pop()
            raise Broken
        return out

    monkeypatch.setattr(module, name, run)


@pytest.mark.parametrize("after", [False, True])
def test_index_refresh_that_breaks_off_is_done_again(spark, folders, values, make_jobs, monkeypatch, after):
    source, work = folders
    retrieval.SearchIndex.build(make_jobs({"job_title": "nurse"}, {"job_title": "chef"}), f"{work}/index", parts=3)
    write_events(spark, source, [event(1, 0, "night nurse", key=1), event(2, 0, "baker", key=5)])
    broken_once(monkeypatch, search_index, "_commit", after)
    with pytest.raises(Exception):
        stream.refresh_index(changed_jobs(spark, source), work)
    index = stream.refresh_index(changed_jobs(spark, source), work)
    assert values(index.postings.filter("field = 'job_title'"), "term", "id", "tf") == [("baker", 5, 1), ("chef", 2, 1), ("night", 1, 1), ("nurse", 1, 1)]
    assert values(index.terms.filter("field = 'job_title'"), "term", "df") == [("baker", 1), ("chef", 1), ("night", 1), ("nurse", 1)]
    assert index.corpus.select("n").first()[0] == 3


@pytest.mark.parametrize("after", [False, True])
def test_counts_of_a_repeated_batch(spark, folders, values, make_jobs, monkeypatch, after):
    """A batch that breaks off before or after its snapshot is written counts once."""
    source, work = folders
    write_events(spark, source, [event(i, i % 2, "click", key=1) for i in range(6)])
    searches = lambda: stream.read_events(spark, str(source)).select("user_id", "ts")
    stream.daily_quota(searches(), work)
    write_events(spark, source, [event(9, 1, "click", key=1), event(10, 7, "click", key=1)])
    broken_once(monkeypatch, stream, "write_snapshot", after)
    with pytest.raises(Exception):
        stream.daily_quota(searches(), work)
    assert values(stream.daily_quota(searches(), work), "user_id", "search_count") == [(0, 3), (1, 4), (7, 1)]


@pytest.mark.parametrize("after", [False, True])
def test_checkouts_of_a_repeated_batch(spark, folders, values, monkeypatch, after):
    source, work = folders
    users, payments = tables(spark)
    write_events(spark, source, [event(1, 1, "buy", key=1)])
    stream.apply_checkouts(checkouts(spark, source), users, payments, work)
    write_events(spark, source, [event(2, 2, "buy", key=2), event(3, 2, "buy", key=3), event(4, 1, "buy", key=1)])
    broken_once(monkeypatch, stream, "write_snapshot", after)
    with pytest.raises(Exception):
        stream.apply_checkouts(checkouts(spark, source), users, payments, work)
    people, paid = stream.apply_checkouts(checkouts(spark, source), users, payments, work)
    assert values(people) == [(1, 2), (2, 2), (3, 0)]
    assert [r for r in values(paid, "user_id", "transaction_id", "status") if r[0] == 2] == [(2, "2", "success"), (2, "3", "success")]
    assert [r[1] for r in values(paid, "user_id", "transaction_id") if r[0] == 1] == ["1", "1", "t"]


PAYMENTS = "payment_id bigint, user_id bigint, amount decimal(12,2), transaction_id string, status string, created_at timestamp_ntz"
CHECKOUTS = "event_id bigint, user_id bigint, tier bigint, transaction_id string, amount_total bigint, event_time timestamp_ntz"
USERS = "user_id bigint, membership_status bigint"
NOW = datetime(2024, 1, 1)


def tables(spark):
    users = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], USERS)
    payments = spark.createDataFrame(
        [(1, 1, None, None, "pending", NOW), (2, 1, None, None, "pending", NOW), (3, 1, None, "t", "success", NOW),
         (4, 3, None, None, "pending", NOW)], PAYMENTS,
    )
    return users, payments


def test_checkouts_settle_all_pending_payments(spark, values):
    users, payments = tables(spark)
    events = spark.createDataFrame(
        [(1, 1, 2, "p1", 2000, NOW), (2, 1, 3, "p2", 3050, NOW), (3, 2, None, "p3", None, NOW)], CHECKOUTS
    )
    new_users, new_payments = billing.apply_checkouts(users, payments, events)
    assert values(new_users, "user_id", "membership_status") == [(1, 3), (2, 1), (3, 0)]
    got = values(new_payments.select("user_id", "payment_id", "transaction_id", "status", F.col("amount").cast("double")))
    assert got == sorted([
        (1, 1, "p1", "success", None), (1, 2, "p1", "success", None), (1, 3, "t", "success", None), (1, None, "p2", "success", 30.5),
        (2, None, "p3", "success", 0.0), (3, 4, None, "pending", None),
    ], key=repr)


def test_repeated_checkout_counts_once(spark, folders, values):
    source, work = folders
    users, payments = tables(spark)

    def run():
        events = stream.read_events(spark, str(source)).select(
            "event_id", "user_id", F.lit(2).cast("bigint").alias("tier"), F.get_json_object("props", "$.k").alias("transaction_id"),
            (F.col("value") * 100).cast("bigint").alias("amount_total"), F.col("ts").alias("event_time"),
        )
        people, paid = stream.apply_checkouts(events, users, payments, work)
        return values(people), values(paid, "user_id", "payment_id", "transaction_id", "status")

    write_events(spark, source, [event(1, 2, "buy", 5.0, key=7), event(2, 2, "buy", 5.0, key=7)])
    people, paid = run()
    assert people == [(1, 0), (2, 2), (3, 0)]
    assert [p for p in paid if p[0] == 2] == [(2, None, "7", "success")]
    write_events(spark, source, [event(3, 2, "buy", 5.0, key=7), event(4, 3, "buy", 5.0, key=8)])
    people, paid = run()
    assert people == [(1, 0), (2, 2), (3, 2)]
    assert [p for p in paid if p[0] != 1] == [(2, None, "7", "success"), (3, 4, "8", "success")]


def checkouts(spark, source):
    return stream.read_events(spark, str(source)).select(
        "event_id", "user_id", F.lit(2).cast("bigint").alias("tier"), F.get_json_object("props", "$.k").alias("transaction_id"),
        (F.col("value") * 100).cast("bigint").alias("amount_total"), F.col("ts").alias("event_time"),
    )


def test_late_checkouts_and_searches_count(spark, folders, values):
    source, work = folders
    users, payments = tables(spark)
    write_events(spark, source, [event(1, 1, "click", day=9, key=1)])
    stream.apply_checkouts(checkouts(spark, source), users, payments, work + "/c")
    stream.daily_quota(stream.read_events(spark, str(source)).select("user_id", "ts"), work + "/q")
    write_events(spark, source, [event(2, 2, "click", day=2, key=2), event(3, 1, "click", day=1, key=1)])
    people, paid = stream.apply_checkouts(checkouts(spark, source), users, payments, work + "/c")
    assert values(people) == [(1, 2), (2, 2), (3, 0)]
    assert [r for r in values(paid, "user_id", "transaction_id", "status") if r[0] == 2] == [(2, "2", "success")]
    quota = stream.daily_quota(stream.read_events(spark, str(source)).select("user_id", "ts"), work + "/q")
    assert values(quota.select("user_id", F.col("day").cast("string"), "search_count")) == [(1, "2024-01-01", 1), (1, "2024-01-09", 1), (2, "2024-01-02", 1)]
