"""Incremental behaviours as Structured Streaming jobs over file sources.

Every job takes a streaming DataFrame and a folder, runs what has arrived (`availableNow`), and can be started again on
the same folder: the checkpoint remembers what has been read and holds Spark's own state, and every write is a function of
the batch id, so a repeated batch writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave import fixed_values as fx
from jobweave.operators import billing
from jobweave.operators.search_index import SearchIndex

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(
    spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of the events files of a folder, with a time column watermarks accept."""
    options = {"pathGlobFilter": names, "maxFilesPerTrigger": files_per_trigger}
    stream = spark.readStream.schema(EVENTS_SCHEMA).options(**options).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def run_batches(stream: DataFrame, folder: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    _finish(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(apply))


def write_snapshot(rows: DataFrame, folder: str, number: int) -> None:
    """The table after batch `number`, as plain Parquet.  It takes the place of the last but one, so that a batch that is
    repeated still finds the state before it, and writes the same again."""
    rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/turn={number % 2}")


def read_snapshot(first: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """The newest snapshot, or the one before a batch; `first` is the table before the first batch."""
    spark = first.sparkSession
    if before is not None:
        if before == 0:
            return first
        paths = [f"{folder}/turn={(before - 1) % 2}"]
    else:
        paths = [p for p in (f"{folder}/turn=0", f"{folder}/turn=1") if _exists(spark, p)]
        if not paths:
            return first
    schema = T.StructType([*first.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(*paths)
    if len(paths) > 1:
        rows = rows.filter(F.col("_batch") == rows.agg(F.max("_batch").alias("newest")).scalar())
    return rows.select(*first.schema.names)


def _exists(spark: SparkSession, folder: str) -> bool:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def append_usage_log(events: DataFrame, folder: str) -> DataFrame:
    """Append search and application rows to a log partitioned by day."""
    rows = usage_rows(events).withColumn("day", F.to_date("date"))
    options = {"checkpointLocation": f"{folder}/checkpoint", "path": f"{folder}/log"}
    _finish(rows.writeStream.format("parquet").partitionBy("day").options(**options).outputMode("append"))
    return events.sparkSession.read.parquet(f"{folder}/log")


def usage_rows(events: DataFrame) -> DataFrame:
    """Clicks and views are searches, purchases are applications."""
    kind = F.col("event_type")
    return events.filter(kind.isin("click", "view", "purchase")).select(
        F.col("event_id").alias("usage_id"),
        "user_id",
        F.col("ts").alias("date"),
        F.when(kind != "purchase", kind).alias("search_keywords"),
        F.when(kind == "purchase", F.concat(F.lit('["'), F.col("props"), F.lit('"]'))).alias("companies_applied"),
    )


def count_views(views: DataFrame, active: DataFrame, folder: str) -> DataFrame:
    """Views per active job.  Spark's state store holds the running counts; every batch writes them as one snapshot."""
    empty = views.sparkSession.createDataFrame([], "id bigint, views bigint")
    counts = views.groupBy("id").agg(F.count("*").alias("views"))

    def apply(batch: DataFrame, number: int) -> None:
        write_snapshot(batch, f"{folder}/views", number)

    run_batches(counts, folder, apply, "complete")
    return read_snapshot(empty, f"{folder}/views").join(active.select("id"), "id", "left_semi")


def daily_quota(searches: DataFrame, folder: str, limit: int = fx.DAILY_SEARCHES) -> DataFrame:
    """Searches per user and UTC day with the limit flag; a search counts for its day however late it comes.

    The counts are state of Spark's state store, without a watermark, so that no day is ever closed.
    """
    empty = searches.sparkSession.createDataFrame([], "user_id bigint, day date, search_count bigint")
    counts = searches.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("search_count"))

    def apply(batch: DataFrame, number: int) -> None:
        write_snapshot(batch, f"{folder}/quota", number)

    run_batches(counts, folder, apply, "complete")
    return read_snapshot(empty, f"{folder}/quota").withColumn("at_limit", F.col("search_count") >= limit)


def refresh_index(changes: DataFrame, folder: str) -> SearchIndex:
    """Keep the search index of a folder in step with changed jobs: each batch is one refresh of it.

    `changes` has the columns of jobs plus `change_no`; the last change of an id in a batch counts, and a job that is not
    active leaves the index.  A batch that is repeated refreshes with the same rows again, which changes nothing.
    """
    spark = changes.sparkSession
    columns = [c for c in changes.columns if c not in ("id", "change_no")]

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct(*columns), "change_no").alias("job")).select("id", "job.*")
        SearchIndex(spark, f"{folder}/index").refresh(last.persist())
        last.unpersist()

    run_batches(changes, folder, apply)
    return SearchIndex(spark, f"{folder}/index")


def apply_checkouts(
    events: DataFrame, users: DataFrame, payments: DataFrame, folder: str
) -> tuple[DataFrame, DataFrame]:
    """Apply completed checkout events once each, however late they come.

    Repeats are known by user and transaction id: Spark's state store keeps all that were seen, without a watermark, and
    those of the first payments table count as seen.  Events without a transaction id are taken as they are.  Each batch
    writes one snapshot of users and one of payments.
    """
    own = F.coalesce(F.concat(F.lit("t"), "transaction_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")))
    once = events.withColumn("_own", own).dropDuplicates(["user_id", "_own"]).drop("_own")

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
        paid = payments.select("user_id", "transaction_id").distinct()
        fresh = batch.join(paid, ["user_id", "transaction_id"], "left_anti")
        old = (read_snapshot(users, f"{folder}/users", number), read_snapshot(payments, f"{folder}/payments", number))
        new_users, new_payments = billing.apply_checkouts(*old, fresh)
        write_snapshot(new_users.select(*users.columns), f"{folder}/users", number)
        write_snapshot(new_payments.select(*payments.columns), f"{folder}/payments", number)

    run_batches(once, folder, apply)
    return read_snapshot(users, f"{folder}/users"), read_snapshot(payments, f"{folder}/payments")


def only_new(stream: DataFrame, folder: str) -> DataFrame:
    """Process what earlier runs on this folder have not; the checkpoint is the list of finished work."""
    options = {"checkpointLocation": f"{folder}/checkpoint", "path": f"{folder}/done"}
    _finish(stream.writeStream.format("parquet").options(**options).outputMode("append"))
    return stream.sparkSession.read.parquet(f"{folder}/done")
