"""Payments, invoices and checkout events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.skew import join_unique

PLAN = "Premium Plan"


def invoices(payments: DataFrame) -> DataFrame:
    """All payments, newest first per user, with the plan label.

    One range-partitioned sort on (user, time, id), so a user with very many payments spreads over several tasks.
    """
    rows = payments.select("user_id", "payment_id", "amount", "transaction_id", "status", "created_at")
    return rows.withColumn("plan", F.lit(PLAN)).orderBy("user_id", F.desc("created_at"), F.desc("payment_id"))


def last_checkout(events: DataFrame) -> DataFrame:
    """Last completed checkout per user of (event_id, user_id, tier, transaction_id, amount_total in pence, event_time)."""
    facts = F.struct("tier", "transaction_id", "amount_total", "event_id", "event_time")
    order = F.struct("event_time", "event_id")
    return events.groupBy("user_id").agg(
        F.max_by(facts, order).alias("last"), F.min_by(facts, order).alias("first")
    )


def apply_checkouts(
    users: DataFrame, payments: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New snapshots of users and payments after completed checkout events.

    The last event sets the tier.  The first one settles all pending payments of the user; events that find none add a
    payment each.  Applying the same events to the result would add payments again, so feed each event once.
    """
    per_user = last_checkout(events)
    tiers = per_user.select("user_id", F.coalesce("last.tier", F.lit(1)).alias("new_tier"))
    new_users = users.join(tiers, "user_id", "left")
    new_users = new_users.withColumn("membership_status", F.coalesce("new_tier", "membership_status")).drop("new_tier")

    pending = payments.filter("status = 'pending'")
    settled_by = per_user.select("user_id", F.struct(F.col("first.transaction_id").alias("id")).alias("paid"))
    settled = join_unique(pending, settled_by, ["user_id"], how="left")
    paid = F.col("paid").isNotNull()
    settled = settled.withColumns(
        {
            "status": F.when(paid, "success").otherwise(F.col("status")),
            "transaction_id": F.when(paid, F.col("paid.id")).otherwise(F.col("transaction_id")),
        }
    )
    untouched = payments.filter("status <> 'pending' OR status IS NULL")

    with_pending = pending.select("user_id").distinct().withColumn("settles", F.lit(True))
    firsts = per_user.select("user_id", F.col("first.event_id").alias("first_event")).join(
        with_pending, "user_id", "left"
    )
    marked = join_unique(events, firsts, ["user_id"])
    settles = (F.col("event_id") == F.col("first_event")) & F.coalesce("settles", F.lit(False))
    added = marked.filter(~settles).select(
        F.lit(None).cast("bigint").alias("payment_id"),
        "user_id",
        (F.coalesce("amount_total", F.lit(0)) / 100.0).cast("decimal(12,2)").alias("amount"),
        "transaction_id",
        F.lit("success").alias("status"),
        F.col("event_time").alias("created_at"),
    )
    columns = ["payment_id", "user_id", "amount", "transaction_id", "status", "created_at"]
    new_payments = untouched.select(*columns).unionByName(settled.select(*columns)).unionByName(added)
    return new_users, new_payments
