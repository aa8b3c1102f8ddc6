"""Joins and top-k that hold up when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
BROADCAST_ROWS = 200_000
#: Rows of one key that one task may hold, and most keys that are marked as hot.
PIECE_ROWS = 1_000_000
HOT_KEYS = 100_000


def is_small(rows: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Has the table at most `max_rows` rows?  Counts no further than that."""
    return rows.limit(max_rows + 1).count() <= max_rows


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Keys with more than `piece_rows` rows, from rows per key, with the number of `_pieces` to cut them into.

    A key also needs more than 1 / `HOT_KEYS` of all rows, so that there are never more than `HOT_KEYS` of them.
    """
    total = counts.agg(F.sum(n).alias("total")).scalar()
    hot = (F.col(n) > piece_rows) & (F.col(n) * HOT_KEYS > total)
    return counts.filter(hot).select(*keys, F.ceil(F.col(n) / piece_rows).cast("int").alias("_pieces"))


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    piece_rows: int = PIECE_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join of rows with a lookup that has each key once.

    Rows of a key with more than `piece_rows` rows are cut into as many pieces as its count asks for, by their content
    and the input partition they come from, so that equal rows part too; both are the same again when a lost task is
    repeated.  The one lookup row of such a key is copied for each piece; all other rows are shuffled as they are.  Rows
    without a key match nothing and are spread over all tasks.  `hot` saves counting where the counts are known.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, piece_rows=piece_rows)
    hashable = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
    spread = F.xxhash64(*hashable, F.spark_partition_id())
    apart = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    hot = F.broadcast(hot)  # at most HOT_KEYS rows
    marked = rows.withColumn("_spread", spread).join(hot, keys, "left")
    piece = F.when(apart, F.pmod("_spread", F.lit(1 << 20))).otherwise(F.pmod("_spread", F.coalesce("_pieces", F.lit(1))))
    cut = marked.withColumn("_salt", piece.cast("int")).drop("_pieces", "_spread")
    copies = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    copied = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_pieces")
    return cut.join(copied, [*keys, "_salt"], how).drop("_salt")


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, salts: int = 16) -> DataFrame:
    """Shuffled inner join where neither side is unique: each key is cut into `salts` pieces by `spread`.

    The small side is copied once per piece.
    """
    cut = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cut.join(copies, [*keys, "_salt"]).drop("_salt")


def top_k(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Column,
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """First k rows of each key with their 1-based rank.

    Each key is ranked in salted pieces first, cut by `spread`, so the last ranking sees at most salts * k rows of a key.
    """
    cut = rows.withColumn("_salt", F.pmod(F.xxhash64(spread, F.spark_partition_id()), F.lit(salts)))
    pieces = W.partitionBy(*keys, "_salt").orderBy(*order)
    rows = cut.withColumn("_r", F.row_number().over(pieces)).filter(F.col("_r") <= k).drop("_r", "_salt")
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def first_rows(rows: DataFrame, order: Sequence[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First rows of the whole table with their rank: a distributed top-k, then a ranking of those `limit` rows only."""
    top = rows.orderBy(*order).limit(limit)
    ranked = top.withColumn(rank, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def number_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Every row with its 1-based number within its key, for keys of any size.

    Rows are cut into ranges of (keys, order) and written.  A running sum over the few counts per key and range gives each
    piece its first number, and rows are numbered inside pieces only, so no task sees more of a key than one range.
    Rows that are equal in `order` share a piece and are numbered in any order.
    """
    from jobweave.sources import workdir

    keys = list(keys)
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    pieces = workdir.stored(ranged, workdir.shared_folder(rows.sparkSession))
    counts = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*order))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, "_piece")]
    firsts = firsts.filter("_first > 0")
    placed = pieces.withColumn("_place", inside).alias("r")
    joined = placed.join(F.broadcast(firsts).alias("f") if is_small(firsts) else firsts.alias("f"), same, "left")
    number = (F.coalesce("f._first", F.lit(0)) + F.col("r._place")).cast("bigint")
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), number.alias(name))
