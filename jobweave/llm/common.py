"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import ship_package
from jobweave.sources.workdir import shared_folder

#: White space of every operator here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once to the shared folder and read back: later jobs start from these files."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers can import this package from now on."""
    ship_package(spark)
    return spark


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def key_of(column: Column) -> Column:
    """A key that is never null: null and the empty text stay different keys."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit("?"))


def attach(rows: DataFrame, lookup: DataFrame, key: str, counts: str, spread: Sequence[str], limit: int = BROADCAST_ROWS, target: int = 1_000_000) -> DataFrame:
    """Left join with a lookup that has each key once and the number of its rows in `counts`.

    Up to `limit` lookup rows (counted) are broadcast.  Beyond it both sides are shuffled, and a key of more than `target`
    rows is cut into pieces of about that size by the hash of the `spread` columns, its lookup row being copied once per
    piece.  There are at most (all rows / target) such keys, whose number of pieces travels with the rows.
    """
    if lookup.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(lookup.drop(counts)), key, "left")
    pieces = F.ceil(F.col(counts) / target).cast("int")
    hot = lookup.filter(F.col(counts) > target).select(key, pieces.alias("_pieces"))
    marked = rows.join(hot.hint("broadcast") if hot.limit(limit + 1).count() <= limit else hot, key, "left")
    piece = F.pmod(F.xxhash64(*spread), F.coalesce("_pieces", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))
    return marked.withColumn("_piece", piece).drop("_pieces").join(lookup.withColumn("_piece", copies).drop(counts), [key, "_piece"], "left").drop("_piece")


# ------------------------------------------------------------------------------------------------ words as numbers

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for batches of usual size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        step, filled = base, 1
        while filled < size:
            np.multiply(have[:filled], np.uint64(step), out=have[filled : 2 * filled])
            step, filled = step * step % (1 << 64), 2 * filled
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts: (hashes, first word of each text plus the end, starts, ends, joined bytes).

    A word's number is the polynomial of its bytes, taken from one running sum over all bytes, then mixed with its length.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    powers = _powers(_FACTOR, len(data))[: len(data)]
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = (sums[ends - 1] - before) * _powers(_INVERSE, len(data))[starts]
    hashes = mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, offsets), starts, ends, data


def without(rows: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is not among the distinct `ids`; null counts as a key.  Up to `limit` ids (counted) are broadcast."""
    ids = ids.select(F.col(key).alias("__without")).distinct()
    small = F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
    return rows.join(small, rows[key].eqNullSafe(F.col("__without")), "left_anti")


def shared_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes below the shared folder and hand the file to every executor; returns its name for `SparkFiles.get`."""
    context = spark.sparkContext
    folder = shared_folder(spark)
    unique = f"{folder.rsplit('/', 1)[1]}-{name}"
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{unique}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path)
    try:
        for start in range(0, len(data), 1 << 20):
            out.write(bytearray(data[start : start + (1 << 20)]))
    finally:
        out.close()
    context.addFile(system.makeQualified(path).toString())
    return unique


def size_step(n: str) -> Column:
    """Sizes in steps of a sixteenth of a power of two."""
    return F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")


def most(rows: DataFrame, n: str, limit: int) -> float:
    """Smallest `size_step` such that at most `limit` rows reach it; the driver sees one row per step, under 1100."""
    sizes = sorted(rows.groupBy(size_step(n).alias("step")).count().collect(), reverse=True)
    total, bound = 0, math.inf
    for at, count in sizes:
        if total + count > limit:
            break
        total, bound = total + count, at
    return bound


def released() -> None:
    """Give memory that a task no longer needs back to the system: Python workers stay for later tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
