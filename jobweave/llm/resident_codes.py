"""Vector codes by member-resident Lloyd rounds.

Vectors are cut into equal parts, and each part position has a codebook.  A part lives with the owner of its codebook entry:
rows are laid out by (position, entry, salt), the salt cutting entries of many members.  Owners sum their resident members into
new entries, one small row per entry and task.  When parts are assigned again, each task writes those that keep their entry in
place and those that change it apart, and only the latter go through the next shuffle to their new owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import attach, shipped, table
from jobweave.sources.workdir import shared_folder

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Integer components are held within this bound, so that distances and sums stay within 64 bits.
BOUND = 1 << 26
#: Members of an entry that share a salt.
MEMBERS = 2_000
BLOCK = 4096

Codebooks = list[np.ndarray]


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each integer vector; ties go to the lower index.  Exact."""
    most = max(np.abs(vectors).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * vectors.shape[1] * float(most) ** 2 < 2**53 else np.int64
    x, y = vectors.astype(kind), entries.astype(kind)
    scores = (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    best = scores.argmin(axis=1)
    return best, (scores[np.arange(len(x)), best] + (x * x).sum(axis=1)).astype(np.int64)


def integers(column: Column, scale: int = SCALE, bound: int = BOUND) -> Column:
    """Components as integers floor(scale * x), held within the bound."""
    whole = F.transform(column, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(bound))), F.lit(float(bound)))).cast("int"))
    return whole


def usable(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, row, v: integer vectors of the usable rows.

    A row is usable if its vector and all components are there and finite, and if its length is the one of the smallest usable
    vec_id's vector and a multiple of `parts`.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows.filter(good & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", "label", "embedding")
    width = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("width")).first()
    return kept.filter(F.size("embedding") == (width[0] if width else 0)).select("vec_id", "label", F.monotonically_increasing_id().alias("row"), integers(F.col("embedding")).alias("v"))


def _assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state with the nearest entry of each part, its error, and whether it moved."""
    sent = state.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                block = batch.slice(low, BLOCK)
                row, position, entry, v = (block.column(i) for i in range(4))
                at, old = position.to_numpy(), entry.to_numpy()
                vectors = np.frombuffer(b"".join(v.to_pylist()), np.int32).reshape(len(at), -1)
                best, error = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
                for p in np.unique(at).tolist():
                    mine = at == p
                    best[mine], error[mine] = nearest(vectors[mine].astype(np.int64), sent.value[p])
                yield pa.RecordBatch.from_arrays([row, position, pa.array(best), v, pa.array(error), pa.array(best != old)], ["row", "position", "entry", "v", "error", "moved"])

    return state.select("row", "position", "entry", "v").mapInArrow(assign, "row bigint, position int, entry int, v binary, error bigint, moved boolean")


def _sums(state: DataFrame, width: int) -> DataFrame:
    """position, entry, n, s0, s1, ...: what owners add up from their resident members."""
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                block = batch.slice(low, BLOCK)
                at, entry = block.column(0).to_numpy().astype(np.int64), block.column(1).to_numpy()
                vectors = np.frombuffer(b"".join(block.column(2).to_pylist()), np.int32).reshape(len(at), -1).astype(np.int64)
                keys, where = np.unique(at << 32 | entry, return_inverse=True)
                sums = np.zeros((len(keys), vectors.shape[1] + 1), np.int64)
                np.add.at(sums, where, np.concatenate((np.ones((len(at), 1), np.int64), vectors), axis=1))
                for key, own in zip(keys.tolist(), sums):
                    totals[key >> 32, key & 0xFFFFFFFF] = totals.get((key >> 32, key & 0xFFFFFFFF), 0) + own
        if totals:
            matrix = np.stack(list(totals.values()))
            places = np.array(list(totals), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1]), *(pa.array(c) for c in matrix.T)], ["position", "entry", "n", *names])

    kinds = ", ".join(f"{name} bigint" for name in ("n", *names))
    rows = state.select("position", "entry", "v").mapInArrow(add, f"position int, entry int, {kinds}")
    return rows.groupBy("position", "entry").agg(*(F.sum(name).alias(name) for name in ("n", *names)))


def _settled(state: DataFrame, books: Codebooks, path: str) -> DataFrame:
    """The state after an assignment: rows that keep their entry written where they are, the others at their new owner.

    The tasks first write both kinds into two folders; only the folder of rows that moved is read again for a shuffle.
    """
    spark = state.sparkSession
    _assigned(state, books).write.partitionBy("moved").parquet(f"{path}/assigned")
    both = spark.read.schema("row bigint, position int, entry int, v binary, error bigint, moved boolean").parquet(f"{path}/assigned")
    moved = both.filter("moved").drop("moved")
    counts = {(r["position"], r["entry"]): r["count"] for r in moved.groupBy("position", "entry").count().collect()}
    if not counts:
        return both.drop("moved")
    hot = [f"WHEN {(p << 32) + e} THEN {-(-n // MEMBERS)}" for (p, e), n in counts.items() if n > MEMBERS]
    pieces = F.expr(f"CASE shiftleft(CAST(position AS BIGINT), 32) + entry {' '.join(hot)} ELSE 1 END") if hot else F.lit(1)
    owned = moved.repartition("position", "entry", F.pmod(F.xxhash64("row"), pieces))
    owned.write.parquet(f"{path}/arrived")
    return both.filter("NOT moved").drop("moved").unionAll(spark.read.schema(moved.schema).parquet(f"{path}/arrived"))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that no later job reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def coded(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error of every usable row; the final codebooks).

    `usable` says which rows count.  Codebooks start as the parts of the smallest `entries` vec_ids (nulls last, equal ids by
    their vectors), fewer if there are fewer rows; repeated rows count as often as they stand.  Ties go to the lower entry,
    means are floored, and an entry without members stays.  Without usable rows the codebooks are empty.  At most `entries`
    rows and `parts * entries` sums of one part's width reach the driver.
    """
    spark = shipped(rows.sparkSession)
    base = shared_folder(spark)
    path = f"{base}/vectors"
    kept = usable(rows, parts)
    kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    width = len(first[0]) // parts if first else 0
    start = np.array(first, np.int64).reshape(len(first), parts, width)
    books = [start[:, p] for p in range(parts)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                own = [x.tobytes() for x in flat[:, p]]
                position, entry = np.full(len(own), p, np.int32), np.full(len(own), -1, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(position), pa.array(entry), pa.array(own, pa.binary())], ["row", "position", "entry", "v"])

    state = kept.select("row", "v").mapInArrow(cut, "row bigint, position int, entry int, v binary")
    for turn in range(rounds + 1 if first else 0):
        state = _settled(state, books, f"{base}/round{turn}")
        if turn:
            removed(spark, f"{base}/round{turn - 1}")
        if turn < rounds:
            for r in _sums(state, width).collect():
                books[r["position"]][r["entry"]] = [total // r["n"] for total in r[3:]]
    if not first:
        state = spark.createDataFrame([], "row bigint, position int, entry int, v binary, error bigint")
    codes = [F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"c{p}") for p in range(parts)]
    by_row = state.groupBy("row").agg(F.sum("error").alias("error"), *codes)
    out = kept.select("vec_id", "label", "row").join(by_row, "row")
    return out.select("vec_id", "label", F.array(*(f"c{p}" for p in range(parts))).alias("codes"), "error"), books


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all embeddings with their errors, also summed over equal labels."""
    rows, books = coded(table(spark, folder, "embeddings"))
    code = F.concat(*(F.lower(F.lpad(F.hex(F.col("codes")[p]), 2, "0")) for p in range(PARTS)))
    rows = rows.select("vec_id", "label", F.coalesce(F.col("label").cast("string"), F.lit("?")).alias("key"), code.alias("code"), "error")
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = attach(rows, sums, "key", "n", ["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, round after round; for small tables, as all parts meet all entries."""
    head = f"""
k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
    SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM k, range({parts}) t(p)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, x FROM p WHERE r <= {entries}
)"""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
  SELECT r, p, min(d) AS d, arg_min(e, d * 1000 + e) AS e FROM (
    SELECT p.r, p.p, b.e, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.x, b.x)]) AS d FROM p JOIN b{turn} b ON b.p = p.p)
  GROUP BY r, p
)""")
        if turn < rounds:
            steps.append(f"""b{turn + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{turn} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT a.p, a.e, i, sum(p.x[i]) AS s, count(*) AS n FROM a{turn} a JOIN p ON p.r = a.r AND p.p = a.p, range(1, len(p.x) + 1) t(i) GROUP BY a.p, a.e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    tail = f"""c AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (r)"""
    return "WITH " + ", ".join([head.strip(), *steps, tail])


SQL = _sql()
