"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

State of an index, in one folder, by generation:

* `refs`: every (line digest, document) that was inserted, and `gone`, documents that were deleted;
* `counts`: digest, number of its documents, largest of their ids -- exact;
* `filters`: per shard a cuckoo filter of the digests whose count reaches the threshold.

A line is looked up in its shard's filter first; only what the filter knows is tested against the exact counts.  Cuckoo filters
take deletions, so deleting documents lowers counts, takes digests out of the filters and brings their lines back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import SPACES, attach, shipped, table
from jobweave.sources.workdir import shared_folder

MIN_CHARS = 40
MIN_DOCS = 5
SHARDS = 64
#: Rows of one shard that one task probes.
PROBE_ROWS = 250_000
SLOTS, MAX_KICKS, MAX_LOAD = 4, 500, 0.84


def digest_of(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit digest of a line's key: stripped, A-Z in lower case; None for shorter keys."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


# ------------------------------------------------------------------------------------------------ cuckoo filter


class CuckooFilter:
    """Set of 16-byte digests with deletion: four 16-bit fingerprints a bucket, two possible buckets a digest."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, keys / (SLOTS * MAX_LOAD))))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, digests: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.frombuffer(digests, "<u8")[0::2]
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints = np.where(prints == 0, np.uint16(1), prints)
        mask = np.uint64(len(self.table) - 1)
        first = h & mask
        return prints, first.astype(np.int64), (first ^ (self._jump(prints) & mask)).astype(np.int64)

    @staticmethod
    def _jump(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def may_have(self, digests: bytes) -> np.ndarray:
        """Of digests written one after another: False only where a digest was never inserted or is deleted again."""
        prints, a, b = self._places(digests)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, digests: bytes) -> bool:
        """False if the table is too full; it must then be rebuilt larger."""
        mask = len(self.table) - 1
        for value, a, b in zip(*self._places(digests)):
            value, at = np.uint16(value), int(a)
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = value
                    break
            else:
                for kick in range(MAX_KICKS):
                    slot = (int(value) + kick) % SLOTS
                    value, self.table[at, slot] = self.table[at, slot], value
                    at ^= int(self._jump(np.array([value], np.uint16))[0]) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = value
                        break
                else:
                    return False
        return True

    def delete(self, digests: bytes) -> None:
        """Take out digests that are in the filter."""
        for value, a, b in zip(*self._places(digests)):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == value)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def changed_filter(old: bytes | None, kept: list[bytes], added: list[bytes], removed: list[bytes]) -> bytes:
    """The filter after a change; it is rebuilt from all its digests if there is none yet or the table is too full."""
    if old is not None:
        held = CuckooFilter.read(old)
        if len(kept) + len(added) <= held.table.size * MAX_LOAD:
            held.delete(b"".join(removed))
            if held.insert(b"".join(added)):
                return held.bytes()
    live, size = b"".join([*kept, *added]), len(kept) + len(added)
    while True:
        fresh = CuckooFilter.sized(size)
        if fresh.insert(live):
            return fresh.bytes()
        size *= 2


# ------------------------------------------------------------------------------------------------ the index


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (digest, doc_id) of the lines that are long enough."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = {digest_of(line, min_chars) for line in text.split("\n")} if text else set()
                own.discard(None)
                found.extend(own)
                rows.extend([row] * len(own))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), ids], ["digest", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(refs, f"digest binary, doc_id {kind}")
    return rows.dropDuplicates(["digest", "doc_id"])


class LineIndex:
    """A folder that keeps references, counts and filters of lines; each change is a new generation.

    Null ids are one document, whose id is below all others.  A document is inserted once: its lines do not change while it
    is in the index.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int = SHARDS, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.folder, self.shards, self.min_docs, self.min_chars = shipped(spark), folder, shards, min_docs, min_chars
        self.generation = 0

    def _read(self, name: str, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}-{generation}")

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """A repeated or broken change writes its generation anew."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}-{self.generation + 1}")
        return self._read(name, self.generation + 1)

    def _shard(self):
        return F.pmod(F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("bigint"), F.lit(self.shards)).cast("int")

    def refs(self) -> DataFrame:
        """References of the documents that are in the index."""
        parts = []
        for g in range(1, self.generation + 1):
            part = self._read("refs", g)
            for later in range(g + 1, self.generation + 1):
                gone = self._read("gone", later)
                part = part.join(gone, part["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
            parts.append(part)
        return reduce(DataFrame.unionAll, parts)

    def counts(self) -> DataFrame:
        return self._read("counts", self.generation)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = line_refs(docs, self.min_chars)
        if self.generation:
            old = self.refs()
            same = new["digest"].eqNullSafe(old["digest"]) & new["doc_id"].eqNullSafe(old["doc_id"])
            new = new.join(old, same, "left_anti")
        new = self._write(new, "refs")
        counted = new.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        if self.generation:
            both = counted.unionByName(self.counts())
            counted = both.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
        return self._commit(counted, docs.select("doc_id").limit(0))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take documents out again, given by the column `doc_id`."""
        gone, live = ids.select("doc_id").distinct(), self.refs()
        lost = live.join(gone, live["doc_id"].eqNullSafe(gone["doc_id"]), "left_semi").select("digest").distinct()
        left = live.join(gone, live["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
        again = left.join(lost, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        self._write(live.limit(0), "refs")
        return self._commit(self.counts().join(lost, "digest", "left_anti").unionByName(again), gone)

    def _commit(self, counts: DataFrame, gone: DataFrame) -> LineIndex:
        self._write(gone, "gone")
        counts = self._write(counts, "counts").filter(F.col("n") >= self.min_docs).select("digest")
        if self.generation:
            before = self.counts().filter(F.col("n") >= self.min_docs).select("digest")
            marks = counts.withColumn("now", F.lit(1)).join(before.withColumn("was", F.lit(1)), "digest", "full")
            change = marks.select("digest", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("change"))
            old = self._read("filters", self.generation)
        else:
            change = counts.withColumn("change", F.lit(1))
            old = self.spark.createDataFrame([], "shard int, filter binary")

        def rebuilt(keys: pa.Table, filters: pa.Table) -> pa.Table:
            shard = (keys if keys.num_rows else filters).column("shard")[:1].cast(pa.int32())
            held = filters.column("filter").to_pylist()
            by = {0: [], 1: [], -1: []}
            for digest, what in zip(keys.column("digest").to_pylist(), keys.column("change").to_pylist()):
                by[what].append(digest)
            return pa.table({"shard": shard, "filter": pa.array([changed_filter(held[0] if held else None, by[0], by[1], by[-1])], pa.binary())})

        sharded = change.withColumn("shard", self._shard()).groupBy("shard")
        self._write(sharded.cogroup(old.groupBy("shard")).applyInArrow(rebuilt, "shard int, filter binary"), "filters")
        self.generation += 1
        return self

    def suspects(self, refs: DataFrame) -> DataFrame:
        """References whose digest the filter of its shard may have.  A shard is probed in pieces of bounded size."""
        refs = refs.withColumn("shard", self._shard())
        sizes = refs.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("pieces"))
        sizes = F.broadcast(sizes)  # one row per shard
        cut = refs.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("doc_id", "digest"), "pieces").cast("int")).drop("pieces")
        filters = self._read("filters", self.generation).join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "filter")

        def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
            rows = rows.select(["digest", "doc_id"])
            if not rows.num_rows or not held.num_rows:
                return rows.slice(0, 0)
            digests = b"".join(rows.column("digest").to_pylist())
            return rows.filter(pa.array(CuckooFilter.read(held.column("filter")[0].as_py()).may_have(digests)))

        pairs = cut.groupBy("shard", "piece").cogroup(filters.groupBy("shard", "piece"))
        return pairs.applyInArrow(probe, refs.select("digest", "doc_id").schema)

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, digest) of the lines that a document loses: frequent lines of which it is not the keeper."""
        frequent = self.counts().filter(F.col("n") >= self.min_docs)
        found = attach(self.suspects(refs), frequent.withColumn("known", F.lit(True)), "digest", "n", ["doc_id"])
        return found.filter(F.col("known") & ~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "digest")

    def clean(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """The documents with `text` without lost lines, and `n_lines` and `n_dropped`.

        `refs` may give the references of these documents if they are at hand.  A null or empty text is one empty line.
        """
        drops = self.drops(line_refs(docs, self.min_chars) if refs is None else refs)
        lists = drops.groupBy("doc_id").agg(F.collect_list("digest").alias("__digests")).withColumnRenamed("doc_id", "__id")
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        rows = docs.select(*own).join(lists, docs["doc_id"].eqNullSafe(lists["__id"]), "left").drop("__id")
        place, min_chars = own.index("text"), self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, totals, lost = [], [], []
                for text, digests in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    lines = (text or "").split("\n")
                    gone = set(digests or ())
                    left = [line for line in lines if digest_of(line, min_chars) not in gone] if gone else lines
                    texts.append("\n".join(left))
                    totals.append(len(lines))
                    lost.append(len(lines) - len(left))
                columns = [*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(lost, pa.int64())]
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_lines", "n_dropped"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
        return rows.mapInArrow(cut, f"{schema}, n_lines bigint, n_dropped bigint")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """All documents inserted into a fresh index and cleaned by it.  An empty table gives an empty result."""
    index = LineIndex(docs.sparkSession, shared_folder(docs.sparkSession), **settings).insert(docs)
    return index.clean(docs, index.refs())


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of what stays of every document."""
    rows = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents without repeated lines; `n_chars` follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("_own"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return deduplicated(packed).select(*(made.get(c, F.col("_own")[c]).alias(c) for c in docs.columns))


SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), x AS (
  SELECT r, doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM l
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
