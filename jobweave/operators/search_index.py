"""The written search index: one layout that is built, searched, and kept in step with changed jobs.

Postings lie in folders by field, term part and version, documents and vectors by id slice and version.  A refresh writes
whole new versions of the parts and slices that the changed jobs touch, and at last one small table that says which version of
each part counts.  Readers hold to the table they opened: they never meet half an index.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions import text
from jobweave.functions.skew import is_small
from jobweave.operators import filters as flt
from jobweave.sources import workdir

INDEX_COLUMNS = ("job_title", "organisation_name", "location", "remote_type", "experience_level")
TITLE = INDEX_COLUMNS[0]

# What a hit needs to be filtered and ranked, so that hits never go back to the jobs table.
CARRIED = (
    "location", "org_location", "organisation_name", "experience_level", "remote_type", "job_source", "exists_in_uk",
    "exists_in_london", "has_description",
)
RANKING = ("id", "dl", "title_is", "cats", *CARRIED)
VECTOR_CARRIED = (*CARRIED, "cats")

#: Jobs that one part of the postings and one slice of the documents take on average.
PART_JOBS = 250_000
LEAST_PARTS, MOST_PARTS = 8, 8192
#: Tasks that write the postings of one part, so that a term in a third of all titles is spread over as many files.
PIECES = 32
#: Refreshes after which the files of the postings that stay are sorted together with the new ones.
SORTED_EVERY = 8
#: Files that one task keeps open while it writes; rows for more of them are sorted by folder.
OPEN_WRITERS, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 64
#: Bytes of rows that a worker gets at once, as rows of packed postings are long.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Words whose postings a worker makes at once, and rows of postings that it gives back at once.
BATCH_WORDS, BATCH_ROWS = 1_000_000, 50_000

_FLAGS = "exists_in_uk int, exists_in_london int, has_description int"
_TEXTS = "location string, org_location string, organisation_name string, experience_level string, remote_type string, job_source string"
_RANKING = f"id bigint, dl int, title_is string, cats string, {_TEXTS}, {_FLAGS}"
SCHEMAS = {
    "docs": f"{_RANKING}, copy bigint, title_key string, is_course boolean, terms string, part int, version int",
    "postings": "id bigint, copy bigint, term string, tf int, at array<int>, field string, part int, version int",
    "terms": "term string, df bigint, field string, part int, version int",
    "vectors": f"id bigint, embedding array<float>, {_TEXTS}, {_FLAGS}, cats string, part int, version int",
    "corpus": "n bigint, total bigint, version int",
    "catalog": "kind string, part int, of int, version int",
}


def searchable(jobs: DataFrame) -> DataFrame:
    """One row per active job with its title terms, joined by blanks, and what ranking needs.

    One text is written and read faster than a list of many.  The title itself stays behind: only its equality with a query and the course rule are asked for later, and a digest
    and a flag answer those.
    """

    @F.arrow_udf("struct<cats:string,is_course:boolean>")
    def marks(low: pa.Array) -> pa.Array:
        return flt.title_marks(low)

    flags = {f: F.coalesce(F.col(f), F.lit(0)).cast("int") for f in ("exists_in_uk", "exists_in_london", "has_description")}
    title = text.value_or_blank(F.col("job_title"))
    others = sum((F.size(text.tokens(F.col(c))) for c in INDEX_COLUMNS[2:]), F.size(text.tokens(F.col(INDEX_COLUMNS[1]))))
    rows = jobs.filter("is_active = 1").withColumns({**flags, "words": text.tokens(title), "low": F.lower(title)})
    rows = rows.withColumns(
        {
            "dl": F.size("words") + others,
            "terms": F.array_join("words", " "),
            "title_is": F.sha2("low", 256),
            "title_key": F.sha2(text.strip(F.col("low")), 256),
            "marks": marks(F.col("low")),
        }
    )
    rows = rows.withColumns({"cats": F.col("marks.cats"), "is_course": F.col("marks.is_course")})
    return with_copy(rows.select(*RANKING, "title_key", "is_course", "terms"))


def with_copy(docs: DataFrame) -> DataFrame:
    """`copy` tells documents of one id apart: 0 for an id with one row, else a number from the row's content.

    Only ids are shuffled to find those that repeat; equal rows get equal numbers.
    """
    repeated = docs.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("same_id"), "rows")
    repeated = F.broadcast(repeated) if is_small(repeated) else repeated
    marked = docs.join(repeated, F.col("id").eqNullSafe(F.col("same_id")), "left").drop("same_id")
    return marked.withColumn("copy", F.when(F.col("rows") > 1, F.xxhash64(*docs.columns)).otherwise(F.lit(0))).drop("rows")


def listed(terms: Column) -> Column:
    """The terms of a text that `searchable` joined; no term holds a blank."""
    return F.when(terms == "", F.array().cast("array<string>")).otherwise(F.split(terms, " "))


def term_counts(docs: DataFrame, columns: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """One row per (document, field, term) with tf and the term's places, from the document's own terms."""
    own = [listed(F.col("terms")) if c == TITLE else text.tokens(F.col(c)) for c in columns]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), terms.alias("words")) for c, terms in zip(columns, own)])
    rows = docs.select("id", "copy", F.inline(cells)).filter(F.size("words") > 0)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "copy")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from counted_terms(batch)

    schema = f"id {kinds['id']}, copy {kinds['copy']}, term string, tf int, at array<int>, field string"
    return rows.mapInArrow(count, schema)


def counted_terms(batch: pa.RecordBatch, most: int = BATCH_WORDS) -> Iterator[pa.RecordBatch]:
    """(id, copy, term, tf, at, field) of rows (id, copy, field, words), about `most` words at a time.

    Words become numbers, and one stable sort of (row, word number) brings the places of a term together in order.
    """
    sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes) - sizes) // most
    lows = np.concatenate((np.flatnonzero(np.diff(piece, prepend=-1)), [len(piece)])).tolist()
    for low, high in zip(lows, lows[1:]):
        part, own = batch.slice(low, high - low), sizes[low:high]
        coded = part.column(3).flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(own)), own)
        pair = row * len(coded.dictionary) + code
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        at = order + 1 - (np.cumsum(own) - own)[row[order]]
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(at, pa.int32()))
        of = pa.array(row[order[starts]])
        terms = coded.dictionary.take(pa.array(code[order[starts]]))
        columns = [part.column(0).take(of), part.column(1).take(of), terms, pa.array(ends - starts, pa.int32()), places, part.column(2).take(of)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "copy", "term", "tf", "at", "field"])


def part_of(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def in_pieces(rows: DataFrame) -> DataFrame:
    """Postings dealt out by part and id, sorted as they lie in their files; for rows that are postings already.

    No ranges, which would have to be sampled by working out all rows a second time.
    """
    dealt = rows.repartition("part", F.pmod(F.xxhash64("id", "copy"), F.lit(PIECES)))
    return dealt.sortWithinPartitions("field", "part", "term", "id")


def packed_terms(docs: DataFrame, parts: int, pieces: int = PIECES, columns: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """The postings of `term_counts` in lists, a row for each part, piece and field of about `BATCH_WORDS` words.

    Tasks exchange these few rows in place of a row per posting: of each term of `terms` there are `docs` postings with ids,
    copies and numbers of places in turn, and at last all places.
    """
    own = [F.col("terms") if c == TITLE else F.array_join(text.tokens(F.col(c)), " ") for c in columns]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), terms.alias("words")) for c, terms in zip(columns, own)])
    piece = F.pmod(F.xxhash64("id", "copy"), F.lit(pieces)).cast("int")
    rows = docs.select("id", "copy", piece.alias("piece"), F.inline(cells)).filter(F.col("words") != "")
    rows = rows.withColumn("parts", F.transform(F.split("words", " "), lambda word: part_of(word, parts)))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "copy")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, BATCH_WORDS):
            yield packed(table)

    lists = f"terms array<string>, docs array<int>, ids array<{kinds['id']}>, copies array<{kinds['copy']}>, tfs array<int>, places array<int>"
    return rows.mapInArrow(pack, f"part int, piece int, field string, {lists}")


def _together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches of (..., words, parts) in tables of at least `most` words, so that lists are long."""
    held, words = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            words += pc.sum(pc.list_value_length(batch.column("parts"))).as_py()
        if words >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, words = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _list(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def packed(table: pa.Table) -> pa.RecordBatch:
    """Rows (id, copy, piece, field, words, parts), the words joined by blanks, as rows of `packed_terms`.

    Words become numbers, and one stable sort of (part, piece, field, word number) brings postings and places together in order.
    """
    ids, copies, pieces, words, parts = (_list(table.column(c)) for c in ("id", "copy", "piece", "words", "parts"))
    fields = _list(table.column("field")).dictionary_encode()
    own = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = pc.split_pattern(words, " ").flatten().dictionary_encode()
    row = np.repeat(np.arange(len(own)), own)
    place = np.arange(1, len(row) + 1) - (np.cumsum(own) - own)[row]
    piece, field = pieces.to_numpy(), fields.indices.to_numpy()
    many, kinds, size = int(piece.max()) + 1, len(fields.dictionary), len(coded.dictionary)
    group = (parts.flatten().to_numpy().astype(np.int64) * many + piece[row]) * kinds + field[row]
    entry = group * size + coded.indices.to_numpy()
    order = np.argsort(entry, kind="stable")
    entry, row = entry[order], row[order]
    new = np.diff(entry, prepend=-1) != 0
    posts = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))
    entries = np.flatnonzero(new)
    group = entry[entries] // size
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    at_entry = np.append(firsts, len(entries))
    at_word = np.append(entries[firsts], len(entry))
    at_post = np.searchsorted(posts, at_word)
    of = pa.array(row[posts])

    def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    of_entry = np.searchsorted(posts, np.append(entries, len(entry)))
    group = group[firsts]
    columns = {
        "part": pa.array(group // kinds // many, pa.int32()),
        "piece": pa.array(group // kinds % many, pa.int32()),
        "field": fields.dictionary.take(pa.array(group % kinds)),
        "terms": lists(at_entry, coded.dictionary.take(pa.array(entry[entries] % size))),
        "docs": lists(at_entry, pa.array(np.diff(of_entry), pa.int32())),
        "ids": lists(at_post, ids.take(of)),
        "copies": lists(at_post, copies.take(of)),
        "tfs": lists(at_post, pa.array(np.diff(np.append(posts, len(entry))), pa.int32())),
        "places": lists(at_word, pa.array(place[order], pa.int32())),
    }
    return pa.RecordBatch.from_pydict(columns)


def unpacked(table: pa.Table, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Postings of packed rows, sorted by (field, part, term, id), about `most` rows at a time."""
    fields, parts = _list(table.column("field")).to_pylist(), _list(table.column("part")).to_pylist()
    folders: dict[tuple[str, int], list[int]] = {}
    for i, folder in enumerate(zip(fields, parts)):
        folders.setdefault(folder, []).append(i)
    for (field, part), of in sorted(folders.items()):
        rows = table.take(of)
        terms, docs, ids, copies, tfs, places = (_list(rows.column(c)).flatten() for c in ("terms", "docs", "ids", "copies", "tfs", "places"))
        coded = terms.dictionary_encode()
        ascending = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(ascending), np.int64)
        rank[ascending] = np.arange(len(ascending))
        term = np.repeat(rank[coded.indices.to_numpy()], docs.to_numpy())
        # Without an id comes first.
        order = np.lexsort((ids.fill_null(np.iinfo("int64").min).to_numpy(), term))
        names = coded.dictionary.take(pa.array(ascending))
        ends = np.concatenate(([0], np.cumsum(tfs.to_numpy(), dtype=np.int64)))
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)
        for low in range(0, len(order), most):
            chosen = pa.array(order[low : low + most])
            n = len(chosen)
            columns = {
                "id": ids.take(chosen),
                "copy": copies.take(chosen),
                "term": names.take(pa.array(term[order[low : low + most]])),
                "tf": tfs.take(chosen),
                "at": at.take(chosen),
                "field": pa.repeat(field, n),
                "part": pa.array(np.full(n, part, np.int32)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def merged(rows: DataFrame) -> DataFrame:
    """Packed postings dealt out by part and piece as postings, sorted as they lie in their files.

    A task holds the postings of its pieces, which are a bounded number of documents of one part each.
    """
    kinds = {c: rows.schema[c].dataType.elementType.simpleString() for c in ("ids", "copies")}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield from unpacked(pa.Table.from_batches(held))

    schema = f"id {kinds['ids']}, copy {kinds['copies']}, term string, tf int, at array<int>, field string, part int"
    return rows.repartition("part", "piece").mapInArrow(merge, schema)


class SearchIndex:
    """The index of a folder as it is when opened, or at a given version.

    `docs`: active jobs; `places`: the written postings (field, term, id, copy, tf, at); `facts`: what ranking needs, once per
    (id, copy); `postings`: both joined, with facts in title rows; `terms`: documents per term; `vectors`: embeddings with what
    filters need; `corpus`: one row n, avgdl.  A search reads only the posting folders of its words, needs no shuffle to count
    terms, and never touches the job texts again.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        catalogs = self._read("catalog")
        if version is None:
            version = catalogs.agg(F.max("version")).first()[0]
        self.version = version
        # A few thousand rows at most: part numbers.
        rows = catalogs.filter(F.col("version") == version).select("kind", "part", "of").collect()
        self._of: dict[str, dict[int, int]] = {"terms": {}, "ids": {}}
        for row in rows:
            self._of[row["kind"]][row["part"]] = row["of"]
        self.parts, self.slices = len(self._of["terms"]), len(self._of["ids"])
        self.docs = self._current("docs", "ids").drop("part").withColumn("terms", listed(F.col("terms")))
        self.vectors = self._current("vectors", "ids").drop("part")
        self.places = self._current("postings", "terms")
        self.terms = self._current("terms", "terms")
        counts = self._read("corpus").filter(F.col("version") == version)
        self.corpus = counts.select("n", F.try_divide("total", "n").alias("avgdl"))

    @property
    def facts(self) -> DataFrame:
        return self.docs.select("copy", *RANKING).dropDuplicates(["id", "copy"])

    @property
    def postings(self) -> DataFrame:
        facts = self.facts.withColumnsRenamed({"id": "_id", "copy": "_copy"})
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")) & (F.col("field") == TITLE)
        return self.places.join(facts, same, "left").drop("_id", "_copy")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}")

    def _current(self, table: str, kind: str, among: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table's parts, or some of them, in the versions that count: a filter on folders only."""
        by_version: dict[int, list[int]] = {}
        for part in self._of[kind] if among is None else among:
            by_version.setdefault(self._of[kind][part], []).append(part)
        tests = [(F.col("version") == v) & F.col("part").isin(parts) for v, parts in by_version.items()]
        return self._read(table).filter(reduce(lambda a, b: a | b, tests, F.lit(False))).drop("version")

    def of_terms(self, terms: Iterable[str], field: str = TITLE) -> DataFrame:
        """Postings of some terms; only their folders are read."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("part", part_of(F.col("term"), self.parts))
        return self.places.filter(F.col("field") == field).join(F.broadcast(asked), ["part", "term"])

    @classmethod
    def build(cls, jobs: DataFrame, folder: str, vectors: DataFrame | None = None, parts: int | None = None) -> SearchIndex:
        """Write the index of a jobs table and of its vectors (id, embedding); over an index, as its next version.

        Postings go to the tasks by part and id, `PIECES` for each part, so a term that a third of all titles share is spread
        over many tasks and files; each file is sorted by term and id.  They hold no more than the place of a term: what ranking
        needs is in the documents, once.  Vectors are joined with what their filters need here, so that no search shuffles them.  The number of parts follows the number of jobs unless it is given.
        """
        spark = jobs.sparkSession
        if parts is None:
            parts = min(MOST_PARTS, max(LEAST_PARTS, math.ceil(jobs.count() / PART_JOBS)))
        last = _versions(spark, folder)
        version = last[-1] + 1 if last else 0
        docs = searchable(jobs).withColumn("part", part_of(F.col("id"), parts))
        _write(docs, folder, "docs", version)
        written = spark.read.schema(SCHEMAS["docs"]).parquet(f"{folder}/docs").filter(F.col("version") == version)
        _write(merged(packed_terms(written, parts)), folder, "postings", version)
        counted = spark.read.schema(SCHEMAS["postings"]).parquet(f"{folder}/postings").filter(F.col("version") == version)
        _write(counted.groupBy("field", "part", "term").agg(F.count("*").alias("df")), folder, "terms", version)
        if vectors is None:
            vectors = spark.createDataFrame([], "id bigint, embedding array<float>")
        filled = vectors.filter("embedding IS NOT NULL").select("id", "embedding")
        _write(written.select("id", *VECTOR_CARRIED, "part").join(filled, "id"), folder, "vectors", version)
        stats = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        _commit(spark, folder, version, stats, {"terms": dict.fromkeys(range(parts), version), "ids": dict.fromkeys(range(parts), version)})
        return cls(spark, folder, version)

    def refresh(self, changes: DataFrame, vectors: DataFrame | None = None) -> SearchIndex:
        """The next version, after changed jobs: one row per job as it is now; a job that is not active leaves the index.

        Old and new terms of the changed jobs tell which posting folders are written anew; document frequencies, number and
        total length of the documents change by the difference.  A vector is kept unless `vectors` has a newer one.  Doing a
        refresh again, also one that broke off, gives the same index.
        """
        version = self.version + 1
        ids = changes.select("id").distinct()
        slices = [r[0] for r in ids.select(part_of(F.col("id"), self.slices)).distinct().collect()]  # at most `slices`
        if not slices:
            return self
        few = is_small(ids)
        mark = F.broadcast(ids) if few else ids
        here = self._current("docs", "ids", slices)
        new = searchable(changes).withColumn("part", part_of(F.col("id"), self.slices))
        kept = here.join(mark, "id", "left_anti")
        _write(kept.unionByName(new), self.folder, "docs", version)
        then = {**self._of["ids"], **dict.fromkeys(slices, version)}
        now = self.spark.read.schema(SCHEMAS["docs"]).parquet(f"{self.folder}/docs").filter(F.col("version") == version).drop("version")

        had, has = here.join(mark, "id", "left_semi"), now.join(mark, "id", "left_semi")
        change = _term_docs(had, -1).unionByName(_term_docs(has, 1))
        change = change.groupBy("field", "term").agg(F.sum("more").alias("more")).withColumn("part", part_of(F.col("term"), self.parts))
        change = workdir.cut(change)  # one row per term, read twice below
        parts = [r[0] for r in change.select("part").distinct().collect()]  # at most `parts`
        if parts:
            stay = self._current("postings", "terms", parts).join(mark, "id", "left_anti")
            # What stays lies sorted in its files and is copied as it is; now and then all is sorted into few files again.
            stay = stay if version % SORTED_EVERY else in_pieces(stay)
            _write(stay.unionByName(merged(packed_terms(has, self.parts))), self.folder, "postings", version)
            old = self._current("terms", "terms", parts)
            keys = ["field", "part", "term"]
            df = old.join(change, keys, "full").select(*keys, (F.coalesce("df", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("df"))
            _write(df.filter("df > 0"), self.folder, "terms", version)

        pool = self._current("vectors", "ids", slices)
        known = pool.join(mark, "id", "left_semi").select("id", "embedding")
        if vectors is not None:
            newer = vectors.filter("embedding IS NOT NULL").select("id", "embedding").join(mark, "id", "left_semi")
            known = known.join(newer.select("id"), "id", "left_anti").unionByName(newer)
        filled = has.select("id", *VECTOR_CARRIED, "part").join(known, "id")
        _write(pool.join(mark, "id", "left_anti").unionByName(filled), self.folder, "vectors", version)

        sums = [rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")) for rows in (had, has)]
        before = self._read("corpus").filter(F.col("version") == self.version)
        n = F.col("b.n") - sums[0].select("n").scalar() + sums[1].select("n").scalar()
        total = F.col("b.total") - sums[0].select("total").scalar() + sums[1].select("total").scalar()
        stats = before.alias("b").select(n.alias("n"), total.alias("total"))
        of = {"ids": then, "terms": {**self._of["terms"], **dict.fromkeys(parts, version)}}
        _commit(self.spark, self.folder, version, stats, of)
        return SearchIndex(self.spark, self.folder, version)


def _term_docs(docs: DataFrame, sign: int) -> DataFrame:
    """(field, term, more): documents of each term, `sign` for each, counted by the batches that a worker packs."""
    counts = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("docs").alias("more")))
    rows = packed_terms(docs, 1, 1).select("field", counts)
    return rows.select("field", "term", (F.col("more") * sign).alias("more"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are complete."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/catalog")
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return []
    catalog = spark.read.schema(SCHEMAS["catalog"]).parquet(f"{folder}/catalog")
    return sorted(r["version"] for r in catalog.select("version").distinct().collect())


def _write(rows: DataFrame, folder: str, table: str, version: int) -> None:
    """Replace the folders of this version that the rows fall into; all other folders stay as they are.

    A task keeps up to `OPEN_FILES` files open, so rows are written in the order that they have and not sorted by folder first.
    """
    columns = T.StructType.fromDDL(SCHEMAS[table]).names
    by = ["version"] if table in ("corpus", "catalog") else [c for c in columns if c in ("field", "part", "version")]
    full = rows.withColumn("version", F.lit(version)).select(*columns)
    writer = full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    conf = rows.sparkSession.conf
    before = {name: conf.get(name) for name in (OPEN_WRITERS, BATCH_BYTES)}
    conf.set(OPEN_WRITERS, str(OPEN_FILES))
    conf.set(BATCH_BYTES, str(MOST_BYTES))
    try:
        writer.partitionBy(*by).parquet(f"{folder}/{table}")
    finally:
        for name, value in before.items():
            conf.set(name, value)


def _commit(spark: SparkSession, folder: str, version: int, stats: DataFrame, of: dict[str, dict[int, int]]) -> None:
    """The counts, then the table of parts in one file: with it the version is there."""
    _write(stats, folder, "corpus", version)
    rows = [(kind, part, at) for kind, parts in of.items() for part, at in parts.items()]
    _write(spark.createDataFrame(rows, "kind string, part int, of int").coalesce(1), folder, "catalog", version)
