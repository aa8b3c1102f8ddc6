"""Text search for a whole table of queries: BM25, vector cosine, rank fusion, and the listing on top."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text
from jobweave.functions.skew import is_small, join_unique, number_rows, salted_join, top_k
from jobweave.operators import browse as listing
from jobweave.operators import filters as flt
from jobweave.operators.projections import LISTING, embedding_text
from jobweave.operators.search_index import INDEX_COLUMNS, RANKING, TITLE, VECTOR_CARRIED, SearchIndex, part_of  # noqa: F401
from jobweave.sources import workdir

DIGITS = 9
#: Columns of `RANKING` behind the id that are numbers and never null; the others are texts.
NUMBERS = ("dl", "exists_in_uk", "exists_in_london", "has_description")
MAX_QUERIES = 2048


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(fx.MIN_IDF))


def bm25_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    k1, b = fx.BM25_K1, fx.BM25_B
    return tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, word, parts, times): the words of each normalised query.  `_` inside a word makes a phrase."""
    norm = text.normalise_query(F.col("query"))
    split = queries.select("query_id", F.explode(text.words(norm)).alias("word"))
    counted = split.groupBy("query_id", "word").agg(F.count("*").alias("times"))
    return counted.withColumn("parts", text.tokens(F.col("word"))).filter(F.size("parts") > 0)


def hits(index: SearchIndex, words: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """(word, tf, id, copy) for every job whose title has a query word or phrase; and (word, df).

    `few` words are sent to the posting scans; more of them meet the postings by a shuffle that cuts every term.  Single words
    are posting rows as they stand, and the index knows their number of documents.  A phrase joins the rows of its terms by
    document and counts the places where all follow each other; without phrases adaptive execution drops that half.
    """
    parts = words.select("word", "parts").distinct()
    terms = parts.select("word", F.size("parts").alias("size"), F.posexplode("parts").alias("offset", "term"))
    terms = terms.withColumn("part", part_of(F.col("term"), index.parts))
    title = index.places.filter(F.col("field") == TITLE).drop("field")

    def met(rows: DataFrame, asked: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(asked), ["part", "term"])
        return salted_join(rows, asked, ["part", "term"], F.col("id"))

    one = terms.filter("size = 1")
    singles = met(title, one.select("word", "part", "term")).select("word", F.col("tf").cast("bigint").alias("tf"), "id", "copy")
    known = index.terms.filter(F.col("field") == TITLE).join(F.broadcast(one) if few else one, ["part", "term"])

    placed = met(title, terms.filter("size > 1"))
    first = F.when(F.col("offset") == 0, F.col("copy"))
    starts = F.transform("at", lambda x: x - F.col("offset"))
    joined = placed.groupBy("word", "id", "size").agg(F.max(first).alias("copy"), F.collect_list(starts).alias("starts"))
    both = F.aggregate("starts", F.get("starts", F.lit(0)), F.array_intersect)
    phrases = joined.filter(F.size("starts") == F.col("size")).withColumn("tf", F.size(both).cast("bigint")).filter("tf > 0")
    phrases = phrases.select("word", "tf", "id", "copy")
    counts = known.select("word", "df").unionByName(phrases.groupBy("word").agg(F.count("*").alias("df")))
    return singles.unionByName(phrases), counts


def search_bm25(queries: DataFrame, index: SearchIndex, candidates: int | None = fx.CANDIDATES) -> DataFrame:
    """Per query the first `candidates` jobs whose title has one of its words; all of them, however many, if it is None.

    Order and rank: London, UK, exact title, has description, then score, then id.  Term counts are those of the title;
    lengths are over all indexed columns.

    Up to `BROADCAST_ROWS` query words go to the tasks; there hits are shuffled once, by job, and meet the queries in blocks,
    so no row per (job, query) is made but for those that may rank.  More words meet their hits by a salted join.
    """
    words = query_words(queries)
    few = is_small(words)
    found, df = hits(index, words, few)
    wanted = queries.withColumn("query_is", F.sha2(text.normalise_query(F.col("query")), 256))
    weight = F.col("times") * idf(index.corpus.select("n").scalar(), F.col("df"))
    weighed = words.select("query_id", "word", "times").join(df, "word").select("query_id", "word", weight.alias("weight"))
    if few:
        scored = _score_in_blocks(found, weighed, wanted.select("query_id", "filters", "query_is"), index, candidates)
    else:
        scored = _score_joined(found, weighed, wanted, index)
    scored = scored.withColumn("bm25_score", F.round("bm25_score", DIGITS))
    if candidates is None:
        return _all_ranked(scored)
    order = [F.desc("tier"), F.desc("bm25_score"), F.asc("id")]
    return top_k(scored, ["query_id"], order, candidates, F.col("id")).drop("tier")


def _all_ranked(scored: DataFrame) -> DataFrame:
    """Every scored row with its rank, numbered range by range; rows without a tier or a score come last."""
    behind = {"_tier": F.coalesce(-F.col("tier"), F.lit(1)), "_score": F.coalesce(-F.col("bm25_score"), F.lit(math.inf))}
    kept = workdir.stored(scored.withColumns(behind), workdir.shared_folder(scored.sparkSession))  # ranges are sampled
    ranked = number_rows(kept, ["query_id"], ["_tier", "_score", "id"], "rank")
    return ranked.drop("tier", "_tier", "_score")


def _score_joined(found: DataFrame, weighed: DataFrame, wanted: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, id, tier, bm25_score) of all pairs by joins."""
    facts = index.facts.withColumnsRenamed({"id": "_id", "copy": "_copy"})
    met = found.join(facts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left").drop("_id", "_copy", "copy")
    asked = flt.with_wanted(wanted).select("query_id", *flt.WANTED, "query_is")
    met = salted_join(met, weighed.join(asked, "query_id"), ["word"], F.col("id")).filter(flt.row_meets_request())
    # All that ranks before the score, in one number, so the sums are kept by three plain numbers per pair.
    exact = F.col("title_is") == F.col("query_is")
    bits = (F.col("exists_in_london") == 1, F.col("exists_in_uk") == 1, exact, F.col("has_description") == 1)
    tier = reduce(lambda high, bit: high * 2 + bit.cast("int"), bits, F.lit(0))
    part = F.col("weight") * bm25_weight(F.col("tf"), F.col("dl"), index.corpus.select("avgdl").scalar())
    return met.groupBy("query_id", "id", tier.alias("tier")).agg(F.sum(part).alias("bm25_score"))


def _score_in_blocks(found: DataFrame, weighed: DataFrame, asked: DataFrame, index: SearchIndex, k: int | None) -> DataFrame:
    """(query_id, id, tier, bm25_score) of all pairs that may be among the first `k` of their query, or of all pairs.

    Hits and the facts of the jobs are shuffled by job and sorted, so each job lies in one piece.  A task adds up its jobs
    against all queries, a block at a time, and leaves out what is behind `k` jobs of one block already.  Jobs or queries
    that share an id are summed behind it, so none of theirs is left out.
    """
    spark = found.sparkSession
    # At most BROADCAST_ROWS rows: weights of query words, and the queries that have one.
    weights = weighed.filter("query_id IS NOT NULL").collect()
    with_words = weighed.select("query_id").distinct()
    rows = asked.join(F.broadcast(with_words), "query_id", "left_semi").collect() if weights else []
    numbers: dict = {}
    for i, row in enumerate(rows):
        numbers.setdefault(row["query_id"], []).append(i)
    codes: dict[str, int] = {}
    cells = [(codes.setdefault(r["word"], len(codes)), i, r["weight"]) for r in weights for i in numbers.get(r["query_id"], ())]
    cells.sort()
    code, at, weight = (np.array([c[j] for c in cells], dtype=kind) for j, kind in enumerate(("int64", "int64", "float64")))
    block = {
        "starts": np.searchsorted(code, np.arange(len(codes) + 1)),
        "queries": at,
        "weights": weight,
        "filters": [r["filters"] for r in rows],
        "titles": pd.Index([r["query_is"] for r in rows]),
        "alone": np.array([len(numbers[r["query_id"]]) == 1 for r in rows], dtype=bool),
        "avgdl": index.corpus.first()["avgdl"],
        "k": k,
    }
    shared = spark.sparkContext.broadcast(block)
    coded = F.broadcast(spark.createDataFrame(list(codes.items()), "word string, code int"))
    hit = found.join(coded, "word").select("id", "copy", "code", F.col("tf").cast("int").alias("tf"))
    both = with_facts(hit, index).repartition("id", "copy").sortWithinPartitions("id", "copy", "code")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = BlockScores(shared.value)
        for table in whole_jobs(batches, scan.block_rows):
            yield from scan.of(table)

    scored = both.mapInArrow(score, "number int, id bigint, tier int, score double")
    kind = weighed.schema["query_id"].dataType.simpleString()
    names = F.broadcast(spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"number int, query_id {kind}"))
    return scored.join(names, "number").groupBy("query_id", "id", "tier").agg(F.sum("score").alias("bm25_score"))


def with_facts(hit: DataFrame, index: SearchIndex) -> DataFrame:
    """Hits (id, copy, code, tf) and for every job a row of its facts with code -1.

    The facts are one text: a job has many hits, and each of them would carry a null for every column.  Of equal rows of a job
    the first one gives the facts, so they are not looked for here.
    """
    facts = index.docs.select("id", "copy", F.lit(-1).alias("code"), F.to_json(F.struct(*RANKING[1:])).alias("facts"))
    return facts.unionByName(hit, allowMissingColumns=True)


def _starts(table: pa.Table) -> np.ndarray:
    """Places where the rows of another (id, copy) begin, the first one included."""
    blank = table.column("id").is_null().to_numpy()
    ids = table.column("id").fill_null(0).to_numpy()
    copies = table.column("copy").fill_null(-1).to_numpy()
    other = (ids[1:] != ids[:-1]) | (copies[1:] != copies[:-1]) | (blank[1:] != blank[:-1])
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def whole_jobs(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about `block_rows` rows that end with the last row of a job."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= block_rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(_starts(table)[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class BlockScores:
    """Scores of blocks of jobs against all queries of a request table."""

    CELLS = 2_000_000

    def __init__(self, given: dict) -> None:
        self.__dict__.update(given)
        self.n = len(self.filters)
        self.per_word = np.diff(self.starts)
        self.block_rows = 100_000
        shapes = [tuple(sorted((f or {}).items())) for f in self.filters]
        self.shapes = {shape: np.array([i for i, s in enumerate(shapes) if s == shape]) for shape in set(shapes)}
        # Tier and score of the last of `k` jobs of some block: nothing behind it can be among the first.
        self.bar_tier, self.bar_score = np.full(self.n, -1), np.zeros(self.n)

    def of(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = table.column("code").to_numpy()
        starts = _starts(table)
        ends = np.append(starts[1:], table.num_rows)
        # The facts come first of a job's rows; jobs with facts only have no hit.
        facts = code[starts] < 0
        some = facts & (ends - starts > 1)
        per_row = np.where(code >= 0, self.per_word[np.maximum(code, 0)], 0) if len(self.per_word) else np.zeros(len(code), int)
        yield from self._without_facts(table, code)
        work = np.maximum(np.add.reduceat(per_row, starts), self.n)[some]
        starts, ends = starts[some], ends[some]
        piece = (np.cumsum(work) - work) // self.CELLS
        for low, high in zip(*(np.searchsorted(piece, np.unique(piece), side) for side in ("left", "right"))):
            yield from self._piece(table, code, per_row, starts[low:high], ends[low:high])

    def _without_facts(self, table: pa.Table, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A phrase of a repeated id may lack the copy that it starts in: found by queries without filters, without a score."""
        rows = np.flatnonzero(table.column("copy").is_null().to_numpy())
        if len(rows):
            pairs = [(i, q) for i in rows for q in self.queries[self.starts[code[i]] : self.starts[code[i] + 1]]]
            pairs = [(i, q) for i, q in pairs if not any((self.filters[q] or {}).values())]
            ids = table.column("id").combine_chunks().take(pa.array([i for i, _ in pairs], pa.int64()))
            none = [pa.nulls(len(pairs), kind) for kind in (pa.int32(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([q for _, q in pairs], pa.int32()), ids, *none], ["number", "id", "tier", "score"])

    def _piece(self, table: pa.Table, code: np.ndarray, per_row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        jobs = table.select(["id", "copy", "facts"]).take(pa.array(starts))
        facts = _facts(jobs.column("facts"))
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        rows = np.arange(len(owner)) + np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)
        owner, rows = owner[code[rows] >= 0], rows[code[rows] >= 0]
        tf = table.column("tf").fill_null(0).to_numpy()[rows].astype(float)
        dl = facts["dl"].to_numpy(float)[owner]
        k1, b = fx.BM25_K1, fx.BM25_B
        part = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / self.avgdl))
        many = per_row[rows]
        first = np.repeat(self.starts[code[rows]] - (np.cumsum(many) - many), many)
        entry = first + np.arange(len(first))
        cell = np.repeat(owner, many) * self.n + self.queries[entry]
        score = np.bincount(cell, np.repeat(part, many) * self.weights[entry], minlength=len(starts) * self.n).reshape(-1, self.n)
        for shape, numbers in self.shapes.items():
            if shape:
                score[np.ix_(~_filter_mask(facts, dict(shape)), numbers)] = 0
        job, query = np.nonzero(score > 0)
        score = score[job, query]
        flags = {c: (facts[c] == 1).to_numpy(int) for c in ("exists_in_london", "exists_in_uk", "has_description")}
        tier = (8 * flags["exists_in_london"] + 4 * flags["exists_in_uk"] + flags["has_description"])[job]
        titles = pd.factorize(np.concatenate([facts["title_is"].to_numpy(), self.titles.to_numpy()]))[0]
        tier += 2 * (titles[job] == titles[len(starts) + query])
        rounded = np.round(score, DIGITS)
        bar = self.bar_tier[query]
        single = (jobs.column("copy").to_numpy() == 0)[job] & self.alone[query]
        keep = ~single | (tier > bar) | ((tier == bar) & (rounded >= self.bar_score[query]))
        job, query, score, tier, rounded, single = (x[keep] for x in (job, query, score, tier, rounded, single))
        ids = jobs.column("id").fill_null(0).to_numpy()[job]
        order = np.lexsort((ids, -rounded, -tier, ~single, query))
        job, query, score, tier, rounded, single = (x[order] for x in (job, query, score, tier, rounded, single))
        begins = np.searchsorted(query, query)
        place = np.arange(len(query)) - begins
        if self.k is not None:
            last = single & (place == self.k - 1)
            self.bar_tier[query[last]], self.bar_score[query[last]] = tier[last], rounded[last]
            keep = ~single | (place < self.k)
            job, query, score, tier = (x[keep] for x in (job, query, score, tier))
        cells = [pa.array(query, pa.int32()), jobs.column("id").combine_chunks().take(pa.array(job)), pa.array(tier, pa.int32()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cells, ["number", "id", "tier", "score"])


def _facts(texts: pa.ChunkedArray) -> pd.DataFrame:
    """What ranking needs of some jobs, from its text; nulls are left out of the texts."""
    rows = [json.loads(text) for text in texts.to_pylist()]
    return pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=None if c in NUMBERS else object) for c in RANKING[1:]})


def score_rrf(rank: Column, k: int = fx.RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def _filter_mask(batch: pd.DataFrame, filters: dict[str, str]) -> np.ndarray:
    """Rows of a batch of candidates that meet one filter map; mirrors `filters.row_meets_request`."""
    keep = np.ones(len(batch), dtype=bool)
    for name in flt.SUBSTRING_FILTERS:
        if filters.get(name):
            keep &= batch[name].fillna("").str.lower().str.contains(filters[name].lower(), regex=False).to_numpy(bool)
    for name in flt.EXACT_FILTERS:
        if filters.get(name):
            keep &= (batch[name] == filters[name]).to_numpy(bool)
    category = (filters.get("category") or "").strip()
    if category == fx.GLOBAL_CATEGORY:
        keep &= (batch["exists_in_uk"] == 0).to_numpy(bool)
    elif category in fx.SEARCH_CATEGORIES:
        keep &= batch["cats"].str.contains(f",{category},", regex=False).to_numpy(bool)
    return keep


def _unit(rows: Sequence) -> np.ndarray:
    matrix = np.asarray([np.asarray(r, dtype="float64") for r in rows])
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _result_type(queries: DataFrame) -> str:
    """Block results keep the type of the request ids."""
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, semantic_score double"


def _best_of_block(query_ids, query_filters, units: np.ndarray, batch: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of one batch of candidates for each query of a block: one matrix product, then a partial sort per query."""
    scores = np.round(units @ _unit(batch["embedding"]).T, DIGITS)
    ids = batch["id"].to_numpy()
    masks: dict[tuple, np.ndarray] = {}
    out = []
    for i, (query_id, wanted) in enumerate(zip(query_ids, query_filters)):
        shape = tuple(sorted((wanted or {}).items()))
        if shape not in masks:
            masks[shape] = np.flatnonzero(_filter_mask(batch, dict(shape)))
        rows = masks[shape]
        best = rows[np.lexsort((ids[rows], -scores[i, rows]))[:k]]
        out.append(pd.DataFrame({"query_id": query_id, "id": ids[best], "semantic_score": scores[i, best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "semantic_score": []})


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts).sort_values(["query_id", "semantic_score", "id"], ascending=[True, False, True])
    return every.groupby("query_id").head(k)


def search_semantic(
    queries: DataFrame,
    index: SearchIndex,
    candidates: int = fx.CANDIDATES,
    max_broadcast_queries: int = MAX_QUERIES,
    block_queries: int = 1024,
    block_vectors: int = 4096,
) -> DataFrame:
    """Per query vector the `candidates` active jobs with the highest cosine, by score and id.

    Up to `max_broadcast_queries` query vectors are sent to every task, each task keeps its best rows per query, and the
    vectors are never shuffled.  Beyond that size queries and vectors are cut into blocks that meet by an equi-join on
    (query block, vector block), so no task holds more than one block of each.  Either way only the best `candidates`
    rows of a block leave it, never all pairs.
    """
    return nearest(queries, index.vectors, candidates, max_broadcast_queries, block_queries, block_vectors)


def nearest(
    queries: DataFrame,
    pool: DataFrame,
    candidates: int = fx.CANDIDATES,
    max_broadcast_queries: int = MAX_QUERIES,
    block_queries: int = 1024,
    block_vectors: int = 4096,
) -> DataFrame:
    """`search_semantic` over given candidates: id, embedding and the columns their filters need."""
    asked = queries.filter("query_embedding IS NOT NULL").select("query_id", "filters", "query_embedding")
    head = asked.limit(max_broadcast_queries + 1).collect()
    if len(head) <= max_broadcast_queries:
        best = _scan_with_queries(pool, head, candidates, _result_type(queries))
    else:
        best = _join_blocks(pool, asked, candidates, block_queries, block_vectors)
    return top_k(best, ["query_id"], [F.desc("semantic_score"), F.asc("id")], candidates, F.col("id"))


def _scan_with_queries(pool: DataFrame, rows: list, k: int, result_type: str) -> DataFrame:
    if not rows:
        return pool.sparkSession.createDataFrame([], result_type)
    block = pool.sparkSession.sparkContext.broadcast(
        ([r["query_id"] for r in rows], [r["filters"] for r in rows], _unit([r["query_embedding"] for r in rows]))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_filters, units = block.value
        best = None
        for batch in batches:
            if len(batch):
                new = _best_of_block(query_ids, query_filters, units, batch, k)
                best = new if best is None else _merge([best, new], k)
        if best is not None:
            yield best

    return pool.mapInPandas(scan, result_type)


def _join_blocks(pool: DataFrame, asked: DataFrame, k: int, block_queries: int, block_vectors: int) -> DataFrame:
    def blocks(rows: DataFrame, size: int) -> Column:
        return F.ceil(rows.agg(F.count("*").alias("n")).scalar() / F.lit(size)).cast("int")

    query_blocks, vector_blocks = blocks(asked, block_queries), blocks(pool, block_vectors)

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    def own(col: str, n: Column) -> Column:
        return F.pmod(F.xxhash64(col), n).cast("int")

    left = asked.withColumn("qb", own("query_id", query_blocks)).withColumn("vb", every(vector_blocks))
    right = pool.withColumn("vb", own("id", vector_blocks)).withColumn("qb", every(query_blocks))

    def best(asked_rows: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if asked_rows.empty or batch.empty:
            return pd.DataFrame({"query_id": [], "id": [], "semantic_score": []})
        units = _unit(asked_rows["query_embedding"])
        maps = [dict(m) if m is not None else {} for m in asked_rows["filters"]]
        return _best_of_block(asked_rows["query_id"], maps, units, batch, k)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(best, _result_type(asked))


def fuse(bm25: DataFrame, semantic: DataFrame, weights: tuple[float, float] = fx.WEIGHTS) -> DataFrame:
    """Full outer join of the two ranked lists of each query with the fused score.

    A missing rank counts as list length + 1; if one list is empty the other has all the weight.
    """
    lists = bm25.select("query_id", "id", F.col("rank").alias("bm25_rank"), "bm25_score").join(
        semantic.select("query_id", "id", F.col("rank").alias("semantic_rank"), "semantic_score"),
        ["query_id", "id"],
        "full",
    )
    # At most 2 * candidates rows per query.
    query = W.partitionBy("query_id")
    rows = lists.withColumns(
        {"bm25_rows": F.count("bm25_rank").over(query), "semantic_rows": F.count("semantic_rank").over(query)}
    )
    only_semantic, only_bm25 = F.col("bm25_rows") == 0, F.col("semantic_rows") == 0
    wb = F.when(only_semantic, 0.0).when(only_bm25, 1.0).otherwise(F.lit(weights[0]))
    ws = F.when(only_semantic, 1.0).when(only_bm25, 0.0).otherwise(F.lit(weights[1]))
    b = score_rrf(F.coalesce("bm25_rank", F.col("bm25_rows") + 1))
    s = score_rrf(F.coalesce("semantic_rank", F.col("semantic_rows") + 1))
    return rows.withColumn("hybrid_score", F.round(wb * b + ws * s, 12)).drop("bm25_rows", "semantic_rows")


def search_hybrid(
    queries: DataFrame,
    index: SearchIndex,
    limit: int = 20,
    min_score: Column | float = 0.15,
    candidates: int = fx.CANDIDATES,
) -> DataFrame:
    """Fused candidates of each query in business order, at most `limit`.

    Order: London, UK, exact title, has description, fused score, id.  The score threshold holds for queries of more
    than two words and only if some candidate reaches it.
    """
    fused = fuse(search_bm25(queries, index, candidates), search_semantic(queries, index, candidates))
    facts = index.docs.select(
        "id", "exists_in_london", "exists_in_uk", "has_description", F.col("title_key").alias("title_is"), "is_course"
    )
    bar = min_score if isinstance(min_score, Column) else F.lit(float(min_score))
    asked = queries.select(
        "query_id",
        F.sha2(F.lower(text.strip(F.col("query"))), 256).alias("query_is"),
        F.size(text.words(F.col("query"))).alias("n_words"),
        bar.alias("bar"),
    )
    # At most 2 * candidates rows per query, so a counted number of queries bounds the broadcast.
    rows = fused.join(asked, "query_id")
    if is_small(queries.select("query_id"), MAX_QUERIES):
        rows = F.broadcast(rows).join(facts, "id")
    else:
        rows = join_unique(rows, facts, ["id"])
    rows = rows.withColumn("exact_match", (F.col("title_is") == F.col("query_is")).cast("int"))
    # At most 2 * candidates rows per query from here on.
    best = F.max("hybrid_score").over(W.partitionBy("query_id"))
    strict = (F.col("n_words") > 2) & (F.col("bar") > 0) & (best >= F.col("bar"))
    rows = rows.withColumn("strict", strict).filter(~F.col("strict") | (F.col("hybrid_score") >= F.col("bar")))
    order = [F.desc(c) for c in ("exists_in_london", "exists_in_uk", "exact_match", "has_description", "hybrid_score")]
    return top_k(
        rows.drop("title_is", "query_is", "n_words", "bar", "strict"),
        ["query_id"], [*order, F.asc("id")], limit, F.col("id"), rank="place",
    )


def search(
    queries: DataFrame,
    index: SearchIndex,
    jobs: DataFrame,
    limit: int = 20,
    min_score: float = 0.15,
    candidates: int = fx.CANDIDATES,
    sort_by: str = "relevance",
) -> DataFrame:
    """Answers to a table of requests: blank queries browse, the others search without course titles.

    (query_id, id, rank, hybrid_score); a column `fetch` of the requests overrides `limit`.  `sort_by` orders what blank
    queries see; text queries are always ordered by their score.
    """
    fetch = F.col("fetch") if "fetch" in queries.columns else F.lit(limit)
    asked = queries.withColumn("fetch", fetch)
    blank = text.strip(text.value_or_blank(F.col("query"))) == ""
    typed = asked.filter(~blank)
    answers = []
    if not asked.filter(blank).isEmpty():
        answers.append(listing.browse_requests(asked.filter(blank), jobs, sort_by))
    if not answers or not typed.isEmpty():
        answers.append(_search_typed(typed, index, min_score, candidates))
    return reduce(DataFrame.unionByName, answers)


def _search_typed(typed: DataFrame, index: SearchIndex, min_score: float, candidates: int) -> DataFrame:
    n_words = F.size(text.words(F.col("query")))
    bar = F.when(n_words <= 2, F.greatest(F.lit(0.05), F.lit(min_score * 0.5))).otherwise(F.lit(float(min_score)))
    # A query has at most 2 * candidates rows, so this many cover any fetch; twice the fetch is cut exactly below.
    found = search_hybrid(typed, index, 2 * candidates, bar, candidates)
    limits = typed.select("query_id", "fetch")
    kept = found.join(limits, "query_id").filter(F.col("place") <= 2 * F.col("fetch")).filter(~F.col("is_course"))
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place")).cast("bigint"))
    return ranked.filter(F.col("rank") <= F.col("fetch")).select("query_id", "id", "rank", "hybrid_score")


def search_listing(
    requests: DataFrame, users: DataFrame, index: SearchIndex, jobs: DataFrame, sort_by: str = "relevance"
) -> DataFrame:
    """A table of listing requests answered end to end; `sort_by` orders what blank queries see.

    Requests are (query_id, query, filters, user_id, page, page_limit, location_filter, query_embedding).  Tier gives
    the fetch limit; then search, location scope, tier cap, page; free first pages get placeholder rows.

    Blank requests with the same filters, scope and fetch limit share one result list, so many requests cost as much as
    the few lists they ask for.  A list is at most 3000 rows long; a request takes its slice of it.

    Rows have the listing columns (a column that `jobs` lacks is null), their rank, and the request's `total` and
    `total_pages`; placeholder rows have a title, an organisation and a place only.  `usage.search_log` gives the log rows of
    the same requests.
    """
    tier = F.coalesce("membership_status", F.lit(0))
    # Many requests may come from one user, or from none.
    asked = join_unique(requests, users.select("user_id", "membership_status"), ["user_id"], how="left")
    asked = asked.withColumn("tier", tier).withColumn("fetch", listing.tier_fetch(F.col("tier")))
    blank = text.strip(text.value_or_blank(F.col("query"))) == ""
    shared = F.to_json(F.struct(listing.sorted_filters(F.col("filters")).alias("f"), "location_filter", "fetch"))
    own = F.concat(F.lit("q"), F.col("query_id").cast("string"))
    # Requests and answers are read several times below; written once, they are worked out once.
    asked = workdir.cut(asked.withColumn("list_key", F.when(blank, shared).otherwise(own)))
    lists = asked.drop("query_id", "user_id", "page", "page_limit", "tier", "membership_status")
    lists = lists.withColumnRenamed("list_key", "query_id").dropDuplicates(["query_id"])

    answers = workdir.cut(search(lists, index, jobs, min_score=0.10, sort_by=sort_by))
    flags = jobs.select("id", "exists_in_uk", "exists_in_london")
    scoped = join_unique(answers, flags, ["id"]).join(lists.select("query_id", "location_filter"), "query_id")
    scoped = scoped.filter(flt.row_in_scope(F.col("location_filter")))
    row = F.struct("rank", "id", "hybrid_score")
    found = scoped.groupBy(F.col("query_id").alias("list_key")).agg(F.array_sort(F.collect_list(row)).alias("found"))

    pages = asked.select("query_id", "tier", "page", "page_limit", "list_key")
    pages = join_unique(pages, found, ["list_key"], how="left")
    pages = pages.withColumn("n_found", F.coalesce(F.array_size("found"), F.lit(0)))
    pages = pages.withColumn("total", F.least(F.col("n_found"), listing.tier_cap(F.col("tier"))))
    first = (F.col("page") - 1) * F.col("page_limit")
    on_page = F.greatest(F.lit(0), F.least(F.col("page_limit"), F.col("total") - first))
    none = F.array().cast("array<struct<rank:bigint,id:bigint,hybrid_score:double>>")
    rows = F.transform(
        F.coalesce(F.slice("found", first + 1, on_page), none),
        lambda x, i: F.struct(
            x["id"].alias("id"), (first + i + 1).cast("bigint").alias("rank"), x["hybrid_score"].alias("hybrid_score")
        ),
    )
    counts = F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("page_limit"))).cast("bigint")
    sized = pages.withColumns({"total_pages": counts, "shown": on_page})
    listed = sized.select("query_id", "total", "total_pages", F.inline(rows))
    # Texts only for rows that are shown; the same few jobs may lead very many pages.
    listed = join_unique(listed, jobs.select("id", *[c for c in LISTING if c in jobs.columns and c not in ("id", "hybrid_score")]), ["id"])
    lacking = {c: F.lit(None).cast("string") for c in LISTING if c not in listed.columns}
    listed = listed.withColumns(lacking | {"id": F.col("id").cast("string"), "is_blurred": F.lit(False)})
    listed = listed.select("query_id", *LISTING, "rank", "total", "total_pages")
    teasers = listing.teaser_rows(
        sized.select("query_id", "tier", "page", F.col("page_limit").alias("size"), "shown",
                     F.col("n_found").alias("total"), F.col("total").alias("allowed"), "total_pages"),
        keep=["allowed", "total_pages"],
    ).withColumnRenamed("allowed", "total")
    return listed.unionByName(teasers, allowMissingColumns=True)


def embed_backlog(
    jobs: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], np.ndarray], batch_rows: int = 256
) -> DataFrame:
    """Vectors for active jobs that have none: texts go to `embed` in batches inside the tasks."""
    backlog = jobs.filter("is_active = 1").join(vectors.select("id"), "id", "left_anti")
    texts = embedding_text(backlog).select("id", "embed_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                made = [np.asarray(v, dtype="float32") for v in embed(list(part["embed_text"]))]
                yield pd.DataFrame(
                    {"id": part["id"].to_numpy(), "embedding": made, "embedding_dimension": [len(v) for v in made]}
                )

    return texts.mapInPandas(run, "id bigint, embedding array<float>, embedding_dimension int")
