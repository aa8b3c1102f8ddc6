"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q that holds at least three periods, so each of its words stands in it three
times or more.  A word found less often within its segment therefore belongs to no run and splits the segment; what is left
is counted anew until nothing splits.  Segments that survive are scanned lag by lag.  A run of period q is a stretch of at
least max(24 - q, 2 q) words that equal the word q places on, so places a quarter of that apart meet it four times in a row,
and all lags of a segment together look at about n log n places; only lags with such a meeting are compared word by word.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import mixed, shipped, table, word_hashes

SHORTEST = 24
PERIODS = 3
CHUNK_BYTES = 1 << 20
#: Places that one step of the scan looks at.
STEP = 1 << 20

Run = tuple[int, int, int]


# ------------------------------------------------------------------------------------------------ segments


def surviving(words: np.ndarray, text: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int]]:
    """[start, end) of the segments that no rare word splits any more.

    `words` are numbers of words, `text` the ascending number of the text each word stands in.
    """
    done = []
    place, segment = np.arange(len(words)), text
    while len(place):
        key = mixed(words[place] + segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(key)
        ordered = key[by]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        often = np.empty(len(place), bool)
        often[by] = np.repeat(counts >= periods, counts)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        sizes = np.diff(np.append(starts, len(segment)))
        whole = np.logical_and.reduceat(often, starts)
        done += [(int(place[s]), int(place[s] + n)) for s, n in zip(starts[whole], sizes[whole]) if n >= shortest]
        left = np.flatnonzero(often & ~np.repeat(whole, sizes))
        if not len(left):
            break
        cut = np.concatenate(([True], (left[1:] != left[:-1] + 1) | (segment[left[1:]] != segment[left[:-1]])))
        number = np.cumsum(cut) - 1
        long = np.bincount(number) >= shortest
        left, number = left[long[number]], number[long[number]]
        place, segment = place[left], number
    return sorted(done)


# ------------------------------------------------------------------------------------------------ lags


def _meetings(words: np.ndarray, low: int, high: int, shortest: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first place, place after the last one that is compared) where four tested places in a row agree, for lags [low, high)."""
    n = len(words)
    lags = np.arange(low, high)
    needed = np.maximum(shortest, periods * lags) - lags
    step = np.maximum(needed // 4, 1)
    tests = (n - lags + step - 1) // step
    lag, gap = np.repeat(lags, tests), np.repeat(step, tests)
    offset = np.repeat(np.cumsum(tests) - tests, tests)
    place = (np.arange(len(lag)) - offset) * gap
    agree = words[place] == words[place + lag]
    four = np.flatnonzero(agree[:-3] & agree[1:-2] & agree[2:-1] & agree[3:] & (lag[:-3] == lag[3:]))
    return lag[four], place[four], place[four + 3] + lag[four] + 1


def runs_in(words: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[Run]:
    """(start, length, smallest period) of every run among the words of one segment, by period."""
    n = len(words)
    found: list[Run] = []
    low = 1
    while low <= n // periods:
        high, places = low, 0
        while high <= n // periods and high < 2 * low + 8 and places < STEP:
            places += 4 * n // max(shortest - high, 2 * high)
            high += 1
        lag, first, last = _meetings(words, low, high, shortest, periods)
        for q in np.unique(lag).tolist():
            mine = lag == q
            start, end = first[mine], last[mine]
            for a, length, p in found:
                inside = (start >= a) & (end <= a + length)
                start, end = start[~inside], end[~inside]
            if not len(start):
                continue
            same = np.flatnonzero(np.diff(np.concatenate(([0], (words[:-q] == words[q:]).astype(np.int8), [0]))))
            for a, b in zip(same[0::2].tolist(), same[1::2].tolist()):
                length = b - a + q
                if length >= max(shortest, periods * q) and not any(x <= a and a + length <= x + m for x, m, _ in found):
                    found.append((a, length, q))
        low = high
    return found


def periodic_runs(words: np.ndarray, text: np.ndarray, texts: int, shortest: int = SHORTEST, periods: int = PERIODS) -> list[list[Run]]:
    """Runs of each text, (first word, length, period) by start, then period."""
    first = np.searchsorted(text, np.arange(texts))
    out: list[list[Run]] = [[] for _ in range(texts)]
    for start, end in surviving(words, text, shortest, periods):
        own = int(text[start])
        _, small = np.unique(words[start:end], return_inverse=True)
        out[own] += [(start - int(first[own]) + a, length, q) for a, length, q in runs_in(small.astype(np.int32), shortest, periods)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: list[Run]) -> Run:
    """The run of greatest length / period; of equal ones the first, then the one of the smallest period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; every tenth document by a hash of its id goes on periodically from some word."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


# ------------------------------------------------------------------------------------------------ documents


def collapsed(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs (start, length, period of each), text of every row.

    `text` is the words joined by one space without those that a run holds after its first period.  start, length and period
    are of the run with the greatest length / period, null without a run.  Null, empty and blank texts have no words; rows are
    judged one by one, equal ids or texts or not.  With `plant`, documents chosen by a hash of the id are made periodic first;
    a null id is never chosen.
    """
    shipped(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            low, n = 0, batch.num_rows
            while low < n:
                high, size, own = low, 0, []
                while high < n and size <= CHUNK_BYTES:
                    raw = texts[high].as_py() or b""
                    own.append(planted(raw.split(), ids[high]) if plant else raw.split())
                    size, high = size + len(raw), high + 1
                hashes, first, *_ = word_hashes([b" ".join(words) for words in own])
                text = np.repeat(np.arange(len(own)), np.diff(first))
                found = periodic_runs(hashes, text, len(own), shortest, periods)
                best = [strongest(runs) if runs else (None, None, None) for runs in found]
                left = []
                for words, runs in zip(own, found):
                    keep = np.ones(len(words), bool)
                    for start, length, q in runs:
                        keep[start + q : start + length] = False
                    left.append(b" ".join(itertools.compress(words, keep.tolist()) if runs else words))
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array([len(runs) for runs in found], pa.int64()),
                    *(pa.array([b[i] for b in best], pa.int64()) for i in range(3)),
                    pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], RUNS),
                    pa.array(left, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"])
                low = high

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    out = rows.mapInArrow(scan, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs {run}, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, the planted ones among them, and the text without their repetitions."""
    rows = collapsed(table(spark, folder, "documents"), plant=True)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    digests = (F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)
