"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of `length` bytes names one of its first `width` positions, the one whose 16 bytes have the smallest number: equal
strings name the same place, so only suffixes that start at named places (about two in `width`) have to be sorted, each with
the few bytes before it.  Suffixes whose first `length - width + 1` bytes occur once are dropped, and equal contexts become one
suffix with a count.  Tasks sort what is left into runs, write them front-coded (length of the common prefix, then the rest),
and the runs of a part of the sorted order's groups are merged by a loser tree that keeps for each contender the length of the
prefix it shares with the last winner: bytes known to be equal are never compared again.

The common prefixes of neighbours, forward by the merge and backward by sorting what precedes, then tell for every string
whether another one equals it.  Groups with too many different contexts for one task are done again with a smaller width, at
the end with width one, where a group is one string.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import attach, mixed, released, shipped, stored, table

LENGTH = 400
#: Widths of the rounds: the next one is for groups of more than `GROUP` different contexts only.
WIDTHS = (200, 40, 1)
GROUP = 2000
#: Contexts that one part of the merge takes on average, bytes a task sorts into one run, and bytes of text handled at once.
PART = 8000
RUN_BYTES = 32 << 20
CHUNK_BYTES = 2 << 20
#: Repeated beginnings, 8 bytes each, that are broadcast after they were counted.
BROADCAST_CORES = 1_000_000

_GRAM = 16
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(f)) for f in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
_TABLES: dict[tuple[int, bool], np.ndarray] = {}


# ------------------------------------------------------------------------------------------------ named places


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of a base or its inverse modulo 2 ** 64; kept for chunks of usual size."""
    have = _TABLES.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        have = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _TABLES[which, inverse] = have
    return have


def _range_hashes(data: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit numbers of the byte ranges [start, end)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * _powers(which, False, len(data))[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(which, True, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def named(data: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first string start, last string start) of every named place; `wanted`: ascending starts of whole strings."""
    if not len(wanted):
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate((data, np.zeros(24, np.uint8)))
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    numbers = mixed(eight[: len(data)] * np.uint64(0xBF58476D1CE4E5B9) + mixed(eight[8 : len(data) + 8]))
    numbers = (numbers >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    places = (sliding_least(numbers, width)[wanted] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((places[1:] != places[:-1]) | (wanted[1:] != wanted[:-1] + 1)) + 1
    first = np.concatenate(([0], new))
    return places[first], wanted[first], wanted[np.concatenate((new, [len(wanted)])) - 1]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > CHUNK_BYTES:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def places_of(docs: DataFrame, length: int, width: int, contexts: bool) -> DataFrame:
    """core, and with `contexts` also k1, k2, base, place, before, after, b1, b2, of the named places of every text.

    Of the strings that name a place the first starts `before` bytes ahead of it, the last `after` bytes.  `core` is a number of
    the bytes that all of them share behind the place, (b1, b2) of all bytes from the first to the end of the last.  With a
    column `ranges` (pairs of first and last start, one after another) only strings that start in them count.  Texts may be
    stretches of whole texts from `base` on; places are those in the whole text, ranges those in the stretch.
    """
    ranged = "ranges" in docs.columns
    names = ["core", "k1", "k2", "base", "place", "before", "after", "b1", "b2"][: 9 if contexts else 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            k1, k2, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for low, high in _chunks(texts):
                own = texts[low:high]
                data = np.frombuffer(b"".join(own), np.uint8)
                edges = np.cumsum([0] + [len(t) for t in own])
                marks = np.zeros(len(data) + 1, np.int32)
                if ranged:
                    for row in range(low, high):
                        pairs = np.array(batch.column(4)[row].as_py(), np.int64).reshape(-1, 2) + edges[row - low]
                        np.add.at(marks, pairs[:, 0], 1)
                        np.add.at(marks, pairs[:, 1] + 1, -1)
                else:
                    long = np.flatnonzero(np.diff(edges) >= length)
                    marks[edges[long]] += 1
                    marks[edges[long + 1] - length + 1] -= 1
                wanted = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                place, first, last = named(data, wanted, width)
                if not len(place):
                    continue
                columns = [pa.array(_range_hashes(data, 0, place, place + (length - width + 1)).view(np.int64))]
                if contexts:
                    text = np.searchsorted(edges, place, "right") - 1
                    before, after = place - first, place - last
                    mark = mixed((before * 4096 + after).astype(np.uint64))
                    b1 = _range_hashes(data, 0, first, last + length) ^ mark
                    b2 = _range_hashes(data, 1, first, last + length) + mark
                    own_base = base[low:high][text]
                    columns += [pa.array(k1[low:high][text]), pa.array(k2[low:high][text]), pa.array(own_base), pa.array(own_base + place - edges[text])]
                    columns += [pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(b1.view(np.int64)), pa.array(b2.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names)
        released()

    kinds = "core bigint, k1 bigint, k2 bigint, base bigint, place bigint, before int, after int, b1 bigint, b2 bigint".split(", ")
    return docs.select("k1", "k2", "bytes", "base", *(["ranges"] if ranged else [])).mapInArrow(find, ", ".join(kinds[: len(names)]))


def stretches(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, base, bytes, ranges: of each text (k1, k2, base, bytes) the stretches with the strings that start in `ranges`.

    `ranges` are pairs of first and last start in the whole text in any order.  Strings that overlap stay in one stretch.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, base, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = []
                for first, last in sorted(zip(*[iter(ranges)] * 2)):
                    if own and first <= own[-1][1] + length:
                        own[-1][1] = max(own[-1][1], last)
                        own[-1][2].extend((first, last))
                    else:
                        own.append([first, last, [first, last]])
                rows += [(k1, k2, first, text[first - base : last + length - base], [x - first for x in pairs]) for first, last, pairs in own]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "base", "bytes", "ranges"])

    return texts.select("k1", "k2", "base", "bytes", "ranges").mapInArrow(cut, "k1 bigint, k2 bigint, base bigint, bytes binary, ranges array<bigint>")


# ------------------------------------------------------------------------------------------------ sorted runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings whose first `known` bytes are equal."""
    most = min(len(a), len(b))
    while known < most:
        step = min(known + 32, most)
        if a[known:step] != b[known:step]:
            while a[known] == b[known]:
                known += 1
            return known
        known = step
    return most


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: length of the prefix shared with the one before, length of the rest, and all rests."""
    shared = [0] + [common(a, b) for a, b in zip(strings, strings[1:])]
    rests = [s[n:] for s, n in zip(strings, shared)]
    return np.array(shared, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def decoded(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with the length of the prefix it shares with the one before."""
    last, at = b"", 0
    for n, size in zip(shared.tolist(), sizes.tolist()):
        last = last[:n] + rests[at : at + size]
        at += size
        yield last, n


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, length of the prefix shared with the string before) of all runs in sorted order.

    A loser tree: each inner node holds the loser of its match with the length of the prefix it shares with the winner that
    passed.  Of two contenders, both measured against the last string given out, the one that shares more with it is the
    smaller one; only equal lengths need bytes, from that length on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [None] * k
    shares = [0] * k

    def advance(run: int) -> None:
        heads[run], shares[run] = next(runs[run], (None, 0)) if run < len(runs) else (None, 0)

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share is against the winner from now on."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = heads[a], heads[b]
        n = common(x, y, shares[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    for run in range(k):
        advance(run)
        shares[run] = 0
    losers, winners = [0] * k, list(range(-k, k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    while heads[winner] is not None:
        yield winner, heads[winner], shares[winner]
        advance(winner)
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = match(winner, losers[node])
            node >>= 1


def _shared_with_last(strings: list[bytes]) -> np.ndarray:
    return np.array([0] + [common(a, b) for a, b in zip(strings, strings[1:])], np.int32)


def repeated_starts(strings: list[bytes], shares: np.ndarray, lefts: list[bytes], before: np.ndarray, after: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """Matrix (row, start): whether the string that starts `start` bytes before the place of a row occurs a second time.

    `strings` are sorted, `shares` is what each has in common with the one before; `lefts` are the bytes before the places,
    reversed; `many`: the context occurs more than once.
    """
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    left_shares = _shared_with_last([lefts[i] for i in order])
    order = np.array(order)
    out = np.zeros((len(strings), int(before.max()) + 1), bool)
    for start in range(int(after.min()), int(before.max()) + 1):
        valid = np.flatnonzero((after <= start) & (start <= before))
        right = np.cumsum(shares < length - start)
        left = np.empty(len(order), np.int64)
        left[order] = np.cumsum(left_shares < start)
        pair = right[valid] * (len(order) + 1) + left[valid]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice = many[valid].copy()
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        out[valid, start] = twice
    return out


def spans_in(flags: np.ndarray) -> list[int]:
    """First and last set place of each stretch, one after another."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    edges[1::2] -= 1
    return edges.tolist()


def _runs(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """part, run: the suffixes of the wanted places of each text, sorted per task and part, front-coded."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, own in kept.items():
                own.sort(key=lambda item: item[0])
                shared, sizes, rests = front_coded([item[0] for item in own])
                numbers = np.array([item[2:] for item in own], np.int64)
                lefts = [item[1] for item in own]
                body = [shared.tobytes(), sizes.tobytes(), rests, np.array([len(x) for x in lefts], np.uint16).tobytes(), b"".join(lefts), numbers.tobytes()]
                packed = [pa.array([pa.compress(x, "zstd", asbytes=True) if x else b""], pa.binary()) for x in body]
                lengths = pa.array([[len(x) for x in body]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), lengths, *packed], ["part", "sizes", "shared", "rest_sizes", "rests", "left_sizes", "lefts", "numbers"])
            kept.clear()

        for batch in batches:
            for text, base, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for w in wanted:
                    place, before, after = w["place"] - base, w["before"], w["after"]
                    suffix, left = text[place : place + length - after], text[place - before : place][::-1]
                    kept.setdefault(w["core"] % parts, []).append((suffix, left, before, after, w["many"], w["b1"], w["b2"]))
                    size += length + before
                    if size > RUN_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()
        released()

    return rows.mapInArrow(sort, "part int, sizes array<bigint>, shared binary, rest_sizes binary, rests binary, left_sizes binary, lefts binary, numbers binary")


def _verdicts(runs: DataFrame, length: int) -> DataFrame:
    """b1, b2, starts: for each context the stretches of string starts (bytes before its place) that occur a second time."""

    def merge(rows: pa.Table) -> pa.Table:
        sequences, lefts, numbers = [], [], []
        for row in rows.select(["sizes", "shared", "rest_sizes", "rests", "left_sizes", "lefts", "numbers"]).to_pylist():
            sizes = row.pop("sizes")
            body = [pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(row.values(), sizes)]
            sequences.append(decoded(np.frombuffer(body[0], np.uint16), np.frombuffer(body[1], np.uint16), body[2]))
            ends = np.cumsum(np.frombuffer(body[3], np.uint16).astype(np.int64)).tolist()
            lefts.append([body[4][a:b] for a, b in zip([0, *ends], ends)])
            numbers.append(np.frombuffer(body[5], np.int64).reshape(-1, 5))
        taken = [0] * len(sequences)
        strings, shares, left, place = [], [], [], []
        for run, string, share in merged(sequences):
            strings.append(string)
            shares.append(share)
            left.append(lefts[run][taken[run]])
            place.append((run, taken[run]))
            taken[run] += 1
        own = np.array([numbers[run][at] for run, at in place], np.int64)
        found = repeated_starts(strings, np.array(shares), left, own[:, 0], own[:, 1], own[:, 2] > 0, length)
        some = np.flatnonzero(found.any(axis=1))
        starts = [spans_in(found[i]) for i in some]
        return pa.table([pa.array(own[some, 3]), pa.array(own[some, 4]), pa.array(starts, pa.list_(pa.int32()))], ["b1", "b2", "starts"])

    return runs.groupBy("part").applyInArrow(merge, "b1 bigint, b2 bigint, starts array<int>")


# ------------------------------------------------------------------------------------------------ documents


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """k1, k2, bytes: two numbers of the id and of the text, which equal rows share, and the text in UTF-8."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes")
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()).alias("k1"), F.xxhash64("text").alias("k2"), text, *more)


def repeats(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS, group: int = GROUP, limit: int = BROADCAST_CORES) -> DataFrame:
    """k1, k2, spans of every text with a string of `length` bytes that starts anywhere else too.

    `spans` are first and last starts of such strings, one pair after another, in any order and perhaps overlapping; every
    start counts, in the same text as well.  The last width must be one.
    """
    if widths[-1] != 1 or max(widths) > length - _GRAM + 1:
        raise ValueError("widths end in 1 and leave 16 bytes of every string")
    spark = shipped(docs.sparkSession)
    todo, found = _keyed(docs).withColumn("base", F.lit(0).cast("bigint")), []
    for width in widths:
        cores = places_of(todo, length, width, False).groupBy("core").agg(F.count("*").alias("n")).filter("n > 1")
        cores = stored(cores, "cores")
        shared = cores.withColumn("copies", F.col("n"))
        places = attach(places_of(todo, length, width, True), shared, "core", "n", ["place", "k2"], limit=limit).filter("copies IS NOT NULL")
        places = stored(places.drop("copies"), "places")
        alike = places.groupBy("core", "b1", "b2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "base", "place", "before", "after")).alias("one"))
        alike = stored(alike, "contexts")
        sizes = alike.groupBy("core").agg(F.count("*").alias("different"))
        large = stored(sizes.filter(F.col("different") > group).withColumn("n", F.col("different")), "large")
        some_large = width > 1 and large.limit(1).count() > 0
        if some_large:
            alike = attach(alike, large, "core", "n", ["b1"]).filter("different IS NULL").drop("different")
        own = F.struct("one.place", "one.before", "one.after", (F.col("n") > 1).cast("int").alias("many"), "core", "b1", "b2")
        lists = alike.groupBy("one.k1", "one.k2", "one.base").agg(F.collect_list(own).alias("wanted"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(alike.count() / PART))
        rows = todo.join(lists, ["k1", "k2", "base"]).select("bytes", "base", "wanted")
        verdicts = _verdicts(_runs(rows, length, parts), length)
        key = F.struct("b1", "b2").alias("block")
        verdicts = stored(verdicts.dropDuplicates(["b1", "b2"]).select(key, "starts"), "verdicts")
        counts = alike.select(key, "n")
        verdicts = verdicts.join(counts.dropDuplicates(["block"]), "block")
        hits = attach(places.withColumn("block", F.struct("b1", "b2")), stored(verdicts, "verdicts"), "block", "n", ["place", "k2"]).filter("starts IS NOT NULL")
        stretch = F.sequence(F.lit(0), F.size("starts") - 2, F.lit(2))
        pairs = F.transform(stretch, lambda i: F.array(F.col("place") - F.col("starts")[i + 1], F.col("place") - F.col("starts")[i]))
        found.append(stored(hits.select("k1", "k2", F.flatten(pairs).alias("spans")), "found"))
        if not some_large:
            break
        again = attach(places, large, "core", "n", ["place", "k2"]).filter("different IS NOT NULL")
        ranges = again.groupBy("k1", "k2", "base").agg(F.flatten(F.collect_set(F.array(F.col("place") - F.col("before"), F.col("place") - F.col("after")))).alias("ranges"))
        # Whole texts are shuffled once for all later rounds, which take their strings only.
        todo = stored(stretches(todo.drop("ranges").join(ranges, ["k1", "k2", "base"]), length), "stretches")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    return rows.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def removed_flags(size: int, spans: list[int], length: int) -> np.ndarray:
    """Whether each byte of a text is covered by a string that starts in one of the spans."""
    marks = np.zeros(size + 1, np.int32)
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, pairs[:, 1] + length, -1)
    return np.cumsum(marks[:-1]) > 0


def deduplicated(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left) of every row.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too: in another row, also one with the same
    id, or in the same text, overlapping or not.  Strings are judged on the input, never across rows.  Null texts count as
    empty; texts shorter than `length` stay whole.  Rows without an id are treated like others.  Bytes left need not be UTF-8.
    """
    spans = stored(repeats(docs, length, **how), "spans")
    rows = _keyed(docs, "doc_id").join(spans, ["k1", "k2"], "left").select("doc_id", "bytes", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, n = 0, batch.num_rows
            while low < n:
                high, size, numbers, kept = low, 0, [], []
                while high < n and size <= CHUNK_BYTES:
                    text, own = batch.column(1)[high].as_py(), batch.column(2)[high].as_py()
                    if own:
                        gone = removed_flags(len(text), own, length)
                        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                        numbers.append((len(text), int(gone.sum()), len(spans_in(gone)) // 2))
                    else:
                        kept.append(text)
                        numbers.append((len(text), 0, 0))
                    size, high = size + len(text), high + 1
                columns = [pa.array(column, pa.int64()) for column in zip(*numbers)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                low = high

    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document without its repeated 400-byte strings."""
    rows = deduplicated(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
