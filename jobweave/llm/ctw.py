"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions.  For each decision a tree of contexts, the last bytes of the text, holds counts of zeros
and ones; each context's Krichevsky-Trofimov estimate is mixed with what its longer contexts say, with the weights that the
training text itself gives.

The tree has every context of up to `depth` bytes that occurs at least `least` times in the training documents; the bytes
of rarer contexts go to the rest leaf of the context above, so that no count is lost.  The model therefore grows with the
corpus, and no process holds it: the counts are a table of runs of depth + 1 bytes, tasks own whole subtrees below a context of
three bytes (at most 2 ** 24 runs), and only the contexts of up to two bytes, bounded by the number of byte pairs, are put
together on the driver.  What comes out is a table with the price of every run; texts take the prices of the most used runs from a
broadcast of bounded size and those of all other runs by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import lowered, most, released, shipped, size_step, stored, table, word_hashes

DEPTH = 5
#: A context seen less often is not split off from the context above it.
LEAST = 4
#: Context bytes of the subtrees that tasks own; contexts shorter than that are put together on the driver.
TOP = 3
#: Words and runs whose counts and prices every task holds; those of all others are joined.
FREQUENT_WORDS = 1 << 18
FREQUENT_RUNS = 1 << 20
#: Runs that a task is meant to get, and runs whose subtrees are worked on at once.
TASK_RUNS = 1 << 19
SLICE_RUNS = 1 << 16
FOLDS, HELD_OUT = 7, 2
#: Bytes that are counted or scored at once, and distinct keys that a task holds before it hands counts on.
CHUNK_BYTES = 1 << 20
HELD_KEYS = 1 << 21
END = 0xFF


# ------------------------------------------------------------------------------------------------ contexts


def sequence(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each after `depth` ends and with one end behind it; first place of every text, and the total."""
    pad = bytes([END]) * depth
    data = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    return data, np.cumsum([0] + [len(t) + depth + 1 for t in texts])


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each byte of the texts and their ends -- the byte lowest, above it the bytes before it, the nearest highest --
    and the first of every text, and the total."""
    data, first = sequence(texts, depth)
    code = data[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        code |= data[depth - k : len(data) - k].astype(np.int64) << (8 * (depth + 1 - k))
    real = np.ones(len(data), bool)
    for start in first[:-1]:
        real[start : start + depth] = False
    return code[real[depth:]], first - depth * np.arange(len(first))


# ------------------------------------------------------------------------------------------------ the tree

_HALVES = np.array([0.0])


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) of whole numbers: by products up to 4096, by Stirling's series above."""
    global _HALVES
    if len(_HALVES) == 1:
        _HALVES = np.concatenate(([0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(4096) + 0.5))))
    x = np.maximum(n, 1).astype(np.float64) + 0.5
    long = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 4096, _HALVES[np.minimum(n, 4096).astype(np.int64)], long)


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1).astype(np.float64) + 1
    long = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4097)))))
    return np.where(n <= 4096, small[np.minimum(n, 4096).astype(np.int64)], long)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - np.log(np.pi) - log_factorial(zeros + ones)


def share_of_ones(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def decisions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each run, highest bit first: context * 256 + place in the tree of bits, and the bit taken."""
    byte, steps = codes & 255, np.arange(8)
    places = (byte[:, None] | 256) >> (8 - steps)
    return (codes >> 8 << 8)[:, None] | places, (byte[:, None] >> (7 - steps)) & 1


def summed(ids: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct ids in order, the place of each id among them, and sums of the weights."""
    names, place = np.unique(ids, return_inverse=True)
    return names, place, [np.bincount(place, w, len(names)) for w in weights]


class Level:
    """Decisions of all contexts of one length, by id; what is known of them upward (`weight`, `log`) and downward.

    `weight` is the posterior weight that the context is a leaf, `log` its weighted log probability.  Going down, `mixed` is
    what the contexts so far say, `left` the share that longer ones have to say, and `rest` what the rest leaf says.
    """

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, least: int, longer: tuple | None = None) -> None:
        self.ids, self.zeros, self.ones = ids, zeros, ones
        head = (ids & 255) == 1  # the first decision of a context has all its counts
        self.rare = ((zeros + ones)[head] < least)[np.cumsum(head) - 1] if len(ids) else np.zeros(0, bool)
        own, self.up = log_kt(zeros, ones), None
        if longer is None:
            self.weight, self.log, self.rest = np.ones(len(ids)), own, np.full(len(ids), 0.5)
        else:
            rest_zeros, rest_ones, below = longer
            self.log = np.logaddexp(own, log_kt(rest_zeros, rest_ones) + below) - np.log(2)
            self.weight = np.exp(own - np.log(2) - self.log)
            self.rest = share_of_ones(rest_zeros, rest_ones)

    def shorter(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids of the contexts one byte shorter; zeros, ones, those of their rest leaves, and the logs of their longer contexts."""
        rare = self.rare.astype(np.float64)
        above = (self.ids >> 16 << 8) | (self.ids & 255)
        ids, self.up, sums = summed(above, self.zeros, self.ones, self.zeros * rare, self.ones * rare, np.where(self.rare, 0, self.log))
        return ids, sums

    def mix(self, above: "Level | None") -> None:
        if above is None:
            self.mixed, self.left = self.weight * share_of_ones(self.zeros, self.ones), 1 - self.weight
            return
        if self.up is None:
            self.up = np.searchsorted(above.ids, (self.ids >> 16 << 8) | (self.ids & 255))
        mixed, left, rest = above.mixed[self.up], above.left[self.up], above.rest[self.up]
        own = np.where(self.rare, rest, self.weight * share_of_ones(self.zeros, self.ones))
        self.mixed, self.left = mixed + left * own, np.where(self.rare, 0.0, left * (1 - self.weight))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.zeros(ids.shape, np.int64), np.zeros(ids.shape, bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids


def climbed(level: Level, steps: int, least: int) -> list[Level]:
    """The level and as many shorter ones, the shortest first."""
    levels = [level]
    for _ in range(steps):
        ids, (zeros, ones, *longer) = levels[0].shorter()
        levels.insert(0, Level(ids, zeros, ones, least, longer))
    return levels


def subtrees(codes: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels from the owned contexts to the longest, from runs in order that have all runs of their owned contexts."""
    seen = n > 0
    ids, bits = decisions(codes[seen])
    times = np.broadcast_to(n[seen, None], bits.shape).ravel().astype(np.float64)
    names, _, (total, ones) = summed(ids.ravel(), times, times * bits.ravel())
    return climbed(Level(names, total - ones, ones, least), depth - min(TOP, depth), least)


def top_of(ids: np.ndarray, sums: list[np.ndarray], depth: int, least: int) -> list[Level]:
    """Levels of the contexts above the subtrees, from what `Level.shorter` says of all subtrees."""
    zeros, ones, *longer = sums
    levels = climbed(Level(ids, zeros, ones, least, longer), min(TOP, depth) - 1, least)
    for above, level in zip([None, *levels], levels, strict=False):
        level.mix(above)
    return levels


def prices(codes: np.ndarray, n: np.ndarray, top: list[Level], depth: int, least: int) -> np.ndarray:
    """log10 probability of the byte of each run after the bytes before it; runs as in `subtrees`, unseen ones among them."""
    levels = subtrees(codes, n, depth, least)
    for above, level in zip([top[-1], *levels], levels, strict=False):
        level.mix(above)
    ids, bits = decisions(codes)
    at, hit = levels[-1].find(ids)
    share = levels[-1].mixed[at] if len(levels[-1].ids) else np.full(at.shape, 0.5)
    new = np.flatnonzero(~hit.all(axis=1))
    if len(new):
        share[new] = unseen(codes[new], [*top, *levels], depth)
    return np.log10(np.clip(np.where(bits == 1, share, 1 - share), 1e-12, 1)).sum(axis=1)


def unseen(codes: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """Share of ones in the decisions of any runs, walked from the empty context to the longest one that has the decision.

    The share left for longer contexts goes to the rest leaf if the next context is rare or new, and is even if that context
    never met the decision.
    """
    share, open_ = np.full((len(codes), 8), 0.5), np.ones((len(codes), 8), bool)
    mixed, left, rest = np.zeros(share.shape), np.ones(share.shape), np.full(share.shape, 0.5)
    for length, level in enumerate(levels):
        context = codes >> (8 * (depth - length + 1)) << 8
        at, hit = level.find(decisions(context | (codes & 255))[0])
        head, known = level.find(context | 1)
        common = known & ~level.rare[head] if len(level.ids) else known
        ends = open_ & ~hit
        share = np.where(ends, mixed + left * np.where(common[:, None], 0.5, rest), share)
        open_ &= hit
        if open_.any():
            mixed, left, rest = (np.where(open_, of[at], was) for of, was in ((level.mixed, mixed), (level.left, left), (level.rest, rest)))
    return np.where(open_, mixed, share)


class Lookup:
    """Numbers by key in a table of open places; keys are not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            chosen = free[which]
            self.keys[taken], self.values[taken] = keys[todo[chosen]], values[todo[chosen]]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, 0 where there is none, and the places of the keys that are not there."""
        slot = self._slot(keys)
        out, open_, lost = np.zeros(len(keys)), np.arange(len(keys)), []
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = have == keys
            out[open_[hit]] = self.values[slot[hit]]
            lost.append(open_[have < 0])
            more = ~hit & (have >= 0)
            open_, keys, slot = open_[more], keys[more], (slot[more] + 1) & (len(self.keys) - 1)
            if not len(open_):
                break
        return out, np.sort(np.concatenate([*lost, open_]))


# ------------------------------------------------------------------------------------------------ Spark


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Is the document not learned from?  A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, in lower case, in lists of about `limit` bytes."""
    own, size = [], 0
    for text in map(lowered, texts):
        if own and size + len(text) > limit:
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


class Counts:
    """Sorted distinct keys with their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > HELD_KEYS and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


WORD, RUN = 0, 1


def corpus_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n, uses from (text, held_out): every word (its hash) of the texts to learn from, every run of depth + 1 bytes of
    all texts; `n` counts the texts to learn from, `uses` all."""

    def made(kind: int, learned: bool, counts: Counts) -> pa.RecordBatch:
        keys, n = counts.taken()
        columns = [np.full(len(keys), kind, np.int8), keys.view(np.int64), n if learned else np.zeros(len(n), np.int64), n]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n", "uses"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(kind, learned): Counts() for kind in (WORD, RUN) for learned in (True, False)}
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for learned in (True, False):
                for own in chunks([texts[i] for i in np.flatnonzero(out != learned)]):
                    if learned:
                        held[WORD, True].add(word_hashes(own)[0])
                    held[RUN, learned].add(grams(own, depth)[0])
                    for (kind, of), counts in held.items():
                        if counts.size > HELD_KEYS:
                            yield made(kind, of, counts)
        for (kind, of), counts in held.items():
            yield made(kind, of, counts)

    counted = rows.select("text", "held_out").mapInArrow(count, "kind byte, key bigint, n bigint, uses bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def slices(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, n, uses of the runs of a task in order, cut between owned contexts into slices of about SLICE_RUNS."""
    columns = list(zip(*([c.to_numpy() for c in batch.columns] for batch in batches), strict=True))
    if not columns:
        return
    key, n, uses = (np.concatenate(c) for c in columns)
    order = np.argsort(key)
    key, n, uses = key[order], n[order], uses[order]
    owned = key >> (8 * (depth + 1 - min(TOP, depth)))
    starts = np.concatenate(([0], np.flatnonzero(owned[1:] != owned[:-1]) + 1))
    low = 0
    while low < len(key):
        at = np.searchsorted(starts, low + SLICE_RUNS)
        high = len(key) if at == len(starts) else int(starts[at])
        yield key[low:high], n[low:high], uses[low:high]
        low = high


SUMS = ("zeros", "ones", "rest_zeros", "rest_ones", "below")


def priced(runs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """key, uses, value: log10 probability of every run of (key, n, uses), n being how often it was learned.

    Two passes over the runs, shared out by their three nearest bytes: the first sums up the subtrees for the contexts above
    them, the second takes these contexts' say down again.
    """
    spark = shipped(runs.sparkSession)
    parts = max(1, -(-runs.count() // TASK_RUNS))
    owned = runs.select("key", "n", "uses").repartition(parts, F.shiftright("key", 8 * (depth + 1 - min(TOP, depth))))

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, _ in slices(batches, depth):
            ids, sums = subtrees(key, n, depth, least)[0].shorter()
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, sums)], ["id", *SUMS])
        released()

    found = owned.mapInArrow(upward, "id bigint, " + ", ".join(f"{name} double" for name in SUMS))
    found = found.groupBy("id").agg(*[F.sum(name).alias(name) for name in SUMS]).toArrow().sort_by("id")
    top = spark.sparkContext.broadcast(top_of(found["id"].to_numpy(), [found[name].to_numpy() for name in SUMS], depth, least))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, uses in slices(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uses), pa.array(prices(key, n, top.value, depth, least))], ["key", "uses", "value"])
        released()

    return owned.mapInArrow(downward, "key bigint, uses bigint, value double")


_LOOKUPS: dict[int, tuple] = {}


def pairs_of(text: np.ndarray, keys: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
    """Distinct (text, key) with their counts: text, kind, key, times."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return text[at], np.full(len(at), kind, np.int8), keys[at], np.diff(np.append(at, len(keys)))


def scored(
    docs: DataFrame, depth: int = DEPTH, least: int = LEAST, frequent_words: int = FREQUENT_WORDS, frequent_runs: int = FREQUENT_RUNS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document.

    The model learns from the documents that are not held out.  `score` is the tree's log10 probability of the whole text
    in lower case and of its end, `bits_per_byte` its code length over the bytes and the end; `base_score` is the log10 probability
    of its words under counts with one added.  Null texts are empty: they are the end alone.  Repeated rows count and are
    scored as rows.  Without training documents all bytes are equally likely.  Words are compared by 64-bit hash.
    """
    spark = shipped(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = stored(corpus_counts(rows, depth), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    runs = stored(priced(counts.filter(F.col("kind") == RUN), depth, least), "runs")
    ends = rows.filter(~F.col("held_out")).count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = total["n"] + ends, total["v"] + (1 if ends else 0)
    word_step, run_step = size_step("n"), size_step("uses")
    word_bound, run_bound = most(words, "n", frequent_words), most(runs, "uses", frequent_runs)
    own_words = words.filter(word_step >= word_bound).toArrow().sort_by("key")  # at most frequent_words rows
    own_runs = runs.filter(run_step >= run_bound).select("key", "value").toArrow()  # at most frequent_runs rows
    model = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in (*own_words.columns, *own_runs.columns)))
    del own_words, own_runs
    per_token, number = math.log10(n_train + vocabulary + 1), model._jbroadcast.id()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _LOOKUPS:
            _LOOKUPS.clear()
            keys, n, run_keys, values = model.value
            _LOOKUPS[number] = keys, np.log10(n + 1.0), Lookup(run_keys, values)
        keys, logs, lookup = _LOOKUPS[number]
        for batch in batches:
            done = 0
            for own in chunks(batch.column(1).to_pylist()):
                hashes, first, *_ = word_hashes(own)
                hashes, text = hashes.view(np.int64), np.repeat(np.arange(len(own)), np.diff(first))
                place = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                sums = np.bincount(text[hit], logs[place[hit]] if len(keys) else None, len(own)).astype(float) + math.log10(ends + 1)
                known = np.bincount(text[hit], minlength=len(own)) + (1 if ends else 0)
                codes, start = grams(own, depth)
                each, lost = lookup.find(codes)
                scores = np.diff(np.concatenate(([0.0], np.cumsum(each)))[start])
                rare_words = pairs_of(text[~hit], hashes[~hit], WORD)
                rare_runs = pairs_of(np.searchsorted(start, lost, side="right") - 1, codes[lost], RUN)
                of, kind, key, times = (np.concatenate(c) for c in zip(rare_words, rare_runs, strict=True))
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(len(own) + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(key[order]), pa.array(times[order].astype(np.int32))], ["kind", "key", "times"])
                columns = [
                    batch.column(0).slice(done, len(own)), batch.column(2).slice(done, len(own)), pa.array(np.diff(first).astype(np.int64) + 1),
                    pa.array(known.astype(np.int64)), pa.array(sums), pa.array(scores), pa.array(np.diff(start) - 1),
                    pa.ListArray.from_arrays(pa.array(edges), pairs),
                ]
                done += len(own)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "sums", "score", "n_bytes", "rare"])
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, sums double, score double, n_bytes bigint, rare array<struct<kind:tinyint,key:bigint,times:int>>"
    made = rows.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id())
    made = stored(made, "scores")
    values = words.filter(word_step < word_bound).select(F.lit(WORD).cast("byte").alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value"))
    values = values.unionByName(runs.filter(run_step < run_bound).select(F.lit(RUN).cast("byte").alias("kind"), "key", "value"))
    pairs = made.select("row", F.inline("rare"))
    is_word = F.col("kind") == WORD
    value = F.col("times") * F.col("value")
    more = pairs.join(values, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(is_word, value)).alias("more"), F.sum(F.when(is_word, F.col("times"))).alias("more_known"), F.sum(F.when(~is_word, value)).alias("more_score")
    )
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token
    score_of = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return made.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"), base.alias("base_score"), score_of.alias("score"), "n_bytes",
        (-score_of * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents."""
    return scored(table(spark, folder, "documents"))
