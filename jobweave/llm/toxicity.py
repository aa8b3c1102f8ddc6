"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed embedding of the word and the mean of hashed embeddings of its character trigrams.  Two gated
recurrent layers read a window of words in both directions, attention pools their states, and one number per window comes out.
All overlapping windows of a text are scored; the strongest one decides, after calibration on all windows of labelled texts that
the network was not trained on.  Labels are learned from a bounded sample; language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import lowered, mixed, shipped, table, word_hashes

WINDOW, STRIDE = 32, 16
#: Labelled documents that the network is fitted on at most, and windows, evenly spaced, of each of them.
SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 24
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WORD_ROWS, CHAR_ROWS, WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8192, 4096, 8, 8, 8, 8
ROUNDS, UPDATES, BATCH, RATE, DECAY = 5, 80, 256, 0.01, 1e-5
CHUNK_BYTES = 1 << 20
SCORE_BATCH = 4096


# ------------------------------------------------------------------------------------------------ inputs


@dataclass
class Words:
    """Distinct words: row of the word table, and rows of the character table with each word's first place."""

    word: np.ndarray
    chars: np.ndarray
    first: np.ndarray


def words_and_places(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the word at each place, and the first place of every text plus the end."""
    hashes, first, starts, ends, data = word_hashes(texts)
    distinct, at, places = np.unique(hashes, return_index=True, return_inverse=True)
    starts, lengths = starts[at], (ends - starts)[at]
    begins = np.cumsum(np.concatenate(([0], lengths)))
    inside = np.arange(begins[-1]) - np.repeat(begins[:-1], lengths)
    spot, last = np.repeat(starts, lengths) + inside, np.repeat(lengths, lengths) - 1
    mark = np.uint64(1)
    before = np.where(inside > 0, data[np.maximum(spot - 1, 0)].astype(np.uint64) + np.uint64(2), mark)
    after = np.where(inside < last, data[np.minimum(spot + 1, len(data) - 1)].astype(np.uint64) + np.uint64(2), mark)
    code = (before << np.uint64(20)) | (data[spot].astype(np.uint64) << np.uint64(10)) | after
    chars = (mixed(code + np.uint64(1)) % np.uint64(CHAR_ROWS)).astype(np.int64)
    return Words((mixed(distinct) % np.uint64(WORD_ROWS)).astype(np.int64), chars, begins), places, first


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words; the last one ends with the text."""
    if n <= 0:
        return np.zeros(0, np.int64)
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def windows_of(places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each window, -1 behind short texts, and the text of each window."""
    starts = [window_starts(n) for n in np.diff(first)]
    owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    if not len(owner):
        return np.zeros((0, WINDOW), np.int64), owner
    begin = np.concatenate(starts) + first[owner]
    at = begin[:, None] + np.arange(WINDOW)[None, :]
    out = places[np.minimum(at, len(places) - 1)]
    return np.where(at < first[owner + 1][:, None], out, -1), owner


# ------------------------------------------------------------------------------------------------ network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squash(x: np.ndarray) -> np.ndarray:
    """Logistic function in place, for numbers that are small by construction."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    size = WORD_SIZE + CHAR_SIZE
    own = {"word": draw(WORD_ROWS, WORD_SIZE, scale=0.1), "char": draw(CHAR_ROWS, CHAR_SIZE, scale=0.1)}
    for way in "fb":
        own |= {f"W{way}": draw(size, 3 * HIDDEN, scale=size**-0.5), f"B{way}": np.zeros(3 * HIDDEN, np.float32), f"U{way}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
    own |= {"A": draw(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, scale=ATTENTION**-0.5)}
    return own | {"out": draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "bias": np.zeros(1, np.float32)}


def inputs(p: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """Input vector of each distinct word."""
    sums = np.add.reduceat(p["char"][words.chars], words.first[:-1], axis=0) if len(words.word) else np.zeros((0, CHAR_SIZE), np.float32)
    return np.concatenate([p["word"][words.word], sums / np.diff(words.first)[:, None]], axis=1).astype(np.float32)


def read(gates: np.ndarray, u: np.ndarray, real: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States of one recurrent layer over (step, window, 3 * hidden) gate inputs; states stay zero before the first real word."""
    steps, n, _ = gates.shape
    states = np.empty((steps, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps):
        g = h @ u
        zr = squash(gates[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if real is not None:
            new *= real[t]
        if keep is not None:
            keep.append((h, z, r, c, g[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states


def unread(d_states: np.ndarray, kept: list, u: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of `u`."""
    steps, n, _ = d_states.shape
    d_gates, d_u, d_next = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, z, r, c, g = kept[t]
        d = (d_states[t] + d_next) * real[t]
        d_c = d * (1 - z) * (1 - c * c)
        d_z, d_r = d * (h - c) * z * (1 - z), d_c * g * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_u += h.T @ d_g
        d_next = d * z + d_g @ u.T
    return d_gates, d_u


def forward(p: dict[str, np.ndarray], vectors: np.ndarray, windows: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """One number per window.  `vectors` are the inputs of the distinct words that `windows` points to."""
    order = windows.T
    real = (order >= 0).astype(np.float32)[:, :, None]
    whole = bool(real.all())
    states, memory = [], {"f": [], "b": []}
    for way in "fb":
        gates = (vectors @ p[f"W{way}"] + p[f"B{way}"])[np.maximum(order if way == "f" else order[::-1], 0)]
        mask = None if whole and kept is None else (real if way == "f" else real[::-1])
        own = read(gates, p[f"U{way}"], mask, memory[way] if kept is not None else None)
        states.append(own if way == "f" else own[::-1])
    h = np.concatenate(states, axis=2)
    e = np.tanh(h @ p["A"] + p["a"])
    weight = e @ p["v"] + np.where(real[:, :, 0] > 0, 0, -1e9).astype(np.float32)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, h)
    if kept is not None:
        kept |= {"real": real, "h": h, "e": e, "weight": weight, "pooled": pooled, **memory}
    return pooled @ p["out"] + p["bias"][0]


def backward(p: dict[str, np.ndarray], words: Words, vectors: np.ndarray, windows: np.ndarray, kept: dict, d_out: np.ndarray) -> dict[str, np.ndarray]:
    grads = {"out": kept["pooled"].T @ d_out, "bias": d_out.sum(keepdims=True)}
    d_pooled = d_out[:, None] * p["out"]
    h, e, weight, order = kept["h"], kept["e"], kept["weight"], windows.T
    d_weight = np.einsum("nh,tnh->tn", d_pooled, h)
    d_h = weight[:, :, None] * d_pooled[None]
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["v"] = np.einsum("tn,tna->a", d_score, e)
    d_e = d_score[:, :, None] * p["v"] * (1 - e * e)
    grads |= {"A": np.einsum("tnh,tna->ha", h, d_e), "a": d_e.sum(axis=(0, 1))}
    d_h = (d_h + d_e @ p["A"].T).astype(np.float32)
    d_vectors = np.zeros_like(vectors)
    flat, good = np.maximum(order, 0).ravel(), (order >= 0).ravel()
    for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        turn = (lambda x: x) if way == "f" else (lambda x: x[::-1])
        d_gates, grads[f"U{way}"] = unread(turn(d_h[:, :, part]), kept[way], p[f"U{way}"], turn(kept["real"]))
        d_gates = turn(d_gates).reshape(-1, 3 * HIDDEN)
        by_word = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        np.add.at(by_word, flat[good], d_gates[good])
        grads |= {f"W{way}": vectors.T @ by_word, f"B{way}": by_word.sum(axis=0)}
        d_vectors += by_word @ p[f"W{way}"].T
    grads["word"], grads["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(grads["word"], words.word, d_vectors[:, :WORD_SIZE])
    sizes = np.diff(words.first)
    np.add.at(grads["char"], words.chars, np.repeat(d_vectors[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
    return grads


class Adam:
    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.m, self.s, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        fix = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            p[k] -= fix * self.m[k] / (np.sqrt(self.s[k]) + 1e-8) + rate * DECAY * p[k]


def part_of(words: Words, windows: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows, and the windows that point to them."""
    used, places = np.unique(windows, return_inverse=True)
    places = places.reshape(windows.shape)
    if len(used) and used[0] < 0:
        used, places = used[1:], places - 1
    sizes = np.diff(words.first)[used]
    begins = np.cumsum(np.concatenate(([0], sizes)))
    spots = np.repeat(words.first[used] - begins[:-1], sizes) + np.arange(begins[-1])
    return Words(words.word[used], words.chars[spots], begins), places


def window_scores(p: dict[str, np.ndarray], words: Words, windows: np.ndarray) -> np.ndarray:
    vectors = inputs(p, words)
    parts = [forward(p, vectors, windows[i : i + SCORE_BATCH]) for i in range(0, len(windows), SCORE_BATCH)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


@dataclass
class Model:
    """Network, and the calibration of a text's strongest window; without labels of both kinds only their rate is known.

    `judges` are the texts of the sample that the calibration looks at: those kept out of the training if both kinds are among
    them, else all.
    """

    parameters: dict[str, np.ndarray] | None
    slope: float
    offset: float
    rate: float
    judges: np.ndarray


def strongest(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Largest number of each text's windows; minus infinity for texts without words."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, scores)
    return out


def calibration(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * x).sum() + 0.5 * (a - 1), (q - y).sum() + 0.01 * b])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.05)), float(b)


def train(texts: list[list[bytes]], labels: np.ndarray, rounds: int = ROUNDS, updates: int = UPDATES, seed: int = 7) -> Model:
    """Fit the network to labelled texts, each a list of windows.

    A fifth of the texts is kept for the calibration, here by the windows given; `calibrated` does it again by whole texts.
    Each round has the same number of updates.  In the first one every window of a text has the text's label; after that, of toxic texts only the two strongest windows count as toxic, and the strongest windows of clean texts are
    preferred as clean ones, since a toxic text need not be toxic all over.
    """
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model(None, 1.0, 0.0, rate, np.zeros(len(labels), bool))
    rng = np.random.default_rng(seed)
    words, places, first = words_and_places([w for t in texts for w in t])
    at = first[:-1, None] + np.arange(WINDOW)[None, :]
    windows = np.where(at < first[1:, None], places[np.minimum(at, max(0, len(places) - 1))] if len(places) else -1, -1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kept_out = rng.random(len(texts)) < 0.2
    p, scores = fresh(seed), None
    adam = Adam(p)
    use = ~kept_out[owner] & (windows[:, 0] >= 0)
    toxic = labels[owner] > 0
    for turn in range(rounds):
        bad, good = np.flatnonzero(use & toxic), np.flatnonzero(use & ~toxic)
        if scores is not None:
            order = np.lexsort((-scores, owner))
            place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            rank = np.empty(len(order), np.int64)
            rank[order] = place
            bad = bad[rank[bad] < 2]
            hard = good[rank[good] < 2]
            good = np.concatenate([hard, rng.choice(good, min(len(good), len(hard)), replace=False)])
        elif len(good) > 2 * len(bad):
            good = rng.choice(good, 2 * len(bad), replace=False)
        pool = np.concatenate([bad, good])
        for _ in range(updates):
            chosen = rng.choice(pool, min(BATCH, len(pool)), replace=False)
            own, part = part_of(words, windows[chosen])
            vectors, kept = inputs(p, own), {}
            q = sigmoid(forward(p, vectors, part, kept))
            d = ((q - toxic[chosen]) / len(part)).astype(np.float32)
            adam.step(p, backward(p, own, vectors, part, kept, d), RATE * (1 - 0.8 * turn / rounds))
        scores = window_scores(p, words, windows)
    top = strongest(scores[windows[:, 0] >= 0], owner[windows[:, 0] >= 0], len(texts))
    judged = kept_out & np.isfinite(top)
    judges = judged if 0 < labels[judged].sum() < judged.sum() else np.isfinite(top)
    return calibrated(Model(p, 1.0, 0.0, rate, judges), top[judges], labels[judges])


def calibrated(model: Model, top: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the calibration that these strongest windows and labels of its judges give."""
    slope, offset = calibration(np.clip(top, -30, 30), labels)
    return replace(model, slope=slope, offset=offset)


def strongest_windows(model: Model, texts: list[bytes]) -> np.ndarray:
    """Number of the strongest of all windows of each whole text."""
    words, places, first = words_and_places(texts)
    windows, owner = windows_of(places, first)
    return strongest(window_scores(model.parameters, words, windows), owner, len(texts))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Score of each whole text: 0 for texts without words."""
    if model.parameters is None:
        return np.full(len(texts), model.rate)
    top = strongest_windows(model, texts)
    return np.where(np.isfinite(top), sigmoid(model.slope * np.clip(top, -30, 30) + model.offset), 0.0)


# ------------------------------------------------------------------------------------------------ Spark


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def in_chunks(texts: list[str | None], body, limit: int = CHUNK_BYTES) -> np.ndarray:
    """`body` of the texts in lower case, about `limit` bytes at a time."""
    parts, held, size = [], [], 0
    for text in map(lowered, texts):
        if held and size + len(text) > limit:
            parts.append(body(held))
            held, size = [], 0
        held.append(text)
        size += len(text)
    return np.concatenate([*parts, body(held)]).astype(float)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[list, list[list[bytes]], np.ndarray]:
    """Ids, windows and labels of at most `size` labelled documents that are not held out, chosen by the hash of their id.

    Of several rows of one id the greatest text counts, so that copies of a row bring nothing more to the driver.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_toxic").alias("_toxic"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = lowered(text).split()
                starts = window_starts(len(own))
                if len(starts) > windows:
                    starts = starts[np.linspace(0, len(starts) - 1, windows).round().astype(int)]
                out.append([b" ".join(own[s : s + WINDOW]) for s in starts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary())), batch.column(2).cast(pa.int32())], ["doc_id", "windows", "toxic"])

    got = rows.mapInArrow(cut, f"doc_id {kind}, windows array<binary>, toxic int").toArrow().sort_by("doc_id")
    return got.column("doc_id").to_pylist(), got.column("windows").to_pylist(), np.array(got.column("toxic").to_pylist(), float)


def judged(docs: DataFrame, model: Model, ids: list, labels: np.ndarray) -> Model:
    """The model calibrated by all windows of the whole texts of its judges; one number of each comes to the driver."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    label_of = {ids[i]: labels[i] for i in np.flatnonzero(model.judges)}
    spark = docs.sparkSession
    network = spark.sparkContext.broadcast(model)
    judges = F.broadcast(spark.createDataFrame([(i,) for i in label_of], f"doc_id {kind}"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = in_chunks(batch.column(1).to_pylist(), lambda texts: strongest_windows(network.value, texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top)], ["doc_id", "top"])

    rows = docs.select("doc_id", "text").join(judges, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    found = [r for r in rows.mapInArrow(measure, f"doc_id {kind}, top double").collect() if np.isfinite(r["top"])]
    found.sort(key=lambda r: r["doc_id"])
    return calibrated(model, np.array([r["top"] for r in found]), np.array([label_of[r["doc_id"]] for r in found]))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Network and calibration from the labelled documents that are not held out."""
    ids, windows, toxic = sample(docs, labels)
    model = train(windows, toxic)
    return model if model.parameters is None else judged(docs, model, ids, toxic)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and word-free texts score 0.  Repeated rows are scored alike; a document with several labels is toxic if one says so.
    Without labels of both kinds every text has the rate of toxic labels.
    """
    spark = shipped(docs.sparkSession)
    model = spark.sparkContext.broadcast(fitted(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = in_chunks(batch.column(1).to_pylist(), lambda texts: score_texts(own, texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents."""
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
