"""Byte-level BPE with a lexicon of frequent words.

The words that all documents use most are compiled, with their token ids, into a minimal acyclic transducer: states that
accept the same endings are one state, and the numbers on the edges of a path add up to the word's place in the id table.
The transducer is one file of plain arrays that every worker maps into memory.  Any other word is merged exactly by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jobweave.llm.common import most, released, shared_file, shipped, size_step, stored, table

TOKENIZER = "byte_bpe_50k.json"
LEXICON_WORDS = 1 << 16
#: Words that one worker keeps with their ids, and distinct pieces that it counts before it hands them on.
CACHED_WORDS, COUNTED_PIECES = 250_000, 100_000
#: Longer words are merged with a heap.
SHORT = 64
NONE = 1 << 60
#: Texts that are encoded together.
TEXTS = 200
# The byte-level split of words and the printable stand-ins of bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_signs() -> dict[str, int]:
    """Sign of the vocabulary file -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] of all codes one after another, and where each of them ends."""
    own = sizes[codes]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - own), own) + np.arange(total)], ends


class Vocabulary:
    """Merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        kind, before = spec["model"], spec["pre_tokenizer"]
        plain = not any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if spec["normalizer"] or kind["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or not plain:
            raise ValueError("only byte-level BPE without normalizer, prefix space and unknown token is supported")
        signs, ids = byte_signs(), kind["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in kind["merges"]]
        self.merges = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.hits = np.array([self.merges[k] for k in self.pairs.tolist()], np.int64)
        self.byte_ids = [0] * 256
        for sign, byte in signs.items():
            self.byte_ids[byte] = ids[sign]
        self.bytes_of = {i: bytes(signs[c] for c in token) for token, i in ids.items()}
        self.special: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens that take their surroundings are not supported")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.token_sizes = np.array([len(t) for t in tokens])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = regex.compile(SPLIT)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """Plain pieces at even places, special tokens at odd ones."""
        return self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ids = [self.byte_ids[b] for b in word]
        return tuple(self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids))

    def merge_all(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short words at once: in every step each word that has a pair left merges its best one.

        Tokens stay at their first byte's place and point to the places after and before them; a merge changes two ranks.
        """
        if not words:
            return []
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max()) + 1
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, np.array(self.byte_ids, np.int64)[data], -1)
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        ranks = np.full((n, width), NONE)
        ranks[:, :-1] = self._hits(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            alive = best < NONE
            rows, at, best = rows[alive], at[alive], best[alive]
            gone = after[rows, at]
            ids[rows, at], ids[rows, gone], ranks[rows, gone] = best & 0xFFFFF, -1, NONE
            follow = after[rows, gone]
            after[rows, at] = follow
            before[rows, np.minimum(follow, width - 1)] = at
            ranks[rows, at] = self._hits(ids[rows, at], ids[rows, np.minimum(follow, width - 1)])
            lead = before[rows, at]
            has = lead >= 0
            ranks[rows[has], lead[has]] = self._hits(ids[rows[has], lead[has]], ids[rows[has], at[has]])
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1))
        flat, starts = ids[kept].tolist(), np.concatenate(([0], ends[:-1])).tolist()
        return [tuple(flat[a:b]) for a, b in zip(starts, ends.tolist())]

    def _hits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and result of pairs of ids, `NONE` where they do not merge or one of them is missing."""
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.hits[place], NONE)

    def _merge_short(self, ids: list[int]) -> list[int]:
        find, none = self.merges.get, NONE
        ranks = [find(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at] = best & 0xFFFFF
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = find(ids[at - 1] << 20 | ids[at], none)
            if at < len(ranks):
                ranks[at] = find(ids[at] << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(hit, i, a << 20 | b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (hit := find(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            hit, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j], after[i] = hit & 0xFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (hit := find(ids[left] << 20 | ids[right])) is not None:
                    heapq.heappush(heap, (hit, left, ids[left] << 20 | ids[right]))
        return [i for i in ids if i >= 0]

    def text(self, ids: Sequence[int]) -> str:
        made, _ = gathered(self.token_bytes, self.token_starts, self.token_sizes, np.asarray(ids, np.int64))
        return made.tobytes().decode("utf-8", "replace")


# ------------------------------------------------------------------------------------------------ the transducer


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> bytes:
    """The transducer as one block: sizes, then first edges of the states, targets and numbers of the edges, id table, ends, labels.

    Words are added in order of their bytes.  When a word leaves the path of the one before, the states of the part left
    behind are final and each is replaced by an equal state if there is one.  An edge's number is the count of words that
    come before all words through this edge at its state, so the sum along a word's path is its place in order.
    """
    order = sorted(words)
    state = lambda: {"end": False, "edges": {}, "id": None, "count": 0}
    root, known, path = state(), {}, []

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            child["count"] = child["end"] + sum(c["count"] for c in child["edges"].values())
            key = (child["end"], tuple((b, id(c)) for b, c in child["edges"].items()))
            parent["edges"][byte] = known.setdefault(key, child)

    last = b""
    for word in order:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(same)
        node = path[-1][2] if path else root
        for byte in word[same:]:
            child = state()
            node["edges"][byte] = child
            path.append((node, byte, child))
            node = child
        node["end"], last = True, word
    settle(0)
    root["id"], queue, first, labels, targets, numbers, ends = 0, [root], [0], bytearray(), [], [], bytearray()
    for node in queue:  # grows while it runs
        ends.append(node["end"])
        number = int(node["end"])
        for byte, child in sorted(node["edges"].items()):
            if child["id"] is None:
                child["id"] = len(queue)
                queue.append(child)
            labels.append(byte)
            targets.append(child["id"])
            numbers.append(number)
            number += child["count"]
        first.append(len(labels))
    ids = [words[w] for w in order]
    places = np.cumsum([0, *map(len, ids)])
    arrays = [np.array(a, "<i4").tobytes() for a in (first, targets, numbers, places, list(chain.from_iterable(ids)))]
    arrays += [bytes(ends), bytes(labels)]
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a + b"\0" * (-len(a) % 8) for a in arrays)


class Lexicon:
    """A compiled transducer over bytes or a mapped file."""

    def __init__(self, block: bytes | mmap.mmap) -> None:
        view, at, parts = memoryview(block), 56, []
        for size in view[:56].cast("q"):
            parts.append((at, size))
            at += size + -size % 8
        self.first, self.targets, self.numbers, self.places, self.ids = (view[a : a + n].cast("i") for a, n in parts[:5])
        self.ends = view[parts[5][0] : parts[5][0] + parts[5][1]]
        self.block, self.labels = block, parts[6][0]
        states = np.repeat(np.arange(len(self.ends), dtype=np.int64), np.diff(np.asarray(self.first)))
        self.keys = states * 256 + np.asarray(view[self.labels : self.labels + parts[6][1]])

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, word: bytes) -> tuple[int, ...] | None:
        """Ids of a word, or None if the lexicon does not have it."""
        state, place, first, labels, seek = 0, 0, self.first, self.labels, self.block.find
        for byte in word:
            edge = seek(byte.to_bytes(), labels + first[state], labels + first[state + 1]) - labels
            if edge < 0:
                return None
            place += self.numbers[edge]
            state = self.targets[edge]
        if not self.ends[state]:
            return None
        return tuple(self.ids[self.places[place] : self.places[place + 1]])


    def find_all(self, words: Sequence[bytes]) -> list[tuple[int, ...] | None]:
        """`find` for many words, which go through the states in step."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        if not words or not len(self.keys):
            return [self.find(w) for w in words]
        targets, numbers, ends = (np.asarray(x) for x in (self.targets, self.numbers, self.ends))
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max()) + 1
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        rows, state, place = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(width):
            done = sizes[rows] == at
            for row, ended, spot in zip(rows[done].tolist(), ends[state[done]].tolist(), place[done].tolist()):
                if ended:
                    out[row] = tuple(self.ids[self.places[spot] : self.places[spot + 1]])
            rows, state, place = rows[~done], state[~done], place[~done]
            key = state * 256 + data[rows, at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[edge] == key
            rows, state, place = rows[on], targets[edge[on]].astype(np.int64), place[on] + numbers[edge[on]]
        return out


class Encoder(dict):
    """word -> ids: words met so far in front of the lexicon, and exact merging behind it.

    Words of the lexicon stay, other words are forgotten when there are `limit` of them.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, limit: int = CACHED_WORDS) -> None:
        super().__init__()
        self.vocabulary, self.lexicon, self.limit, self.rare = vocabulary, lexicon, limit, []

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.find(data) if self.lexicon and len(data) <= SHORT else None
        return self.vocabulary.merge(data) if ids is None else ids

    def learn(self, words: set[str]) -> None:
        """Take in the words that are short and not known yet; forget rare ones if there are too many."""
        new = [w for w in words.difference(self) if len(w) <= SHORT]
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        fit = [i for i, d in enumerate(data) if len(d) <= SHORT]
        new, data = [new[i] for i in fit], [data[i] for i in fit]
        found = self.lexicon.find_all(data) if self.lexicon else [None] * len(data)
        rest = [i for i, ids in enumerate(found) if ids is None]
        if len(self.rare) + len(rest) > self.limit:
            for old in self.rare:
                del self[old]
            self.rare.clear()
        for i, ids in zip(rest, self.vocabulary.merge_all([data[i] for i in rest])):
            found[i] = ids
            self.rare.append(new[i])
        self.update(zip(new, found))

    def encode_all(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """Ids of each text; the words of all of them are looked up together."""
        split, special = self.vocabulary.split.findall, self.vocabulary.special
        cut = [[special[p] if i % 2 else split(p) for i, p in enumerate(self.vocabulary.parts(t))] for t in texts]
        self.learn({word for parts in cut for part in parts[::2] for word in part})
        for parts in cut:
            ids: list[int] = []
            for i, part in enumerate(parts):
                if i % 2:
                    ids.append(part)
                else:
                    ids.extend(chain.from_iterable(map(self.__getitem__, part)))
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))


_LOADED: dict[tuple, object] = {}


def _loaded(raw: bytes, lexicon: str | None = None):
    """Vocabulary, or encoder with a lexicon file: built once per worker process."""
    key = (hashlib.sha256(raw).digest(), lexicon)
    if key not in _LOADED:
        if lexicon is None:
            _LOADED[key] = Vocabulary(raw)
        else:
            for old in [k for k in _LOADED if k[1]]:
                del _LOADED[old]
            _LOADED[key] = Encoder(_loaded(raw), Lexicon.open(SparkFiles.get(lexicon)))
    return _LOADED[key]


# ------------------------------------------------------------------------------------------------ Spark


def word_counts(texts: DataFrame, raw, limit: int = COUNTED_PIECES) -> DataFrame:
    """How often each word of the split occurs in all texts.

    Pieces between blanks are counted first, per task and then over all of them; the split then goes over distinct pieces,
    each with its blank, instead of over all texts.  Words at runs of blanks may be counted with one blank less or more.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, heads = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = [*counts, *heads]
            n, after = [*counts.values(), *heads.values()], [True] * len(counts) + [False] * len(heads)
            counts.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(after, pa.bool_()), pa.array(n, pa.int64())], ["piece", "after", "n"])

        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                for text in batch.column(0).slice(low, TEXTS).to_pylist():
                    first, *others = text.split(" ")
                    heads[first] += 1
                    counts.update(others)
                if len(counts) + len(heads) >= limit:
                    yield rows()
        yield rows()
        released()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(raw.value)
        for batch in batches:
            words, times = [], []
            for piece, after, n in zip(*(c.to_pylist() for c in batch.columns)):
                for part in vocabulary.parts(f" {piece}" if after else piece)[::2]:
                    found = vocabulary.split.findall(part)
                    words.extend(found)
                    times.extend([n] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["word", "n"])
        released()

    counted = texts.select("text").mapInArrow(pieces, "piece string, after boolean, n bigint").groupBy("piece", "after").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(split, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, raw_bytes: bytes, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, `words` at most, and give the file to every executor; returns its name."""
    spark = texts.sparkSession
    raw = spark.sparkContext.broadcast(raw_bytes)
    counts = stored(word_counts(texts.filter(F.col("text") != ""), raw), "words")
    top = counts.filter(size_step("n") >= most(counts, "n", words)).select("word").collect()
    vocabulary = Vocabulary(raw_bytes)
    lexicon = {(w := row["word"].encode()): vocabulary.merge(w) for row in top if len(row["word"]) <= SHORT}
    return shared_file(spark, compile_lexicon(lexicon), "lexicon")


Finish = Callable[[Vocabulary, list[int]], tuple]


def encoded(docs: DataFrame, path: str, keep: Sequence[str], finish: Finish, schema: str, words: int = LEXICON_WORDS) -> DataFrame:
    """Columns `keep` of each document and what `finish(vocabulary, ids)` makes of its ids, as the columns of `schema`.

    Every whole text is encoded with special tokens recognised and none added; null counts as empty and has no ids.  Rows
    are taken as they are, repeated ones too; an empty table gives an empty result.  `path` is read on the driver; the file's
    bytes (its size is fixed) and the lexicon (at most `words` words) go to the workers.
    """
    spark = shipped(docs.sparkSession)
    with open(path, "rb") as file:
        raw_bytes = file.read()
    name = build_lexicon(docs.select("text"), raw_bytes, words)
    raw = spark.sparkContext.broadcast(raw_bytes)
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    fields = [*kept.drop("_text").schema.fields]
    added = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(added)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(raw.value, name)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = part.column(part.num_columns - 1).to_pylist()
                made = [finish(encoder.vocabulary, ids) for ids in encoder.encode_all(texts)]
                columns = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *arrow.names])
        released()

    return kept.mapInArrow(encode, StructType([*fields, *added.fields]))


def digests(vocabulary: Vocabulary, ids: list[int]) -> tuple:
    """Number of ids, digest of the ids, digest of the text that they decode to."""
    ids = np.frombuffer(array("I", ids), np.uint32)
    data = ids.astype("<u4", copy=False).tobytes()
    text = vocabulary.text(ids).encode("utf-8", "surrogatepass")
    return len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text).hexdigest()


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with `text`, decoded from an array of ids; null stays null."""
    spark = shipped(rows.sparkSession)
    with open(path, "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decode(column):
        vocabulary = _loaded(raw.value)
        return column.map(lambda x: None if x is None else vocabulary.text(x))

    return rows.withColumn("text", decode(ids))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    docs = table(spark, folder, "documents")
    return encoded(docs, tokenizer_path(), ["doc_id"], digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, ready for packing."""
    return encoded(docs, tokenizer_path(), ["doc_id"], lambda _, ids: (len(ids), ids), "n_tokens bigint, ids array<int>")
