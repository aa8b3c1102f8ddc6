"""Repeated strings, vector codes and periodic runs against brute force on small rows of every odd kind."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import periodic_runs, resident_codes, suffix_runs
from jobweave.llm.common import word_hashes

from .conftest import WORDS

FOLDER = "/root/testdata/sf0.001"

# ------------------------------------------------------------------------------------------------ repeated strings


def without_repeats(texts, length):
    """(bytes, removed, spans, kept) of each text by comparing all strings."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def assert_repeats(spark, rows, length=400, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumn("core", F.lit("own")).withColumn("k1", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("bytes", F.lit(None))
    got = suffix_runs.deduplicated(docs, length, **how).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter((i, *e) for (i, _), e in zip(rows, without_repeats([t for _, t in rows], length)))


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(["alpha", "beta", "gamma", "straße", "日本", "x", "of", "the"]) + str(draw.randint(0, 400)) for _ in range(n))


def test_repeated_strings_of_odd_rows(spark, odd_rows):
    passage = prose(1, 90)
    own = [(100 + i, prose(10 + i, 60) + passage + prose(50 + i, 30)) for i in range(5)]
    exact = [(200, "q" * 399), (201, "q" * 399), (202, "z" * 400), (203, "y" + "z" * 400), (204, "ab" * 500), (205, "k" * 401)]
    text = prose(2, 400)
    twice = [(300, text[:1500] + text[:900]), (300, text[:1500] + text[:900]), (None, text), (None, None)]
    assert_repeats(spark, [(i, t) for i, t, _ in odd_rows] + own + exact + twice)
    assert_repeats(spark, [])


def test_later_rounds_take_the_strings_of_large_groups_only(spark, monkeypatch):
    """Bytes that a round reads: whole texts in the first one, stretches around the shared passage afterwards."""
    passage, taken, places_of = prose(1, 70), [], suffix_runs.places_of
    rows = [(i, prose(10 + i, 900) + passage + prose(50 + i, 900)) for i in range(8)]

    def counted(docs, *more):
        taken.append(docs.agg(F.sum(F.octet_length("bytes"))).first()[0])
        return places_of(docs, *more)

    monkeypatch.setattr(suffix_runs, "places_of", counted)
    assert_repeats(spark, rows, group=1)
    assert len(taken) == 6 and taken[0] == taken[1] == sum(len(t.encode()) for _, t in rows)
    assert all(n < 8 * (len(passage.encode()) + 800) for n in taken[2:])


@pytest.mark.parametrize("group", [1, 3, 2000])
def test_near_copies_need_every_width(spark, group):
    """Groups of many different contexts are done again with smaller widths, with the same result."""
    draw, base = random.Random(3), prose(4, 70)
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = draw.choice("abcdefgh#")
        rows.append((i, "".join(text)[draw.randint(0, 30) :]))
    assert_repeats(spark, rows, 120, widths=(60, 10, 1), group=group)
    assert_repeats(spark, rows[:12], 120, widths=(60, 1), group=group, limit=0)


def test_loser_tree_merges_front_coded_runs():
    draw = random.Random(9)
    for runs in (1, 2, 3, 7, 8):
        lists = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 30))) for _ in range(runs)]
        coded = [suffix_runs.front_coded(own) if own else (np.zeros(0, np.uint16), np.zeros(0, np.uint16), b"") for own in lists]
        assert [[s for s, _ in suffix_runs.decoded(*c)] for c in coded] == lists
        out = list(suffix_runs.merged([suffix_runs.decoded(*c) for c in coded]))
        strings = [s for _, s, _ in out]
        assert strings == sorted(s for own in lists for s in own)
        assert [n for *_, n in out][1:] == [suffix_runs.common(a, b) for a, b in zip(strings, strings[1:])]
        for run, own in enumerate(lists):
            assert [s for r, s, _ in out if r == run] == own


def test_equal_strings_name_equal_places():
    data = np.frombuffer((prose(7, 300) + "#" + prose(7, 300)).encode(), np.uint8)
    half = (len(data) - 1) // 2
    place, first, last = suffix_runs.named(data, np.arange(len(data) - 399), 200)
    names = {start: p - start for p, a, b in zip(place, first, last) for start in range(a, b + 1)}
    assert len(names) == len(data) - 399 and all(0 <= d < 200 for d in names.values())
    assert all(names[i] == names[i + half + 1] for i in range(half - 400))


# ------------------------------------------------------------------------------------------------ vector codes


def lloyd(rows, entries=256, rounds=4):
    """(vec_id, label, codes, error) and codebooks by comparing every part with every entry."""
    good = [(i, label, [float(np.float32(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    if not good:
        return [], []
    x = np.floor(1024 * np.array([v for *_, v in good])).astype(np.int64).reshape(len(good), 4, -1)
    books = [x[:entries, p].copy() for p in range(4)]
    for turn in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        best = [m.argmin(axis=1) for m in d]
        for p in range(4 if turn < rounds else 0):
            for e in set(best[p].tolist()):
                own = x[best[p] == e, p]
                books[p][e] = own.sum(axis=0) // len(own)
    error = sum(m.min(axis=1) for m in d)
    return [(r[0], r[1], [int(b[i]) for b in best], int(error[i])) for i, r in enumerate(good)], books


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    for name in ("row", "v", "position", "entry", "moved", "n"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame


def odd_vectors(n):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(i % 3, 0.4) for _ in range(8)], draw.choice([0, 1, None])) for i in range(n)]
    rows += [(1000 + i, [0.25] * 8, 7) for i in range(60)] + [rows[0], rows[0], (None, rows[3][1], None)]
    return rows + [(2000, None, 1), (2001, [None] + [0.5] * 7, 1), (2002, [float("nan")] * 8, None), (2003, [float("-inf")] + [1.0] * 7, 2)]


@pytest.mark.parametrize("n, entries", [(0, 256), (40, 256), (90, 16)])
def test_codes_of_odd_vectors(spark, n, entries, monkeypatch):
    monkeypatch.setattr(resident_codes, "MEMBERS", 10)
    rows = odd_vectors(n) if n else [(1, None, 0)]
    got, books = resident_codes.coded(vectors(spark, rows), entries=entries)
    expected, want = lloyd(rows, entries)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    assert sorted([(r.vec_id, r.label, list(r.codes), r.error) for r in got.collect()], key=key) == sorted(expected, key=key)
    assert [b.tolist() for b in books if len(b)] == [b.tolist() for b in want]


def test_odd_lengths_and_large_components(spark):
    rows = [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0), (3, [], 0), (4, [3e38, -3e38, 1.0, 2.0], 0), (5, [2.0] * 4, None)]
    got, _ = resident_codes.coded(vectors(spark, rows))
    assert sorted((r.vec_id, list(r.codes), r.error) for r in got.collect()) == [(1, [0, 0, 0, 0], 0), (4, [1, 1, 0, 1], 0), (5, [2, 2, 2, 1], 0)]
    big = np.array([[1 << 26, -(1 << 26)], [0, 0]])
    best, error = resident_codes.nearest(big, np.array([[-(1 << 26), 1 << 26], [0, 1]]))
    assert best.tolist() == [1, 1] and error.tolist() == [(1 << 52) + ((1 << 26) + 1) ** 2, 1]


def test_only_changing_parts_move(spark, monkeypatch):
    """After the first round the shuffle holds only parts whose entry changed."""
    moved, arrive = [], resident_codes._settled

    def watched(state, books, path):
        before = {(r.row, r.position): r.entry for r in state.select("row", "position", "entry").collect()}
        out = arrive(state, books, path)
        after = {(r.row, r.position): r.entry for r in out.select("row", "position", "entry").collect()}
        changed = sum(before[k] != after[k] for k in after)
        try:
            arrived = spark.read.parquet(f"{path}/arrived").count()
        except Exception:  # nothing moved, nothing written
            arrived = 0
        moved.append((changed, arrived))
        return out

    monkeypatch.setattr(resident_codes, "_settled", watched)
    resident_codes.coded(vectors(spark, odd_vectors(60)), entries=8)
    assert all(a == b for a, b in moved) and moved[0][0] > moved[-1][0]


# ------------------------------------------------------------------------------------------------ periodic runs


def runs_of(words):
    """Every run of a list of words, by comparing the words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size, run = j - i + q, words[i : j + q]
            if j > i and size >= max(24, 3 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(300):
        words = []
        for _ in range(draw.randint(1, 6)):
            unit = [b"%d" % draw.randint(0, draw.choice([1, 2, 5, 40])) for _ in range(draw.randint(1, 30))]
            words += (unit * 6)[: draw.randint(1, 6 * len(unit))]
        hashes, first, *_ = word_hashes([b" ".join(words), b"a b c", b" ".join(words[::-1])])
        got = periodic_runs.periodic_runs(hashes, np.repeat(np.arange(3), np.diff(first)), 3)
        assert got == [runs_of(words), [], runs_of(words[::-1])]


def test_collapsed_documents(make_docs, odd_rows):
    phrase = " ".join(f"w{i % 7}" for i in range(60))
    more = [(400, phrase, "p"), (401, f"start {phrase}\n{phrase}\tend", "p"), (402, "la " * 24, "p"), (403, "la " * 23, "p"), (None, "na " * 40, "p"), (404, "  " * 30, "p")]
    rows = odd_rows + more
    for plant in (False, True):
        got = periodic_runs.collapsed(make_docs(rows), plant=plant).collect()
        expected = []
        for doc_id, text, _ in rows:
            words = [w.encode() for w in WORDS.findall(text or "")]
            h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and plant else 1
            if h % 10 == 0 and words:
                n, g = len(words), h // 10
                a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            runs = runs_of(words) if len(words) < 2000 else None
            if runs is None:
                continue
            gone = {i for s, size, q in runs for i in range(s + q, s + size)}
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
            left = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
            expected.append((doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], tuple(runs), left))
        have = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, tuple(map(tuple, r.runs)), r.text) for r in got if r.doc_id != 4]
        assert Counter(have) == Counter(expected)
    assert periodic_runs.collapsed(make_docs([])).count() == 0


def test_longest_text_and_one_word(make_docs):
    long = " ".join(["same"] * 50_000)
    mixed = " ".join(f"word{i % 997}" for i in range(30_000))
    got = {r.doc_id: r for r in periodic_runs.collapsed(make_docs([(1, long, "a"), (2, mixed, "a")])).collect()}
    assert (got[1].n_runs, got[1].length, got[1].period, got[1].text) == (1, 50_000, 1, "same")
    assert (got[2].n_runs, got[2].length, got[2].period) == (1, 30_000, 997)


# ------------------------------------------------------------------------------------------------ queries


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_queries_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in suffix_runs.query(spark, FOLDER).collect()}
    assert got == {i: (*e[:3], hashlib.sha256(e[3]).hexdigest()) for i, e in zip(docs, without_repeats(docs.values(), 400))}
    for r in periodic_runs.query(spark, FOLDER).collect():
        words = [w.encode() for w in WORDS.findall(docs[r.doc_id] or "")]
        h = zlib.crc32(str(r.doc_id).encode())
        if len(words) > 700:
            continue
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
