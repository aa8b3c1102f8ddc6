"""Operators against brute force, exact round trips and held-out accuracy."""

import functools
import gzip
import itertools
import math
import os
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobweave.llm import bpe_lexicon, chat_windows, common, ctw, host_rules, html_extract, line_dedup, setsketch, templates, toxicity, warc_zip

from .conftest import low, sha, words

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


# ------------------------------------------------------------------------------------------------ words

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x1c .", max_size=30), min_size=1, max_size=6))
def test_word_hashes(texts):
    encoded = [common.lowered(t) for t in texts]
    hashes, first, *_ = common.word_hashes(encoded)
    found = [words(low(t)) for t in texts]
    assert list(np.diff(first)) == [len(w) for w in found]
    by_word = {w: int(h) for w, h in zip(itertools.chain(*found), hashes)}
    assert [by_word[w] for w in itertools.chain(*found)] == [int(h) for h in hashes]
    assert len(set(by_word.values())) == len(by_word)


def test_attach_shuffles_as_it_broadcasts(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS key")
    lookup = rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "concat('v', key) AS v").filter("key <> 'k7'")
    small = common.attach(rows, lookup, "key", "n", ["id"]).collect()
    large = common.attach(rows, lookup, "key", "n", ["id"], limit=0, target=100).collect()
    assert sorted(small, key=str) == sorted(large, key=str) and len(small) == 3000


# ------------------------------------------------------------------------------------------------ 1

def brute_tree(texts, depth, least=1):
    """Counts of (context, decision) kept in dictionaries; weighted probabilities by recursion."""
    counts, children, pad = defaultdict(lambda: [0, 0]), defaultdict(set), bytes([ctw.END])
    for text in texts:
        data = pad * depth + text + pad
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = data[i - d : i]
                if d:
                    children[context[1:]].add(context)
                node = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts[context, node][bit] += 1
                    node = 2 * node + bit

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def kept(context):
        return sum(counts[context, 1]) >= least

    def rest(context, node):
        left = [counts[c, node] for c in children[context] if not kept(c)]
        return sum(a for a, _ in left), sum(b for _, b in left)

    @functools.cache
    def weighted(context, node):
        own = kt(*counts[context, node])
        if len(context) == depth:
            return own
        below = kt(*rest(context, node)) + sum(weighted(c, node) for c in children[context] if kept(c))
        return math.log(0.5) + np.logaddexp(own, below)

    def chance(data, i, node, d=0):
        context = data[i - d : i]
        a, b = counts[context, node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        share = math.exp(math.log(0.5) + kt(a, b) - weighted(context, node))
        longer = data[i - d - 1 : i]
        if longer in children[context] and kept(longer):
            more = chance(data, i, node, d + 1)
        else:
            zeros, ones = rest(context, node)
            more = (ones + 0.5) / (zeros + ones + 1)
        return share * own + (1 - share) * more

    def score(text):
        data, total = pad * depth + text + pad, 0.0
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                p = chance(data, i, node)
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        return total

    return score


def local_prices(texts, codes, depth, least):
    """Prices of runs from a model of the texts, all subtrees in one piece."""
    seen, n = np.unique(ctw.grams(texts, depth)[0], return_counts=True)
    names = np.union1d(seen, codes)
    times = np.zeros(len(names), np.int64)
    times[np.searchsorted(names, seen)] = n
    top = ctw.top_of(*ctw.subtrees(names, times, depth, least)[0].shorter(), depth, least)
    return ctw.prices(names, times, top, depth, least)[np.searchsorted(names, codes)]


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
@pytest.mark.parametrize("least", [1, 2, 3, 50])
def test_tree_is_context_tree_weighting(depth, least):
    texts = [b"abracadabra", b"abba cadabra", b"", b"banana ban"]
    score = brute_tree(texts, depth, least)
    trial = [b"abra", b"", b"banana", b"cab cab ab", b"zebra\xc3\xa4 abracax"]
    codes, start = ctw.grams(trial, depth)
    sums = np.add.reduceat(local_prices(texts, codes, depth, least), start[:-1])
    assert np.allclose(sums, [score(t) for t in trial], atol=1e-6)


@pytest.mark.parametrize("context", [b"the", b"dog", b"xyz", b"xhe"])
def test_prices_of_a_context_sum_to_one(context):
    codes = np.array([context[2] << 24 | context[1] << 16 | context[0] << 8 | byte for byte in range(256)])
    assert (10 ** local_prices([b"the cat and the dog", b"a dog"], codes, 3, 2)).sum() == pytest.approx(1)


def test_rare_runs_are_joined(spark, make_docs, monkeypatch):
    """Any share of runs and words in the broadcast, and any cut into tasks and slices, gives the score of the brute-force tree."""
    rng = random.Random(5)
    texts = {i: "".join(rng.choices("abcd eé", k=rng.randrange(60))) for i in range(40)}
    docs = make_docs([(i, t, "s") for i, t in texts.items()])
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    score = brute_tree([t.encode() for i, t in texts.items() if not out[i]], 4, 2)
    right = {i: score(t.encode()) for i, t in texts.items()}
    for options, task, piece in (({}, 1 << 19, 1 << 16), ({"frequent_runs": 60, "frequent_words": 3}, 200, 16), ({"frequent_runs": 0, "frequent_words": 0}, 50, 1)):
        monkeypatch.setattr(ctw, "TASK_RUNS", task)
        monkeypatch.setattr(ctw, "SLICE_RUNS", piece)
        rows = ctw.scored(docs, depth=4, least=2, **options).collect()
        assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(right)
        for r in rows:
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
            assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / (r["n_bytes"] + 1))


@needs_data
def test_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    tokens = {i: [*words(low(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(itertools.chain.from_iterable(t for i, t in tokens.items() if not held[i]))
    n, v = sum(counts.values()), len(counts)
    for rows in (ctw.scored(docs).collect(), ctw.scored(docs, frequent_words=50, frequent_runs=5000).collect()):
        for r in rows:
            own = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(own), n, held[r["doc_id"]])
            assert r["n_known"] == sum(counts[w] > 0 for w in own)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        out_of_sample = [r for r in rows if r["held_out"]]
        assert -sum(r["score"] for r in out_of_sample) * math.log2(10) / sum(r["n_bytes"] + 1 for r in out_of_sample) < 2.4


# ------------------------------------------------------------------------------------------------ 2

def test_extraction_on_held_out_pages():
    model, writer, right, total = html_extract.train(html_extract.labelled_pages()), html_extract.Writer(4711), 0, 0
    for _ in range(300):
        page, states = html_extract.parse(writer.page()), []
        for node in page.nodes:
            above = states[node.parent] if node.parent >= 0 else 0
            states.append(above if node.label is None else node.label)
        share = html_extract.marginals(model, page)
        for i, _ in page.texts():
            right, total = right + ((share[i] > 0.5) == bool(states[i])), total + 1
    assert right / total > 0.97


def test_messages_are_exact():
    """Marginals of small trees against the sum over all assignments."""
    model = html_extract.train(html_extract.labelled_pages(200))
    html = '<body><div class="menu"><a href=x>Home</a></div><div id="content"><p>Some words here.</p><div class="ad">Buy it</div></div>'
    page = html_extract.parse(html)
    nodes = page.nodes
    assert len(nodes) <= 10
    sums, total = np.zeros(len(nodes)), 0.0
    for states in itertools.product(range(3), repeat=len(nodes)):
        weight = model.root[states[0]]
        for i, node in enumerate(nodes):
            if i:
                weight *= model.follow[html_extract.kind(node)][states[node.parent]][states[i]]
                for name in html_extract.features(node):
                    weight *= model.evidence.get(name, (1, 1, 1))[states[i]]
        total += weight
        sums += weight * (np.array(states) == html_extract.CONTENT)
    assert np.allclose(html_extract.marginals(model, page), sums / total, atol=1e-6)


def test_extraction_keeps_the_article_only():
    model = html_extract.train(html_extract.labelled_pages())
    html = """<html><head><title>T &amp; t</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body><header><p>Site name</p></header>
      <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept them all.</p></div>
      <main><article><h1>Head &lt;1&gt;</h1><p>First  <b>bold</b>
      text.<div class="ad">Buy this wonderful thing now.</div><p>Short<p>Line<br>two</article></main>
      <section id="comments"><article class="comment"><p>I liked this article very much, thank you.</p></article></section>
      <aside><p>Read this other long story about other things.</p></aside><form><label>Mail</label><input><button>Send</button></form>
      <footer><p>All rights reserved.</p></footer>"""
    assert html_extract.extract(model, html) == "Head <1>\nFirst bold text.\nShort\nLine two"


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<html><head><meta charset=utf-8><title>T</title><article><p>All of it.</article>", ["All of it."]),
        ("<head><link rel=x> <title>T</title> Bare words.<p>More.", ["Bare words.", "More."]),
        ("<body><div><svg><path d=x><text>label</div><p>After.</p><svg><p>shape</p></svg><p>End.", ["After.", "End."]),
        ("<p>Pick <select><option>one<option>two<div>After.</div><video src=x>no video<main>End.", ["Pick", "After.", "End."]),
        ("<p>Seen <object data=x><p>unseen</p></object> again</p>", ["Seen again"]),
        ("<p>Now 3 < 5 and 7 < 9 euros", ["Now 3 < 5 and 7 < 9 euros"]),
        ("<p>5 > 3 and 2 < 4 <a href='x", ["5 > 3 and 2 < 4"]),
    ],
)
def test_left_out_end_tags_hide_nothing(html, texts):
    assert [node.text for _, node in html_extract.parse(html).texts()] == texts


@pytest.mark.parametrize("part", ["<svg>", "<svg><p>", "<select><option>", "<head>", "<a href='x>", "<div>", "<p>", "<li>", "<", "<!--", "</div>", '<a "', "<ul><li>", "<td>"])
def test_broken_markup_takes_linear_time(part):
    model = html_extract.Model({}, {})
    html_extract.extract(model, part * 30_000 + "x")


# ------------------------------------------------------------------------------------------------ 3

def test_template_finds_other_values(spark, make_docs):
    item = "A train travels 60 km in 2 hours and then 90 km in 3 hours so how far did Anna and Bert get in total"
    same = "Intro words. A train travels 75 km in 4 hours, and then 20 km in 9 hours; so how far did Carla and Dirk get in total? End."
    broken = item.replace("Anna", "Carla").replace("Bert", "Carla")
    other = "A train travels fast and nobody knows in how many hours it gets to the next town where Anna lives"
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    docs = make_docs([(1, same, "a"), (2, broken, "a"), (3, other, "a"), (4, item.upper(), "a"), (5, f"and {item.lower()} end", "a"), (6, None, "a")])
    found = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(docs, items).collect()}
    assert set(found) == {(1, 7), (2, 7), (4, 7), (5, 7)}
    assert {r["covered_tokens"] for r in found.values()} == {r["item_tokens"] for r in found.values()} == {len(item.split())}
    assert found[1, 7]["n_slots"] >= 4
    assert {tuple(r) for r in templates.contaminated(docs, items, block_rows=3).collect()} == {tuple(r) for r in found.values()}
    assert {(r["doc_id"], r["item_id"], r["item_tokens"], r["covered_tokens"]) for r in found.values()} == brute_contaminated(dict(docs.select("doc_id", "text").collect()), {7: item})


def brute_contaminated(texts, items, window=8):
    """Windows of templates compared one by one, written without the operator's steps."""

    def read(text):
        kept = "".join(c for c in text or "" if c.isalpha() or c.isnumeric() or c in ".!?" or c in " \t\n\x0b\x0c\r")
        raw = [w for w in words(kept) if w.strip(".!?")]
        bare = [w.strip(".!?") for w in raw]
        core = [w.lower() for w in bare]
        number = [w[0] in "0123456789" for w in core]
        plain = ["<num>" if number[i] else "<unit>" if i and number[i - 1] and w in templates.UNITS else w for i, w in enumerate(core)]
        capital = [w[0] != w[0].lower() for w in bare]
        canon = [p if p[0] == "<" or not (capital[i] and i and raw[i - 1][-1] not in ".!?") else "<name>" for i, p in enumerate(plain)]
        return core, plain, canon, ["<name>"] + canon[1:] if capital and capital[0] else canon

    found, parsed = set(), {d: read(t) for d, t in texts.items()}
    for item, text in items.items():
        core, plain, canon, lead = read(text)
        size = min(window, len(core))
        wanted = defaultdict(set)
        for at in range(len(core) - size + 1 if core else 0):
            for kind, form in (("plain", plain), ("canon", canon), ("canon", lead)):
                wanted[kind, tuple(form[at:at + size])].add(at)
        for doc, (said, *forms, _) in parsed.items():
            covers = set()
            for kind, form in zip(("plain", "canon"), forms):
                for pos in range(len(said) - size + 1):
                    seen = tuple(form[pos:pos + size])
                    for at in wanted.get((kind, seen), ()):
                        pairs = [(t, core[at + k], said[pos + k]) for k, t in enumerate(seen) if t[0] == "<"]
                        if len({p[:2] for p in pairs}) == len(set(pairs)) and (size - len(pairs) >= 3 or all(a == s for _, a, s in pairs)):
                            covers |= set(range(at, at + size))
            if len(covers) >= 13 and 2 * len(covers) >= len(core) or covers and len(covers) == len(core):
                found.add((doc, item, len(core), len(covers)))
    return found


def test_template_windows_need_words(spark, make_docs):
    items = spark.createDataFrame([(1, "5"), (2, "Paris London"), (3, "Anna 3"), (4, "Which is larger"), (5, "What is 5 plus 7 when Bob counts apples and pears"), (6, "in 1990")], "item_id bigint, text string")
    texts = [
        (1, "Karl 7 was there in 1987 with Berta Huber.", "a"), (2, "he asked: Which is larger", "a"), (3, "WHAT IS 8 PLUS 9 WHEN BOB COUNTS APPLES AND PEARS", "a"),
        (4, "from paris london is far", "a"), (5, "only 5 of them", "a"), (6, "it was in 1990", "a"),
    ]
    docs = make_docs(texts)
    found = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(docs, items).collect()}
    assert found == {(2, 4), (3, 5), (4, 2), (5, 1), (6, 6)}


def test_template_large_benchmark_sends_hashes(spark, make_docs, monkeypatch):
    """Many windows: one pass over the documents, the broadcast holds nothing but hashes, and the pairs are the same."""
    items = spark.createDataFrame([(i, f"A train number {i} travels 60 km in 2 hours and then Anna and Bert walk 9 miles to town {i % 5} and back") for i in range(30)], "item_id bigint, text string")
    rows = [(i, f"Intro. A train number {i} travels 75 km in 4 hours and then Carla and Dirk walk 7 miles to town {i} and back", "a") for i in range(8)]
    docs = make_docs([*rows, (100, "Which is larger", "a"), (101, None, "a")])
    few = templates.contaminated(docs, items)
    many = templates.contaminated(docs, items, block_rows=10)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() > 30
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == few._jdf.queryExecution().optimizedPlan().toString().count("Generate")
    assert plan.count("strategy=broadcast") == plan.count("LeftSemi") == 1
    monkeypatch.setattr(templates, "KEY_ROWS", 7)
    assert sorted(map(tuple, templates.contaminated(docs, items, block_rows=10).collect())) == sorted(map(tuple, few.collect()))


@needs_data
def test_template_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    cut = items.selectExpr("item_id + 100000 AS item_id", "array_join(slice(split(text, ' '), 3, 5), ' ') AS text").unionByName(items.select("item_id", "text"))
    got = {(r["doc_id"], r["item_id"], r["item_tokens"], r["covered_tokens"]) for r in templates.contaminated(docs, cut).collect()}
    want = brute_contaminated(dict(docs.select("doc_id", "text").collect()), dict(cut.select("item_id", "text").collect()))
    assert got == want and got


def test_template_finds_short_items_and_joined_values(spark, make_docs):
    items = [(1, "Anna has 3 apples and buys 2 more pears"), (2, "What is the height"), (3, "A cart drives 60 km in the morning and then one more long way of 90 km in the evening")]
    texts = [
        (1, "Question: Carla has 5 apples and buys 7 more pears. End.", "a"), (2, "Question: What is the height of it", "a"),
        (3, "It says: A cart drives 75 km in the morning and then one more long way of 75 km in the evening.", "a"),
        (4, "Carla had 5 apples, and what was the height? A cart drove 75 km in the morning.", "a"),
    ]
    items, docs = spark.createDataFrame(items, "item_id bigint, text string"), make_docs(texts)
    found = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert all(r["covered_tokens"] == r["item_tokens"] for r in found.values())


def test_stage_drops_any_case(spark, make_docs, tmp_path):
    item = "A train travels 60 km in 2 hours and then 90 km in 3 hours so how far did Anna and Bert get in total"
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([(1, item.upper(), "a"), (2, "Other words of a text that is kept.", "a")])
    assert [r["doc_id"] for r in templates.stage(spark, docs, str(tmp_path)).collect()] == [2]


# ------------------------------------------------------------------------------------------------ 4

@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe_lexicon.tokenizer_path(), "rb") as file:
        return bpe_lexicon.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_lexicon.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tabtheing'sS1½é<|endoftext|>", max_size=80))
def test_encoding_equals_the_library(vocabulary, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe_lexicon.Encoder(vocabulary, None).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.text(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_special_and_long_words(vocabulary, library):
    rng = random.Random(1)
    texts = ["a<|endoftext|><|endoftext|> b<|endof", "x" * 3000, "".join(rng.choice("theabcing") for _ in range(5000))]
    for text in texts:
        assert bpe_lexicon.Encoder(vocabulary, None).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact(tmp_path):
    plain = [b"", b"a", b"walking", b"talking", b"walked", b"talked", b"walks", b"\xff\x00", b"baking"]
    known = {w: (i, len(w)) for i, w in enumerate(plain)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe_lexicon.compile_lexicon(known))
    lexicon = bpe_lexicon.Lexicon.open(str(path))
    assert all(lexicon.find(w) == ids for w, ids in known.items())
    assert [lexicon.find(w) for w in (b"walk", b"talkings", b"b", b"\x00")] == [None] * 4
    right = {w: frozenset(x[len(w):] for x in plain if x.startswith(w)) for x in plain for w in (x[:i] for i in range(len(x) + 1))}
    assert len(lexicon.ends) == len(set(right.values()))


def test_encoder_forgets_rare_words_only(vocabulary):
    encoder = bpe_lexicon.Encoder(vocabulary, bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon({b" the": vocabulary.merge(b" the")})), limit=2)
    for word in ("zzxq", "qqxz", "xxyy", " the", "yyxx", "zyzy"):
        assert encoder.encode(word) == list(vocabulary.merge(word.encode()))
    assert " the" in encoder and len(encoder) <= 3


def test_words_are_merged_alike_in_any_company(vocabulary):
    rng = random.Random(4)
    plain = ["".join(rng.choice("theaingor é½") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    one_by_one = [vocabulary.merge(w) for w in plain]
    assert vocabulary.merge_all(plain) == one_by_one
    assert [tuple(vocabulary._merge_long([vocabulary.byte_ids[b] for b in w])) for w in plain] == one_by_one
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon(dict(zip(plain[::2], one_by_one[::2]))))
    assert lexicon.find_all([*plain, b"", b"zz"]) == [lexicon.find(w) for w in [*plain, b"", b"zz"]]


def test_word_counts(spark):
    texts = ["the cat. The cat's 12 cats", "a\nb the", "", "the"]
    with open(bpe_lexicon.tokenizer_path(), "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())
    rows = bpe_lexicon.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"), raw, limit=2).collect()
    split = bpe_lexicon.Vocabulary(raw.value).split
    assert {r["word"]: r["n"] for r in rows} == Counter(w for t in texts for w in split.findall(t))


@needs_data
def test_encoding_of_documents(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in bpe_lexicon.query(spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == sha(texts[r["doc_id"]] or "")
    made = bpe_lexicon.encoded(docs, bpe_lexicon.tokenizer_path(), ["doc_id"], lambda _, ids: (ids,), "ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe_lexicon.decoded(made, bpe_lexicon.tokenizer_path()).collect()} == texts


# ------------------------------------------------------------------------------------------------ 5

def test_measures(make_docs):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice("ab|c# d$e".split() + ["ä" * rng.randint(1, 3)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts.append(" ".join(["one two three four five six seven eight nine"] * 3))
    rows = {r["doc_id"]: r for r in host_rules.measured(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        own, r = words(text), rows[i]
        runs = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
        again = {k + j for k in range(len(own) - 7) for j in range(8) if runs[tuple(own[k : k + 8])] > 1}
        lines = [line for line in text.split("\n") if words(line)]
        want = (len(own), sum(map(len, own)), sum(c in host_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in host_rules.MEASURES) == want


def test_bad_hosts_lose_all_documents(make_docs):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "bad", "spam") for i in range(200)] + [(1000 + i, "bad" if i % 10 == 0 else good, f"h{i % 5}") for i in range(200)]
    rows += [(5000, "bad", "tiny"), (5001, good, None)]
    kept = {r["doc_id"] for r in host_rules.judged(make_docs(rows)).filter("kept").collect()}
    assert kept == {i for i, t, s in rows if t == good and s != "spam"}


# ------------------------------------------------------------------------------------------------ 6

def brute_lines(texts):
    key = lambda line: low(line.strip(common.SPACES))
    owners = defaultdict(set)
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                owners[key(line)].add(i)
    out = {}
    for i, text in texts.items():
        lines = (text or "").split("\n")
        out[i] = "\n".join(line for line in lines if len(owners[key(line)]) < 5 or max(owners[key(line)]) == i)
    return out


def test_line_index_is_reversible(spark, make_docs, tmp_path):
    rng = random.Random(6)
    pool = [f"line number {k} of the pool that is long enough to count as a key {k * k}" for k in range(8)]
    texts = {i: "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else f" {rng.choice(pool)}\t" if rng.random() < 0.7 else f"short {rng.random()}" for _ in range(4)) for i in range(40)}
    docs = make_docs([(i, t, "s") for i, t in texts.items()])
    clean = lambda index, rows: {r["doc_id"]: r["text"] for r in index.clean(rows).collect()}
    index = line_dedup.LineIndex(spark, f"{tmp_path}/lines", shards=3).insert(docs.filter("doc_id < 25")).insert(docs.filter("doc_id >= 20"))
    assert clean(index, docs) == brute_lines(texts)
    index.delete(docs.filter("doc_id % 3 = 0 OR doc_id > 35"))
    left = docs.filter("NOT (doc_id % 3 = 0 OR doc_id > 35)")
    rest = {i: t for i, t in texts.items() if not (i % 3 == 0 or i > 35)}
    assert clean(index, left) == brute_lines(rest)
    index.delete(left.filter("doc_id > 4"))
    few = {i: t for i, t in rest.items() if i <= 4}
    assert clean(index, left.filter("doc_id <= 4")) == brute_lines(few) == few
    index.insert(docs.filter("doc_id > 4 OR doc_id % 3 = 0"))
    assert clean(index, docs) == brute_lines(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 333, 2000])
def test_cuckoo_filter(n):
    rng = random.Random(n)
    keys = [rng.randbytes(16) for _ in range(n)]
    data = line_dedup.changed_filter(None, [], keys, [])
    held = line_dedup.CuckooFilter.read(data)
    assert held.may_have(b"".join(keys)).all()
    gone, left = keys[: n // 2], keys[n // 2 :]
    held = line_dedup.CuckooFilter.read(line_dedup.changed_filter(data, left, [], gone))
    assert held.may_have(b"".join(left)).all() if left else True
    strangers = b"".join(rng.randbytes(16) for _ in range(2000))
    assert held.may_have(strangers).mean() < 0.02
    more = [rng.randbytes(16) for _ in range(3 * n)]
    grown = line_dedup.CuckooFilter.read(line_dedup.changed_filter(held.bytes(), left, more, []))
    assert grown.may_have(b"".join([*left, *more])).all()


# ------------------------------------------------------------------------------------------------ 7

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a<|\\>im_end\n", max_size=40), st.text(alphabet="ab\\n\n<|", max_size=12))
def test_escapes(text, role):
    assert chat_windows.unescape(chat_windows.escape(text)) == text and "<|" not in chat_windows.escape(text)
    shown = chat_windows.Turn(role, text, 1).shown()
    assert chat_windows.read_turns(shown) == [(role, text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.text(alphabet="ab <|", max_size=60)), min_size=1, max_size=25), st.integers(5, 60), st.integers(0, 30))
def test_windows(turns, budget, history):
    made = list(chat_windows.cut(turns, budget, history))
    assert [(t.role, t.text) for w in made for t in w.fresh] == turns
    system = turns[0] if turns[0][0] == "system" else None
    done = 0
    for i, w in enumerate(made):
        total = sum(t.tokens for t in [*w.context, *w.fresh])
        base = sum(t.tokens for t in w.context) if i else 0
        assert total <= budget or len(w.fresh) == 1 and (not w.context or w.context[0].role == "system" and len(w.context) == 1)
        if i:
            own = w.context[1:] if system else w.context
            assert not system or (w.context[0].role, w.context[0].text) == system
            before = turns[1 if system else 0 : done]
            assert [(t.role, t.text) for t in own] == before[len(before) - len(own) :]
            assert sum(t.tokens for t in own) <= history and base >= 0
        done += len(w.fresh)


@needs_data
def test_conversations(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r["conv_id"]].append((r["role"], r["text"] or ""))
    tricky = "<|im_end|><|im_start|>assistant ok"
    by_conv[-1] = [("user", tricky), ("assistant", tricky)]
    found = {r["conv_id"]: r for r in chat_windows.query(spark, FOLDER).collect()}
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))


# ------------------------------------------------------------------------------------------------ 8

def test_gradients():
    rng = np.random.default_rng(3)
    texts = [b"you are bad", b"a good word here", b"x"]
    own, places, first = toxicity.words_and_places(texts)
    windows, _ = toxicity.windows_of(places, first)
    p = {k: x.astype(np.float64) for k, x in toxicity.fresh().items()}
    d_out = rng.normal(size=len(windows))
    vectors, kept = toxicity.inputs(p, own), {}
    toxicity.forward(p, vectors, windows, kept)
    grads = toxicity.backward(p, own, vectors, windows, kept, d_out)
    for name in ("Wf", "Ub", "A", "v", "out", "Bf"):
        spot = tuple(rng.integers(0, n) for n in p[name].shape)
        values = []
        for step in (1e-2, -1e-2):
            p[name][spot] += step
            values.append(float((toxicity.forward(p, toxicity.inputs(p, own), windows) * d_out).sum()))
            p[name][spot] -= step
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(float(grads[name][spot]), abs=2e-3, rel=0.05), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        starts = toxicity.window_starts(n)
        assert set(range(n)) == {s + k for s in starts for k in range(toxicity.WINDOW) if s + k < n}
        assert len(set(starts.tolist())) == len(starts)


def test_network_learns_held_out_texts():
    rng = random.Random(8)
    plain = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(800)]
    bad = ["hateful", "wretch", "vermin", "scoundrel"]

    def text(toxic):
        own = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        for _ in range(max(2, len(own) // 40) if toxic else 0):
            own[rng.randrange(len(own))] = rng.choice(bad)
        return " ".join(own).encode()

    def cut(t):
        own = t.split()
        return [b" ".join(own[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(own))]

    labels = np.array([float(i % 4 == 0) for i in range(800)])
    model = toxicity.train([cut(text(y)) for y in labels], labels, updates=40)
    trial = np.array([float(i % 2) for i in range(200)])
    score = toxicity.score_texts(model, [text(y) for y in trial])
    assert ((score >= 0.7) == trial).mean() > 0.95


def test_calibration_sees_whole_texts_and_each_id_once(spark, make_docs):
    """Passages that no sampled window shows count in the calibration; copies of a labelled row bring one text to the driver."""
    rng = random.Random(3)
    plain, bad = [f"word{i}" for i in range(40)], [f"slur{i}" for i in range(5)]

    def text(toxic):
        own = rng.choices(plain, k=900 if rng.random() < 0.5 else 40)
        at = rng.randrange(len(own))
        return " ".join(own[:at] + rng.choices(bad, k=12) * toxic + own[at:])

    rows = [(i, text(i % 2), "s") for i in range(90)]
    docs = make_docs(rows + [(0, rows[0][1][:50], "s")] * 300 + [(1, None, "s")] * 5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id bigint, toxic int")
    ids, windows, toxic = toxicity.sample(docs, labels, windows=3)
    assert ids == [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1] and max(map(len, windows)) == 3
    model = toxicity.train(windows, toxic, updates=20)
    texts = dict(r[:2] for r in rows)
    judges = [(i, y) for i, y, chosen in zip(ids, toxic, model.judges, strict=True) if chosen]
    top = toxicity.strongest_windows(model, [low(texts[i]).encode() for i, _ in judges])
    right = toxicity.calibrated(model, top, np.array([y for _, y in judges]))
    found = toxicity.judged(docs, model, ids, toxic)
    assert (found.slope, found.offset) == (pytest.approx(right.slope, rel=1e-3), pytest.approx(right.offset, rel=1e-3))


# ------------------------------------------------------------------------------------------------ 9

def test_reader_reads_any_stored_package(tmp_path):
    path = str(tmp_path / "a.zip")
    data = os.urandom(5000)
    with zipfile.ZipFile(path, "w") as package:
        package.comment = b"PK\x05\x06 in a comment is no end"[:0]
        package.writestr("first", b"x" * 10)
        with package.open(zipfile.ZipInfo("long"), "w", force_zip64=True) as member:
            member.write(data)
        package.writestr("näme", b"y")
    system, base = warc_zip.opened(path)
    with system.open_input_file(base) as file:
        found = {m.name: m for m in warc_zip.members(file)}
        assert list(found) == ["first", "long", "näme"] and found["long"].size == 5000
        start = warc_zip.member_start(file, found["long"])
        assert file.read_at(5000, start) == data


def test_reader_follows_zip64_directory(tmp_path, monkeypatch):
    path = str(tmp_path / "many.zip")
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 200)
    with zipfile.ZipFile(path, "w") as package:
        for i in range(9):
            package.writestr(f"m{i}", bytes([i]) * (i + 60))
    with open(path, "rb") as raw:
        assert b"PK\x06\x06" in raw.read()
    system, base = warc_zip.opened(path)
    with system.open_input_file(base) as file:
        for i, m in enumerate(warc_zip.members(file)):
            assert file.read_at(m.size, warc_zip.member_start(file, m)) == bytes([i]) * (i + 60)


def test_members_that_are_not_stored_are_refused(tmp_path):
    path = str(tmp_path / "packed.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("a", b"x" * 1000)
    system, base = warc_zip.opened(path)
    with system.open_input_file(base) as file, pytest.raises(ValueError):
        warc_zip.member_start(file, warc_zip.members(file)[0])


def test_records_round_trip():
    payload = "<p>é\r\n\r\n</p>".encode() * 9
    digest = __import__("hashlib").sha256(payload).hexdigest()
    data = warc_zip.record(3, "http://a b\r\nc", payload, digest, None, False)
    made = warc_zip.parsed(gzip.decompress(gzip.compress(data)))
    assert (made.page_id, made.url, made.kind, made.payload) == (3, "http://a b\r\nc", "response", payload)
    with pytest.raises(ValueError):
        warc_zip.parsed(data.replace(b"<p>", b"<q>"))


@needs_data
def test_pages_in_many_packages(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    archives = warc_zip.write_archives(pages, f"{tmp_path}/w", package_bytes=5000)
    assert archives.count() > 3
    read = warc_zip.read_archives(archives, range_bytes=2000).filter("record_type = 'response'")
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in read.collect():
        assert bytes(r["payload"]).decode() == want[r["page_id"]]


# ------------------------------------------------------------------------------------------------ 10

def brute_components(texts, size, percent=80):
    sets = {}
    for i, text in texts.items():
        own = words(low(text))
        sets[i] = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} or ({tuple(own)} if own else set())
    low_of = {i: i for i in texts}

    def find(x):
        while low_of[x] != x:
            x = low_of[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            low_of[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("size,centers", [(2, 64), (5, 2)])
def test_components(make_docs, size, centers):
    rng = random.Random(10)
    pool = [f"w{k}" for k in range(400)]
    texts, at = {}, 0
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(pool)
            texts[at], at = " ".join(own), at + 1
    chain = [rng.choice(pool) for _ in range(200)]
    for step in range(12):  # neighbours are linked, the ends are not
        texts[at], at = " ".join(chain[8 * step : 8 * step + 110]), at + 1
    texts |= {at: "", at + 1: "one", at + 2: "one", at + 3: "One two"}
    want, sizes = brute_components(texts, size)
    rows = setsketch.grouped(make_docs([(i, t, "s") for i, t in texts.items()]), size, centers=centers).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_hundreds_of_copies_around_the_threshold(make_docs, monkeypatch):
    """Most pairs of the group are just below or above the threshold; what tiles find equals brute force."""
    monkeypatch.setattr(setsketch, "BLOCK", 40)
    monkeypatch.setattr(setsketch, "TILE_SHINGLES", 64)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = {}
    for at in range(220):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        texts[at] = " ".join(own)
    want, _ = brute_components(texts, 2)
    rows = setsketch.grouped(make_docs([(i, t, "s") for i, t in texts.items()]), 2, centers=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert 5 < len(set(want.values())) < 215


def test_members_that_met_in_tiles_are_not_paired_again(make_docs, monkeypatch):
    """Small buckets of a group whose large buckets were compared in tiles: pairs do not grow with the square of the group."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = {}
    for at in range(220):
        own = list(base)
        for _ in range(rng.randint(4, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        texts[at] = " ".join(own)
    counts, likely = [], setsketch.likely
    monkeypatch.setattr(setsketch, "likely", lambda pairs, *more: counts.append(pairs.count()) or likely(pairs, *more))
    want, _ = brute_components(texts, 2)
    rows = setsketch.grouped(make_docs([(i, t, "s") for i, t in texts.items()]), 2, centers=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert counts[-1] <= len(texts)


def test_links_of_a_tile_join_labels():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    for outer in (np.ones(50, bool), rng.random(50) < 0.3):
        labels = rng.integers(0, 20, 50).tolist()
        got = {tuple(sorted((labels[i], labels[j]))) for i, j in setsketch.joining_links(labels, sets, outer, 50)}
        pairs = [(i, j) for i in range(50) for j in range(50) if i != j and (outer.all() or (outer[i] and not outer[j]))]
        assert got == {tuple(sorted((labels[i], labels[j]))) for i, j in pairs if labels[i] != labels[j] and setsketch.similar(sets[i], sets[j], 50)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(items[:2000]), np.unique(items[500:])
    one, two, union = setsketch.sketches([a, b, np.unique(items)], 512)
    assert (np.maximum(one, two) == union).all()
    got = setsketch.estimate(one[None], two[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert got == pytest.approx(0.5, abs=0.08)
    assert not setsketch.sketches([np.zeros(0, np.uint64)]).any()


def test_labels_of_long_chains(spark):
    labels = spark.range(60).selectExpr("id AS node", "id AS label")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 59), (59, 55)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in setsketch.components(labels, links).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (50, 55, 59) else i for i in range(60)}


# ------------------------------------------------------------------------------------------------ pipeline

@needs_data
def test_pipeline(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    measures = {r["doc_id"]: r for r in host_rules.judged(docs).collect()}
    texts = {i: r["text"] for i, r in measures.items() if r["kept"]}
    texts = brute_lines(texts)
    groups, _ = brute_components(texts, 5)
    left = {i: t for i, t in texts.items() if groups[i] == i}
    hit = {pair[0] for pair in brute_contaminated(left, dict(spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()))}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items() if i not in hit}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == want


def test_native_operators_use_no_python(spark, make_docs):
    docs = make_docs([(1, "some words", "a")])
    items = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    for frame in (host_rules.judged(docs), templates.contaminated(docs, items)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
