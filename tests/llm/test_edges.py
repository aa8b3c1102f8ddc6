"""Odd rows, empty tables and clashing columns in every operator and stage."""

import pytest

import corpus_pipeline
from jobweave.llm import bpe_lexicon, chat_windows, ctw, host_rules, html_extract, line_dedup, setsketch, templates, toxicity, warc_zip

ITEMS = [(1, "a question of many words that is asked in this test of the benchmark set"), (2, None), (3, ""), (4, "short item")]


@pytest.fixture(scope="module")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_clean_rows(spark, odd, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, folder)
        assert made.columns == odd.columns, name
        assert {r["n"] for r in made.collect()} == {"own n"}, name


def test_stages_on_empty_tables(spark, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_quality(odd, empty):
    rows = {r["doc_id"]: r for r in host_rules.judged(odd, columns=["doc_id"]).collect()}
    assert rows[1]["n_words"] == rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["base_failed"]
    assert rows[4]["n_words"] == 60_000 and rows[4]["base_failed"]
    assert host_rules.judged(empty).count() == 0


def test_line_dedup(odd, empty):
    rows = {r["doc_id"]: r for r in line_dedup.deduplicated(odd).collect()}
    assert rows[1]["n_lines"] == rows[2]["n_lines"] == 1 and rows[1]["text"] == ""
    assert [rows[10 + i]["n_dropped"] for i in range(6)] == [2, 2, 2, 2, 2, 0]
    assert rows[3]["text"] == " \t\n\x0b "
    assert line_dedup.deduplicated(empty).count() == 0


def test_near_dedup(odd, empty):
    rows = setsketch.grouped(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["n_shingles"] == 0 and by_id[5]["component_id"] == 5 and by_id[6]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert setsketch.grouped(empty).count() == 0


def test_decontamination(spark, odd, empty, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert templates.contaminated(odd, items).count() == 0
    assert templates.contaminated(empty, items).count() == 0
    assert templates.contaminated(odd, items.limit(0)).count() == 0
    hit = odd.limit(0).unionByName(odd.filter("doc_id = 6").selectExpr(*[f"'Before. A {ITEMS[0][1][2:]} after, short item!' AS text" if c == "text" else c for c in odd.columns]))
    assert {(r["doc_id"], r["item_id"]) for r in templates.contaminated(hit, items).collect()} == {(6, 1), (6, 4)}


def test_language_model(odd, empty):
    rows = ctw.scored(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert ctw.scored(empty).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(16)], "doc_id bigint, toxic int")
    rows = toxicity.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
    assert {r["score"] for r in toxicity.scored(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(empty, labels).count() == 0


def test_encoding(odd, empty):
    path = bpe_lexicon.tokenizer_path()
    rows = bpe_lexicon.encoded(odd, path, ["doc_id"], bpe_lexicon.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe_lexicon.encoded(empty, path, ["doc_id"], bpe_lexicon.digests, "n bigint, a string, b string").count() == 0


def test_pages(spark, tmp_path):
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c\n d", "<p>Words of some text, here they are.</p>" * 9), (4, "x", "<p>Words of some text, here they are.</p>" * 9), (4, "x", "<p>Words of some text, here they are.</p>" * 9), (None, "y", "<p>Words of some text, here they are.</p>" * 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html_extract.main_texts(pages).collect()}
    assert texts[1] == texts[2] == "" and texts[3].count("\n") == 8
    archives = warc_zip.write_archives(pages, f"{tmp_path}/warc")
    read = warc_zip.read_archives(archives)
    by_url = {r["url"]: r for r in read.collect()}
    assert set(by_url) == {"http://a", None, "http://c\n d", "x", "y"} and bytes(by_url["http://c\n d"]["payload"]).decode() == rows[2][2]
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_zip.resolved(read).collect())
    n = len(rows[2][2])
    assert kinds == [("1", "response", None, 0), ("2", "response", None, 0), ("3", "response", None, n), ("4", "revisit", 3, n), ("4", "revisit", 3, n), ("None", "revisit", 3, n)]
    none = pages.limit(0)
    assert html_extract.main_texts(none).count() == 0
    assert warc_zip.resolved(warc_zip.read_archives(warc_zip.write_archives(none, f"{tmp_path}/none"))).count() == 0


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "hi"), (2, 0, "system\n<|im_end|>\\", "a\\<|b<\\|c"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat_windows.windows(conversations)
    turns = {r["conv_id"]: chat_windows.read_turns(r["formatted"]) for r in made.collect()}
    assert turns[2] == [("system\n<|im_end|>\\", "a\\<|b<\\|c"), ("assistant", "same"), ("assistant", "same")] and turns[1][0] == ("", "")
    assert {r["conv_id"]: r["n_turns"] for r in chat_windows.read_back(made).collect()} == {1: 2, None: 1, 2: 3}
    assert chat_windows.read_back(chat_windows.windows(conversations.limit(0))).count() == 0
