"""Quality rules on documents, with verdicts on whole hosts.

Every document is measured by itself.  The failures of all documents of a host are counted, the host's failure rate is shrunk
towards the rate of all hosts by a beta prior fitted to the hosts themselves, and the host's verdict goes back to its
documents.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import attach, key_of, let, stored, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are percentages so that every test is on whole numbers."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 40
    min_mean_chars: int = 2
    max_mean_chars: int = 20
    max_dup_line_pct: int = 50
    max_host_rate: float = 0.6


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text.

    Texts whose windows all differ are done after one hash set.  Otherwise (hash, position) pairs are sorted, positions with
    an equal neighbour are put in order, and each covers as many words as lie before the next one, `window` at most.
    """

    def covered(sorted_pairs: Column) -> Column:
        def twin(pair: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(sorted_pairs, j)["h"] == pair["h"], F.lit(False))
            return same(i - 1) | same(i + 1)

        at = F.array_sort(F.transform(F.filter(sorted_pairs, twin), lambda p: p["i"]))
        step = lambda a: F.transform(a, lambda x, i: F.coalesce(F.least(F.get(a, i + 1) - x, F.lit(window)), F.lit(window)))
        return let(at, lambda a: F.aggregate(step(a), F.lit(0), lambda total, x: total + x))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents with `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed` and `failed`.

    A null or blank text has no words and fails.  Own columns of these names are replaced.  Every number comes from the whole
    text.  Windows are compared by 64-bit hash within one text.
    """
    text = F.coalesce("text", F.lit(""))
    n, hashes = F.size("_words"), F.col("_windows")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    rows = rows.withColumn("_windows", F.when(n >= WINDOW, windows).otherwise(none))
    rows = rows.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("_words"), hashes).cast("bigint"),
        "_n_lines": F.size("_lines"),
    }).drop("_words", "_windows", "_lines")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    more = (
        (100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("n_words"))
        | (F.col("word_chars") < rules.min_mean_chars * F.col("n_words"))
        | (F.col("word_chars") > rules.max_mean_chars * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("_n_lines"))
    )
    return rows.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | more).drop("_n_lines")


def host_verdicts(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per `_host`: `n` documents, shrunk failure `rate`, and `host_failed`.

    The prior is the beta distribution whose moments match the hosts' rates: its mean is the rate of all documents, its
    strength 1 / rho - 1, where rho is the moment estimate of the correlation within hosts.  Hosts that differ by no more
    than chance give rho 0, that is the strongest prior: strength is held between 1 and the number of documents.
    """
    hosts = rows.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("bigint")).alias("x"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("x").cast("double") * F.col("x") / F.col("n")).alias("xx")).first()
    mean, strength = 0.0, 1.0
    if total["n"]:
        n, x, k, nn, xx = (float(total[c]) for c in ("n", "x", "k", "nn", "xx"))
        mean, noise = x / n, x / n * (1 - x / n)
        spread = noise * (n - nn / n - (k - 1))
        rho = (xx - x * x / n - (k - 1) * noise) / spread if spread > 0 else 0.0
        strength = min(max(1 / rho - 1, 1.0), n) if rho > 0 else n
    rate = (F.col("x") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("_host", "n", rate.alias("host_rate")).withColumn("host_failed", F.col("host_rate") > rules.max_host_rate)


def judged(docs: DataFrame, host: str = "source", rules: Rules = Rules(), columns: list[str] | None = None) -> DataFrame:
    """Documents with their measures, `host_rate` and `kept`: neither the document nor its host failed.

    `host` names the column of the domain; documents without one are a host of their own.  Measures are taken once and
    written with `columns` (all by default); hosts are counted from there.  Repeated rows count as rows.  An empty table
    gives an empty result.
    """
    keep = docs.columns if columns is None else columns
    extra = [*MEASURES, "base_failed", "failed"]
    rows = measured(docs.withColumn("_host", key_of(F.col(host))), rules).select(*[c for c in keep if c not in extra], "_host", *extra)
    rows = stored(rows, "measures")
    hosts = host_verdicts(rows, rules)
    kept = ~F.col("failed") & ~F.col("host_failed")
    spread = ["doc_id", "n_words", "word_chars"]
    return attach(rows, hosts, "_host", "n", spread).withColumn("kept", kept).drop("_host", "host_failed")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    rows = judged(table(spark, folder, "documents"), columns=["doc_id"])
    return rows.select("doc_id", *MEASURES, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass, with their own columns, whatever their names are."""
    packed = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"))
    return judged(packed, columns=["doc_id", "_own"]).filter("kept").select("_own.*")


SQL = r"""
WITH a AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT doc_id, source, t,
    [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM a
), c AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, w
  FROM b
), win AS (
  SELECT r, unnest(range(1, n_words - 6)) AS i, w FROM c
), g AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS s FROM win
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), m AS (
  SELECT c.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM c LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), d AS (
  SELECT *, base_failed OR 100 * n_symbols > 40 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 50 * n_lines AS failed FROM f
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS x FROM d GROUP BY source
), p AS (
  SELECT sum(n) AS n, sum(x) AS x, count(*) AS k, sum(n * n) AS nn, sum(x * x / n) AS xx FROM h
), q AS (
  SELECT *, x / n AS mean, (x / n) * (1 - x / n) AS noise FROM p
), u AS (
  SELECT *, CASE WHEN noise * (n - nn / n - (k - 1)) > 0 THEN (xx - x * x / n - (k - 1) * noise) / (noise * (n - nn / n - (k - 1))) ELSE 0 END AS rho FROM q
), v AS (
  SELECT mean, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), n) ELSE n END AS strength FROM u
), o AS (
  SELECT source, (x + mean * strength) / (h.n + strength) > 0.6 AS host_failed FROM h, v
)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT host_failed AS kept
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
"""
