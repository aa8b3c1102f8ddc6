"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question asked again with other values keeps its template.
Every window of eight template tokens of every document meets the windows of the benchmark by hash.  A window also has a plain
form, in which words are only lower-cased, and counts if either form meets the item's: a passage is found in any letter case.
On each alignment (document position minus item position) the windows whose values are consistent are counted, and a document
that covers enough of an item is contaminated.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import stored, table, without, words_of

WINDOW = 8
#: An item is found in a document that covers all its tokens, or at least this many and this share of them.
MIN_TOKENS = 13
MIN_PERCENT = 50
#: A window with fewer tokens beside its placeholders must repeat the item's values as they are.
MIN_LITERALS = 3
#: Windows of the benchmark in a broadcast; of a larger benchmark only hashes are, and so many of them at once.
BLOCK_ROWS = 50_000
KEY_ROWS = 1_000_000
ENDS = ".!?"
# Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "inch", "inches", "foot", "feet",
    "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "pound", "pounds",
    "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute",
    "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar",
    "dollars", "euro", "euros", "percent", "degree", "degrees",
)
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
NOISE = r"[^\p{L}\p{N}.!?\x20\x09-\x0D]+"


def tokens(rows: DataFrame) -> DataFrame:
    """The rows with `_core`, the tokens of `text` without punctuation in lower case, `_plain`, their template without names,
    `_canon`, their template, and `_lead`, the template whose first token is a name too if it begins with a capital.

    Signs other than sentence ends vanish, so `1,000` is one token.  A token that begins with a digit is a number; a unit
    follows a number; a name begins with a capital and does not begin a sentence.  Null texts have no tokens.
    """
    ends = F.lit(ENDS)
    rows = rows.withColumn("_text", F.regexp_replace(F.coalesce("text", F.lit("")), NOISE, ""))
    rows = rows.withColumn("_raw", F.filter(words_of(F.col("_text")), lambda t: F.btrim(t, ends) != ""))
    rows = rows.withColumn("_cased", F.transform("_raw", lambda t: F.btrim(t, ends)))
    rows = rows.withColumn("_core", F.transform("_cased", lambda t: F.lower(t)))
    digit = lambda t: (t >= "0") & (t < ":")

    def plain(core: Column, i: Column) -> Column:
        unit = (i > 0) & digit(F.get("_core", i - 1)) & core.isin(*UNITS)
        return F.when(digit(core), NUM).when(unit, UNIT).otherwise(core)

    def named(kind: Column, i: Column) -> Column:
        first, before = F.substring(F.get("_cased", i), 1, 1), F.get("_raw", i - 1)
        inside = (i > 0) & ~F.right(before, F.lit(1)).isin(*ENDS)
        return F.when((first != F.lower(first)) & ~kind.isin(NUM, UNIT) & inside, NAME).otherwise(kind)

    rows = rows.withColumn("_plain", F.transform("_core", plain))
    rows = rows.withColumn("_canon", F.transform("_plain", named))
    initial = F.substring(F.get("_cased", F.lit(0)), 1, 1)
    rows = rows.withColumn("_lead", F.transform("_canon", lambda t, i: F.when((i == 0) & (initial != F.lower(initial)), NAME).otherwise(t)))
    return rows.drop("_text", "_raw", "_cased")


def window_hash(hashes: str, at: Column, length: int) -> Column:
    """Hash of the window of `length` tokens at place `at` (0 is the first) from the hashes of the tokens."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(length)])


def window_hashes(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each window of each of the lengths: doc_id, _core, _plain, _canon, _pos and hash.

    Tokens are hashed once; a window is hashed from those numbers after the explode, where no lambda is interpreted.  Names make
    the template form of a window differ from the plain one; where they do not, there is one row.
    """
    each = lambda form: F.transform(form, lambda t: F.xxhash64(t))
    hashed = texts.select("doc_id", "_core", "_plain", "_canon", each("_plain").alias("_words"), each("_canon").alias("_kinds"))
    spots = hashed.select("*", F.posexplode_outer("_words").alias("_pos", "_word"))
    forms = []
    for length in lengths:
        inside = F.col("_pos") + length <= F.size("_words")
        plain, canon = (window_hash(hashes, F.col("_pos"), length) for hashes in ("_words", "_kinds"))
        forms += [F.when(inside, plain), F.when(inside & (plain != canon), canon)]
    return spots.select("doc_id", "_core", "_plain", "_canon", "_pos", F.explode(F.array(*forms)).alias("hash"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the items: item_id, item_tokens, length, at, plain, hash, template, slots.  A shorter item is one window.

    Each window is there in each of its forms, `plain` telling which form its template has; a first token with a capital is a
    word in one of them and a name in another, as it may stand inside a sentence of a document.
    """
    rows = stored(tokens(items.select("item_id", "text")).withColumn("item_tokens", F.size("_canon")), "items").filter("item_tokens > 0")
    rows = rows.withColumn("length", F.least(F.lit(window), F.col("item_tokens")))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("item_tokens") - F.col("length"))))
    forms = {"_canon": False, "_plain": True, "_lead": False}
    cut = [F.struct(F.lit(plain).alias("plain"), F.slice(form, F.col("at") + 1, F.col("length")).alias("template")) for form, plain in forms.items()]
    rows = rows.withColumn("_form", F.explode(F.array_distinct(F.array(*cut)))).select("*", "_form.plain", "_form.template")
    slot = lambda t, i: F.when(t.isin(NUM, NAME, UNIT), F.struct(i.alias("offset"), t.alias("kind"), F.get("_core", F.col("at") + i).alias("asked")))
    slots = F.filter(F.transform("template", slot), lambda s: s.isNotNull())
    rows = rows.withColumn("_hashes", F.transform("template", lambda t: F.xxhash64(t)))
    hashed = reduce(lambda other, n: F.when(F.col("length") == n, window_hash("_hashes", F.lit(0), n)).otherwise(other), range(1, window + 1), F.lit(None))
    return rows.select("item_id", "item_tokens", "length", "at", "plain", hashed.alias("hash"), "template", slots.alias("slots"))


def aligned_windows(docs: DataFrame, windows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every window of every document that equals a benchmark window: doc_id, item_id, item_tokens, length, at, shift, slots,
    and `same`, whether the templates are equal beyond their hash (tested after the join, so that only hits are cut out).

    The benchmark is the stated query set: up to `block_rows` windows are broadcast as they are.  Of more windows only the
    distinct hashes are, `KEY_ROWS` at a time, so that neither executors nor passes over the documents grow with what the
    windows hold; the few windows of documents that meet one are cut out and joined by a shuffle.  All lengths of windows are
    taken in one pass.  The outer form of explode keeps Spark from testing `size(windows) > 0` below the columns that it would
    then have to compute again.
    """
    windows = stored(windows, "benchmark")
    counts = windows.groupBy("length").count().collect()  # at most WINDOW rows
    if not counts:
        empty = "item_tokens int, length int, at int, shift int, slots array<struct<kind:string,asked:string,said:string>>, same boolean"
        kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *windows.schema.fields]}
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, {empty}")
    spots = window_hashes(tokens(docs.select("doc_id", "text")), sorted(n for n, _ in counts))
    if sum(n for _, n in counts) <= block_rows:
        return _compared(spots.join(F.broadcast(windows), "hash"), F.col("_pos"))
    keys = stored(windows.select("hash").distinct(), "hashes")
    blocks = -(-keys.count() // KEY_ROWS)
    longest = max(n for n, _ in counts)
    forms = [F.slice(form, F.col("_pos") + 1, longest).alias(form) for form in ("_core", "_plain", "_canon")]
    met = []
    for block in range(blocks):
        own = F.broadcast(keys.filter(F.pmod("hash", F.lit(blocks)) == block))
        met.append(spots.join(own, "hash", "left_semi").select("doc_id", "_pos", "hash", *forms))
    return _compared(reduce(DataFrame.unionAll, met).join(windows.hint("merge"), "hash"), F.lit(0))


def _compared(hits: DataFrame, start: Column) -> DataFrame:
    """Hits of windows with their slots, and whether the templates are equal; `start` is where the window lies in the forms."""
    cut = lambda form: F.slice(form, start + 1, F.col("length"))
    said = F.transform("slots", lambda s: F.struct(s["kind"], s["asked"], F.get("_core", start + s["offset"]).alias("said")))
    same = F.when(F.col("plain"), cut("_plain")).otherwise(cut("_canon")) == F.col("template")
    return hits.select("doc_id", "item_id", "item_tokens", "length", "at", (F.col("_pos") - F.col("at")).alias("shift"), said.alias("slots"), same.alias("same"))


def covered(at: Column, length: Column) -> Column:
    """Tokens below windows of one length that begin at the distinct positions `at`."""
    ordered = F.array_sort(at)
    steps = F.transform(ordered, lambda x, i: F.coalesce(F.least(F.get(ordered, i + 1) - x, length), length))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_tokens: int = MIN_TOKENS, min_percent: int = MIN_PERCENT, block_rows: int = BLOCK_ROWS, min_literals: int = MIN_LITERALS) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, item_tokens, covered_tokens, n_slots.

    A window counts if one value of the item always stands for one value of the document inside it (two values of the item may
    stand for one of the document), and if it has `min_literals` tokens beside its placeholders or repeats the item's values as
    they are.  Rows of one doc_id count as one document, null ids too; null, empty and token-free texts and items find nothing;
    an empty table gives no pairs.
    """
    hits = aligned_windows(docs, benchmark_windows(items, window), block_rows)
    distinct = lambda *fields: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*[s[f] for f in fields]))))
    literal = (F.col("length") - F.size("slots") >= min_literals) | F.forall("slots", lambda s: s["asked"] == s["said"])
    # tested inside the aggregate: as a filter it would move below the join
    counts = F.col("same") & literal & (distinct("kind", "asked") == distinct("kind", "asked", "said"))
    keys = ["doc_id", "item_id", "item_tokens", "length"]
    by_shift = hits.groupBy(*keys, "shift").agg(F.collect_set(F.when(counts, F.col("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_set(F.when(counts, F.col("slots"))))).alias("slots"))
    whole = by_shift.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.max(F.size("slots")).cast("bigint").alias("n_slots"))
    rows = whole.withColumn("covered_tokens", covered(F.col("at"), F.col("length")))
    enough = (F.col("covered_tokens") >= min_tokens) & (100 * F.col("covered_tokens") >= min_percent * F.col("item_tokens"))
    rows = rows.filter(enough | (F.col("covered_tokens") == F.col("item_tokens")))
    return rows.select("doc_id", "item_id", F.col("item_tokens").cast("bigint"), F.col("covered_tokens").cast("bigint"), "n_slots")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Contaminated documents with the items that they hold, in any letter case and with any values."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, in any letter case and with any values."""
    found = stored(contaminated(docs, table(spark, folder, "benchmark")), "contaminated")
    return without(docs, found, "doc_id").select(*docs.columns)


SQL = r"""
WITH src AS (
  SELECT 0 AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), t AS (
  SELECT k, id, [x FOR x IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}.!?\x20\x09-\x0D]+', '', 'g'),
    '[\x20\x09-\x0D]+') IF trim(x, '.!?') <> ''] AS raw FROM src
), u AS (
  SELECT k, id, unnest(raw) AS r, unnest(range(len(raw))) AS i FROM t
), c AS (
  SELECT k, id, i, r, trim(r, '.!?') AS cased, lower(trim(r, '.!?')) AS core, lag(r) OVER o AS before, lower(trim(lag(r) OVER o, '.!?')) AS last
  FROM u WINDOW o AS (PARTITION BY k, id ORDER BY i)
), d AS (
  SELECT k, id, i, core, cased[1] <> lower(cased[1]) AS capital, core >= '0' AND core < ':' AS num,
    coalesce(last >= '0' AND last < ':' AND core IN (@units), false) AS unit, coalesce(right(before, 1) NOT IN ('.', '!', '?'), false) AS inside FROM c
), e AS (
  SELECT k, id, i, core, capital, CASE WHEN num THEN '<num>' WHEN unit THEN '<unit>' ELSE core END AS plain,
    CASE WHEN num THEN '<num>' WHEN unit THEN '<unit>' WHEN capital AND inside THEN '<name>' ELSE core END AS canon FROM d
), a AS (
  SELECT k, id, count(*) AS total, list(core ORDER BY i) AS cores, list(plain ORDER BY i) AS plains, list(canon ORDER BY i) AS canons,
    list(CASE WHEN i = 0 AND capital THEN '<name>' ELSE canon END ORDER BY i) AS leads FROM e GROUP BY k, id
), items AS (
  SELECT id AS item_id, total, least(8, total) AS len, unnest(range(total - least(8, total) + 1)) AS pos, cores, plains, canons, leads FROM a WHERE k = 1
), forms AS (
  SELECT item_id, total, len, pos, true AS p, plains[pos + 1:pos + len] AS tpl, cores[pos + 1:pos + len] AS asked FROM items
  UNION ALL SELECT item_id, total, len, pos, false, canons[pos + 1:pos + len], cores[pos + 1:pos + len] FROM items
  UNION ALL SELECT item_id, total, len, pos, false, leads[pos + 1:pos + len], cores[pos + 1:pos + len] FROM items WHERE pos = 0
), texts AS (
  SELECT id AS doc_id, i AS spot, len, core, plain, canon FROM e, (SELECT DISTINCT len FROM items) WHERE k = 0
), spans AS (
  SELECT doc_id, spot, len, list(core) OVER o AS said, string_agg(plain, ' ') OVER o AS plains, string_agg(canon, ' ') OVER o AS canons FROM texts
  WINDOW o AS (PARTITION BY doc_id, len ORDER BY spot ROWS BETWEEN CURRENT ROW AND len - 1 FOLLOWING)
), said AS (
  SELECT doc_id, len, spot, true AS p, plains AS s, said FROM spans WHERE len(said) = spans.len
  UNION ALL SELECT doc_id, len, spot, false, canons, said FROM spans WHERE len(said) = spans.len
), hit AS (
  SELECT DISTINCT doc_id, item_id, total, len, pos, spot - pos AS shift, p, tpl, asked, said
  FROM said JOIN forms USING (len, p) WHERE s = array_to_string(tpl, ' ')
), judged AS (
  SELECT *, [{'kind': tpl[j], 'asked': asked[j], 'said': said[j]} FOR j IN range(1, len + 1) IF tpl[j] IN ('<num>', '<unit>', '<name>')] AS slots FROM hit
), good AS (
  SELECT * FROM judged WHERE len(list_distinct([{'kind': x.kind, 'asked': x.asked} FOR x IN slots])) = len(list_distinct(slots))
    AND (judged.len - len(slots) >= 3 OR len([x FOR x IN slots IF x.asked <> x.said]) = 0)
), slotted AS (
  SELECT doc_id, item_id, max(len(list_distinct(flatten(all_slots)))) AS n_slots
  FROM (SELECT doc_id, item_id, list(slots) AS all_slots FROM good GROUP BY doc_id, item_id, shift) GROUP BY ALL
), spots AS (
  SELECT DISTINCT doc_id, item_id, total, len, pos FROM good
), steps AS (
  SELECT *, lead(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS nxt FROM spots
), covers AS (
  SELECT doc_id, item_id, total AS item_tokens, CAST(sum(least(len, coalesce(nxt - pos, len))) AS BIGINT) AS covered_tokens FROM steps GROUP BY ALL
)
SELECT doc_id, item_id, item_tokens, covered_tokens, CAST(n_slots AS BIGINT) AS n_slots FROM covers JOIN slotted USING (doc_id, item_id)
WHERE covered_tokens = item_tokens OR covered_tokens >= 13 AND 100 * covered_tokens >= 50 * item_tokens
""".replace("@units", ", ".join(f"'{u}'" for u in UNITS))
