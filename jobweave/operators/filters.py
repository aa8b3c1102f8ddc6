"""Row predicates over the jobs table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text

SUBSTRING_FILTERS = ("location", "org_location", "organisation_name")
EXACT_FILTERS = ("experience_level", "remote_type", "job_source")
#: Bytes of text whose categories a worker finds at once.
CHUNK_BYTES = 32 << 20


def holds(col: Column, value: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring; with `wildcards`, `%` and `_` in the value keep their LIKE meaning."""
    return F.ilike(col, F.lit(f"%{value}%")) if wildcards else F.lower(col).contains(value.lower())


def apply_filters(jobs: DataFrame, filters: Mapping[str, str], wildcards: bool = False) -> DataFrame:
    """Keep the jobs that meet every given filter."""
    for name in SUBSTRING_FILTERS:
        if filters.get(name):
            jobs = jobs.filter(holds(F.col(name), filters[name], wildcards))
    for name in EXACT_FILTERS:
        if filters.get(name):
            jobs = jobs.filter(F.col(name) == filters[name])
    if filters.get("category"):
        jobs = in_category(jobs, filters["category"])
    return jobs


def in_category(jobs: DataFrame, category: str) -> DataFrame:
    """Jobs of one search category; an unknown category keeps all."""
    category = category.strip()
    if category == fx.GLOBAL_CATEGORY:
        return jobs.filter(F.col("exists_in_uk") == 0)
    if category not in fx.SEARCH_CATEGORIES:
        return jobs
    return jobs.filter(text.any_of(F.col("job_title"), fx.SEARCH_CATEGORIES[category]))


def categories_of(low: Column) -> Column:
    """Ids of all search categories a lower-case title belongs to."""
    marks = [F.when(text.any_in(low, found), F.lit(key)) for key, found in fx.SEARCH_CATEGORIES.items()]
    return F.array_compact(F.array(*marks))


def category_list(low: Column) -> Column:
    """The same as one text, `,1,14,`, for a plain substring test."""
    return F.concat(F.lit(","), F.array_join(categories_of(low), ","), F.lit(","))


def category_lists(low: pa.Array, most: int = CHUNK_BYTES) -> pa.Array:
    """`category_list` of many long texts at once, about `most` bytes at a time."""
    return title_marks(low, most).field("cats")


def title_marks(low: pa.Array, most: int = CHUNK_BYTES) -> pa.StructArray:
    """`category_list` and `is_course` of many long texts in lower case at once, about `most` bytes at a time.

    A word list without blanks is looked for in the distinct pieces between blanks instead of in every text.
    """
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = (np.cumsum(sizes) - sizes) // most
    lows = np.concatenate((np.flatnonzero(np.diff(chunk, prepend=-1)), [len(low)])).tolist()
    names = np.array([*fx.SEARCH_CATEGORIES])
    lists = [*fx.SEARCH_CATEGORIES.values(), fx.COURSE_WORDS]
    made = []
    for start, end in zip(lows, lows[1:]):
        marks, number = np.unique(_marks(low.slice(start, end - start), lists), return_inverse=True)
        cats = [f",{','.join(names[[mark >> k & 1 == 1 for k in range(len(names))]])}," for mark in marks.tolist()]
        course = pa.array((marks >> len(names) & 1 == 1).tolist(), pa.bool_())
        number = pa.array(number)
        made.append(pa.StructArray.from_arrays([pa.array(cats, pa.string()).take(number), course.take(number)], ["cats", "is_course"]))
    return pa.concat_arrays(made) if made else pa.array([], pa.struct({"cats": pa.string(), "is_course": pa.bool_()}))


def _marks(low: pa.Array, lists: Sequence[Iterable[str]]) -> np.ndarray:
    """One number for each lower-case text: a bit for each word list of which the text holds a needle."""
    pieces = pc.split_pattern(low, " ")
    coded = pieces.flatten().dictionary_encode()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))))
    own = np.zeros(len(coded.dictionary), np.int64)
    of_text = np.zeros(len(low), np.int64)
    data, ends = _joined(coded.dictionary)
    for k, found in enumerate(lists):
        for needle in map(str.lower, found):
            if " " not in needle:
                places = [m.start() for m in re.finditer(re.escape(needle.encode()), data)]
                own[np.searchsorted(ends, places, "right")] |= 1 << k
            # A needle with a blank spans pieces: without one that ends like its first word it is nowhere.
            elif needle.partition(" ")[0].encode() + b" " in data:
                of_text |= pc.match_substring(low, needle).to_numpy(zero_copy_only=False).astype(np.int64) << k
    # Every text has at least one piece, be it empty.
    return of_text | np.bitwise_or.reduceat(own[coded.indices.to_numpy()], offsets[:-1])


def _joined(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words with a blank behind each, and where each of them ends."""
    every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    data = pc.binary_join(every, " ")[0].as_buffer().to_pybytes() + b" "
    return data, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)


WANTED = tuple(f"want_{c}" for c in (*SUBSTRING_FILTERS, *EXACT_FILTERS, "category"))


def with_wanted(requests: DataFrame) -> DataFrame:
    """Spread the `filters` map of requests over `want_*` columns, null where nothing is asked."""

    def given(name: str) -> Column:
        return F.nullif(F.try_element_at("filters", F.lit(name)), F.lit(""))

    category = text.strip(given("category"))
    known = category.isin(fx.GLOBAL_CATEGORY, *fx.SEARCH_CATEGORIES)
    columns = {f"want_{c}": F.lower(given(c)) for c in SUBSTRING_FILTERS}
    columns |= {f"want_{c}": given(c) for c in EXACT_FILTERS}
    columns["want_category"] = F.when(known, F.concat(F.lit(","), category, F.lit(",")))
    return requests.withColumns(columns)


def row_meets_request() -> Column:
    """`apply_filters` for rows that carry a job, its `cats` list and the `want_*` columns of a request."""
    checks = [
        F.col(f"want_{c}").isNull() | F.coalesce(F.lower(c).contains(F.col(f"want_{c}")), F.lit(False))
        for c in SUBSTRING_FILTERS
    ]
    checks += [
        F.col(f"want_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"want_{c}"), F.lit(False)) for c in EXACT_FILTERS
    ]
    category = F.col("want_category")
    of_category = F.when(category == f",{fx.GLOBAL_CATEGORY},", F.col("exists_in_uk") == 0).otherwise(
        F.col("cats").contains(category)
    )
    checks.append(category.isNull() | of_category)
    return reduce(lambda a, b: a & b, checks)


def without_courses(jobs: DataFrame, course_words: Iterable[str] = fx.COURSE_WORDS_BROWSE) -> DataFrame:
    """Browse rule: drop course titles, and rows without a title."""
    return jobs.filter(~text.any_of(F.col("job_title"), course_words))


def is_course(title: Column, course_words: Iterable[str] = fx.COURSE_WORDS) -> Column:
    """Search rule: a missing title is no course."""
    return text.any_of(text.value_or_blank(title), course_words)


def with_link(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("is_active") == 1) & (F.col("job_link") != ""))


def location_scope(jobs: DataFrame, scope: str) -> DataFrame:
    """`uk`, `london`, or anything else for all."""
    flag = {"uk": "exists_in_uk", "london": "exists_in_london"}.get(scope)
    return jobs.filter(F.col(flag) == 1) if flag else jobs


def row_in_scope(scope: Column) -> Column:
    return (
        F.when(scope == "uk", F.col("exists_in_uk") == 1)
        .when(scope == "london", F.col("exists_in_london") == 1)
        .otherwise(F.lit(True))
    )


def featured_places(jobs: DataFrame, places: Iterable[str] = fx.FEATURED_PLACES) -> DataFrame:
    return jobs.filter(
        (F.col("is_active") == 1) & (F.col("exists_in_uk") == 1) & text.any_of(F.col("location"), places)
    )


def without_usable_link(jobs: DataFrame) -> DataFrame:
    """Active jobs whose link is missing or not a web address, with the reason."""
    bad = F.col("job_link").isNull() | ~F.lower(F.col("job_link")).startswith("http")
    return jobs.filter((F.col("is_active") == 1) & bad).withColumn("deactivation_reason", F.lit("no_job_link"))


def vague_title(
    title: Column,
    junk: Iterable[str] = fx.JUNK_TITLES,
    markers: Iterable[str] = fx.JUNK_MARKERS,
    short: Iterable[str] = fx.SHORT_TITLES,
) -> Column:
    low = F.lower(title)
    is_short = (F.length(title) <= 2) & ~F.upper(title).isin(*short)
    return low.isin(*junk) | text.any_of(title, markers) | is_short


def with_vague_title(jobs: DataFrame, **lists) -> DataFrame:
    found = jobs.filter((F.col("is_active") == 1) & vague_title(F.col("job_title"), **lists))
    return found.withColumn("deactivation_reason", F.lit("vague_or_test_title"))


def due_for_check(jobs: DataFrame, as_of: str, recheck_days: int = 3, batch: int | None = None) -> DataFrame:
    """Active jobs never checked or checked too long ago: never checked first, then oldest, then id."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(recheck_days)} DAYS")
    last = F.col("last_health_check")
    due = jobs.filter((F.col("is_active") == 1) & (last.isNull() | (last < cutoff)))
    due = due.orderBy(last.asc_nulls_first(), F.col("id").asc())
    return due if batch is None else due.limit(batch)


def embedding_backlog(jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active jobs without a vector, by id.  Both ids are unique, so no key is hot."""
    return jobs.filter("is_active = 1").join(vectors.select("id"), "id", "left_anti").orderBy("id")


def description_backlog(jobs: DataFrame, batch: int | None = None) -> DataFrame:
    """Jobs with a link and no description, newest id first; one batch of them if a size is given."""
    missing = F.col("job_description").isNull() | (F.col("job_description") == "")
    waiting = jobs.filter(F.col("job_link").isNotNull() & missing).orderBy(F.col("id").desc())
    return waiting if batch is None else waiting.limit(batch)


def blocked_domain(url: Column, domains: Iterable[str] = fx.BLOCKED_DOMAINS) -> Column:
    return F.coalesce(text.any_of(url, domains), F.lit(False))
