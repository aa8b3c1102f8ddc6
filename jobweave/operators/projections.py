"""Column-only operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text

LISTING = (
    "id", "job_title", "organisation_name", "org_location", "location", "remote_type", "experience_level", "salary",
    "dateposted", "job_description", "job_link", "company_url", "job_source", "hybrid_score", "views_count",
    "is_blurred",
)
VECTOR_COLUMNS = ("embedding_vector", "embedding_base64", "embedding")


def listing(jobs: DataFrame) -> DataFrame:
    """The 16 listing columns; a row without a score gets 0."""
    score = F.coalesce(F.col("hybrid_score"), F.lit(0.0)) if "hybrid_score" in jobs.columns else F.lit(0.0)
    scored = jobs.withColumns({"hybrid_score": score.cast("double"), "is_blurred": F.lit(False)})
    return scored.select(*LISTING)


def detail(views: DataFrame, jobs: DataFrame, saved: DataFrame) -> DataFrame:
    """One row per (user, job) view of an active job: all columns but the vectors, and whether the user saved it."""
    from jobweave.functions.skew import join_unique

    pairs = views.select("user_id", "id").distinct()
    marks = saved.select("user_id", "id").distinct().withColumn("is_saved", F.lit(True))
    flagged = pairs.join(marks, ["user_id", "id"], "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))
    return join_unique(flagged, jobs.filter("is_active = 1").drop(*VECTOR_COLUMNS), ["id"])


def embedding_text(jobs: DataFrame) -> DataFrame:
    """Text to embed; rows with fewer than 3 characters drop out.  Blank parts keep their separators."""
    parts = ("job_title", "job_description", "organisation_name", "location", "experience_level", "remote_type")
    pieces = [text.value_or_blank(F.col(p)) for p in parts]
    joined = pieces[0]
    for piece in pieces[1:]:
        joined = F.concat(joined, F.lit(" "), piece)
    return jobs.withColumn("embed_text", text.strip(joined)).filter(F.length("embed_text") >= 3)


def search_string(register: DataFrame) -> DataFrame:
    """`organisation town county careers`, without blank or `nan` parts; rows without an organisation drop out."""

    def part(name: str) -> Column:
        clean = text.strip(F.col(name))
        return F.when(~clean.isin("", "nan"), clean)

    clean = register.withColumns({n: part(n) for n in ("organisation_name", "town", "county")})
    query = F.concat_ws(" ", "organisation_name", "town", "county", F.lit("careers"))
    return (
        clean.filter(F.col("organisation_name").isNotNull())
        .withColumn("search_query", query)
        .withColumns({n: text.value_or_blank(F.col(n)) for n in ("town", "county")})
    )


def org_location(town: Column, county: Column) -> Column:
    joined = F.concat(text.value_or_blank(town), F.lit(", "), text.value_or_blank(county))
    return F.regexp_replace(joined, "^[, ]+|[, ]+$", "")


def job_location(location: Column, org: Column) -> Column:
    """The stated location, else the first comma part of the employer's."""
    first = F.trim(F.split_part(org, F.lit(","), F.lit(1)))
    return F.coalesce(text.blank_to_null(location, "not specified", "nan"), F.when(first != "", first))


def age_label(posted: Column, as_of: str) -> Column:
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(posted))
    days = F.floor(seconds / 86400)
    unit = F.when(days == 1, " Day Ago").otherwise(" Days Ago")
    return F.when(days.isNull(), "").when(days == 0, "Today").otherwise(F.concat(days.cast("string"), unit))


def without_label(place: Column) -> Column:
    """A place without the word that announces it: `Location: x`, `locations - x` and `[location] x` give x."""
    low, signs = F.lower(place), " \t\n\r:-"
    out = F.when(low.startswith("[location]"), F.substr(place, F.lit(len("[location]") + 1)))
    for word in ("locations", "location"):
        after = F.substr(place, F.lit(len(word) + 1))
        announced = low.startswith(word) & F.substring(after, 1, 1).isin(*signs)
        out = out.when(announced, F.ltrim(after, F.lit(signs)))
    return out.otherwise(place)


def card(jobs: DataFrame, as_of: str) -> DataFrame:
    """Display columns of a job card and of its detail page."""
    place = F.coalesce(F.nullif("location", F.lit("")), F.nullif("org_location", F.lit("")), F.lit("UK"))
    place = text.strip(without_label(place))
    link = F.col("job_link")
    mail = F.contains(link, F.lit("@")) & ~F.contains(link, F.lit("http")) & ~F.contains(link, F.lit("mailto:"))
    return jobs.select(
        "id",
        "job_title",
        age_label(F.col("dateposted"), as_of).alias("age_label"),
        F.when(F.col("salary") != "Not Specified", F.col("salary")).otherwise("").alias("display_salary"),
        F.coalesce(F.nullif(place, F.lit("")), F.lit("Location Not Specified")).alias("display_location"),
        F.coalesce(F.nullif("remote_type", F.lit("")), F.lit("Fulltime")).alias("display_type"),
        F.when(F.col("exists_in_uk") == 0, "Remote / Global Job").otherwise("").alias("badge"),
        F.replace(
            F.coalesce(F.nullif("job_description", F.lit("")), F.lit("No description provided.")),
            F.lit("\ufffd"),
            F.lit("\u2022"),
        ).alias("display_description"),
        F.when(mail, F.concat(F.lit("mailto:"), link)).otherwise(link).alias("apply_link"),
    )


def filter_from_label(label: Column) -> tuple[Column, Column]:
    """(remote type, experience level) a sidebar label stands for; null if it is not of that kind."""

    def lookup(table: dict[str, str]) -> Column:
        pairs = [F.lit(item) for pair in table.items() for item in pair]
        return F.try_element_at(F.create_map(*pairs), label)

    return lookup(fx.REMOTE_LABELS), lookup(fx.LEVEL_LABELS)


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(text.value_or_blank(first), F.lit(" "), text.value_or_blank(last)))


def email_name(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def clean_description(col: Column) -> Column:
    """Take the writer's boilerplate, the first colon and outer quotes off a description; null if nothing is left."""
    out = text.strip(col)
    for phrase in fx.DESCRIPTION_BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = text.strip(F.regexp_replace(out, r"^([^:]*):", "$1"))
    out = F.regexp_replace(F.regexp_replace(out, r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.nullif(text.strip(out), F.lit(""))


def clean_written_description(col: Column) -> Column:
    """Variant for page-based descriptions: drop a `job description:` label and outer quotes."""
    out = text.strip(F.regexp_replace(text.strip(col), r"(?i)job description\s*:", ""))
    return F.nullif(text.strip(F.regexp_replace(out, r"""^["']+|["']+$""", "")), F.lit(""))
