"""Reading and writing the model tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.functions import text
from jobweave.operators import liveness, projections

REGISTER_SCHEMA = T.StructType(
    [
        T.StructField("Organisation Name", T.StringType()),
        T.StructField("Town/City", T.StringType()),
        T.StructField("County", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A model table from a folder with one Parquet table per name."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table scan over at least as many tasks as there are cores.

    For per-row work such as parsing.  A table in enough files or row groups, as any large one, is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A model table from a relational database, when its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Sponsor register (CSV with a header row) as (organisation_name, town, county)."""
    raw = spark.read.csv(path, schema=REGISTER_SCHEMA, header=True, multiLine=True, escape='"')
    return raw.toDF("organisation_name", "town", "county")


def import_jobs(
    raw: DataFrame,
    uk_places: Iterable[str] | None = None,
    london_places: Iterable[str] | None = None,
) -> DataFrame:
    """Raw job rows to the jobs table: trimmed lower-case column names, titled rows only, typed flags, location tags."""
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    titled = named.filter(text.strip(F.col("job_title")) != "")
    # A table without the column means active; an empty cell does not.
    active, views = F.lit(1), F.lit(0)
    if "is_active" in named.columns:
        active = F.coalesce(F.upper(F.col("is_active").cast("string")) == "TRUE", F.lit(False)).cast("int")
    if "views_count" in named.columns:
        views = F.coalesce(F.expr("try_cast(try_cast(views_count AS double) AS int)"), F.lit(0))
    typed = titled.withColumns({"is_active": active, "views_count": views})
    lists = {k: v for k, v in (("uk_places", uk_places), ("london_places", london_places)) if v is not None}
    return liveness.tag_location(typed, **lists)


def has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path and an empty folder as analysis errors
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def write_jobs(jobs: DataFrame, path: str, force: bool = False) -> bool:
    """Write the table unless it already has rows; `force` replaces them.  Tells whether it wrote."""
    if not force and has_rows(jobs.sparkSession, path):
        return False
    jobs.write.mode("overwrite").parquet(path)
    return True


def active_without_vectors(jobs: DataFrame) -> DataFrame:
    return jobs.filter("is_active = 1").drop("embedding_vector", "embedding")


def export_active(jobs: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = active_without_vectors(jobs).write.mode("overwrite")
    writer.option("header", True).format(file_format).save(path)


def with_columns(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the missing ones of the given (name, type) columns as nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in rows.columns}
    return rows.withColumns(missing) if missing else rows


#: Types that a column may take over the versions of a table, each read into the next without loss.
WIDER = (("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "double"), ("float", "double"), ("date", "timestamp_ntz"))


def wider_type(one: T.DataType, other: T.DataType) -> T.DataType | None:
    """The type that holds the values of both, or None."""
    if one == other or isinstance(other, T.NullType):
        return one
    if isinstance(one, T.NullType):
        return other
    names = {one.simpleString(): one, other.simpleString(): other}
    for line in WIDER:
        if all(name in line for name in names):
            return names[max(names, key=line.index)]
    return None


def merged_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """Nullable columns of all versions in order of first sight; names differ by more than case, the first spelling stays.

    Numbers and dates take the wider type; nested types must be equal. Types without a common one raise ValueError.
    """
    merged: dict[str, T.StructField] = {}
    for field in (f for schema in schemas for f in schema.fields):
        known = merged.get(field.name.lower(), T.StructField(field.name, field.dataType))
        kind = wider_type(known.dataType, field.dataType)
        if kind is None:
            raise ValueError(f"column {known.name} is {known.dataType.simpleString()} in one version and {field.dataType.simpleString()} in another")
        merged[field.name.lower()] = T.StructField(known.name, kind)
    return T.StructType(list(merged.values()))


def read_versions(spark: SparkSession, paths: list[str], columns: Mapping[str, str] | None = None) -> DataFrame:
    """Stored Parquet versions of one table as a single scan: what a version lacks is null, as are the given extra columns.

    Only the footers are read to agree on the columns; filters and column choice reach the files of every version.
    """
    schema = merged_schema(spark.read.parquet(path).schema for path in paths)
    return with_columns(spark.read.schema(schema).parquet(*paths), columns or {})


def decode_embeddings(rows: DataFrame, column: str = "embedding_base64") -> DataFrame:
    """Base64 text of little-endian float32 values to vector and dimension; unreadable rows keep a null vector."""
    read = rows.select("id", F.try_to_binary(F.col(column), F.lit("base64")).alias("raw"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [
                np.frombuffer(raw, dtype="<f4") if raw is not None and len(raw) and len(raw) % 4 == 0 else None
                for raw in batch["raw"]
            ]
            sizes = pd.array([None if v is None else len(v) for v in vectors], dtype="Int32")
            yield pd.DataFrame({"id": batch["id"], "embedding": vectors, "embedding_dimension": sizes})

    return read.mapInPandas(decode, "id bigint, embedding array<float>, embedding_dimension int")


def org_register(suppliers: DataFrame) -> DataFrame:
    """Register rows with their search string and location."""
    searched = projections.search_string(suppliers)
    return searched.withColumn("org_location", projections.org_location(F.col("town"), F.col("county")))
