"""Training-data pipeline: from raw documents to token ids, in five stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobweave.llm import bpe_lexicon, host_rules, line_dedup, setsketch, templates
from jobweave.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Every stage but the last returns the columns of `documents`.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", host_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", setsketch.stage),
    ("decontamination", templates.stage),
    ("bpe_encoding", bpe_lexicon.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Recurrent near-duplicate links could be written in SQL, merging by rank could not.
ORACLE_SQL: str | None = None
