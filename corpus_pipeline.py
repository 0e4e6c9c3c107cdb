"""From raw documents to token files: five stages, each an operator of termloom.llm.

Quality rules reject documents, near duplicates keep one document of a group, contaminated documents go,
sources are mixed to their target weights, and what is taken is written as token ids and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import decontaminate, mixing, near_dedup, quality_rules, token_output
from termloom.llm.common import Scope, stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_output", token_output.stage),
]

#: Near duplicates, templates and tokens can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written as Parquet, read by the next and deleted behind it."""
    docs = table(spark, sf_dir, "documents")
    with Scope(spark) as whole:
        for name, stage in STAGES[:-1]:
            with Scope(spark) as own:
                kept = stored(stage(spark, docs, sf_dir), name)
                own.keep(kept)
            whole.drop(docs)
            docs = kept
        out = STAGES[-1][1](spark, docs, sf_dir)
        # the result is read from what the last stage has stored
        whole.keep(*[df for df, _ in whole.tables if df is not docs])
    return out
