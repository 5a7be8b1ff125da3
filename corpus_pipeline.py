"""The corpus pipeline: documents through five of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm.bpe import bpe_stage
from sparkquarry.llm.decontaminate import decontaminate_stage
from sparkquarry.llm.jaccard_join import jaccard_stage
from sparkquarry.llm.language_id import language_stage
from sparkquarry.llm.line_dedup import line_stage
from sparkquarry.llm.shared import cut, free, table

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the learned and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        free(*before)
        before = [docs]
    return docs
