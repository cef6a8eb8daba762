"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept. Rows without an id or text pass through
(an empty text is packed as its end token); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.llm import jaccard, line_dedup, pii
from basketry.llm import toxicity as toxic_language
from basketry.llm.common import forget, keep, prepare
from basketry.llm.queries import packed, table, toxicity_model


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The given columns with another text, and its length where one is kept."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather toxic than not go."""
    model = toxicity_model(prepare(spark), docs, sf_dir)
    return docs.where(toxic_language.score(F.col("text"), model) < 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, if need be empty."""
    done = line_dedup.dedup_lines(docs, "doc_id", "text", min_chars=10)
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return _with_text(done, kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays."""
    found = jaccard.similar_documents(docs, "doc_id", "text", words=5, percent=75)
    extra = found.where("component_id <> doc").select("doc").distinct()
    return docs.join(extra, docs["doc_id"] == extra["doc"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    model = pii.learn(docs, "doc_id", "text")
    rows = docs.select(F.struct("*").alias("row"), pii.find(F.col("text"), model).alias("found"))
    masked = rows.select("row", pii.mask(F.col("row.text"), F.col("found.spans")).alias("masked"))
    return _with_text(masked, F.col("masked"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised, cut and packed; ``ids`` holds the training data."""
    # Executors still hold memory of the stages before.
    return packed(prepare(spark), docs, with_ids=True, cache_bytes=64 * 1024**2, together=1024**2)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned scores, components and packing are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)  # the last one's table stays: the result reads it
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
