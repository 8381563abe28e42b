"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written before the
next stage reads it; all but the last return the columns of ``documents``. Stages leave nulls,
repeated rows and further columns in place unless they remove the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.llm import decontamination, jaccard_join, mixing, suffix_dedup, toxicity
from pricelens.tables import checkpointed, table

#: A document goes at this toxicity score or more.
TOXIC = 0.5


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> list:
    """The columns of documents with another text, and its length where they have one."""
    return [F.col(text).alias(c) if c == "text" else F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, scored by a model of all labels; null and empty texts score 0 and stay."""
    weights = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    named = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))
    clean = toxicity.score(named, weights, keep_text=True).where(F.col("score") < TOXIC)
    return clean.select(*(F.col(c if c == "text" else f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones; documents without words stay."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes under repeated strings, and their new length; no row goes."""
    columns = docs.columns
    named = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(columns)))
    cut = suffix_dedup.remove_repeats(named)
    cut = cut.select(*(F.col("kept" if c == "text" else f"_{i}").alias(c) for i, c in enumerate(columns)))
    return cut.select(*_with_text(docs, "text", columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    columns = docs.columns
    named = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(columns)))
    clean = decontamination.decontaminate(named, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated"))
    return clean.select(*(F.col(c if c == "text" else f"_{i}").alias(c) for i, c in enumerate(columns)))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_to_weights),
]

#: Not expressible: a trained model decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
