"""A training corpus from raw documents: five stages, each written before the next one reads it.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. The last one returns packed pieces; the others return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, read_table
from tidewell.llm.decontaminate import drop_contaminated
from tidewell.llm.jaccard import keep_one
from tidewell.llm.packing import pack
from tidewell.llm.pii import redact
from tidewell.llm.quality import keep_good
from tidewell.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the thresholds of their language and source keep.

    A null text has no words, so it goes; a null language or source is a value of
    its own; repeated rows are judged alike. No rows give none, and columns of
    any name stay as they are.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 on five-word shingles join.

    The smallest doc_id stays; a null one only if its group has no other. Rows
    equal in doc_id and text are one; texts without words are in no group. No
    rows give none, and other columns stay as they are.
    """
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by the rule of a twentieth of their words.

    A text that is null or has no words is never contaminated, nor does such an
    item contaminate; repeated rows share a verdict. No rows give none, no items
    keep all, and other columns stay as they are.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null texts, repeated rows and all other columns stay as they are, but for
    n_chars, which follows the new text. No rows give none.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids.

    The last stage: it returns pieces in place of the columns of documents. A
    null text is its end id alone; null and repeated identifiers are packed row
    by row. No rows give no pieces.
    """
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL can't express the tokenizer and the conditional random field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
