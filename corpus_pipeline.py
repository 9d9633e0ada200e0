"""A training-data pipeline over documents: toxicity, near duplicates, benchmark contamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further columns there are. A stage works on all
that its predecessor kept. Null and empty texts are clean, have no near duplicates and size 0, and stay to the end. Rows of
one doc_id share its fate; rows with a null doc_id can't be told apart by it, so only the toxic ones among them go. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, without, written
from quarry.llm.decontamination import remove_leaking
from quarry.llm.mixing import mix
from quarry.llm.near_duplicates import near_duplicates
from quarry.llm.privacy import find_spans, learn, redact
from quarry.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels that are held out by op6 stay out of learning here too."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    return without(docs, written(gone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return remove_leaking(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text, and n_chars follows; no document goes."""
    # the other columns go along as one struct, so that no name of theirs clashes; the text goes once
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), "text")
    clean = redact(find_spans(rows, learn(docs.select("text"))))
    chars = F.when(F.col("text").isNull(), F.col("doc")["n_chars"]).otherwise(F.char_length("text").cast("long"))
    return clean.select(*(F.col("text") if c == "text" else (chars if c == "n_chars" else F.col("doc")[c]).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left: doc_id, source, size, source_size, target, taken."""
    documents, _ = mix(docs.select("doc_id", "text", "source"))
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: The learned stages cannot be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
