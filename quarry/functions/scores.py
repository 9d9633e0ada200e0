"""Normalisations of scores within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int | None, by: str | list[str] = "qid", score: str = "score", tie: str = "docid", rank: str = "rank") -> DataFrame:
    """df with rank from 1 by score descending, then tie ascending, cut at k."""
    keys = [by] if isinstance(by, str) else by
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))))
    cut = ranked if k is None else ranked.where(F.col(rank) <= k)
    return cut.withColumn(rank, F.col(rank).cast("long"))


def minmax(value: Column, by: str = "qid") -> Column:
    """(x - min) / (max - min) within a group, over a range of 1 where all are equal."""
    w = W.partitionBy(by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return (value - F.min(value).over(w)) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def minmax_half(value: Column, by: str = "qid") -> Column:
    """Scaled to 0.5 to 1; 0.75 where all are equal."""
    w = W.partitionBy(by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return F.when(span == 0, F.lit(0.75)).otherwise(0.5 + 0.5 * (value - F.min(value).over(w)) / F.nullif(span, F.lit(0.0)))


def softmax(value: Column, by: str = "qid") -> Column:
    """exp(x - logsumexp) within a group."""
    w = W.partitionBy(by)
    return F.exp(value - F.max(value).over(w))


def probability(df: DataFrame, score: str = "score", by: str = "qid", name: str = "weight") -> DataFrame:
    """df with scores as shares of their sum; by softmax where any is negative; 0 where the sum is 0."""
    w = W.partitionBy(by)
    raised = F.exp(F.col(score) - F.max(score).over(w))
    total = F.sum(score).over(w)
    soft = F.col("_raised") / F.sum("_raised").over(w)
    share = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.col(score) / F.nullif(F.col("_total"), F.lit(0.0)))
    staged = df.withColumn("_raised", raised).withColumn("_total", total).withColumn("_soft", soft).withColumn("_low", F.min(score).over(w))
    return staged.withColumn(name, F.when(F.col("_low") < 0, F.col("_soft")).otherwise(share)).drop("_raised", "_total", "_soft", "_low")


def posterior(df: DataFrame, score: str = "score", by: str = "qid", name: str = "posterior") -> DataFrame:
    """df with exp(score - logsumexp(score)) within a group."""
    w = W.partitionBy(by)
    staged = df.withColumn("_raised", F.exp(F.col(score) - F.max(score).over(w)))
    return staged.withColumn(name, F.col("_raised") / F.sum("_raised").over(w)).drop("_raised")
