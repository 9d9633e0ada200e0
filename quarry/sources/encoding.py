"""Encoding a corpus into vectors as a job that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import l2norm
from quarry.operators.dense import norm_stats

Encoder = Callable[[DataFrame, str, str], DataFrame]


def _finished(spark: SparkSession, out: str) -> set[int]:
    """Numbers of the shards in the ledger: each has a folder that was made when its vectors were complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(at)} if files.exists(at) else set()


def _mark(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def encode(docs: DataFrame, encoder: Encoder, out: str, key: str = "docid", text: str = "text", shards: int = 16, normalise: bool = True, at_most: int | None = None) -> list[int]:
    """Encodes docs into out/vectors (key, v) by an encoder of tables, and returns the shards that this call encoded.

    Documents are dealt by a hash of their key into `shards` folders, once; each shard is then encoded, written, and entered
    in the ledger when it is complete. A call with the same folder skips what the ledger holds, so a job that was killed is
    taken up at its first unfinished shard, which is written anew. at_most ends a call after so many shards. A shard is an
    ordinary distributed job: choose their number for how much work may be lost, not for what a machine holds.
    """
    spark = docs.sparkSession
    if -1 not in _finished(spark, out):
        dealt = docs.select(key, text).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
        dealt.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{out}/documents")
        _mark(spark, f"{out}/ledger/shard=-1")
    rows, done, now = spark.read.parquet(f"{out}/documents"), _finished(spark, out), []
    there = sorted(r["shard"] for r in rows.select("shard").distinct().collect())
    for shard in [s for s in there if s not in done][:at_most]:
        vectors = encoder(rows.where(F.col("shard") == shard).drop("shard"), key, text)
        vectors = vectors.withColumn("v", l2norm(F.col("v"))) if normalise else vectors
        vectors.write.mode("overwrite").parquet(f"{out}/vectors/shard={shard}")
        _mark(spark, f"{out}/ledger/shard={shard}")
        now.append(shard)
    return now


def encoded(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of the finished shards, and the statistics of their norms."""
    done = sorted(_finished(spark, out) - {-1})
    vectors = spark.read.parquet(f"{out}/vectors").where(F.col("shard").isin(done)).drop("shard")
    return vectors, norm_stats(vectors)
