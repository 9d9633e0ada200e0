"""Postings in blocks over shards of the documents, and retrieval that leaves out the blocks that cannot matter.

A term's postings are dealt over shards by document and lie there in blocks, greatest parts first, each with its greatest
part. A term that very many documents hold is spread over all buckets of the table, and a query reads only those of its
blocks whose documents can still reach its k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.operators.lexical import Index

#: Postings of a block, and documents of a shard, about.
BLOCK, SHARD = 128, 100_000
#: Scores are rounded to six decimals, so bounds are compared with a margin.
MARGIN = 2e-6


@dataclass(frozen=True)
class Blocks:
    """blocks (term, shard, block, n, most, entries array<struct<docid, part>>), terms (term, df), stats (one row: n, avgdl,
    total, shards)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def write_blocks(index: Index, folder: str, name: str, buckets: int, k1: float = 1.2, b: float = 0.75) -> None:
    """The blocks of an index, with BM25 parts before weight and idf; bucketed and sorted by term and shard, so that a join on
    these needs no exchange of the blocks. name: of the table in the catalog, whose files lie in folder."""
    one = index.stats.first()
    shards = max(buckets, -(-one["n"] // SHARD))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(one["avgdl"])))
    placed = index.postings.join(index.doclen, "docid").select("term", F.pmod(F.xxhash64("docid"), F.lit(shards)).cast("int").alias("shard"), "docid", part.alias("part"))
    # a shard holds about SHARD documents at most, and so does a term within it
    nth = F.row_number().over(W.partitionBy("term", "shard").orderBy(F.desc("part"), "docid"))
    blocks = placed.withColumn("block", F.floor((nth - 1) / BLOCK).cast("int")).groupBy("term", "shard", "block").agg(
        F.count("*").alias("n"), F.max("part").alias("most"), F.collect_list(F.struct("docid", "part")).alias("entries")
    )
    table = blocks.repartition(buckets, "term", "shard").sortWithinPartitions("term", "shard")
    table.write.bucketBy(buckets, "term", "shard").sortBy("term", "shard").option("path", f"{folder}/blocks").saveAsTable(name)
    index.postings.sparkSession.table(name).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/terms")
    index.stats.withColumn("shards", F.lit(shards)).write.parquet(f"{folder}/stats")


def read_blocks(spark: SparkSession, folder: str, name: str) -> Blocks:
    return Blocks(spark.table(name), spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/stats"))


def _wanted(terms: DataFrame, index: Blocks, keys: list[str]) -> DataFrame:
    """(keys, term, shard, gain): each term of a query in each shard, with its weight times idf."""
    one = index.stats.first()
    idf = F.log(1 + (F.lit(one["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(index.terms, "term").select(*keys, "term", (F.col("weight") * idf).alias("gain"))
    return weighed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(one["shards"] - 1))))


def _parts(wanted: DataFrame, index: Blocks, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, docid, score): summed parts of the documents in the wanted blocks."""
    met = wanted.join(index.blocks.select("term", "shard", "block", "entries"), on)
    rows = met.select(*keys, "gain", F.inline("entries"))
    return rows.groupBy(*keys, "docid").agg(F.sum(F.col("gain") * F.col("part")).alias("score"))


def chosen_blocks(terms: DataFrame, index: Blocks, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, term, shard, block, gain, n, read): every block of each query's terms, and whether it has to be read.

    The first block of each term and shard is scored; what these add up to is at most a document's score, so the k-th of these
    sums is at most the k-th score. The most that a document of a block can have is the block's greatest part and, of the
    other terms, the greatest of the shard.
    """
    by = list(keys)
    wanted = _wanted(terms, index, by)
    first = _parts(wanted.withColumn("block", F.lit(0)), index, by, ["term", "shard", "block"])
    reached = top_k(first, k, by).where(F.col("rank") == k).select(*by, F.col("score").alias("reached"))
    heads = wanted.join(index.blocks.select("term", "shard", "block", "n", "most"), ["term", "shard"]).withColumn("bound", F.col("gain") * F.col("most"))
    in_shard = W.partitionBy(*by, "shard")
    heads = heads.withColumn("others", F.sum(F.when(F.col("block") == 0, F.col("bound"))).over(in_shard) - F.max("bound").over(W.partitionBy(*by, "shard", "term")))
    bounded = heads.join(reached, by, "left")
    read = F.col("reached").isNull() | (F.col("bound") + F.col("others") >= F.col("reached") - MARGIN)
    return bounded.select(*by, "term", "shard", "block", "gain", "n", read.alias("read"))


def retrieve_blocks(terms: DataFrame, index: Blocks, k: int = 1000, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, docid, score, rank): the best k documents of each weighted bag of terms (keys, term, weight), weights at least 0;
    the same rows as lexical.retrieve() gives. Scores to 6 decimals."""
    by = list(keys)
    chosen = chosen_blocks(terms, index, k, keys).where("read").select(*by, "term", "shard", "block", "gain")
    scored = _parts(chosen, index, by, ["term", "shard", "block"])
    return top_k(scored.withColumn("score", F.round("score", 6)), k, by)


def block_report(terms: DataFrame, index: Blocks, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(blocks, read, postings, postings_read) of all queries together."""
    found = chosen_blocks(terms, index, k, keys)
    return found.agg(F.count("*").alias("blocks"), F.count_if("read").alias("read"), F.sum("n").alias("postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("postings_read"))
