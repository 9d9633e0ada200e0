"""Inverted files of vectors: cells around k-means centres, stored as partitions of a table and probed by queries.

How many cells a query has to probe is measured when the file is built, on a sample of the vectors themselves, and stored
with it; searching reads the probed partitions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.samples import bounded
from quarry.functions.scores import top_k
from quarry.operators import nearest
from quarry.operators.dense import cells, ivf_build

#: Vectors by which the number of probes is measured, at most, and the share of their exact neighbours that must be met.
MEASURED, TARGET = 200, 0.95


@dataclass(frozen=True)
class CellFile:
    """vectors (the given columns, v, cell) in a folder for each cell, centres (cell, v, n), the columns that name a vector,
    and what was measured: probes, and the recall that they reached on the sample."""

    vectors: DataFrame
    centres: DataFrame
    keys: tuple[str, ...]
    probes: int
    recall: float


def write_cells(vectors: DataFrame, keys: tuple[str, ...], folder: str, k: int = 10, lists: int | None = None, target: float = TARGET, kind: str = "cosine") -> None:
    """The cell file of vectors (keys, v, any others) in a folder: tables `vectors`, `centres` and `measured`.

    Cells that very many vectors fall into are written by several tasks. The sample's exact neighbours come from one scan of
    all vectors against at most MEASURED of them.
    """
    spark, n = vectors.sparkSession, vectors.count()
    assigned, centres = ivf_build(vectors.select(F.struct(*keys).alias("docid"), "v", F.struct("*").alias("row")), lists or cells(n)[0])
    assigned.select("row.*", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
    held = spark.read.parquet(f"{folder}/vectors")
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, v array<double>")
    table.join(F.broadcast(sizes), "cell").coalesce(1).write.parquet(f"{folder}/centres")
    table = spark.read.parquet(f"{folder}/centres")
    sample = bounded(held.select(F.struct(*keys).alias("qid"), "v"), MEASURED, "qid")
    near = nearest.best(sample, held, list(keys), k + 1, kind).where(F.struct(*keys) != F.col("qid"))
    met = top_k(near.withColumn("_key", F.struct(*keys)), k, tie="_key").join(held.select(*keys, "cell"), list(keys)).select("qid", "cell")
    order = nearest.probing(sample, table, len(centres)).select("qid", F.posexplode("cells").alias("nth", "cell")).withColumn("nth", F.col("nth") + 1)
    found = met.join(order, ["qid", "cell"])
    probes = found.agg(F.ceil(F.percentile("nth", F.lit(target))).cast("int").alias("probes"))
    share = F.avg((F.col("nth") <= F.col("probes")).cast("double"))
    found.join(F.broadcast(probes), F.lit(True)).agg(F.coalesce(F.max("probes"), F.lit(1)).alias("probes"), F.coalesce(share, F.lit(1.0)).alias("recall")).coalesce(1).write.parquet(f"{folder}/measured")


def read_cells(spark: SparkSession, folder: str, keys: tuple[str, ...]) -> CellFile:
    measured = spark.read.parquet(f"{folder}/measured").first()
    return CellFile(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/centres"), keys, measured["probes"], measured["recall"])


def probed(index: CellFile, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(qid, cell, n) of the cells that each query (qid, v) probes."""
    each = nearest.probing(queries, index.centres, probes or index.probes).select("qid", F.explode("cells").alias("cell"))
    return each.join(F.broadcast(index.centres.select("cell", "n")), "cell").select("qid", "cell", "n")


def _wanted(index: CellFile, queries: DataFrame, probes: int | None) -> DataFrame:
    """The vectors in cells that any query probes. These cells, at most 4,096 numbers, are a filter on the partitions, so the
    others are not read."""
    each = nearest.probing(queries, index.centres, probes or index.probes).select(F.explode("cells").alias("cell")).distinct()
    return index.vectors.where(F.col("cell").isin([r["cell"] for r in each.collect()]))


def met(index: CellFile, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """queries' columns, `q`, and the columns of the vectors in the cells that each query probes."""
    near = probed(index, queries, probes).select("qid", "cell")
    asked = queries.withColumnRenamed("v", "q").join(near, "qid")
    return _wanted(index, queries, probes).join(asked, "cell").drop("cell")


def cell_search(index: CellFile, queries: DataFrame, k: int = 10, probes: int | None = None, kind: str = "cosine", rank: str = "rank") -> DataFrame:
    """(qid, keys, score, rank): the best k of the vectors that each query (qid, v) meets; they are compared cell by cell."""
    found = nearest.best(queries, _wanted(index, queries, probes), list(index.keys), k, kind, rank, index.centres, probes or index.probes)
    return found.withColumn(rank, F.col(rank).cast("long"))


def looked_at(index: CellFile, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(queries, looked_at): how many queries there are, and the share of all vectors that a query compares, on average."""
    total = index.centres.agg(F.sum("n").alias("total"))
    each = nearest.probing(queries, index.centres, probes or index.probes)
    return each.agg(F.count("*").alias("queries"), F.avg("n").alias("mean")).join(total, F.lit(True)).select("queries", (F.col("mean") / F.col("total")).alias("looked_at"))
