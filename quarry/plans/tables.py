"""The tables that the registered queries start from, derived from the given ones. Same definitions as in prelude.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.blocks import Blocks, read_blocks, write_blocks
from quarry.operators.cells import CellFile, read_cells, write_cells
from quarry.operators.lexical import Index, bm25, rm3, stored_index, weighted
from quarry.sources.stored import folder_of, stored, version


class Tables:
    """Tables of one data folder. The index, the runs and the judgments are written once a session and folder, to the shared
    folder, and read by everything else; the rest are plans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._key: tuple | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def key(self) -> tuple:
        if self._key is None:
            self._key = (self.dir, version(self.spark, self.dir))
        return self._key

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return stored(self.spark, (name, *self.key), make)

    @property
    def queries(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    @property
    def docs(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("docid"), "text")

    @property
    def index(self) -> Index:
        return stored_index(self.spark, self.key, lambda: self.docs)

    @property
    def blocks(self) -> Blocks:
        """The index in blocks over shards, built once a session from the index."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = lambda folder: f"blocks_{folder.rpartition('/')[2]}"
        folder = folder_of(self.spark, ("blocks", *self.key), lambda f: write_blocks(self.index, f, name(f), buckets))
        return read_blocks(self.spark, folder, name(folder))

    def bm25(self) -> DataFrame:
        return bm25(self.queries, self.index, 100)

    def expanded(self) -> DataFrame:
        return rm3(self.queries, self.index, self.run_a)

    def boosted(self) -> DataFrame:
        return weighted(self.rm3_terms.select("qid", "term", "weight"), self.index, 100)

    @property
    def run_a(self) -> DataFrame:
        return self.stored("run_a", self.bm25)

    @property
    def rm3_terms(self) -> DataFrame:
        return self.stored("rm3", self.expanded)

    @property
    def run_b(self) -> DataFrame:
        return self.stored("run_b", self.boosted)

    @property
    def qrels(self) -> DataFrame:
        def make() -> DataFrame:
            opening = F.lower(F.substring("query", 1, 40))
            judged = self.run_a.select("qid", "docid").join(self.queries, "qid").join(self.docs, "docid").join(self.read("labels").select(F.col("doc_id").alias("docid"), "quality"), "docid", "left")
            grade = F.when(F.contains(F.lower("text"), opening), 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
            return judged.select("qid", "docid", grade.cast("int").alias("grade")).where("grade IS NOT NULL")

        return self.stored("qrels", make)

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")

    @property
    def dq(self) -> DataFrame:
        """The stated query set: vectors whose id is divisible by 100, searched against all."""
        return self.vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "v", "label")

    @property
    def dd(self) -> DataFrame:
        return self.vectors.select(F.col("vec_id").alias("docid"), "v", "label")

    @property
    def tokvec(self) -> DataFrame:
        return self.vectors.select(F.floor(F.col("vec_id") / 4).alias("docid"), (F.col("vec_id") % 4).cast("int").alias("pos"), F.col("label").alias("tokid"), "v")

    @property
    def qtok(self) -> DataFrame:
        return self.tokvec.where("docid % 25 = 0").select(F.col("docid").alias("qid"), F.col("pos").alias("qpos"), "tokid", F.lit(1.0).alias("weight"), "v")

    def _cells(self, name: str, vectors: Callable[[], DataFrame], keys: tuple[str, ...], k: int) -> CellFile:
        folder = folder_of(self.spark, (name, *self.key), lambda f: write_cells(vectors(), keys, f, k))
        return read_cells(self.spark, folder, keys)

    @property
    def cells(self) -> CellFile:
        """The vectors by cells, built once a session like the index."""
        return self._cells("cells", lambda: self.dd.select("docid", "v"), ("docid",), 10)

    @property
    def token_cells(self) -> CellFile:
        return self._cells("token cells", lambda: self.tokvec, ("docid", "pos", "tokid"), 20)

    @property
    def dqrels(self) -> DataFrame:
        near = F.explode(F.array(*(F.col("label") + k for k in (-1, 0, 1)))).alias("label")  # so that labels are joined by equality
        pairs = self.dq.select("qid", F.col("label").alias("ql"), near).join(self.dd.select("docid", "label"), "label")
        return pairs.select("qid", "docid", F.when(F.col("label") == F.col("ql"), 2).otherwise(1).alias("grade"))

    def judged(self, run: DataFrame) -> DataFrame:
        """The rows of dqrels for the pairs that a run holds; all of dqrels grow with the square of the vectors."""
        pairs = run.select("qid", "docid").distinct().join(self.dq.select("qid", F.col("label").alias("ql")), "qid").join(self.dd.select("docid", "label"), "docid")
        return pairs.select("qid", "docid", F.when(F.col("label") == F.col("ql"), 2).when(F.abs(F.col("label") - F.col("ql")) == 1, 1).alias("grade")).where("grade IS NOT NULL")

    @property
    def dcounts(self) -> DataFrame:
        """(qid, grade, n): how many rows of dqrels a query has of a grade."""
        near = F.explode(F.array(*(F.col("label") + k for k in (-1, 0, 1)))).alias("label")
        sizes = self.dd.groupBy("label").agg(F.count("*").alias("n"))
        pairs = self.dq.select("qid", F.col("label").alias("ql"), near).join(F.broadcast(sizes), "label")
        return pairs.groupBy("qid", F.when(F.col("label") == F.col("ql"), 2).otherwise(1).alias("grade")).agg(F.sum("n").alias("n"))

    @property
    def history(self) -> DataFrame:
        day = F.dayofyear("ts")
        return self.read("events").groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("score"))

    def events_index(self) -> DataFrame:
        """Indexes as a search would return them, some beyond the vectors there are."""
        return self.read("events").select((F.col("event_id") * 3).alias("idx"))
