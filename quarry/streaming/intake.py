"""Incremental intake: documents and postings, resumable by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import analyze
from quarry.operators.lexical import Index


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_postings(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends postings (term, docid, tf) of each batch of documents to a folder of its own number, so that a batch that is
    repeated after a failure replaces itself; ends when all that is there has been taken."""

    def append(batch: DataFrame, number: int) -> None:
        postings = analyze(batch.withColumnRenamed("doc_id", "docid"), "docid", "text").groupBy(F.col("stem").alias("term"), "docid").agg(F.count("*").alias("tf"))
        postings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Rows taken so far, and rows a second of the last batch."""
    reports = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in reports), "rows_per_second": reports[-1]["processedRowsPerSecond"] if reports else 0.0, "batches": len(reports)}


def stream_segments(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of documents (doc_id, text) as a segment of its own number: postings (term, docid, tf) and the ids of
    its documents, without terms too. Of a document that comes twice in a batch one row, the least text, counts. A batch that
    is repeated after a failure replaces its segment. Ends when all that is there has been taken."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("docid")).agg(F.min("text").alias("text"))
        analyze(rows, "docid", "text").groupBy(F.col("stem").alias("term"), "docid").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        rows.select("docid").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def _latest(spark: SparkSession, out: str) -> int | None:
    """The last merge that was finished."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/merged")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    done = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(at) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "stats/_SUCCESS"))]
    return max(done, default=None)


def _counted(postings: DataFrame, sign: int) -> DataFrame:
    return postings.groupBy("term").agg((sign * F.count("*")).alias("df"), (sign * F.sum("tf")).alias("cf"))


def merge_segments(spark: SparkSession, out: str) -> Index:
    """The index of all segments so far: those since the last merge are merged into it, and the result is the next merge.

    Of a document that came again the last segment counts. The merge's postings are read once to leave out the documents that
    were replaced, and written anew; document frequencies and the sums of lengths are changed by what the new documents add
    and the replaced ones take away, not counted again. A merge is complete when its last table, stats, is; one that was cut
    off is not read and is written again.
    """
    last = _latest(spark, out)
    held = lambda part, schema: _read(spark, f"{out}/merged/n={last}/{part}", schema)
    old, lengths = held("postings", "term string, docid long, tf long"), held("doclen", "docid long, dl long")
    terms, stats = held("terms", "term string, df long, cf long"), held("stats", "n long, total long, upto long, avgdl double")
    upto = (stats.first() or {"upto": -1})["upto"]
    arrived = _read(spark, f"{out}/documents", "docid long, batch int").where(F.col("batch") > upto)
    highest = arrived.agg(F.max("batch").alias("b")).first()["b"]
    if highest is not None:
        newest = arrived.groupBy("docid").agg(F.max("batch").alias("batch"))
        fresh = _read(spark, f"{out}/postings", "term string, docid long, tf long, batch int").where(F.col("batch") > upto).join(newest, ["docid", "batch"], "left_semi").select("term", "docid", "tf")
        gone, ids = old.join(newest, "docid", "left_semi"), newest.select("docid")
        folder = f"{out}/merged/n={0 if last is None else last + 1}"
        old.join(ids, "docid", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(f"{folder}/postings")
        added = fresh.groupBy("docid").agg(F.sum("tf").alias("dl"))
        lengths.join(ids, "docid", "left_anti").unionByName(added).write.mode("overwrite").parquet(f"{folder}/doclen")
        changed = terms.unionByName(_counted(fresh, 1)).unionByName(_counted(gone, -1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        changed.where("df > 0").write.mode("overwrite").parquet(f"{folder}/terms")
        sums = [added.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")), lengths.join(ids, "docid", "left_semi").agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("total"))]
        total = stats.select("n", "total").unionByName(sums[0]).unionByName(sums[1]).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        total.select("n", "total", F.lit(highest).cast("long").alias("upto"), (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")
        last = 0 if last is None else last + 1
        held = lambda part, schema: spark.read.parquet(f"{out}/merged/n={last}/{part}")
    return Index(held("postings", "term string, docid long, tf long"), held("doclen", "docid long, dl long"), held("stats", "n long, total long, upto long, avgdl double").select("n", "avgdl", "total"))


def merged_terms(spark: SparkSession, out: str) -> DataFrame:
    """(term, df, cf) as the last merge keeps them."""
    return _read(spark, f"{out}/merged/n={_latest(spark, out)}/terms", "term string, df long, cf long")
