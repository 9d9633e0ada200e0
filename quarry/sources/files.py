"""Readers and writers of run, judgment, evaluation, feature, query, document, vector and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import norm


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != ''")
    return lines.select(F.split("line", r"\s+").alias("f"), F.monotonically_increasing_id().alias("line_no"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank, score, tag) of lines `qid Q0 docid rank score tag`; shorter lines are skipped, fields that aren't numbers are null."""
    rows = _fields(spark, path).where(F.size("f") >= 6)
    return rows.select(_at(0).alias("qid"), _at(2).alias("docid"), _at(3).try_cast("int").alias("rank"), _at(4).try_cast("double").alias("score"), _at(5).alias("tag"))


def read_run_short(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank, score): full lines as above, 3 to 5 fields as `qid docid rank` with the rank as the score."""
    n = F.size("f")
    rows = _fields(spark, path).where(n >= 3)
    rank = F.when(n >= 6, _at(3)).otherwise(_at(2)).try_cast("int")
    score = F.when(n >= 6, _at(4).try_cast("double")).otherwise(_at(2).try_cast("double"))
    return rows.select(_at(0).alias("qid"), F.when(n >= 6, _at(2)).otherwise(_at(1)).alias("docid"), rank.alias("rank"), score.alias("score"))


def run_lines(run: DataFrame, tag: str = "run") -> DataFrame:
    """Lines of a run file, ranks from 1 in each query by score, ties by docid."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    return run.withColumn("rank", rank).select("qid", "rank", F.format_string("%s Q0 %s %d %.6f " + tag, F.col("qid").cast("string"), F.col("docid").cast("string"), "rank", "score").alias("value"))


def write_trec_run(run: DataFrame, path: str, tag: str = "run") -> None:
    run_lines(run, tag).repartition("qid").sortWithinPartitions("qid", "rank").select("value").write.text(path)


def resort_run(run: DataFrame, base: int = 0) -> DataFrame:
    """run with ranks by score again, from base."""
    return run.withColumn("rank", (F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "docid")) - 1 + base).cast("long"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, grade): comments, short lines and grades that aren't numbers are dropped; of repeated pairs the last line counts."""
    rows = _fields(spark, path).where((F.size("f") >= 4) & ~_at(0).startswith("#"))
    graded = rows.select(_at(0).alias("qid"), _at(2).alias("docid"), _at(3).try_cast("int").alias("grade"), "line_no").where("grade IS NOT NULL")
    return graded.groupBy("qid", "docid").agg(F.max_by("grade", "line_no").alias("grade"))


def qrels_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.format_string("%s 0 %s %d", F.col("qid").cast("string"), F.col("docid").cast("string"), "grade").alias("value"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels_lines(qrels).write.text(path)


def read_eval(spark: SparkSession, path: str, layout: str = "trec_eval") -> DataFrame:
    """(metric, qid, value) of `metric qid value` or, with layout="galago", `qid metric value`."""
    metric, qid = (0, 1) if layout == "trec_eval" else (1, 0)
    return _fields(spark, path).where(F.size("f") >= 3).select(_at(metric).alias("metric"), _at(qid).alias("qid"), _at(2).try_cast("double").alias("value"))


_FEATURES = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("query_text", T.StringType()),
    T.StructField("term_features", T.MapType(T.StringType(), T.StructType([T.StructField("rm_weight", T.DoubleType()), T.StructField("semantic_score", T.DoubleType()), T.StructField("original_term", T.StringType())]))),
    T.StructField("num_expansion_terms", T.IntegerType()),
])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text, term_features, num_expansion_terms) of JSON lines, plain or gzip; malformed lines are dropped, of a repeated id the last counts."""
    rows = spark.read.schema(_FEATURES).option("mode", "DROPMALFORMED").json(path).where("query_id IS NOT NULL").withColumn("line_no", F.monotonically_increasing_id())
    last = rows.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("line_no"))))
    return last.where("nth = 1").drop("nth", "line_no")


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.option("compression", "gzip" if compress else "none").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a tab-separated file. A first line that holds a key word names the columns; else the first two are
    taken; a file of one column gets ids q1, q2, ... in its order. Blank queries are dropped."""
    head = spark.read.text(path).first()
    names = (head["value"] if head else "").lower().split("\t")
    has_header = any(n.strip() in ("qid", "query_id", "id", "query", "text", "title", "topic") for n in names)
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("line_no"))
    if has_header:
        rows = rows.where(F.lower(F.concat_ws("\t", "f")) != "\t".join(names))
    width = len(names)
    if width == 1:
        numbered = rows.where(F.trim(_at(0)) != "").withColumn("n", F.row_number().over(W.orderBy("line_no")))  # a query file
        return numbered.select(F.concat(F.lit("q"), F.col("n").cast("string")).alias("qid"), _at(0).alias("query"))
    id_at = next((i for i, n in enumerate(names) if n.strip() in ("qid", "query_id", "id")), 0) if has_header else 0
    text_at = next((i for i, n in enumerate(names) if n.strip() in ("query", "text", "title", "topic")), 1) if has_header else 1
    return rows.select(_at(id_at).alias("qid"), _at(text_at).alias("query")).where("trim(query) != ''")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(docid, text) of JSON lines with doc_id and doc_text, id and text, or docno and text; other shapes are skipped."""
    schema = "doc_id string, doc_text string, id string, text string, docno string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.coalesce("doc_id", "id", "docno").alias("docid"), F.coalesce("doc_text", "text").alias("text")).where("docid IS NOT NULL AND text IS NOT NULL")


def validate_documents(rows: DataFrame, sample: int = 100, shown: int = 3, least: float = 0.9) -> DataFrame:
    """Counts over a sample of raw JSON lines (value): valid, invalid, rate, the names seen, the first `shown` lines of the sample
    as they came, and an alarm where the rate is under `least`."""
    head = rows.limit(sample).withColumn("names", F.json_object_keys("value")).withColumn("nth", F.monotonically_increasing_id())
    has = lambda n: F.coalesce(F.array_contains("names", n), F.lit(False))
    valid = (has("doc_id") & has("doc_text")) | (has("id") & has("text")) | (has("docno") & has("text"))
    rate = F.avg(valid.cast("int"))
    lines = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("nth", "value"))), 1, shown), lambda s: s["value"])
    return head.agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.round(rate, 6).alias("rate"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("names"),
        lines.alias("samples"), F.coalesce(rate < least, F.lit(False)).alias("alarm"),
    )


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors as Parquet in single precision, and a one-row table of what they are beside it: n, dim, and whether all have
    length 1 (within a thousandth)."""
    vectors.withColumn("v", F.col("v").cast("array<float>")).write.parquet(f"{path}/vectors")
    unit = F.abs(norm(F.col("v").cast("array<double>")) - 1) < 1e-3
    vectors.sparkSession.read.parquet(f"{path}/vectors").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.coalesce(F.bool_and(unit), F.lit(False)).alias("normalised")).write.parquet(f"{path}/about")


def about_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/about")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").withColumn("v", F.col("v").cast("array<double>"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a bundle that are there."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as missing:  # noqa: BLE001  only a missing path is tolerated
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return found


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.option("header", True).csv(path) if kind == "csv" else df.write.json(path)
