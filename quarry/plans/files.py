"""Queries that write derived tables to files and read them back, and incremental intake."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import mlp, rounded
from quarry.operators import lexical
from quarry.operators.dense import hashed_terms, norm_stats, pairs
from quarry.operators.evaluation import per_query
from quarry.operators.training import kfold
from quarry.plans.dense import MLP_1, MLP_2, MLP_3
from quarry.plans.interaction import _LETTERS
from quarry.plans.lexical import FEATURES
from quarry.plans.prelude import hashed, sql
from quarry.plans.tables import Tables
from quarry.sources import encoding, files
from quarry.sources.stored import shared_folder
from quarry.streaming import intake


def _folder(t: Tables) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/files/{uuid.uuid4().hex}"


def _run(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_trec_run(t.run_a, path, "a")
    return files.read_trec_run(t.spark, path)


def _short(t: Tables) -> DataFrame:
    path = _folder(t)
    t.run_a.select(F.concat_ws(" ", F.col("qid").cast("string"), F.col("docid").cast("string"), F.col("rank").cast("string")).alias("value")).write.text(path)
    return files.read_run_short(t.spark, path)


def _qrels(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_qrels(t.qrels, path)
    return files.read_qrels(t.spark, path)


def _eval(t: Tables) -> DataFrame:
    path = _folder(t)
    per_query(t.run_a, t.qrels, ("map", "p_10")).select(F.format_string("%s %d %.6f", "metric", "qid", "value").alias("value")).write.text(path)
    return files.read_eval(t.spark, path)


def _features(t: Tables) -> DataFrame:
    """(query_id, query_text, term_features, num_expansion_terms) of all queries, as a feature job would write them."""
    terms = lexical.term_features(t.queries, t.index, t.docs, t.run_a)
    entry = F.struct("term", F.struct("rm_weight", F.col("semantic").alias("semantic_score"), "original_term"))
    maps = terms.groupBy("qid").agg(F.map_from_entries(F.collect_list(entry)).alias("term_features"), F.count("*").cast("int").alias("num_expansion_terms"))
    return maps.join(t.queries, "qid").select(F.col("qid").cast("string").alias("query_id"), F.col("query").alias("query_text"), "term_features", "num_expansion_terms")


def _feature_file(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_jsonl(_features(t), path, compress=True)
    back = files.read_features(t.spark, path)
    return back.select("query_id", "num_expansion_terms", F.explode("term_features")).select("query_id", "num_expansion_terms", F.col("key").alias("term"), F.col("value.rm_weight").alias("rm_weight"), F.col("value.semantic_score").alias("semantic"), F.col("value.original_term").alias("original_term"))


def _query_file(t: Tables) -> DataFrame:
    path = _folder(t)
    t.queries.select(F.concat_ws("\t", F.col("qid").cast("string"), F.translate("query", "\n", " ")).alias("value")).write.text(path)
    return files.read_queries(t.spark, path)


def _document_lines(t: Tables) -> DataFrame:
    named = F.when(F.col("docid") % 3 == 0, F.to_json(F.struct(F.col("docid").cast("string").alias("doc_id"), F.col("text").alias("doc_text")))).when(F.col("docid") % 3 == 1, F.to_json(F.struct(F.col("docid").cast("string").alias("id"), "text")))
    return t.docs.select(F.coalesce(named, F.to_json(F.struct(F.col("docid").cast("string").alias("docno"), F.col("text").alias("body")))).alias("value"))


def _document_file(t: Tables) -> DataFrame:
    path = _folder(t)
    _document_lines(t).write.text(path)
    return files.read_documents(t.spark, path).select("docid", F.md5("text").alias("digest"))


def _vector_store(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_vectors(t.vectors.select("vec_id", "v"), path)
    return files.read_vectors(t.spark, path).select("vec_id", rounded(F.col("v"), signed=True).alias("v"))


def _about_vectors(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_vectors(t.vectors.select("vec_id", "v"), path)
    return files.about_vectors(t.spark, path)


def _bundle(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_bundle({"queries": t.queries, "qrels": t.qrels}, path)
    found = files.read_bundle(t.spark, path, ("queries", "qrels", "features"))
    rows = [df.agg(F.lit(name).alias("part"), F.count("*").alias("rows")) for name, df in found.items()]
    return rows[0].unionByName(rows[1])


def _report(t: Tables) -> DataFrame:
    path = _folder(t)
    files.write_report(kfold(t.queries), path)
    return t.spark.read.option("header", True).schema("fold long, split string, qid long").csv(path)


def _fold_folder(t: Tables) -> str:
    """documents as a folder of files, which a stream can watch."""
    path = _folder(t)
    t.read("documents").select("doc_id", "text").write.parquet(path)
    return path


def _streamed(t: Tables) -> DataFrame:
    out, state = _folder(t), _folder(t)
    query = intake.stream_postings(intake.stream_documents(t.spark, _fold_folder(t)), out, state)
    query.awaitTermination()
    return t.spark.read.parquet(out).select("term", "docid", "tf")


def _merged(t: Tables) -> DataFrame:
    """Postings of the documents after a first intake in which every tenth had another text, and a second one of all."""
    out, state, source = _folder(t), _folder(t), _folder(t)
    docs = t.read("documents").select("doc_id", "text")
    other = F.when(F.col("doc_id") % 10 == 0, F.concat_ws(" ", F.lit("replaced later"), "text")).otherwise(F.col("text"))
    for rows in (docs.where("doc_id % 3 != 1").select("doc_id", other.alias("text")), docs):
        rows.write.mode("append").parquet(source)
        intake.stream_segments(intake.stream_documents(t.spark, source), out, state).awaitTermination()
        index = intake.merge_segments(t.spark, out)
    return index.postings


def _merged_bm25(t: Tables) -> DataFrame:
    """BM25 over the index that two merges of streamed segments give."""
    out, state = _folder(t), _folder(t)
    source = _fold_folder(t)
    intake.stream_segments(intake.stream_documents(t.spark, source, files_at_once=1), out, state).awaitTermination()
    return lexical.bm25(t.queries, intake.merge_segments(t.spark, out), 100)


def _encoded(t: Tables) -> DataFrame:
    """Vectors of all documents from a job that is stopped after three shards and taken up again."""
    out = _folder(t)
    encoding.encode(t.docs, hashed_terms, out, shards=8, at_most=3)
    encoding.encode(t.docs, hashed_terms, out, shards=8)
    return encoding.encoded(t.spark, out)[0].select("docid", rounded(F.col("v")).alias("v"))


def _ingested(t: Tables) -> DataFrame:
    out, state = _folder(t), _folder(t)
    stream = intake.stream_documents(t.spark, _fold_folder(t)).select("doc_id", F.length("text").alias("chars"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


def _progress(t: Tables) -> DataFrame:
    """(rows, percent): what a finished stream over the documents has taken, of all there are."""
    out, state = _folder(t), _folder(t)
    query = intake.stream_postings(intake.stream_documents(t.spark, _fold_folder(t)), out, state)
    query.awaitTermination()
    done = intake.progress(query)["rows"]
    return t.read("documents").agg(F.lit(done).cast("long").alias("rows"), F.round(100.0 * F.lit(done) / F.count("*"), 6).alias("percent"))


def _letters(texts: pd.Series) -> pd.Series:
    """A supplied encoder: the counts of letters a to z, as a model would turn a batch of texts into vectors."""
    return texts.map(lambda text: np.bincount(np.frombuffer((text or "").lower().encode(), np.uint8), minlength=256)[97:123].astype(float).tolist())


def embed(docs: DataFrame, key: str, text: str, encoder) -> DataFrame:  # noqa: ANN001
    """(key, v) by an encoder of pandas series of texts, a batch at a time."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def encode(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            yield pd.DataFrame({key: rows[key], "v": encoder(rows[text])})

    return docs.select(key, text).mapInPandas(encode, schema)


def _by_query(t: Tables) -> DataFrame:
    """A grouped step: each query's rows with their share of its greatest score."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(score=(rows["score"] / rows["score"].max()).round(6))

    return t.run_a.select("qid", "docid", "score").groupBy("qid").applyInPandas(share, "qid long, docid long, score double")


def _pairs(t: Tables) -> DataFrame:
    return pairs(t.dq, t.dd)


QUERIES = {
    "read_trec_run": _run,
    "read_run_short": _short,
    "write_trec_run": lambda t: files.run_lines(t.run_a, "a").select("value"),
    "resort_trec_run": lambda t: files.resort_run(t.run_b),
    "read_qrels": _qrels,
    "write_qrels": lambda t: files.qrels_lines(t.qrels),
    "read_eval_per_query": _eval,
    "read_features_jsonl": _feature_file,
    "write_features_jsonl": lambda t: _features(t).select("query_id", "query_text", "num_expansion_terms"),
    "read_queries_tsv": _query_file,
    "read_documents_jsonl": _document_file,
    "validate_documents": lambda t: files.validate_documents(_document_lines(t).orderBy("value"), 100).select(F.expr("valid + invalid").alias("seen"), "names", F.size("samples").alias("shown")),
    "embeddings_about": _about_vectors,
    "save_load_embeddings": _vector_store,
    "save_load_dataset_bundle": _bundle,
    "write_report": _report,
    "stream_ingest_documents": _ingested,
    "stream_build_postings": _streamed,
    "stream_merge_segments": _merged,
    "stream_merged_bm25": _merged_bm25,
    "stream_progress": _progress,
    "embed_texts": lambda t: hashed_terms(t.docs, "docid", "text").select("docid", rounded(F.col("v")).alias("v")),
    "embed_job": _encoded,
    "embed_job_norms": lambda t: norm_stats(hashed_terms(t.docs, "docid", "text")),
    "encoder_udf": lambda t: embed(t.docs, "docid", "text", _letters),
    "mlp_score": lambda t: _pairs(t).select("qid", "docid", F.round(mlp(MLP_1, MLP_2, MLP_3)(F.col("q"), F.col("v")), 6).alias("score")),
    "by_query": _by_query,
    "pipe": lambda t: t.run_a.transform(lambda run: run.where("rank <= 10")).transform(lambda run: run.select("qid", "docid")),
}

_A = "SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid"
SQL = {
    "read_trec_run": sql("run_a", f"{_A}, rank::INT AS rank, score, 'a' AS tag FROM run_a"),
    "read_run_short": sql("run_a", f"{_A}, rank::INT AS rank, rank::DOUBLE AS score FROM run_a"),
    "write_trec_run": sql("run_a", "SELECT printf('%s Q0 %s %d %.6f a', qid::VARCHAR, docid::VARCHAR, rank, score) AS value FROM run_a"),
    "resort_trec_run": sql("run_b", "SELECT qid, docid, score, rank - 1 AS rank FROM run_b"),
    "read_qrels": sql("qrels", f"{_A}, grade FROM qrels"),
    "write_qrels": sql("qrels", "SELECT printf('%s 0 %s %d', qid::VARCHAR, docid::VARCHAR, grade) AS value FROM qrels"),
    "read_eval_per_query": sql(
        "qrels", "SELECT metric, qid, value FROM (SELECT 'map' AS metric, qid::VARCHAR AS qid, round(coalesce(ap / nullif(rel, 0), 0), 6) AS value FROM e UNION ALL SELECT 'p_10', qid::VARCHAR, round(hits / 10e0, 6) FROM e)",
        r="SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY qid ORDER BY r) AS hit FROM (SELECT qid, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid::VARCHAR DESC) AS r FROM run_a LEFT JOIN qrels USING (qid, docid))",
        e="SELECT * FROM (SELECT qid, coalesce(sum(hit / r) FILTER (grade > 0), 0) AS ap, count(*) FILTER (grade > 0 AND r <= 10) AS hits FROM r GROUP BY qid) JOIN (SELECT qid, count(*) FILTER (grade > 0) AS rel FROM qrels GROUP BY qid) USING (qid)",
    ),
    "read_features_jsonl": sql("rm3t", "SELECT qid::VARCHAR AS query_id, (count(*) OVER (PARTITION BY qid))::INT AS num_expansion_terms, term, rm_weight, semantic, original_term FROM feat", **FEATURES),
    "write_features_jsonl": sql("rm3t", "SELECT qid::VARCHAR AS query_id, query AS query_text, n::INT AS num_expansion_terms FROM q JOIN (SELECT qid, count(*) AS n FROM feat GROUP BY qid) USING (qid)", **FEATURES),
    "embeddings_about": sql("vecs", "SELECT count(*) AS n, max(len(v))::INT AS dim, bool_and(abs(sqrt(list_dot_product(v, v)) - 1) < 1e-3) AS normalised FROM vecs"),
    "validate_documents": """SELECT seen, least(3, seen)::INT AS shown, array_to_string(list_sort(list_distinct(flatten([CASE WHEN a > 0 THEN ['doc_id', 'doc_text'] ELSE [] END, CASE WHEN a < seen AND b > 0 THEN ['docno', 'body'] ELSE [] END, CASE WHEN a + b < seen THEN ['id', 'text'] ELSE [] END]))), ',') AS names
      FROM (SELECT least(100, count(*)) AS seen, count(*) FILTER (doc_id % 3 = 0) AS a, count(*) FILTER (doc_id % 3 = 2) AS b FROM documents)""",
    "save_load_dataset_bundle": sql("qrels", "SELECT 'queries' AS part, count(*) AS rows FROM q UNION ALL SELECT 'qrels', count(*) FROM qrels"),
    "stream_progress": "SELECT count(*) AS rows, 100e0 AS percent FROM documents",
    "embed_texts": sql("d", "SELECT docid, list_transform(v, lambda e: round(e, 6)) AS v FROM h", h=hashed("d", "docid", "text")),
    "embed_job": sql("d", "SELECT docid, list_transform(v, lambda e: round(e, 6)) AS v FROM h", h=hashed("d", "docid", "text")),
    "embed_job_norms": sql("d", "SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT sqrt(list_dot_product(v, v)) AS x FROM h)", h=hashed("d", "docid", "text")),
    "encoder_udf": sql("d", f"SELECT docid, {_LETTERS.format(x='text')} AS v FROM d"),
    "mlp_score": sql(
        "dq dd", "SELECT qid, docid, round(sum(h * [0.5e0, -0.25e0, 0.75e0, 1e0][k + 1]), 6) AS score FROM l2 GROUP BY qid, docid",
        hq="SELECT qid, j, sum(x * ((7 * i + 3 * j) % 11 - 5) / 20e0) AS a FROM (SELECT qid, unnest(range(0, 64)) AS i, unnest(v) AS x FROM dq), (SELECT unnest(range(8)) AS j) GROUP BY qid, j",
        hd="SELECT docid, j, sum(x * ((7 * (i + 64) + 3 * j) % 11 - 5) / 20e0) AS b FROM (SELECT docid, unnest(range(0, 64)) AS i, unnest(v) AS x FROM dd), (SELECT unnest(range(8)) AS j) GROUP BY docid, j",
        l2="SELECT qid, docid, k, greatest(0, sum(greatest(0, a + b) * ((5 * j + 2 * k) % 7 - 3) / 8e0)) AS h FROM hq JOIN hd USING (j), (SELECT unnest(range(4)) AS k) GROUP BY qid, docid, k",
    ),
    "read_queries_tsv": sql("q", "SELECT qid::VARCHAR AS qid, replace(query, chr(10), ' ') AS query FROM q"),
    "read_documents_jsonl": sql("d", "SELECT docid::VARCHAR AS docid, md5(text) AS digest FROM d WHERE docid % 3 < 2"),
    "save_load_embeddings": sql("vecs", "SELECT vec_id, list_transform(v, lambda e: round(e, 6)) AS v FROM vecs"),
    "write_report": sql("q", "SELECT fold, CASE WHEN own = fold THEN 'testing' ELSE 'training' END AS split, qid FROM (SELECT qid, row_number() OVER (ORDER BY md5('1:' || qid), qid) % 5 AS own FROM q), (SELECT unnest(range(5)) AS fold)"),
    "stream_ingest_documents": "SELECT doc_id, length(text)::INT AS chars FROM documents",
    "stream_build_postings": sql("postings", "SELECT term, docid, tf FROM postings"),
    "stream_merge_segments": sql("postings", "SELECT term, docid, tf FROM postings"),
    "stream_merged_bm25": sql("run_a", "SELECT qid, docid, score, rank FROM run_a"),
    "by_query": sql("run_a", "SELECT qid, docid, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM run_a"),
    "pipe": sql("run_a", "SELECT qid, docid FROM run_a WHERE rank <= 10"),
}
