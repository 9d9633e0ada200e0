"""Features of query-document similarity matrices, term scores from mentions, and passage rescoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scores import minmax_half, top_k
from quarry.functions.text import passages, tokens
from quarry.functions.vectors import dot, mean_vector, similarity
from quarry.operators.late import SPECIAL, token_pairs

# Centres and widths of the kernels.
KERNELS = ((1.0, 1e-5), *((round(0.9 - 0.2 * k, 1), 0.1) for k in range(10)))


def histogram_features(queries: DataFrame, docs: DataFrame, candidates: DataFrame, bins: int = 30) -> DataFrame:
    """(qid, docid, qpos, bin, value): log(1 + n) of similarities in each bin that has any; bin int((v + 1) / 2 * (bins - 1)), clamped."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.round("sim", 9) + 1) / 2 * (bins - 1)))).cast("long")
    counted = token_pairs(queries, docs, candidates).groupBy("qid", "docid", "qpos", at.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("qid", "docid", "qpos", "bin", F.round(F.log1p("n"), 6).alias("value"))


def kernel_features(queries: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, docid, kernel, value): sum over query tokens of 0.01 log of the soft count of similarities near each centre."""
    kernels = F.explode(F.array(*(F.struct(F.lit(k).alias("kernel"), F.lit(m).alias("mu"), F.lit(s).alias("sigma")) for k, (m, s) in enumerate(KERNELS))))
    met = token_pairs(queries, docs, candidates).select("qid", "docid", "qpos", "sim", kernels.alias("k")).select("qid", "docid", "qpos", "sim", "k.*")
    d = F.col("sim") - F.col("mu")
    rows = met.groupBy("qid", "docid", "qpos", "kernel").agg(F.sum(F.exp(-d * d / (2 * F.col("sigma") * F.col("sigma")))).alias("soft"))
    return rows.groupBy("qid", "docid", "kernel").agg(F.round(F.sum(0.01 * F.log(F.greatest("soft", F.lit(1e-10)))), 6).alias("value"))


def mention_scores(queries: DataFrame, docs: DataFrame, run: DataFrame, how: str = "centroid", fb_docs: int = 3) -> DataFrame:
    """(qid, tokid, score): a token's score from its mentions in the query's first documents: its share of the similarity
    mass of each document, by the document's posterior. centroid takes the mean query vector, max and mul take each query
    token (special ones left out) and pool over them."""
    w = W.partitionBy("qid")
    fed = run.where(F.col("rank") <= fb_docs).withColumn("_r", F.exp(F.col("score") - F.max("score").over(w)))
    fed = fed.select("qid", "docid", (F.col("_r") / F.sum("_r").over(w)).alias("post"))
    if how == "centroid":
        q = mean_vector(queries.select("qid", "v"), ["qid"]).select("qid", F.lit(0).alias("qpos"), F.col("v").alias("q"))
    else:
        q = queries.where(~F.col("tokid").isin(*SPECIAL)).select("qid", "qpos", F.col("v").alias("q"))
    met = fed.join(docs.select("docid", "pos", "tokid", "v"), "docid").join(q, "qid").withColumn("cos", F.greatest(F.lit(0.0), similarity(F.col("q"), F.col("v"))))
    of_token = met.groupBy("qid", "qpos", "docid", "post", "tokid").agg(F.sum("cos").alias("mass"))
    total = F.sum("mass").over(W.partitionBy("qid", "qpos", "docid"))
    share = of_token.withColumn("share", F.col("post") * F.when(total > 0, F.col("mass") / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    by_token = share.groupBy("qid", "qpos", "tokid").agg(F.sum("share").alias("s"))
    pooled: Column = F.product("s") if how == "mul" else F.max("s")
    return by_token.groupBy("qid", "tokid").agg(F.round(pooled, 6).alias("score"))


def nprf_score(run: DataFrame, docs: DataFrame, weights: dict[str, list], fb_docs: int = 3, depth: int = 20) -> DataFrame:
    """A run's first `depth` documents by their likeness to its first fb_docs, with supplied weights: the kernel features of
    each feedback document and candidate go through a hidden layer (tanh), times the gate of the feedback document's score
    (scaled to 0.5 to 1), and a linear layer over feedback places.

    weights: w1 (hidden x kernels), b1, w2 (hidden), b2, gate, out (fb_docs), bias.
    """
    top = run.where(F.col("rank") <= depth)
    fed = top.where(F.col("rank") <= fb_docs).select("qid", F.col("docid").alias("fb"), F.col("rank").alias("nth"), minmax_half(F.col("score")).alias("scaled"))
    met = fed.join(top.select("qid", "docid"), "qid")
    own = docs.join(fed.select(F.col("fb").alias("docid")).distinct(), "docid", "left_semi").select(F.col("docid").alias("qid"), F.col("pos").alias("qpos"), "tokid", F.lit(1.0).alias("weight"), "v")
    kernels = kernel_features(own, docs, met.select(F.col("fb").alias("qid"), "docid").distinct())
    x = kernels.groupBy(F.col("qid").alias("fb"), "docid").agg(F.transform(F.array_sort(F.collect_list(F.struct("kernel", "value"))), lambda k: k["value"]).alias("x"))
    row = lambda values: F.array(*(F.lit(float(v)) for v in values))
    hidden: Column = F.lit(float(weights["b2"]))
    for w, b, out in zip(weights["w1"], weights["b1"], weights["w2"], strict=True):
        hidden = hidden + F.tanh(dot(F.col("x"), row(w)) + float(b)) * float(out)
    part = met.join(x, ["fb", "docid"]).withColumn("part", F.get(row(weights["out"]), (F.col("nth") - 1).cast("int")) * float(weights["gate"]) * F.col("scaled") * hidden)
    return top_k(part.groupBy("qid", "docid").agg(F.round(F.sum("part") + float(weights["bias"]), 6).alias("score")), None)


def new_terms(terms: DataFrame, own: DataFrame, n: int = 10) -> DataFrame:
    """The best n expansion terms of more than one character that are not the query's own stems."""
    return top_k(terms.where(F.length("term") > 1).join(own.select("qid", "term"), ["qid", "term"], "left_anti").select("qid", "term", "weight"), n, "qid", "weight", "term", "place")


def max_passage(run: DataFrame, queries: DataFrame, docs: DataFrame, size: int = 10, stride: int = 5, max_chars: int | None = None) -> DataFrame:
    """run scored by the best passage: the number of its distinct tokens that the query has; a document without passages keeps its score."""
    cut = run.join(docs, "docid").join(queries, "qid").select("qid", "docid", F.array_distinct(tokens(F.col("query"))).alias("wanted"), F.explode(passages(F.col("text"), size, stride, max_chars)).alias("passage"))
    best = cut.groupBy("qid", "docid").agg(F.max(F.size(F.array_intersect("wanted", tokens(F.col("passage"))))).cast("double").alias("best"))
    return top_k(run.select("qid", "docid", "score").join(best, ["qid", "docid"], "left").select("qid", "docid", F.coalesce("best", "score").alias("score")), None)
