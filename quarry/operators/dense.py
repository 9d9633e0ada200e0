"""Vector search, feedback in vector space, hybrid weighting and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.functions.samples import bounded
from quarry.functions.scores import top_k
from quarry.functions.text import tokens
from quarry.functions.vectors import by_dimension, dot, l2norm, mean_vector, norm, similarity, sum_vector
from quarry.operators import nearest
from quarry.operators.evaluation import evaluate
from quarry.operators.hyperplanes import lsh_build, lsh_compared, lsh_knn, lsh_pairs, lsh_search  # noqa: F401

def pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs of a stated query set and the documents, a broadcast block of queries at a time: (qid, q, docid, v)."""
    out = None
    for block in nearest.blocks(queries):
        part = docs.select("docid", "v").join(F.broadcast(block.select("qid", F.col("v").alias("q"))), F.lit(True))
        out = part if out is None else out.unionByName(part)
    return out


def exact_knn(queries: DataFrame, docs: DataFrame, k: int = 10, kind: str = "cosine") -> DataFrame:
    """(qid, docid, score, rank): best k documents of each query, scores to 6 decimals, ties by docid."""
    if kind in nearest.KINDS:
        return nearest.best(queries, docs, ["docid"], k, kind).withColumn("rank", F.col("rank").cast("long"))
    scored = pairs(queries, docs).select("qid", "docid", F.round(similarity(F.col("q"), F.col("v"), kind), 6).alias("score"))
    return top_k(scored, k)


def rank_scores(run: DataFrame, k: int) -> DataFrame:
    return run.withColumn("score", F.round(1 - (F.col("rank") - 1) / F.lit(float(k)), 6))


def cells(n: int) -> tuple[int, int]:
    """Coarse cells and probed cells for n vectors."""
    lists = min(4096, max(1, n // 39))
    return lists, min(128, max(1, lists // 4))


def _nearest_cell(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of least Euclidean distance to each vector brought to length 1, and these vectors."""
    length = np.sqrt((x * x).sum(1, keepdims=True))
    unit, half = np.divide(x, length, out=x.copy(), where=length > 0), (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(unit[i : i + 1024] @ centres.T - half, axis=1) for i in range(0, len(unit), 1024)] or [np.zeros(0, int)]), unit


def _train(sample: DataFrame, lists: int, seed: int, steps: int = 15) -> np.ndarray:
    """Centres by Lloyd's steps from distinct vectors of the sample. Vectors are assigned and summed where they lie; a step
    sends back a row for each cell and task, and there are at most 16 tasks."""
    context = sample.sparkSession.sparkContext
    x = sample.select("v").repartition(min(16, context.defaultParallelism)).persist()
    start = x.distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(lists).toArrow().column("v")
    centres = nearest.Vectors(start)
    _, centres = _nearest_cell(centres.x[~centres.null], np.zeros((1, centres.dim)))
    for _ in range(steps if len(centres) > 1 else 0):
        sent = context.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            now = sent.value
            n, total = np.zeros(len(now), np.int64), np.zeros(now.shape)
            for batch in batches:
                v = nearest.Vectors(batch.column(0), now.shape[1])
                at, unit = _nearest_cell(v.x[~v.null], now)
                order = np.argsort(at, kind="stable")
                cells, starts = np.unique(at[order], return_index=True)
                if len(cells):
                    n[cells] += np.diff(np.r_[starts, len(at)])
                    total[cells] += np.add.reduceat(unit[order], starts, axis=0)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "n", "v"])

        found = x.mapInArrow(sums, "cell int, n long, v array<double>").toArrow()
        cell, n, total = found.column("cell").to_numpy(), np.zeros(len(centres)), np.zeros(centres.shape)
        np.add.at(n, cell, found.column("n").to_numpy())
        np.add.at(total, cell, nearest.Vectors(found.column("v"), centres.shape[1]).x)
        fresh = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        sent.unpersist()
        if np.allclose(fresh, centres, atol=1e-4):
            break
        centres = fresh
    x.unpersist()
    return centres


def ivf_build(docs: DataFrame, lists: int, seed: int = 42, most_trained: int = 100_000) -> tuple[DataFrame, list]:
    """docs with their cell, and the cell centres. They are learnt from at most most_trained vectors, by hash order; every
    vector is assigned to a cell."""
    centres = _train(bounded(docs, most_trained, "docid"), lists, seed)
    sent = docs.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = nearest.Vectors(batch.column(batch.schema.get_field_index("v")), sent.value.shape[1]).x
            yield batch.append_column("cell", pa.array(_nearest_cell(x, sent.value)[0], pa.int32()))

    return docs.mapInArrow(assign, StructType([*docs.schema.fields, StructField("cell", IntegerType())])), list(centres)


def _centre_table(spark: SparkSession, centres: list) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "docid long, v array<double>")


def probes_for(queries: DataFrame, indexed: DataFrame, centres: list, k: int = 10, target: float = 0.95, most: int = 200) -> int:
    """Cells to probe so that a share `target` of the exact k nearest is found, measured on `most` queries at most."""
    sample = bounded(queries, most, "qid")
    nearest = exact_knn(sample, indexed, k).join(indexed.select("docid", "cell"), "docid")
    order = exact_knn(sample, _centre_table(queries.sparkSession, centres), len(centres)).select("qid", F.col("docid").cast("int").alias("cell"), F.col("rank").alias("nth"))
    needed = nearest.join(order, ["qid", "cell"]).agg(F.percentile("nth", F.lit(target)).alias("n")).first()["n"]
    return max(1, -int(-(needed or 1) // 1))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact results that an approximate search has found."""
    met = exact.select("qid", "docid").join(found.select("qid", "docid", F.lit(1).alias("hit")), ["qid", "docid"], "left")
    return met.agg(F.count_distinct("qid").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def ivf_search(queries: DataFrame, indexed: DataFrame, centres: list, k: int = 10, probes: int = 8) -> DataFrame:
    """Best k by cosine among the documents of each query's nearest cells. The centres are at most 4,096 rows."""
    near = exact_knn(queries, _centre_table(queries.sparkSession, centres), probes).select("qid", F.col("docid").cast("int").alias("cell"))
    probed = near.join(queries.select("qid", F.col("v").alias("q")), "qid")
    met = indexed.join(probed, "cell").select("qid", "docid", F.round(similarity(F.col("q"), F.col("v")), 6).alias("score"))
    return top_k(met, k)


def recommend_index(n: Column, dim: Column, low_memory: Column) -> Column:
    """The search plan for n vectors."""
    return F.when(n < 10_000, "flat").when(n < 100_000, "ivf").when(low_memory, "pq").when(dim > 512, "hnsw").otherwise("ivf")


def norm_stats(vectors: DataFrame) -> DataFrame:
    n = norm(F.col("v"))
    return vectors.agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.round(F.min(n), 6).alias("low"), F.round(F.max(n), 6).alias("high"))


def embedding_quality(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Mean norms, range of cosines, and mean cosine of pairs of equal and of other labels with their separation, as one row."""
    measured, r = nearest.cosines(queries, docs), lambda c, name: F.round(c, 6).alias(name)
    of_pairs = measured.select(r(F.col("low"), "low"), r(F.col("high"), "high"), r(F.col("good"), "positive"), r(F.col("bad"), "negative"), r(F.col("good") - F.col("bad"), "separation"))
    of_norms = queries.agg(F.round(F.avg(norm(F.col("v"))), 6).alias("query_norm")).join(docs.agg(F.round(F.avg(norm(F.col("v"))), 6).alias("doc_norm")), F.lit(True))
    return of_pairs.join(of_norms, F.lit(True))


def prf_vectors(queries: DataFrame, run: DataFrame, docs: DataFrame, n: int = 3, how: str = "average", alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """(qid, v): the mean of the query and its first n documents, or alpha times the query plus beta times the documents'
    mean; the query itself without feedback."""
    fed = run.where(F.col("rank") <= n).select("qid", "docid").join(docs.select("docid", "v"), "docid").select("qid", "v")
    if how == "average":
        return mean_vector(queries.select("qid", "v").unionByName(fed), ["qid"])
    means = mean_vector(fed, ["qid"]).withColumnRenamed("v", "m")
    fused = F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda q, m: alpha * q + beta * m))
    return queries.select("qid", "v").join(means, "qid", "left").select("qid", fused.alias("v"))


def rescore(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int | None = 100, kind: str | Callable[[Column, Column], Column] = "cosine", missing: str = "drop") -> DataFrame:
    """run scored anew by a similarity: one of similarity()'s kinds, or a function of two vectors such as vectors.bilinear() and
    vectors.mlp() make; rows without a vector are dropped, or keep their score with missing="keep"."""
    joined = run.select("qid", "docid", F.col("score").alias("old")).join(queries.select("qid", F.col("v").alias("q")), "qid").join(docs.select("docid", "v"), "docid", "left" if missing == "keep" else "inner")
    fresh = F.round(kind(F.col("q"), F.col("v")) if callable(kind) else similarity(F.col("q"), F.col("v"), kind), 6)
    return top_k(joined.select("qid", "docid", F.coalesce(F.when(F.col("v").isNotNull(), fresh), "old").alias("score")), k)


def vector_prf(run: DataFrame, queries: DataFrame, docs: DataFrame, n: int = 3, how: str = "rocchio", kind: str = "dot", depth: int = 1000) -> DataFrame:
    return rescore(run.where(F.col("rank") <= depth), prf_vectors(queries, run, docs, n, how), docs, depth, kind)


def importance(features: DataFrame, alpha: float = 0.5, beta: float = 0.5, mode: str = "both", squash: bool = False, digits: int | None = 6) -> DataFrame:
    """features (rm_weight, semantic) with weight: alpha times the first plus beta times the second, or one of them alone."""
    a, b = (1 / (1 + F.exp(-F.lit(x))) if squash else F.lit(x) for x in (alpha, beta))
    parts = {"both": a * F.col("rm_weight") + b * F.col("semantic"), "rm3_only": a * F.col("rm_weight"), "cosine_only": b * F.col("semantic")}
    return features.withColumn("weight", parts[mode] if digits is None else F.round(parts[mode], digits))


def enhance(queries: DataFrame, weighted: DataFrame, terms: DataFrame, lam: float | Column = 0.5, first: int = 15, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, v): (1 - lam) q + lam times the weighted mean of the vectors of the first terms; the query where the weights are
    nothing. weighted: (keys, term, weight, place); terms: (term, v); lam may be a column of queries."""
    by, lam = list(keys), lam if isinstance(lam, Column) else F.lit(lam)
    used = weighted.where(F.col("place") <= first).select(*by, "term", "weight").join(terms.select("term", "v"), "term")
    total = used.groupBy(*by).agg(F.sum("weight").alias("total"))
    summed = by_dimension(used.select(*by, "weight", "v"), by, F.col("weight") * F.col("x"), how="sum").withColumnRenamed("v", "s")
    joined = queries.join(summed, by, "left").join(total, by, "left")
    mixed = F.transform(F.zip_with("v", "s", lambda q, s: F.struct(q.alias("q"), s.alias("s"))), lambda c: (1 - lam) * c["q"] + lam * c["s"] / F.col("total"))
    return joined.select(*by, F.when(F.col("total") > 1e-8, mixed).otherwise(F.col("v")).alias("v"))


def fit_weights(run: DataFrame, queries: DataFrame, features: DataFrame, terms: DataFrame, docs: DataFrame, qrels: DataFrame, grid: list[tuple[float, float, float]], metric: str = "ndcg_10", counts: DataFrame | None = None) -> DataFrame:
    """(alpha, beta, lam, value, n, best): the metric of the run reranked by the query of every setting of a grid, in one job.

    Settings are a small table that queries and their term features are multiplied by; candidates are scored once for each
    setting, where their vectors lie. best marks the greatest value; ties are all marked. For counts see evaluate().
    """
    settings = F.broadcast(run.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(grid)], "cfg int, alpha double, beta double, lam double"))
    weight = F.round(F.col("alpha") * F.col("rm_weight") + F.col("beta") * F.col("semantic"), 6)
    weighted = features.join(settings, F.lit(True)).select("cfg", "qid", "term", "place", weight.alias("weight"))
    asked = queries.select("qid", "v").join(settings, F.lit(True))
    mixed = enhance(asked, weighted, terms, F.col("lam"), keys=("cfg", "qid")).withColumnRenamed("v", "q")
    scored = run.select("qid", "docid").join(docs.select("docid", "v"), "docid").join(mixed, "qid").select("cfg", "qid", "docid", F.round(similarity(F.col("q"), F.col("v")), 6).alias("score"))
    values = evaluate(scored, qrels, (metric,), ("cfg",), counts).join(settings, "cfg")
    return values.select("alpha", "beta", "lam", "value", "n", (F.col("value") == F.max("value").over(W.partitionBy())).alias("best"))


def hashed_terms(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, v): a text's tokens counted into `dim` buckets by hash, with signs, at length 1; zeros without tokens. The
    encoder that is used where no model is supplied: it needs no training and runs on plain columns."""
    hashed = F.md5("token")
    number = lambda a, n: F.conv(F.substring(hashed, a, n), 16, 10).cast("int")
    cells = df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, (number(1, 4) % dim).alias("dim")).agg(F.sum(1 - 2 * (number(5, 1) % 2)).cast("double").alias("x"))
    filled = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.try_element_at("cells", d), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), dim)
    return df.select(key).distinct().join(filled, key, "left").select(key, F.when(F.col("cells").isNull(), none).otherwise(l2norm(at)).alias("v"))


def concat_prf(run: DataFrame, queries: DataFrame, docs: DataFrame, encoder: Callable[[DataFrame, str, str], DataFrame] = hashed_terms, n: int = 3, depth: int = 100, kind: str = "dot") -> DataFrame:
    """The first `depth` of a run scored by the encoding of the query joined with its first n documents' texts, in order;
    the query alone where fewer than n have a text. Documents without text are left out."""
    top = run.where(F.col("rank") <= depth)
    texts = docs.select("docid", "text").where("text IS NOT NULL AND trim(text) != ''").join(top.select("docid").distinct(), "docid", "left_semi")
    fed = top.where(F.col("rank") <= n).join(texts, "docid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("fed"))
    whole = F.concat_ws(" ", F.array("query"), F.transform("fed", lambda f: f["text"]))
    asked = queries.join(fed, "qid", "left").select("qid", F.when(F.size("fed") >= n, whole).otherwise(F.col("query")).alias("text"))
    return rescore(top, encoder(asked, "qid", "text"), encoder(texts, "docid", "text"), depth, kind)


def interpolate(run: DataFrame, fresh: DataFrame, w: float = 0.7, min_docs: int = 10) -> DataFrame:
    """w times the first score plus (1 - w) times the new one; queries with fewer than min_docs candidates keep their ranking."""
    n = F.count("*").over(W.partitionBy("qid"))
    joined = run.select("qid", "docid", F.col("score").alias("old")).join(fresh.select("qid", "docid", F.col("score").alias("new")), ["qid", "docid"], "left").withColumn("n", n)
    mixed = F.when(F.col("n") < min_docs, F.col("old")).otherwise(w * F.col("old") + (1 - w) * F.coalesce("new", F.lit(0.0)))
    return top_k(joined.select("qid", "docid", F.round(mixed, 6).alias("score")), None)


def multi_stage(run: DataFrame, scorer: Callable[[DataFrame], DataFrame], stages: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Rescores in stages; after each, twice its depth stays."""
    for depth in stages:
        run = top_k(scorer(run).select("qid", "docid", "score"), 2 * depth)
    return run


def project(vectors: DataFrame, key: str, k: int = 2) -> DataFrame:
    """vectors with `xy`, their first k principal components."""
    ml = vectors.withColumn("_v", array_to_vector("v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(ml).transform(ml).select(key, vector_to_array("_p").alias("xy"))


def relevant_and_rest(run: DataFrame, relevant: DataFrame, n: int = 10) -> DataFrame:
    """(qid, docid, kind, place): for each query the first n relevant documents by docid, and the first n of its run that are
    not relevant, by rank. relevant: (qid, docid)."""
    good = relevant.select("qid", "docid").distinct()
    rest = run.join(good, ["qid", "docid"], "left_anti")
    sides = ((good, "relevant", F.col("docid")), (rest, "rest", F.col("rank")))
    placed = [df.select("qid", "docid", F.lit(kind).alias("kind"), F.row_number().over(W.partitionBy("qid").orderBy(order)).cast("long").alias("place")).where(F.col("place") <= n) for df, kind, order in sides]
    return placed[0].unionByName(placed[1])


def project_queries(chosen: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 2) -> DataFrame:
    """chosen (qid, docid, kind, place) and the queries themselves (kind query, place 0, no docid) with `xy`, their coordinates
    on the first k principal axes of the query and its documents. The axes are those of each query's summed covariances; an
    axis points to where its greatest entry is positive."""
    asked = queries.join(chosen.select("qid").distinct(), "qid", "left_semi").select("qid", F.lit(None).cast("long").alias("docid"), F.lit("query").alias("kind"), F.lit(0).cast("long").alias("place"), "v")
    points = chosen.join(docs.select("docid", "v"), "docid").select("qid", "docid", "kind", "place", "v").unionByName(asked)
    means = mean_vector(points.select("qid", "v"), ["qid"]).withColumnRenamed("v", "m")
    centred = points.join(means, "qid").withColumn("v", F.zip_with("v", "m", lambda x, m: x - m)).drop("m")
    # a row of the covariance matrix for each query and dimension: what points have there times the points, summed
    rows = centred.select("qid", F.posexplode("v").alias("row", "x"), "v")
    covariance = by_dimension(rows.select("qid", "row", "x", "v").withColumnRenamed("x", "at"), ["qid", "row"], F.col("at") * F.col("x"), how="sum")
    matrices = covariance.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda r: r["v"]).alias("c"))

    @F.pandas_udf("array<array<double>>")
    def axes(c: pd.Series) -> pd.Series:
        out = []
        for matrix in c:
            found = np.linalg.eigh(np.stack(matrix))[1][:, ::-1][:, :k].T
            out.append([list(a * np.sign(a[np.abs(a).argmax()])) for a in found])
        return pd.Series(out)

    turned = matrices.select("qid", axes("c").alias("axes"))
    return centred.join(turned, "qid").select("qid", "docid", "kind", "place", F.transform("axes", lambda a: dot(a, F.col("v"))).alias("xy"))


def fit_pairwise(features: DataFrame, qrels: DataFrame, steps: int = 12, ridge: float = 1e-3) -> DataFrame:
    """(feature, weight): a logistic fit on differences of features between a query's documents of unlike grades, by Newton's
    steps on gradients and curvatures that are summed where the pairs lie; ridge times the squared weights is added.

    features: (qid, docid, x) of candidates, an array of few values. Pairs are formed within a query's candidates, so their
    number is bounded by the depth of the run; unjudged candidates have grade 0. Each step sends back one row.
    """
    graded = features.join(qrels.select("qid", "docid", "grade"), ["qid", "docid"], "left").select("qid", F.coalesce("grade", F.lit(0)).alias("grade"), "x")
    low = graded.select("qid", F.col("grade").alias("less"), F.col("x").alias("y"))
    pairs = graded.join(low, "qid").where("grade > less").select(F.zip_with("x", "y", lambda a, b: a - b).alias("x")).persist()
    width = pairs.select(F.max(F.size("x")).alias("n")).first()["n"] or 0
    w = np.zeros(width)
    for _ in range(steps if width else 0):
        p = 1 / (1 + F.exp(-dot(F.array(*(F.lit(float(v)) for v in w)), F.col("x"))))
        x = [F.col("x")[i] for i in range(width)]
        sums = pairs.agg(F.count("*").alias("n"), *(F.sum((1 - p) * x[i]).alias(f"g{i}") for i in range(width)), *(F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(width) for j in range(i + 1))).first()
        slope = np.array([sums[f"g{i}"] for i in range(width)]) / sums["n"] - 2 * ridge * w
        bend = np.array([[sums[f"h{max(i, j)}_{min(i, j)}"] for j in range(width)] for i in range(width)]) / sums["n"] + 2 * ridge * np.eye(width)
        w = w + np.linalg.solve(bend, slope)
    pairs.unpersist()
    return features.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "feature int, weight double")


def weighted_rank(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, docid, score, rank): candidates (qid, docid, x) by the weighted sum of their features."""
    w = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "weight"))), lambda s: s["weight"]).alias("w"))
    return top_k(features.join(F.broadcast(w), F.lit(True)).select("qid", "docid", F.round(dot(F.col("w"), F.col("x")), 6).alias("score")), None)


def pooled(tokens: DataFrame, how: str = "mean") -> DataFrame:
    """(docid, v): the first token's vector (cls), or the mean or greatest of each element."""
    if how == "cls":
        return tokens.groupBy("docid").agg(F.min_by("v", "pos").alias("v"))
    return by_dimension(tokens.select("docid", "v"), ["docid"], F.col("x"), how={"mean": "avg", "max": "max"}[how])


def totals(tokens: DataFrame) -> DataFrame:
    return sum_vector(tokens.select("docid", "v"), ["docid"])
