"""Late interaction: documents and queries as bags of token vectors.

Tokens of documents are (docid, pos, tokid, v), of queries (qid, qpos, tokid, weight, v). A token's best similarity in a
document is at least 0, as a document shorter than the padded length has zero vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.functions.vectors import dot, mean_vector
from quarry.operators import nearest
from quarry.operators.cells import CellFile, cell_search, looked_at, met

# Token ids that mark a sequence, a query, a document, or a mask.
SPECIAL = (101, 102, 103, 1, 2)


def token_pairs(queries: DataFrame, docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(qid, qpos, qtok, weight, docid, pos, tokid, sim) of query tokens and document tokens, of candidates (qid, docid) or
    of all documents; without candidates query tokens are broadcast in blocks."""
    q = queries.select("qid", "qpos", F.col("tokid").alias("qtok"), "weight", F.col("v").alias("q"))
    if candidates is not None:
        met = docs.join(candidates.select("qid", "docid"), "docid").join(q, "qid")
    else:
        met = reduce(DataFrame.unionByName, [docs.join(F.broadcast(block), F.lit(True)) for block in nearest.blocks(q)])
    return met.select("qid", "qpos", "qtok", "weight", "docid", "pos", "tokid", dot(F.col("q"), F.col("v")).alias("sim"))


def maxsim(queries: DataFrame, docs: DataFrame, candidates: DataFrame | None = None, k: int | None = 1000) -> DataFrame:
    """(qid, docid, score, rank): sum over query tokens of weight times the best similarity, at least 0."""
    if candidates is None:
        # tokens stay together by document, so there is one row for each query and document and none for each pair of tokens
        asked = queries.groupBy("qid").agg(F.collect_list(F.struct("weight", "v")).alias("q"))
        held = docs.groupBy("docid").agg(F.collect_list("v").alias("d"))
        return top_k(nearest.best_bags(asked, held, k), k)
    best = token_pairs(queries, docs, candidates).groupBy("qid", "docid", "qpos", "weight").agg(F.max("sim").alias("sim"))
    return top_k(best.groupBy("qid", "docid").agg(F.round(F.sum(F.col("weight") * F.greatest(F.lit(0.0), "sim")), 6).alias("score")), k)


def contributions(queries: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, docid, best): each document token's best similarity over query tokens, by position."""
    best = token_pairs(queries, docs, candidates).groupBy("qid", "docid", "pos").agg(F.round(F.max("sim"), 6).alias("sim"))
    return best.groupBy("qid", "docid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sim"))), lambda s: s["sim"]).alias("best"))


def exact_match_share(queries: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, docid, share): the part of MaxSim that comes from query tokens whose best document token is the same token."""
    met = token_pairs(queries, docs, candidates).where(~F.col("qtok").isin(*SPECIAL))
    best = met.groupBy("qid", "docid", "qpos", "qtok", "weight").agg(F.max("sim").alias("sim"), F.min_by("tokid", F.struct(-F.col("sim"), "pos")).alias("tokid"))
    value = F.col("weight") * F.greatest(F.lit(0.0), "sim")
    sums = best.groupBy("qid", "docid").agg(F.sum(value).alias("all"), F.sum(F.when(F.col("qtok") == F.col("tokid"), value).otherwise(0.0)).alias("same"))
    return sums.select("qid", "docid", F.round(F.when(F.col("all") > 0, F.col("same") / F.nullif("all", F.lit(0.0))).otherwise(0.0), 6).alias("share"))


def interaction_matrix(queries: DataFrame, docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, docid, qpos, sims, best_pos): a row of the similarity matrix for each query token, and where it is greatest."""
    rounded = token_pairs(queries, docs, candidates).withColumn("sim", F.round("sim", 6))
    return rounded.groupBy("qid", "docid", "qpos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "sim"))), lambda s: s["sim"]).alias("sims"), F.min_by("pos", F.struct(-F.col("sim"), "pos")).alias("best_pos")
    )


#: What names a token vector in a cell file of tokens.
TOKEN = ("docid", "pos", "tokid")


def probed_pairs(queries: DataFrame, index: CellFile, probes: int | None = None) -> DataFrame:
    """token_pairs() of query tokens and the document tokens in the cells that they probe."""
    asked = queries.select(F.struct("qid", "qpos", F.col("tokid").alias("qtok"), "weight").alias("qid"), "v")
    found = met(index, asked, probes)
    return found.select("qid.*", *TOKEN, dot(F.col("q"), F.col("v")).alias("sim"))


def token_neighbours(queries: DataFrame, docs: DataFrame | CellFile, k: int) -> DataFrame:
    """The k nearest document tokens of each query token, ties by document and position: of all tokens, or, with a cell file
    of tokens for docs, of those in the probed cells."""
    asked = queries.select(F.struct("qid", "qpos", F.col("tokid").alias("qtok"), "weight").alias("qid"), "v")
    found = cell_search(docs, asked, k, kind="dot", rank="place") if isinstance(docs, CellFile) else nearest.best(asked, docs, list(TOKEN), k, "dot", "place")
    return found.select("qid.*", *TOKEN, F.col("score").alias("sim"), F.col("place").cast("int").alias("place"))


def set_retrieve(queries: DataFrame, docs: DataFrame | CellFile, k: int = 1000) -> DataFrame:
    return token_neighbours(queries, docs, k).select("qid", "docid").distinct()


def ann_score(queries: DataFrame, docs: DataFrame | CellFile, k: int = 1000, depth: int | None = 1000) -> DataFrame:
    """Approximate MaxSim from each query token's k neighbours only."""
    best = token_neighbours(queries, docs, k).groupBy("qid", "qpos", "weight", "docid").agg(F.greatest(F.lit(0.0), F.max("sim")).alias("sim"))
    return top_k(best.groupBy("qid", "docid").agg(F.round(F.sum(F.col("weight") * F.col("sim")), 6).alias("score")), depth)


def end_to_end(queries: DataFrame, docs: DataFrame | CellFile, k: int = 1000, depth: int | None = 1000) -> DataFrame:
    """Candidates by each query token's neighbours, then their full MaxSim."""
    tokens = docs.vectors.drop("cell") if isinstance(docs, CellFile) else docs
    return maxsim(queries, tokens, set_retrieve(queries, docs, k), depth)


def token_recall(queries: DataFrame, docs: DataFrame, index: CellFile, k: int = 1000) -> DataFrame:
    """(queries, looked_at, recall): query tokens, the share of all tokens that each looks at, and of the documents that the
    exhaustive search retrieves the share that the cells give."""
    full, fast = set_retrieve(queries, docs, k), set_retrieve(queries, index, k).withColumn("hit", F.lit(1))
    share = full.join(fast, ["qid", "docid"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return looked_at(index, queries.select(F.struct("qid", "qpos").alias("qid"), "v")).join(share, F.lit(True))


def fetch_encodings(run: DataFrame, docs: DataFrame) -> DataFrame:
    """run with the token ids and vectors of each document, by position."""
    bags = docs.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("pos", "tokid", "v"))).alias("bag"))
    return run.join(bags, "docid").withColumn("tokids", F.transform("bag", lambda t: t["tokid"])).withColumn("vectors", F.transform("bag", lambda t: t["v"])).drop("bag")


def token_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("tokid").agg(F.count("*").alias("cf"), F.count_distinct("docid").alias("df"))


def token_idf(docs: DataFrame) -> DataFrame:
    """(tokid, idf): ln((1 + N) / (1 + df)) over N documents."""
    n = docs.agg(F.count_distinct("docid").alias("n"))
    return token_stats(docs).join(F.broadcast(n), F.lit(True)).select("tokid", F.round(F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))), 6).alias("idf"))


def tokens_of(docs: DataFrame, tokid: int, share: float = 1.0, seed: int = 1) -> DataFrame:
    """All vectors of a token id, or the first share of them in hash order."""
    mine = docs.where(F.col("tokid") == tokid)
    order = W.partitionBy("tokid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "docid", "pos")))
    return mine.withColumn("_p", F.percent_rank().over(order)).where(F.col("_p") < share).drop("_p") if share < 1 else mine


def nearest_tokens(vectors: DataFrame, docs: DataFrame | CellFile, k: int = 10, low: int = 0) -> DataFrame:
    """(qid, qpos, tokid, n, place): token ids among a vector's k neighbours by how often, more than `low` times, special ids left out."""
    counted = token_neighbours(vectors, docs, k).where(~F.col("tokid").isin(*SPECIAL)).groupBy("qid", "qpos", "tokid").agg(F.count("*").alias("n")).where(F.col("n") > low)
    return top_k(counted, None, ["qid", "qpos"], "n", "tokid", "place")


def prune_by_frequency(queries: DataFrame, stats: DataFrame, cutoff: int, by: str = "cf") -> DataFrame:
    """The cutoff query tokens of lowest frequency; tokens without one come last."""
    order = W.partitionBy("qid").orderBy(F.col(by).asc_nulls_last(), "qpos")
    return queries.join(stats.select("tokid", by), "tokid", "left").withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= cutoff).select("qid", "qpos", "tokid", "place")


def prune_first(queries: DataFrame, cutoff: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy("qpos")
    return queries.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= cutoff).select("qid", "qpos", "tokid", "place")


def prune_special(queries: DataFrame, ids: tuple[int, ...] = (101, 1, 103)) -> DataFrame:
    return queries.where(~F.col("tokid").isin(*ids))


def merge_indexes(parts: list[DataFrame]) -> DataFrame:
    """Several indexes as one, each part's document numbers moved past those before it."""
    numbered = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    sizes = numbered.groupBy("part").agg((F.max("docid") + 1).alias("size"))
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return numbered.join(F.broadcast(offsets), "part").withColumn("docid", F.col("docid") + F.col("offset")).drop("offset")


def merge_pieces(tokens: DataFrame) -> DataFrame:
    """(docid, word_no, word, v): pieces that begin with ## joined to the word before, vectors averaged."""
    w = W.partitionBy("docid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    words = tokens.withColumn("word_no", F.sum((~F.col("piece").startswith("##")).cast("int")).over(w))
    text = words.groupBy("docid", "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: F.regexp_replace(s["piece"], "^##", "")), "").alias("word"))
    return text.join(mean_vector(words.select("docid", "word_no", "v"), ["docid", "word_no"]), ["docid", "word_no"])


def _clusters(k: int, seed: int):  # noqa: ANN202  a function of one query's rows
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["docid", "pos"])
        x = np.array(rows["v"].tolist(), dtype=float)
        draw = np.random.default_rng(seed)
        centres = x[np.sort(draw.choice(len(x), size=min(k, len(x)), replace=False))]
        for _ in range(20):
            near = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
            fresh = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
            if np.allclose(fresh, centres):
                break
            centres = fresh
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "qpos": np.arange(len(centres)), "v": centres.tolist()})

    return fit


def late_prf(queries: DataFrame, run: DataFrame, docs: DataFrame, fb_docs: int = 3, k: int = 24, fb_embs: int = 10, beta: float = 1.0, seed: int = 42, index: CellFile | None = None) -> DataFrame:
    """Query tokens with the centres of the feedback documents' token vectors added: each centre is named by its most
    frequent near token (looked for in the cells of index, if given), the fb_embs of highest idf are kept, with weight beta
    times idf. A query's feedback is fb_docs documents, so one task holds few vectors."""
    fed = run.where(F.col("rank") <= fb_docs).select("qid", "docid").join(docs.select("docid", "pos", "v"), "docid")
    centres = fed.groupBy("qid").applyInPandas(_clusters(k, seed), "qid long, qpos int, v array<double>")
    as_tokens = centres.select("qid", "qpos", F.lit(-1).alias("tokid"), F.lit(1.0).alias("weight"), "v")
    named = nearest_tokens(as_tokens, index or docs).where("place = 1").select("qid", "qpos", "tokid").join(token_idf(docs), "tokid")
    best = top_k(named, fb_embs, "qid", "idf", "qpos", "place").join(centres, ["qid", "qpos"])
    added = best.select("qid", (1000 + F.col("place")).cast("int").alias("qpos"), "tokid", (beta * F.col("idf")).alias("weight"), "v")
    return queries.select("qid", "qpos", "tokid", "weight", "v").unionByName(added)


def late_prf_pipeline(queries: DataFrame, docs: DataFrame, rerank: bool = True, depth: int = 1000, token_k: int = 100, index: CellFile | None = None) -> DataFrame:
    """Retrieve, score, expand, and score again: the same candidates, or those of the expanded query. Tokens are looked for in
    the cells of index, if given."""
    first = end_to_end(queries, index or docs, token_k, depth)
    fuller = late_prf(queries, first, docs, index=index)
    return maxsim(fuller, docs, first if rerank else set_retrieve(fuller, index or docs, token_k), depth)
