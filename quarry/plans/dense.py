"""Queries over vectors, feedback in vector space, and late interaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as vec
from quarry.functions.scores import top_k
from quarry.operators import cells, dense, late, nearest
from quarry.operators import evaluation as ev
from quarry.plans.prelude import hashed, sql, topk
from quarry.plans.tables import Tables

_K = 20


def _run(t: Tables) -> DataFrame:
    """The twenty nearest of the stated queries, searched for once a session."""
    return t.stored("dense run", lambda: dense.exact_knn(t.dq, t.dd, _K))


def _term_vectors(t: Tables) -> DataFrame:
    """Label centroids stand for terms: (term, v)."""
    return vec.mean_vector(t.dd.select(F.col("label").alias("term"), "v"), ["term"])


def _features(t: Tables, digits: int | None = 6) -> DataFrame:
    """(qid, term, place, rm_weight, semantic): labels near a query's, weighted by distance."""
    near = t.dq.select("qid", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("term"))
    rm = F.round(1.0 / (1 + F.abs(F.col("term") - F.col("label"))), 6)
    scored = near.select("qid", "term", rm.alias("rm_weight")).join(_term_vectors(t), "term").join(t.dq.select("qid", F.col("v").alias("q")), "qid")
    out = scored.select("qid", "term", "rm_weight", (lambda c: c if digits is None else F.round(c, digits))(vec.similarity(F.col("q"), F.col("v"), "clamped")).alias("semantic"))
    return top_k(out, None, "qid", "rm_weight", "term", "place")


def _enhanced(t: Tables, digits: int | None = 6) -> DataFrame:
    return dense.enhance(t.dq, dense.importance(_features(t, digits), digits=digits), _term_vectors(t))


def _candidates(t: Tables) -> DataFrame:
    """Each query document with the twenty documents that follow it."""
    return t.qtok.select("qid").distinct().select("qid", F.explode(F.sequence(F.col("qid") + 1, F.col("qid") + 20)).alias("docid"))


def _effect(t: Tables) -> DataFrame:
    runs = ev.name_runs({"plain": _run(t), "expanded": dense.exact_knn(_enhanced(t, None), t.dd, _K)})
    return ev.compare(ev.evaluate(runs, t.judged(runs), ("map", "ndcg_10"), ("run",), t.dcounts), "plain")


def _ablation(t: Tables) -> DataFrame:
    runs = {}
    for mode in ("both", "rm3_only", "cosine_only"):
        runs[mode] = dense.exact_knn(dense.enhance(t.dq, dense.importance(_features(t, None), mode=mode, digits=None), _term_vectors(t)), t.dd, _K)
    named = ev.name_runs(runs)
    return ev.evaluate(named, t.judged(named), ("map", "ndcg_10"), ("run",), t.dcounts)


def _ivf(t: Tables) -> DataFrame:
    """The ten nearest of the stated queries in the cells that they probe, with what was measured when these were built."""
    found = cells.cell_search(t.cells, t.dq, 10)
    return found.withColumn("probes", F.lit(t.cells.probes)).withColumn("measured_recall", F.lit(t.cells.recall))


def _lsh(t: Tables) -> DataFrame:
    """The ten nearest of the stated queries in the buckets that they probe, with the share of all pairs that were compared and
    the recall that was measured when the buckets were built."""
    index = dense.lsh_build(t.dd.select("docid", "v"))
    share = dense.lsh_compared(index, t.dq).join(t.dq.agg(F.count("*").alias("q")), F.lit(True)).join(t.dd.agg(F.count("*").alias("d")), F.lit(True)).select((F.col("n") / (F.col("q") * F.col("d"))).alias("compared"))
    return dense.lsh_search(index, t.dq, 10).join(F.broadcast(share), F.lit(True)).withColumn("measured_recall", F.lit(index.recall))


def _recall(t: Tables, found: DataFrame) -> DataFrame:
    """(queries, reached): whether an approximate search finds 0.9 or more of the ten nearest of the stated queries."""
    return dense.recall(found, dense.exact_knn(t.dq, t.dd, 10)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


#: Settings of the hybrid weights that are tried: alpha, beta, lambda.
_GRID = [(a, b, lam) for a in (0.0, 0.5, 1.0) for b in (0.25, 0.75) for lam in (0.3, 0.7)]


def _fitted(t: Tables) -> DataFrame:
    return dense.fit_weights(_run(t), t.dq, _features(t), _term_vectors(t), t.dd, t.judged(_run(t)), _GRID, counts=t.dcounts)


def _pair_features(t: Tables) -> DataFrame:
    """(qid, docid, x): cosines of each candidate with the query, and with the mean term vectors by either weight."""
    out = _run(t).select("qid", "docid")
    sides = [t.dq.select("qid", "v")] + [dense.enhance(t.dq, dense.importance(_features(t, None), mode=mode, digits=None), _term_vectors(t), 1.0) for mode in ("rm3_only", "cosine_only")]
    for n, side in enumerate(sides):
        scored = dense.rescore(_run(t), side, t.dd, None).select("qid", "docid", F.col("score").alias(f"x{n}"))
        out = out.join(scored, ["qid", "docid"])
    return out.select("qid", "docid", F.array("x0", "x1", "x2").alias("x"))


def _pieces(t: Tables) -> DataFrame:
    """Token vectors named as word pieces: odd positions continue a word."""
    piece = F.concat(F.when(F.col("pos") % 2 == 1, "##").otherwise(""), F.lit("t"), F.col("tokid").cast("string"))
    return t.tokvec.select("docid", "pos", piece.alias("piece"), "v")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else vec.rounded(F.col(c)).alias(c) if kind == "array<double>" else F.col(c) for c, kind in df.dtypes))


#: Weights that are supplied to the learned similarities, by a rule: 64 x 64, and 128 x 8, 8 x 4, 4.
BILINEAR = [[((3 * i + 5 * j) % 7 - 3) / 10 for j in range(64)] for i in range(64)]
MLP_1 = [[((7 * i + 3 * j) % 11 - 5) / 20 for j in range(8)] for i in range(128)]
MLP_2 = [[((5 * i + 2 * j) % 7 - 3) / 8 for j in range(4)] for i in range(8)]
MLP_3 = [0.5, -0.25, 0.75, 1.0]


def _choice(t: Tables) -> DataFrame:
    # the first ten relevant of a query are the first ten of its label; further ones matter only where the run holds them
    firsts = top_k(t.dd.select("label", "docid", F.lit(0).alias("score")).distinct(), 10, "label", "score", "docid")
    relevant = t.dq.select("qid", "label").join(firsts, "label").select("qid", "docid")
    return dense.relevant_and_rest(_run(t), relevant.unionByName(t.judged(_run(t)).where("grade = 2").select("qid", "docid")), 10)


QUERIES = {
    "normalize_vectors": lambda t: t.vectors.select("vec_id", vec.rounded(vec.l2norm(F.col("v"))).alias("v")),
    "vector_similarity": lambda t: nearest.measures(t.dq, t.dd),
    "bilinear_score": lambda t: nearest.products(t.dq.select("qid", F.transform("v", lambda x, i: x * (1 + i % 3)).alias("v")), t.dd, 0.25),
    "pool_tokens": lambda t: _rounded(dense.pooled(t.tokvec, "mean").withColumnRenamed("v", "mean").join(dense.pooled(t.tokvec, "max").withColumnRenamed("v", "high"), "docid").join(dense.pooled(t.tokvec, "cls").withColumnRenamed("v", "cls"), "docid")),
    "vector_sum": lambda t: _rounded(dense.totals(t.tokvec)),
    "vector_mean": lambda t: _rounded(vec.mean_vector(t.tokvec.select("docid", "v"), ["docid"])),
    "query_doc_crossjoin": lambda t: nearest.products(t.dq, t.dd).withColumnRenamed("score", "dot"),
    "exact_knn": _run,
    "exact_knn_l2": lambda t: dense.exact_knn(t.dq, t.dd, _K, "l2"),
    "knn_rank_scores": lambda t: dense.rank_scores(_run(t), _K),
    "ivf_knn": _ivf,
    "ivf_recall": lambda t: _recall(t, _ivf(t)),
    "lsh_knn": _lsh,
    "lsh_recall": lambda t: _recall(t, dense.lsh_knn(t.dq, t.dd)),
    "fit_weights": _fitted,
    "concat_prf_rerank": lambda t: dense.concat_prf(t.run_a, t.queries, t.docs),
    "recommend_index": lambda t: t.vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).select("n", dense.recommend_index(F.col("n"), F.col("dim"), F.lit(False)).alias("plan"), dense.recommend_index(F.col("n") * 1000, F.col("dim"), F.lit(True)).alias("low_memory_plan")),
    "embedding_norm_stats": lambda t: dense.norm_stats(t.vectors),
    "embedding_quality": lambda t: dense.embedding_quality(t.dq, t.dd),
    "lookup_vectors_by_index": lambda t: t.events_index().join(t.vectors.select(F.col("vec_id").alias("idx"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id")), "idx", "left").select("idx", F.coalesce("id", F.lit("")).alias("id")),
    "prf_average": lambda t: _rounded(dense.prf_vectors(t.dq, _run(t), t.dd, 3, "average")),
    "prf_rocchio": lambda t: _rounded(dense.prf_vectors(t.dq, _run(t), t.dd, 3, "rocchio")),
    "vector_prf_rerank": lambda t: dense.vector_prf(_run(t), t.dq, t.dd),
    "term_importance": lambda t: dense.importance(_features(t), squash=True),
    "enhanced_query_vector": lambda t: _enhanced(t, None).select("qid", F.posexplode("v").alias("dim", "x")),
    "rerank_candidates": lambda t: dense.rescore(_run(t), _enhanced(t, None), t.dd, 100, missing="keep"),
    "rerank_bilinear": lambda t: dense.rescore(_run(t), _enhanced(t, None), t.dd, 100, vec.bilinear(BILINEAR, 0.25), "keep"),
    "rerank_mlp": lambda t: dense.rescore(_run(t), _enhanced(t, None), t.dd, 100, vec.mlp(MLP_1, MLP_2, MLP_3), "keep"),
    "batch_retrieval_job": lambda t: dense.exact_knn(_enhanced(t, None), t.dd, _K),
    "expansion_effect": _effect,
    "ablation_eval": _ablation,
    "score_interpolation": lambda t: dense.interpolate(_run(t), dense.rescore(_run(t), _enhanced(t, None), t.dd, None)),
    "multi_stage_rerank": lambda t: dense.multi_stage(_run(t), lambda run: dense.rescore(run, _enhanced(t, None), t.dd, None)),
    "token_index": lambda t: t.tokvec.groupBy("docid").agg(F.count("*").alias("doclen"), F.min("tokid").alias("least"), F.max("tokid").alias("greatest")),
    "merge_token_indexes": lambda t: late.merge_indexes([t.tokvec.where("docid < 50").drop("v"), t.tokvec.where("docid >= 50").withColumn("docid", F.col("docid") - 50).drop("v")]),
    "maxsim_score": lambda t: late.maxsim(t.qtok, t.tokvec),
    "maxsim_contributions": lambda t: late.contributions(t.qtok, t.tokvec, _candidates(t)),
    "exact_match_share": lambda t: late.exact_match_share(t.qtok, t.tokvec, _candidates(t)),
    "interaction_matrix": lambda t: late.interaction_matrix(t.qtok, t.tokvec, _candidates(t)),
    "set_retrieve": lambda t: late.set_retrieve(t.qtok, t.tokvec, 20),
    "ann_retrieve_score": lambda t: late.ann_score(t.qtok, t.tokvec, 20),
    "end_to_end": lambda t: late.end_to_end(t.qtok, t.tokvec, 20),
    "set_retrieve_cells": lambda t: late.set_retrieve(t.qtok, t.token_cells, 20),
    "ann_retrieve_cells": lambda t: late.ann_score(t.qtok, t.token_cells, 20),
    "end_to_end_cells": lambda t: late.end_to_end(t.qtok, t.token_cells, 20),
    "nearest_tokens_cells": lambda t: late.nearest_tokens(t.qtok, t.token_cells),
    "token_recall": lambda t: late.token_recall(t.qtok, t.tokvec, t.token_cells, 20),
    "token_recall_reached": lambda t: late.token_recall(t.qtok, t.tokvec, t.token_cells, 20).select("queries", (F.col("recall") >= 0.9).alias("reached")),
    "fetch_encodings": lambda t: late.fetch_encodings(_candidates(t), t.tokvec).select("qid", "docid", "tokids", F.size("vectors").alias("n_vectors")),
    "embeddings_by_token": lambda t: late.tokens_of(t.tokvec, 3).select("docid", "pos", "tokid"),
    "nearest_tokens": lambda t: late.nearest_tokens(t.qtok, t.tokvec),
    "token_idf": lambda t: late.token_idf(t.tokvec),
    "colbert_prf": lambda t: late.late_prf(t.qtok, late.end_to_end(t.qtok, t.token_cells, 20), t.tokvec, index=t.token_cells),
    "colbert_prf_pipeline": lambda t: late.late_prf_pipeline(t.qtok, t.tokvec, token_k=20, index=t.token_cells),
    "prune_query_tokens_freq": lambda t: late.prune_by_frequency(t.qtok, late.token_stats(t.tokvec), 2),
    "prune_query_tokens_first": lambda t: late.prune_first(t.qtok, 2),
    "prune_query_tokens_special": lambda t: late.prune_special(t.qtok).select("qid", "qpos", "tokid"),
    "merge_wordpieces": lambda t: _rounded(late.merge_pieces(_pieces(t))),
    "add_ranks": lambda t: top_k(_run(t).select("qid", "docid", "score"), None),
    "cutoff": lambda t: top_k(_run(t).select("qid", "docid", "score"), 5),
    "relevant_vs_rest_choice": _choice,
    "relevant_vs_rest": lambda t: dense.project_queries(_choice(t), t.dq, t.dd),
    "vector_projection": lambda t: dense.project(t.vectors, "vec_id"),
    "fit_pairwise": lambda t: dense.fit_pairwise(_pair_features(t), t.judged(_run(t))),
}

_COS = "CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 THEN 0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
_QD = _COS.format(a="dq.v", b="dd.v")
#: A rounded value is a plain 0 in Spark, whatever was rounded; DuckDB's keeps the sign, until 0 is added.
_LIST6 = "list_transform({x}, lambda e: round(e, 6) + 0e0)"


def _knn(q: str, score: str = _QD, k: int | None = _K) -> str:
    return topk(f"SELECT dq.qid AS qid, dd.docid AS docid, round({score}, 6) AS score FROM {q} dq, dd", "qid", "score", "docid", k)


def _by_dim(source: str, keys: str, fold: str, vector: str = "v") -> str:
    inner = f"SELECT {keys}, unnest(range(0, len({vector}))) AS dim, unnest({vector}) AS x, * EXCLUDE ({keys}, {vector}) FROM ({source})"
    return f"SELECT {keys}, list(x ORDER BY dim) AS v FROM (SELECT {keys}, dim, {fold} AS x FROM ({inner}) GROUP BY {keys}, dim) GROUP BY {keys}"


_RUN = {"run": _knn("dq")}
_TERMV = _by_dim("SELECT label AS term, v FROM dd", "term", "avg(x)")
_FEAT = {
    "tv": _TERMV,
    "feat": topk(f"SELECT qid, term, rm_weight, round(greatest(0, {_COS.format(a='q', b='v')}), 6) AS semantic FROM (SELECT qid, v AS q, label, unnest(range(0, 10))::INT AS term FROM dq) JOIN tv USING (term), LATERAL (SELECT round(1e0 / (1 + abs(term - label)), 6) AS rm_weight)", "qid", "rm_weight", "term", None, "place"),
}


def _enh(weight: str, name: str = "enh") -> dict[str, str]:
    summed = _by_dim(f"SELECT qid, {weight} AS w, v FROM feat JOIN tv USING (term) WHERE place <= 15", "qid", "sum(w * x)")
    return {
        f"{name}_s": summed.replace("AS v FROM", "AS s FROM", 1),
        name: f"SELECT qid, CASE WHEN total > 1e-8 THEN list_transform(list_zip(v, s), lambda c: 0.5e0 * c[1] + 0.5e0 * c[2] / total) ELSE v END AS v FROM dq LEFT JOIN {name}_s USING (qid) LEFT JOIN (SELECT qid, sum({weight}) AS total FROM feat WHERE place <= 15 GROUP BY qid) USING (qid)",
    }


_BOTH = "0.5e0 * rm_weight + 0.5e0 * semantic"
#: Features and weights as they are: rounded ones can move a score over the edge between two of six decimals.
_EXACT = {**_FEAT, "feat": _FEAT["feat"].replace("round(greatest(0,", "(greatest(0,").replace(", 6) AS semantic", ") AS semantic")}
_ENH = {**_EXACT, **_enh(_BOTH)}
_SQUASH = "1 / (1 + exp(-0.5e0)) * rm_weight + 1 / (1 + exp(-0.5e0)) * semantic"


def _rescored(run: str, q: str, kind: str = _COS, k: int | None = None) -> str:
    return topk(f"SELECT r.qid AS qid, r.docid AS docid, round({kind.format(a='a.v', b='b.v')}, 6) AS score FROM {run} r JOIN {q} a ON a.qid = r.qid JOIN dd b ON b.docid = r.docid", "qid", "score", "docid", k)


_FUSED = {
    "fb": _by_dim("SELECT run.qid AS qid, dd.v AS v FROM run JOIN dd USING (docid) WHERE rank <= 3", "qid", "avg(x)").replace("AS v FROM", "AS m FROM", 1),
    "rocchio": "SELECT qid, CASE WHEN m IS NULL THEN v ELSE list_transform(list_zip(v, m), lambda c: c[1] + 0.5e0 * c[2]) END AS v FROM dq LEFT JOIN fb USING (qid)",
}


def _mean_metrics(runs: str) -> dict[str, str]:
    return {
        "runs": runs,
        "rk": "SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY run, qid ORDER BY r) AS hit FROM (SELECT run, qid, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, docid::VARCHAR DESC) AS r FROM runs LEFT JOIN dqrels USING (qid, docid))",
        "ideal": "SELECT qid, count(*) AS rel, sum(grade / log2(p + 1)) FILTER (p <= 10) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS p FROM dqrels) GROUP BY qid",
        "per": "SELECT run, qid, round(coalesce(ap / rel, 0), 6) AS map, round(dcg / best, 6) AS ndcg_10 FROM (SELECT run, qid, sum(hit / r) FILTER (grade > 0) AS ap, sum(grade / log2(r + 1)) FILTER (r <= 10) AS dcg FROM rk GROUP BY run, qid) JOIN ideal USING (qid)",
        "many": "SELECT run, 'map' AS metric, round(avg(map), 6) AS value, count(*) AS n FROM per GROUP BY run UNION ALL SELECT run, 'ndcg_10', round(avg(ndcg_10), 6), count(*) FROM per GROUP BY run",
    }


_SIM = {
    "cand": "SELECT qid, unnest(range(qid + 1, qid + 21)) AS docid FROM (SELECT DISTINCT qid FROM qtok)",
    "sims": "SELECT q.qid AS qid, qpos, q.tokid AS qtok, weight, d.docid AS docid, pos, d.tokid AS tokid, list_dot_product(q.v, d.v) AS sim FROM qtok q, tokvec d",
    "csims": "SELECT sims.* FROM sims JOIN cand USING (qid, docid)",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qpos ORDER BY sim DESC, docid, pos) AS place FROM (SELECT * REPLACE (round(sim, 6) AS sim) FROM sims)) WHERE place <= 20",
}
_MAXSIM = topk("SELECT qid, docid, round(sum(weight * greatest(0, sim)), 6) AS score FROM (SELECT qid, docid, qpos, weight, max(sim) AS sim FROM {s} GROUP BY ALL) GROUP BY qid, docid", "qid", "score", "docid", 1000)
_STATS = "SELECT tokid, count(*) AS cf, count(DISTINCT docid) AS df FROM tokvec GROUP BY tokid"

SQL = {
    "normalize_vectors": sql("vecs", "SELECT vec_id, " + _LIST6.format(x="list_transform(v, lambda e: CASE WHEN n = 0 THEN e ELSE e / n END)") + " AS v FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM vecs)"),
    "vector_similarity": sql("dq dd", f"SELECT qid, docid, round({_QD}, 6) AS cosine, round(greatest(0, {_QD}), 6) AS clamped, round(list_dot_product(dq.v, dd.v), 6) AS dot, round(-list_distance(dq.v, dd.v), 6) AS l2, round(-list_sum(list_transform(list_zip(dq.v, dd.v), lambda c: abs(c[1] - c[2]))), 6) AS l1 FROM dq, dd"),
    "bilinear_score": sql("dq dd", "SELECT qid, docid, round(list_dot_product(list_transform(dq.v, lambda x, i: x * (1 + (i - 1) % 3)), dd.v) + 0.25e0, 6) AS score FROM dq, dd"),
    "pool_tokens": sql("tokvec", f"SELECT docid, {_LIST6.format(x='a.v')} AS mean, {_LIST6.format(x='b.v')} AS high, {_LIST6.format(x='c.v')} AS cls FROM a JOIN b USING (docid) JOIN (SELECT docid, arg_min(v, pos) AS v FROM tokvec GROUP BY docid) c USING (docid)", a=_by_dim("SELECT docid, v FROM tokvec", "docid", "avg(x)"), b=_by_dim("SELECT docid, v FROM tokvec", "docid", "max(x)")),
    "vector_sum": sql("tokvec", f"SELECT docid, {_LIST6.format(x='v')} AS v FROM a", a=_by_dim("SELECT docid, v FROM tokvec", "docid", "sum(x)")),
    "vector_mean": sql("tokvec", f"SELECT docid, {_LIST6.format(x='v')} AS v FROM a", a=_by_dim("SELECT docid, v FROM tokvec", "docid", "avg(x)")),
    "query_doc_crossjoin": sql("dq dd", "SELECT qid, docid, round(list_dot_product(dq.v, dd.v), 6) AS dot FROM dq, dd"),
    "exact_knn": sql("dq dd", _knn("dq")),
    "ivf_recall": sql("dq", "SELECT count(*) AS queries, true AS reached FROM dq"),
    "lsh_recall": sql("dq", "SELECT count(*) AS queries, true AS reached FROM dq"),
    "token_recall_reached": sql("qtok", "SELECT count(*) AS queries, true AS reached FROM qtok"),
    "fit_weights": sql(
        "dqrels", "SELECT alpha, beta, lam, value, n, value = max(value) OVER () AS best FROM many JOIN grid ON grid.cfg::VARCHAR = many.run WHERE metric = 'ndcg_10'", **_RUN, **_FEAT,
        grid=f"SELECT * FROM (VALUES {', '.join(f'({i}, {a}e0, {b}e0, {lam}e0)' for i, (a, b, lam) in enumerate(_GRID))}) g(cfg, alpha, beta, lam)",
        gw="SELECT cfg, qid, round(alpha * rm_weight + beta * semantic, 6) AS w, v FROM feat JOIN tv USING (term), grid WHERE place <= 15",
        gs=_by_dim("SELECT cfg, qid, w, v FROM gw", "cfg, qid", "sum(w * x)").replace("AS v FROM", "AS s FROM", 1),
        ge="SELECT cfg, qid, CASE WHEN total > 1e-8 THEN list_transform(list_zip(v, s), lambda c: (1 - lam) * c[1] + lam * c[2] / total) ELSE v END AS v FROM (SELECT * FROM dq, grid) LEFT JOIN gs USING (cfg, qid) LEFT JOIN (SELECT cfg, qid, sum(w) AS total FROM gw GROUP BY cfg, qid) USING (cfg, qid)",
        **_mean_metrics(f"SELECT cfg::VARCHAR AS run, r.qid AS qid, r.docid AS docid, round({_COS.format(a='a.v', b='b.v')}, 6) AS score FROM run r JOIN ge a ON a.qid = r.qid JOIN dd b ON b.docid = r.docid"),
    ),
    "concat_prf_rerank": sql(
        "run_a", topk("SELECT r.qid AS qid, r.docid AS docid, round(list_dot_product(a.v, b.v), 6) AS score FROM run_a r JOIN eq a ON a.qid = r.qid JOIN ed b ON b.docid = r.docid WHERE r.rank <= 100", "qid", "score", "docid", 100),
        texts="SELECT docid, text FROM d WHERE text IS NOT NULL AND trim(text) <> '' AND docid IN (SELECT docid FROM run_a)",
        asked="SELECT qid, CASE WHEN n >= 3 THEN query || ' ' || fed ELSE query END AS text FROM q LEFT JOIN (SELECT qid, count(*) AS n, string_agg(text, ' ' ORDER BY rank) AS fed FROM run_a JOIN texts USING (docid) WHERE rank <= 3 GROUP BY qid) USING (qid)",
        eq=hashed("asked", "qid", "text"), ed=hashed("texts", "docid", "text"),
    ),
    "exact_knn_l2": sql("dq dd", _knn("dq", "-list_distance(dq.v, dd.v)")),
    "knn_rank_scores": sql("dq dd", "SELECT qid, docid, rank, round(1 - (rank - 1) / 20e0, 6) AS score FROM run", **_RUN),
    "recommend_index": sql("vecs", "SELECT count(*) AS n, CASE WHEN count(*) < 10000 THEN 'flat' WHEN count(*) < 100000 THEN 'ivf' WHEN max(len(v)) > 512 THEN 'hnsw' ELSE 'ivf' END AS plan, CASE WHEN count(*) * 1000 < 10000 THEN 'flat' WHEN count(*) * 1000 < 100000 THEN 'ivf' ELSE 'pq' END AS low_memory_plan FROM vecs"),
    "embedding_norm_stats": sql("vecs", "SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT sqrt(list_dot_product(v, v)) AS x FROM vecs)"),
    "embedding_quality": sql(
        "dqrels", f"""SELECT round(min(c), 6) AS low, round(max(c), 6) AS high, round(avg(c) FILTER (hit), 6) AS positive, round(avg(c) FILTER (NOT hit), 6) AS negative, round(avg(c) FILTER (hit) - avg(c) FILTER (NOT hit), 6) AS separation,
      (SELECT round(avg(sqrt(list_dot_product(v, v))), 6) FROM dq) AS query_norm, (SELECT round(avg(sqrt(list_dot_product(v, v))), 6) FROM dd) AS doc_norm FROM (SELECT {_QD} AS c, dq.label = dd.label AS hit FROM dq, dd)""",
    ),
    "lookup_vectors_by_index": sql("vecs", "SELECT idx, coalesce('v' || vec_id, '') AS id FROM (SELECT event_id * 3 AS idx FROM events) LEFT JOIN vecs ON vec_id = idx"),
    "prf_average": sql("dq dd", f"SELECT qid, {_LIST6.format(x='v')} AS v FROM a", **_RUN, a=_by_dim("SELECT qid, v FROM dq UNION ALL SELECT run.qid, dd.v FROM run JOIN dd USING (docid) WHERE rank <= 3", "qid", "avg(x)")),
    "prf_rocchio": sql("dq dd", f"SELECT qid, {_LIST6.format(x='v')} AS v FROM rocchio", **_RUN, **_FUSED),
    "vector_prf_rerank": sql("dq dd", _rescored("run", "rocchio", "list_dot_product({a}, {b})", 1000), **_RUN, **_FUSED),
    "term_importance": sql("dq dd", f"SELECT qid, term, rm_weight, semantic, place, round({_SQUASH}, 6) AS weight FROM feat", **_FEAT),
    "enhanced_query_vector": sql("dq dd", "SELECT qid, unnest(range(0, len(v)))::INT AS dim, unnest(v) AS x FROM enh", **_ENH),
    "rerank_candidates": sql("dq dd", _rescored("run", "enh", k=100), **_RUN, **_ENH),
    "rerank_bilinear": sql(
        "dq dd", topk("SELECT qid, docid, round(sum(a * b * ((3 * i + 5 * j) % 7 - 3) / 10e0) + 0.25e0, 6) AS score FROM ea JOIN run USING (qid) JOIN da USING (docid) GROUP BY qid, docid", "qid", "score", "docid", 100), **_RUN, **_ENH,
        ea="SELECT qid, unnest(range(0, 64)) AS i, unnest(v) AS a FROM enh", da="SELECT docid, unnest(range(0, 64)) AS j, unnest(v) AS b FROM dd",
    ),
    "rerank_mlp": sql(
        "dq dd", topk("SELECT qid, docid, round(sum(h * [0.5e0, -0.25e0, 0.75e0, 1e0][k + 1]), 6) AS score FROM l2 GROUP BY qid, docid", "qid", "score", "docid", 100), **_RUN, **_ENH,
        hq="SELECT qid, j, sum(x * ((7 * i + 3 * j) % 11 - 5) / 20e0) AS a FROM (SELECT qid, unnest(range(0, 64)) AS i, unnest(v) AS x FROM enh), (SELECT unnest(range(8)) AS j) GROUP BY qid, j",
        hd="SELECT docid, j, sum(x * ((7 * (i + 64) + 3 * j) % 11 - 5) / 20e0) AS b FROM (SELECT docid, unnest(range(0, 64)) AS i, unnest(v) AS x FROM dd), (SELECT unnest(range(8)) AS j) GROUP BY docid, j",
        l2="SELECT qid, docid, k, greatest(0, sum(greatest(0, a + b) * ((5 * j + 2 * k) % 7 - 3) / 8e0)) AS h FROM hq JOIN run USING (qid) JOIN hd USING (docid, j), (SELECT unnest(range(4)) AS k) GROUP BY qid, docid, k",
    ),
    "relevant_vs_rest_choice": sql(
        "dqrels", """SELECT qid, docid, kind, place FROM (
      SELECT qid, docid, 'relevant' AS kind, row_number() OVER (PARTITION BY qid ORDER BY docid) AS place FROM dqrels WHERE grade = 2
      UNION ALL SELECT qid, docid, 'rest', row_number() OVER (PARTITION BY qid ORDER BY rank) FROM run ANTI JOIN (SELECT * FROM dqrels WHERE grade = 2) USING (qid, docid)) WHERE place <= 10""", **_RUN,
    ),
    "batch_retrieval_job": sql("dq dd", _knn("enh"), **_ENH),
    "expansion_effect": sql("dqrels", "SELECT a.run, a.metric, a.value, b.value AS base, round(CASE WHEN b.value > 0 THEN a.value - b.value ELSE a.value END, 6) AS absolute, round(CASE WHEN b.value > 0 THEN 100 * (a.value - b.value) / b.value ELSE 0 END, 6) AS percent FROM many a JOIN many b USING (metric) WHERE a.run = 'expanded' AND b.run = 'plain'", **_RUN, **_ENH, run2=_knn("enh"), **_mean_metrics("SELECT 'plain' AS run, qid, docid, score FROM run UNION ALL SELECT 'expanded', qid, docid, score FROM run2")),
    "ablation_eval": sql("dqrels", "SELECT run, metric, value, n FROM many", **_ENH, **_enh("0.5e0 * rm_weight", "er"), **_enh("0.5e0 * semantic", "ec"), r1=_knn("enh"), r2=_knn("er"), r3=_knn("ec"), **_mean_metrics("SELECT 'both' AS run, qid, docid, score FROM r1 UNION ALL SELECT 'rm3_only', qid, docid, score FROM r2 UNION ALL SELECT 'cosine_only', qid, docid, score FROM r3")),
    "score_interpolation": sql("dq dd", topk("SELECT qid, docid, round(CASE WHEN n < 10 THEN run.score ELSE 0.7e0 * run.score + (1 - 0.7e0) * f.score END, 6) AS score FROM run JOIN f USING (qid, docid) JOIN (SELECT qid, count(*) AS n FROM run GROUP BY qid) USING (qid)", "qid", "score", "docid", None), **_RUN, **_ENH, f=_rescored("run", "enh")),
    "multi_stage_rerank": sql("dq dd", _rescored("s2", "enh", k=40), **_RUN, **_ENH, s1=_rescored("run", "enh", k=10), s2=_rescored("s1", "enh", k=20)),
    "token_index": sql("tokvec", "SELECT docid, count(*) AS doclen, min(tokid) AS least, max(tokid) AS greatest FROM tokvec GROUP BY docid"),
    "merge_token_indexes": sql("tokvec", "SELECT docid, pos, tokid, (docid >= 50)::INT AS part FROM tokvec"),
    "maxsim_score": sql("qtok", _MAXSIM.format(s="sims"), **_SIM),
    "maxsim_contributions": sql("qtok", "SELECT qid, docid, list(sim ORDER BY pos) AS best FROM (SELECT qid, docid, pos, round(max(sim), 6) + 0e0 AS sim FROM csims GROUP BY ALL) GROUP BY qid, docid", **_SIM),
    "exact_match_share": sql("qtok", "SELECT qid, docid, round(CASE WHEN sum(weight * greatest(0, sim)) > 0 THEN coalesce(sum(weight * greatest(0, sim)) FILTER (qtok = tokid), 0) / sum(weight * greatest(0, sim)) ELSE 0 END, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY qid, docid, qpos ORDER BY sim DESC, pos) AS k FROM csims WHERE qtok NOT IN (101, 102, 103, 1, 2)) WHERE k = 1 GROUP BY qid, docid", **_SIM),
    "interaction_matrix": sql("qtok", "SELECT qid, docid, qpos, list(s ORDER BY pos) AS sims, min(pos) FILTER (s = top) AS best_pos FROM (SELECT *, round(sim, 6) + 0e0 AS s, max(round(sim, 6)) OVER (PARTITION BY qid, docid, qpos) AS top FROM csims) GROUP BY qid, docid, qpos", **_SIM),
    "set_retrieve": sql("qtok", "SELECT DISTINCT qid, docid FROM near", **_SIM),
    "ann_retrieve_score": sql("qtok", _MAXSIM.format(s="near"), **_SIM),
    "end_to_end": sql("qtok", _MAXSIM.format(s="(SELECT sims.* FROM sims JOIN (SELECT DISTINCT qid, docid FROM near) USING (qid, docid))"), **_SIM),
    "fetch_encodings": sql("qtok", "SELECT qid, docid, list(tokid ORDER BY pos) AS tokids, count(*)::INT AS n_vectors FROM cand JOIN tokvec USING (docid) GROUP BY qid, docid", cand=_SIM["cand"]),
    "embeddings_by_token": sql("tokvec", "SELECT docid, pos, tokid FROM tokvec WHERE tokid = 3"),
    "nearest_tokens": sql("qtok", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qpos ORDER BY n DESC, tokid) AS place FROM (SELECT qid, qpos, tokid, count(*) AS n FROM near WHERE place <= 10 AND tokid NOT IN (101, 102, 103, 1, 2) GROUP BY ALL))", **_SIM),
    "token_idf": sql("tokvec", f"SELECT tokid, round(ln((1e0 + n) / (1e0 + df)), 6) AS idf FROM ({_STATS}), (SELECT count(DISTINCT docid) AS n FROM tokvec)"),
    "prune_query_tokens_freq": sql("qtok", f"SELECT qid, qpos, tokid, place FROM (SELECT qid, qpos, tokid, row_number() OVER (PARTITION BY qid ORDER BY cf NULLS LAST, qpos) AS place FROM qtok LEFT JOIN ({_STATS}) USING (tokid)) WHERE place <= 2"),
    "prune_query_tokens_first": sql("qtok", "SELECT * FROM (SELECT qid, qpos, tokid, row_number() OVER (PARTITION BY qid ORDER BY qpos) AS place FROM qtok) WHERE place <= 2"),
    "prune_query_tokens_special": sql("qtok", "SELECT qid, qpos, tokid FROM qtok WHERE tokid NOT IN (101, 1, 103)"),
    "merge_wordpieces": sql("tokvec", f"SELECT docid, word_no, word, {_LIST6.format(x='v')} AS v FROM a JOIN (SELECT docid, word_no, string_agg('t' || tokid, '' ORDER BY pos) AS word FROM w GROUP BY docid, word_no) USING (docid, word_no)", w="SELECT *, sum((pos % 2 = 0)::INT) OVER (PARTITION BY docid ORDER BY pos)::BIGINT AS word_no FROM tokvec", a=_by_dim("SELECT docid, word_no, v FROM w", "docid, word_no", "avg(x)")),
    "add_ranks": sql("dq dd", "SELECT qid, docid, score, rank FROM run", **_RUN),
    "cutoff": sql("dq dd", "SELECT qid, docid, score, rank FROM run WHERE rank <= 5", **_RUN),
}
