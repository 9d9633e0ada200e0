"""Queries over the inverted index and query expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import blocks, evaluation, lexical
from quarry.plans.prelude import feedback, retrieve, rm3, sql, topk
from quarry.plans.tables import Tables

_METRIC = ("ndcg_10",)


def _terms(t: Tables) -> DataFrame:
    return t.rm3_terms.select("qid", "term", "weight")


def _tuned(t: Tables) -> DataFrame:
    run = lexical.tune_alpha(t.queries, t.index, t.run_a, reach=10)
    return evaluation.evaluate(run, t.qrels, _METRIC, ("alpha",)).withColumn("best", F.col("value") == F.max("value").over(scores.W.partitionBy("metric"))).select("alpha", "value", "n", "best")


QUERIES = {
    "tokenize": lambda t: text.tokenize(t.docs, "docid", "text"),
    "analyze_terms": lambda t: text.analyze(t.docs, "docid", "text"),
    "build_postings": lambda t: lexical.build_postings(t.docs).postings,
    "index_stats": lambda t: t.index.stats.select("n", F.round("avgdl", 6).alias("avgdl"), "total"),
    "term_stats": lambda t: lexical.term_stats(t.index.postings),
    "bm25_topk": lambda t: t.bm25(),
    "weighted_query_topk": lambda t: t.boosted(),
    "bm25_block_topk": lambda t: blocks.retrieve_blocks(lexical.query_terms(t.queries), t.blocks, 100),
    "weighted_block_topk": lambda t: blocks.retrieve_blocks(_terms(t).withColumn("weight", F.greatest("weight", F.lit(1e-6))), t.blocks, 100),
    "block_report": lambda t: blocks.block_report(_terms(t), t.blocks, 100),
    "feedback_docs": lambda t: lexical.feedback(t.run_a).select("qid", "docid", "rank", F.round("weight", 6).alias("weight")),
    "rm1_feedback_model": lambda t: lexical.rm1(lexical.feedback(t.run_a), t.index).select("qid", "term", F.round("p", 6).alias("p")),
    "rm3_expand": lambda t: t.expanded(),
    "stem_to_original": lambda t: lexical.surface_forms(lexical.feedback(t.run_a), t.docs),
    "bo1_expand": lambda t: lexical.divergence_expand(t.queries, t.index, t.run_a, "bo1"),
    "kl_expand": lambda t: lexical.divergence_expand(t.queries, t.index, t.run_a, "kl"),
    "two_pass_retrieval": lambda t: lexical.two_pass(t.queries, t.index, "bo1"),
    "expansion_stats": lambda t: lexical.expansion_stats(_terms(t)),
    "explain_expansion": lambda t: lexical.explain_expansion(t.queries, t.run_a),
    "semantic_scores": lambda t: lexical.semantic_scores(t.queries, _terms(t), lexical.profiles(t.index, lexical.met_terms(t.queries, _terms(t)))),
    "term_features": lambda t: lexical.term_features(t.queries, t.index, t.docs, t.run_a),
    "sample_queries": lambda t: t.queries.orderBy(F.md5(F.concat(F.lit("7:"), F.col("qid").cast("string")))).limit(25),
    "tune_alpha": _tuned,
    "minmax_per_query": lambda t: t.run_a.select("qid", "docid", F.round(scores.minmax(F.col("score")), 6).alias("scaled")),
    "minmax_half": lambda t: t.run_a.select("qid", "docid", F.round(scores.minmax_half(F.col("score")), 6).alias("scaled")),
    "sum_or_softmax_norm": lambda t: scores.probability(t.run_a.withColumn("score", F.when(F.col("qid") % 2 == 0, F.col("score")).otherwise(F.col("score") - 20))).select("qid", "docid", F.round("weight", 6).alias("weight")),
    "logsumexp_posterior": lambda t: scores.posterior(t.run_a).select("qid", "docid", F.round("posterior", 6).alias("posterior")),
}

_DIV = {
    "bo1": "tfx * log2((1 + cf / n) / (cf / n)) + log2(1 + cf / n)",
    "kl": "(tfx / lx) * log2((tfx / lx) / (cf / total))",
}


def _divergence(model: str) -> str:
    raw = f"""SELECT qid, term, round({_DIV[model]}, 6) AS raw FROM (
      SELECT qid, term, tfx, sum(tfx) OVER (PARTITION BY qid) AS lx FROM (SELECT qid, term, sum(tf) AS tfx FROM run_a JOIN postings USING (docid) WHERE rank <= 3 GROUP BY qid, term)
    ) JOIN freq USING (term), stats"""
    best = topk(f"SELECT * FROM ({raw}) WHERE raw > 0", "qid", "raw", "term", 10, "place")
    return f"""SELECT qid, term, round(sum(weight), 6) AS weight FROM (
      SELECT qid, term, raw / max(raw) OVER (PARTITION BY qid) AS weight FROM ({best}) UNION ALL SELECT qid, term, weight FROM qbag) GROUP BY qid, term"""


_SEMANTIC = """SELECT qid, term, round(greatest(0, coalesce(dot / (qlen * tlen), 0)), 6) AS semantic FROM rm3t
  LEFT JOIN (SELECT qid, term, sum(x * qx) AS dot FROM rm3t JOIN prof USING (term) JOIN qv USING (qid, docid) GROUP BY qid, term) USING (qid, term)
  LEFT JOIN (SELECT qid, sqrt(sum(qx * qx)) AS qlen FROM qv GROUP BY qid) USING (qid)
  LEFT JOIN (SELECT term, sqrt(sum(x * x)) AS tlen FROM prof GROUP BY term) USING (term)"""
_PROFILES = {
    "prof": "SELECT term, docid, tf * ln(1 + n / df) AS x FROM postings JOIN freq USING (term), stats",
    "qv": "SELECT qid, docid, sum(weight * x) AS qx FROM qbag JOIN prof USING (term) GROUP BY qid, docid",
}
_FORMS = topk(
    "SELECT qid, stem AS term, form, count(*) AS n FROM run_a JOIN dterms USING (docid) WHERE rank <= 10 GROUP BY ALL", "qid, term", "n", "form", 1
)
FEATURES = {
    **_PROFILES,
    "sem": _SEMANTIC,
    "forms": _FORMS,
    "feat": """SELECT qid, rm3t.term AS term, place, round((weight - min(weight) OVER w) / CASE WHEN max(weight) OVER w = min(weight) OVER w THEN 1 ELSE max(weight) OVER w - min(weight) OVER w END, 6) AS rm_weight,
      semantic, coalesce(form, rm3t.term) AS original_term FROM rm3t JOIN sem USING (qid, term) LEFT JOIN forms USING (qid, term) WINDOW w AS (PARTITION BY qid)""",
}
NDCG10 = """SELECT {keys}, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS value FROM (
    SELECT {keys}, sum(coalesce(grade, 0) / log2(r + 1)) FILTER (r <= 10) AS dcg FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, docid::VARCHAR DESC) AS r FROM {run}) LEFT JOIN qrels USING (qid, docid) GROUP BY {keys})
  JOIN (SELECT qid, sum(grade / log2(p + 1)) FILTER (p <= 10) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS p FROM qrels) GROUP BY qid) USING (qid)"""

_TOKENS = r"""SELECT docid, unnest(range(0, len(toks)))::INT AS pos, unnest(toks) AS token FROM (
  SELECT docid, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: regexp_matches(t, '^[a-z]{2,}$')) AS toks FROM d)"""
_ALPHA_RUN = retrieve("alphat", 1000, "alpha, qid")
_ALPHA_TERMS = topk(
    f"""SELECT alpha, qid, term, round(sum(part), 6) AS weight FROM (
      SELECT alpha, qid, stem AS term, alpha / count(*) OVER (PARTITION BY qid, alpha) AS part FROM qterms, alphas
      UNION ALL SELECT alpha, qid, term, (1 - alpha) * p AS part FROM (
        SELECT qid, term, sum(f.weight * tf / dl) AS p FROM ({feedback("run_a", 10)}) f JOIN postings USING (docid) JOIN doclen USING (docid) GROUP BY qid, term), alphas
    ) GROUP BY alpha, qid, term""",
    "alpha, qid", "weight", "term", 15, "place",
)

SQL = {
    "tokenize": sql("d", _TOKENS),
    "analyze_terms": sql("dterms", "SELECT docid, pos, form, stem FROM dterms"),
    "build_postings": sql("postings", "SELECT term, docid, tf FROM postings"),
    "index_stats": sql("stats", "SELECT n, round(avgdl, 6) AS avgdl, total FROM stats"),
    "term_stats": sql("freq", "SELECT term, cf, df FROM freq"),
    "bm25_topk": sql("run_a", "SELECT qid, docid, score, rank FROM run_a"),
    "weighted_query_topk": sql("run_b", "SELECT qid, docid, score, rank FROM run_b"),
    "bm25_block_topk": sql("run_a", "SELECT qid, docid, score, rank FROM run_a"),
    "weighted_block_topk": sql("run_b", "SELECT qid, docid, score, rank FROM run_b"),
    "feedback_docs": sql("run_a", f"SELECT qid, docid, rank, round(weight, 6) AS weight FROM ({feedback('run_a', 10)})"),
    "rm1_feedback_model": sql("run_a", f"SELECT qid, term, round(sum(f.weight * tf / dl), 6) AS p FROM ({feedback('run_a', 10)}) f JOIN postings USING (docid) JOIN doclen USING (docid) GROUP BY qid, term"),
    "rm3_expand": sql("run_a", rm3("run_a")),
    "stem_to_original": sql("run_a", f"SELECT qid, term, form FROM ({_FORMS})"),
    "bo1_expand": sql("run_a", _divergence("bo1")),
    "kl_expand": sql("run_a", _divergence("kl")),
    "two_pass_retrieval": sql("run_a", f"SELECT qid, docid, score, rank FROM ({retrieve('expanded', 100)})", expanded=_divergence("bo1")),
    "expansion_stats": sql("rm3t", "SELECT qid, count(*) AS n, round(avg(weight), 6) AS mean, round(median(weight), 6) AS median, min(weight) AS low, max(weight) AS high, round(coalesce(stddev_samp(weight), 0), 6) AS std FROM rm3t GROUP BY qid"),
    "explain_expansion": sql(
        "run_a",
        """SELECT qid, terms, hits, used, best, log_scores FROM (SELECT qid, string_agg(stem, ' ' ORDER BY pos) AS terms FROM qterms GROUP BY qid)
      JOIN (SELECT qid, count(*) AS hits, count(*) FILTER (rank <= 10) AS used, max(score) FILTER (rank <= 10) AS best, bool_or(rank <= 10 AND score < 0) AS log_scores FROM run_a GROUP BY qid) USING (qid)""",
    ),
    "semantic_scores": sql("rm3t", _SEMANTIC, **_PROFILES),
    "term_features": sql("rm3t", "SELECT qid, term, place, rm_weight, semantic, original_term FROM feat", **FEATURES),
    "sample_queries": sql("q", "SELECT qid, query FROM q ORDER BY md5('7:' || qid) LIMIT 25"),
    "tune_alpha": sql(
        "qrels", "SELECT alpha, value, n, value = max(value) OVER () AS best FROM (SELECT alpha, round(avg(value), 6) AS value, count(*) AS n FROM per GROUP BY alpha)",
        alphas="SELECT unnest([0.1e0, 0.3e0, 0.5e0, 0.7e0, 0.9e0]) AS alpha", alphat=_ALPHA_TERMS, runs=_ALPHA_RUN, per=NDCG10.format(keys="alpha, qid", run="runs"),
    ),
    "minmax_per_query": sql("run_a", "SELECT qid, docid, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END, 6) AS scaled FROM run_a WINDOW w AS (PARTITION BY qid)"),
    "minmax_half": sql("run_a", "SELECT qid, docid, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.75e0 ELSE 0.5e0 + 0.5e0 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM run_a WINDOW w AS (PARTITION BY qid)"),
    "sum_or_softmax_norm": sql(
        "run_a",
        """SELECT qid, docid, round(CASE WHEN low < 0 THEN exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY qid) WHEN total = 0 THEN 0 ELSE s / total END, 6) AS weight FROM (
      SELECT *, min(s) OVER w AS low, max(s) OVER w AS top, sum(s) OVER w AS total FROM (SELECT qid, docid, CASE WHEN qid % 2 = 0 THEN score ELSE score - 20 END AS s FROM run_a) WINDOW w AS (PARTITION BY qid))""",
    ),
    "logsumexp_posterior": sql("run_a", "SELECT qid, docid, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY qid), 6) AS posterior FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM run_a)"),
}
