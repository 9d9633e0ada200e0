"""Queries over metrics, comparisons and rank analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.operators import evaluation as ev
from quarry.operators import lexical
from quarry.plans.lexical import FEATURES, NDCG10
from quarry.plans.prelude import retrieve, sql
from quarry.plans.tables import Tables

#: Queries whose bounds by step are sent to all tasks, at most.
MOST_SENT = 100_000
_FOUR = ("map", "ndcg_10", "mrr", "p_10")


def _values(t: Tables, run: DataFrame, metric: str = "ndcg_10") -> DataFrame:
    return ev.per_query(run, t.qrels, (metric,)).select("qid", "value")


def _labelled(t: Tables) -> DataFrame:
    return ev.helps_hurts(_values(t, t.run_a), _values(t, t.run_b))


def _many(t: Tables, metrics: tuple[str, ...] = _FOUR) -> DataFrame:
    return ev.evaluate(ev.name_runs({"bm25": t.run_a, "rm3": t.run_b}), t.qrels, metrics, ("run",))


def _folds(t: Tables) -> DataFrame:
    fold = F.row_number().over(ev.W.orderBy(F.md5(F.concat(F.lit("1:"), F.col("qid").cast("string"))))) % 5
    folds = t.queries.select("qid", fold.alias("fold"))
    return ev.per_query(t.run_a, t.qrels, _FOUR).join(folds, "qid").groupBy("fold", "metric").agg(F.avg("value").alias("value"))


def _steps(t: Tables) -> DataFrame:
    """(qid, step, term, weight): each query's expansion terms in the order in which a build-up curve adds them."""
    return t.rm3_terms.select("qid", F.col("place").alias("step"), "term", "weight")


def leading_steps(running: DataFrame, lasts: DataFrame, k: int, most: int) -> DataFrame:
    """(qid, step, docid, score): at every step from 1 to the `last` of a query (lasts: qid, last), the documents that have one of its k best scores,
    ties of the k-th included, of its first `most` by score, then docid. running (qid, docid, step, next, score): each score of a document with the
    step at which it begins and that of the next, if there is one; a document's later scores are not smaller.

    The k-th best of the scores that begin at a step, or at one before, is a bound below the k-th best score there, so only
    scores that reach it are spread over the steps at which they hold.
    """
    begun = top_k(running.select("qid", "step", "docid", "score"), k, ["qid", "step"]).where(F.col("rank") == k).select("qid", "step", F.col("score").alias("kth"))
    every = lasts.select("qid", F.explode(F.sequence(F.lit(1), "last")).alias("step"))
    so_far = F.max("kth").over(W.partitionBy("qid").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    bound = every.join(begun, ["qid", "step"], "left").select("qid", F.struct("step", F.coalesce(so_far, F.lit(float("-inf"))).alias("least")).alias("at"))
    bounds = bound.groupBy("qid").agg(F.array_sort(F.collect_list("at"))["least"].alias("least"))
    bounds = F.broadcast(bounds) if lasts.count() <= MOST_SENT else bounds  # else Spark exchanges all of running by qid
    # bounds rise, so a score that doesn't reach the first one reaches none
    near = running.join(bounds, "qid").where(F.col("score") >= F.col("least")[F.col("step") - 1])
    held = near.select("qid", "docid", "score", F.explode(F.filter(F.sequence("step", F.coalesce(F.col("next") - 1, F.size("least"))), lambda s: F.col("score") >= F.col("least")[s - 1])).alias("step"))
    by_score = W.partitionBy("qid", "step").orderBy(F.desc("score"))
    tied = held.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= k)
    return top_k(tied.drop("place"), most, ["qid", "step"]).drop("rank")


def build_up(t: Tables) -> DataFrame:
    """(qid, step, value): nDCG@10 of the query of the first `step` terms. Parts of each term are scored once; a document's
    score is their running sum and holds from the step of one of its terms to that of its next. The run of a step is cut at
    1,000; of these, those with one of the ten best scores are ranked."""
    steps = _steps(t)
    parts = lexical.bm25_parts(steps, t.index).select("qid", "step", "docid", "part")
    by_step = W.partitionBy("qid", "docid").orderBy("step")
    score = F.round(F.sum("part").over(by_step.rowsBetween(W.unboundedPreceding, 0)), 6)
    running = parts.withColumns({"score": score, "next": F.lead("step").over(by_step)})
    lasts = steps.groupBy("qid").agg(F.max("step").alias("last"))
    return ev.per_query(leading_steps(running, lasts, 10, 1000), t.qrels, ("ndcg_10",), ("qid", "step")).select("qid", "step", "value")


def final_query(t: Tables) -> DataFrame:
    """(qid, rm3, hybrid): nDCG@10 at depth 20 of the boosted query by RM3 weights and by half of each signal."""
    features = lexical.term_features(t.queries, t.index, t.docs, t.run_a)
    rm = features.select("qid", "term", F.col("rm_weight").alias("weight"))
    both = features.select("qid", "term", (0.5 * F.col("rm_weight") + 0.5 * F.col("semantic")).alias("weight"))
    runs = [_values(t, lexical.weighted(w, t.index, 20)) for w in (rm, both)]
    return runs[0].withColumnRenamed("value", "rm3").join(runs[1].withColumnRenamed("value", "hybrid"), "qid")


def _metric(name: str):  # noqa: ANN202
    wanted = tuple(m for m in ev.METRICS if m.split("_")[0] == name)
    return lambda t: ev.per_query(t.run_a, t.qrels, wanted)


QUERIES = {
    "join_run_qrels": lambda t: ev.join_qrels(t.run_a, t.qrels).select("qid", "docid", "rank", "score", "grade"),
    "eval_run": lambda t: ev.evaluate(t.run_a, t.qrels),
    "eval_per_query": lambda t: ev.per_query(t.run_a, t.qrels),
    "metric_map": _metric("map"),
    "metric_ndcg": _metric("ndcg"),
    "metric_mrr": _metric("mrr"),
    "metric_recall": _metric("recall"),
    "metric_precision": _metric("p"),
    "eval_many_runs": _many,
    "compare_runs": lambda t: ev.compare(_many(t), "bm25"),
    "results_table": lambda t: ev.results_table(_many(t), _FOUR),
    "fold_aggregate": lambda t: ev.aggregate_folds(_folds(t)),
    "helps_hurts": _labelled,
    "helps_hurts_lists": lambda t: ev.label_lists(_labelled(t)),
    "magnitude_stats": lambda t: ev.magnitudes(_labelled(t)),
    "paired_ttest": lambda t: ev.with_p(ev.ttest(_values(t, t.run_a), _values(t, t.run_b))),
    "best_worst_queries": lambda t: ev.best_worst(_labelled(t)),
    "rank_distribution": lambda t: ev.rank_distribution(t.run_a, t.qrels),
    "average_ranks": lambda t: ev.average_ranks(t.run_a, t.qrels),
    "per_query_rank_analysis": lambda t: ev.per_query_ranks(t.run_b, t.qrels, t.run_a),
    "doc_rank_improvements": lambda t: ev.improved_docs(t.run_b, t.qrels, t.run_a),
    "join_two_runs": lambda t: ev.pair_runs(t.run_a, t.run_b),
    "build_up_curve": build_up,
    "curve_summary": lambda t: ev.curve_summary(build_up(t)),
    "mean_curve": lambda t: ev.mean_curve(build_up(t)),
    "final_query_eval": final_query,
    "metric_tracker": lambda t: ev.track(t.history),
    "metric_tracker_summary": lambda t: ev.track_summary(t.history),
    "weight_history": lambda t: ev.weight_change(t.history),
    "epoch_summary": lambda t: ev.epoch_summary(t.history),
}


def _per_query(run: str, keys: str = "qid") -> str:
    """Long form of all metrics, in another way than the operator: every metric is its own aggregate over a joined list."""
    cuts = {"ndcg": (5, 10, 20, 100), "recall": (10, 100, 1000), "p": (10, 20)}
    out = ["coalesce(ap / nullif(num_rel, 0), 0) AS map", "coalesce(1 / first_rank, 0) AS mrr"]
    out += [f"coalesce(dcg_{k} / nullif(ideal_{k}, 0), 0) AS ndcg_{k}" for k in cuts["ndcg"]]
    out += [f"coalesce(hits_{k} / nullif(num_rel, 0), 0) AS recall_{k}" for k in cuts["recall"]] + [f"hits_{k} / {k}e0 AS p_{k}" for k in cuts["p"]]
    run_side = ", ".join([*(f"sum(grade / log2(r + 1)) FILTER (r <= {k}) AS dcg_{k}" for k in cuts["ndcg"]), *(f"count(*) FILTER (grade > 0 AND r <= {k}) AS hits_{k}" for k in (10, 20, 100, 1000))])
    ideal = ", ".join(f"sum(grade / log2(p + 1)) FILTER (p <= {k}) AS ideal_{k}" for k in cuts["ndcg"])
    return f"""SELECT {keys}, metric, round(value, 6) AS value FROM (UNPIVOT (
      SELECT {keys}, {", ".join(o.replace(" AS ", "::DOUBLE AS ") if not o.startswith("hits") else o for o in out)} FROM (
        SELECT {keys}, sum(hit / r) FILTER (grade > 0) AS ap, min(r) FILTER (grade > 0) AS first_rank, {run_side} FROM (
          SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY {keys} ORDER BY r) AS hit FROM (
            SELECT {keys}, docid, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, docid::VARCHAR DESC) AS r, coalesce(grade, 0) AS grade FROM {run} LEFT JOIN qrels USING (qid, docid))) GROUP BY {keys})
      JOIN (SELECT qid, count(*) FILTER (grade > 0) AS num_rel, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS p FROM qrels) GROUP BY qid) USING (qid)
    ) ON COLUMNS(* EXCLUDE ({keys})) INTO NAME metric VALUE value)"""


_PER_A = _per_query("run_a")
_MANY = {"runs": "SELECT 'bm25' AS run, qid, docid, score FROM run_a UNION ALL SELECT 'rm3', qid, docid, score FROM run_b", "per": _per_query("runs", "run, qid"), "many": "SELECT run, metric, round(avg(value), 6) AS value, count(*) AS n FROM per WHERE metric IN ('map', 'ndcg_10', 'mrr', 'p_10') GROUP BY run, metric"}
_LABELLED = {
    "va": NDCG10.format(keys="qid", run="run_a"),
    "vb": NDCG10.format(keys="qid", run="run_b"),
    "lab": "SELECT *, CASE WHEN change > 0 THEN 'improvement' WHEN change < 0 THEN 'degradation' ELSE 'unchanged' END AS label FROM (SELECT qid, va.value AS base, vb.value AS value, round(vb.value - va.value, 6) AS change FROM va JOIN vb USING (qid))",
}
_RANKS = {name: f"SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid::VARCHAR DESC) AS r FROM {run}" for name, run in (("ra", "run_a"), ("rb", "run_b"))}
_CURVE = {
    "parts": "SELECT qid, place AS step, docid, weight * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl)) AS part FROM rm3t JOIN freq USING (term) JOIN postings USING (term) JOIN doclen USING (docid), stats",
    "stepped": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, step ORDER BY score DESC, docid) AS k FROM (
      SELECT p.qid AS qid, s.place AS step, docid, round(sum(part), 6) AS score FROM parts p JOIN rm3t s ON s.qid = p.qid AND p.step <= s.place GROUP BY ALL)) WHERE k <= 1000""",
    "curve": NDCG10.format(keys="qid, step", run="stepped"),
}
_BIN = "CASE WHEN r <= 10 THEN 'Top 10' WHEN r <= 50 THEN '11-50' WHEN r <= 100 THEN '51-100' WHEN r <= 1000 THEN 'Beyond 100' END"


def _only(name: str) -> str:
    return sql("qrels", f"SELECT qid, metric, value FROM per WHERE split_part(metric, '_', 1) = '{name}'", per=_PER_A)


SQL = {
    "join_run_qrels": sql("qrels", "SELECT qid, docid, rank, score, coalesce(grade, 0) AS grade FROM run_a LEFT JOIN qrels USING (qid, docid)"),
    "eval_run": sql("qrels", "SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM per GROUP BY metric", per=_PER_A),
    "eval_per_query": sql("qrels", "SELECT qid, metric, value FROM per", per=_PER_A),
    **{f"metric_{long}": _only(short) for long, short in (("map", "map"), ("ndcg", "ndcg"), ("mrr", "mrr"), ("recall", "recall"), ("precision", "p"))},
    "eval_many_runs": sql("qrels run_b", "SELECT run, metric, value, n FROM many", **_MANY),
    "compare_runs": sql("qrels run_b", "SELECT a.run, metric, a.value AS value, b.value AS base, round(CASE WHEN b.value > 0 THEN a.value - b.value ELSE a.value END, 6) AS absolute, round(CASE WHEN b.value > 0 THEN 100 * (a.value - b.value) / b.value ELSE 0 END, 6) AS percent FROM many a JOIN many b USING (metric) WHERE a.run != 'bm25' AND b.run = 'bm25'", **_MANY),
    "results_table": sql("qrels run_b", "SELECT run, max(value) FILTER (metric = 'map') AS map, max(value) FILTER (metric = 'ndcg_10') AS ndcg_10, max(value) FILTER (metric = 'mrr') AS mrr, max(value) FILTER (metric = 'p_10') AS p_10 FROM many GROUP BY run", **_MANY),
    "fold_aggregate": sql(
        "qrels", "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n, string_agg(printf('%.4f', value), ',' ORDER BY fold) AS folds FROM f GROUP BY metric",
        per=_PER_A, fo="SELECT qid, row_number() OVER (ORDER BY md5('1:' || qid)) % 5 AS fold FROM q",
        f="SELECT fold, metric, avg(value) AS value FROM per JOIN fo USING (qid) WHERE metric IN ('map', 'ndcg_10', 'mrr', 'p_10') GROUP BY fold, metric",
    ),
    "helps_hurts": sql("qrels run_b", "SELECT qid, base, value, change, label FROM lab", **_LABELLED),
    "helps_hurts_lists": sql("qrels run_b", "SELECT label, count(*) OVER (PARTITION BY label) AS n, qid FROM lab", **_LABELLED),
    "magnitude_stats": sql("qrels run_b", "SELECT label, count(*) AS n, round(avg(change), 6) AS mean, round(median(change), 6) AS median, max(change) AS high, min(change) AS low FROM lab WHERE label != 'unchanged' GROUP BY label", **_LABELLED),
    "paired_ttest": sql(
        "qrels run_b", """SELECT n, mean, std, t, d, round(CASE WHEN n > 1 THEN 1 - 2 * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma(n / 2e0) - lgamma((n - 1) / 2e0)) / sqrt(pi() * (n - 1)) * pow(1 + pow(i * abs(t) / 2000, 2) / (n - 1), -n / 2e0)) * abs(t) / 6000 FROM range(2001) r(i)) ELSE 1 END, 6) AS p FROM one""", **_LABELLED,
        one="SELECT n, round(m, 6) AS mean, round(s, 6) AS std, round(CASE WHEN s > 0 THEN m / (s / sqrt(n)) ELSE 0 END, 6) AS t, round(CASE WHEN s > 0 THEN m / s ELSE 0 END, 6) AS d FROM (SELECT count(*) AS n, avg(value - base) AS m, coalesce(stddev_samp(value - base), 0) AS s FROM lab)",
    ),
    "best_worst_queries": sql("qrels run_b", "(SELECT 'best' AS side, qid, base, value, change FROM lab WHERE change > 0 ORDER BY change DESC, qid LIMIT 5) UNION ALL (SELECT 'worst', qid, base, value, change FROM lab WHERE change < 0 ORDER BY change, qid LIMIT 5)", **_LABELLED),
    "rank_distribution": sql(
        "qrels", f"SELECT grade, bin, n, round(100e0 * n / sum(n) OVER (PARTITION BY grade), 6) AS percent FROM (SELECT grade, bin, count(*) AS n FROM (SELECT grade, {_BIN} AS bin FROM ra JOIN qrels USING (qid, docid) WHERE grade > 0) WHERE bin IS NOT NULL GROUP BY GROUPING SETS ((bin), (grade, bin)))", ra=_RANKS["ra"],
    ),
    "average_ranks": sql("qrels", "SELECT grade, round(avg(r), 6) AS mean, median(r)::DOUBLE AS median, count(*) AS n FROM ra JOIN qrels USING (qid, docid) WHERE grade > 0 GROUP BY ROLLUP (grade)", ra=_RANKS["ra"]),
    "per_query_rank_analysis": sql(
        "qrels run_b",
        """SELECT qid, count(*) AS relevant, count(now) AS found, count(*) FILTER (now <= 10) AS top10, count(*) FILTER (now <= 50) AS top50, round(avg(now), 6) AS mean_rank, count(*) FILTER (now < old) AS improved,
      count(*) FILTER (now > old) AS degraded, count(*) FILTER (now IS NOT NULL AND old IS NULL) AS gained, count(*) FILTER (now IS NULL AND old IS NOT NULL) AS lost
      FROM (SELECT qid, rb.r AS now, ra.r AS old FROM qrels LEFT JOIN rb USING (qid, docid) LEFT JOIN ra USING (qid, docid) WHERE grade > 0) GROUP BY qid""", **_RANKS,
    ),
    "doc_rank_improvements": sql("qrels run_b", 'SELECT qid, docid, grade, ra.r AS "then", rb.r AS now, ra.r - rb.r AS gain FROM qrels JOIN rb USING (qid, docid) JOIN ra USING (qid, docid) WHERE grade > 0 AND rb.r < ra.r', **_RANKS),
    "join_two_runs": sql("run_b", "SELECT qid, docid, a.rank AS base_rank, a.score AS base_score, b.rank AS rank, b.score AS score FROM run_a a FULL JOIN run_b b USING (qid, docid)"),
    "build_up_curve": sql("qrels rm3t", "SELECT qid, step, value FROM curve", **_CURVE),
    "curve_summary": sql(
        "qrels rm3t", "SELECT qid, round(coalesce(sum((value + nxt) / 2), 0), 6) AS auc, arg_max(value, step) FILTER (step <= 5) AS at_5, arg_max(value, step) FILTER (step <= 10) AS at_10, max(value) AS peak, count(*) AS steps FROM (SELECT *, lead(value) OVER (PARTITION BY qid ORDER BY step) AS nxt FROM curve) GROUP BY qid", **_CURVE,
    ),
    "mean_curve": sql(
        "qrels rm3t", """SELECT s.step AS step, round(avg(coalesce(c.value, final)), 6) AS value, count(*) AS n FROM (SELECT qid, arg_max(value, step) AS final FROM curve GROUP BY qid) l
      CROSS JOIN (SELECT unnest(range(1, (SELECT max(step) FROM curve) + 1)) AS step) s LEFT JOIN curve c ON c.qid = l.qid AND c.step = s.step GROUP BY s.step""", **_CURVE,
    ),
    "final_query_eval": sql(
        "qrels rm3t", "SELECT qid, a.value AS rm3, b.value AS hybrid FROM x a JOIN y b USING (qid)", **FEATURES,
        w1="SELECT qid, term, greatest(rm_weight, 1e-6) AS weight FROM feat", w2="SELECT qid, term, greatest(0.5e0 * rm_weight + 0.5e0 * semantic, 1e-6) AS weight FROM feat",
        r1=retrieve("w1", 20), r2=retrieve("w2", 20), x=NDCG10.format(keys="qid", run="r1"), y=NDCG10.format(keys="qid", run="r2"),
    ),
    "metric_tracker": sql(
        "history", """SELECT run, epoch, score, best, improved, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS since, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 >= 3 AS stop FROM (
      SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY epoch) AS island FROM (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best,
      score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved FROM history))""",
    ),
    "metric_tracker_summary": sql("history", "SELECT run, arg_min(score, epoch) AS first, arg_max(score, epoch) AS last, max(score) AS best, min(epoch) FILTER (score = top) AS best_epoch, round(max(score) - arg_min(score, epoch), 6) AS gain FROM (SELECT *, max(score) OVER (PARTITION BY run) AS top FROM history) GROUP BY run"),
    "weight_history": sql("history", 'SELECT run, first, last, round(last - first, 6) AS change, round(CASE WHEN first != 0 THEN 100 * (last - first) / first END, 6) AS percent, round(last / sum(last) OVER (), 6) AS share FROM (SELECT run, arg_min(score, epoch) AS first, arg_max(score, epoch) AS last FROM history GROUP BY run)'),
    "epoch_summary": sql(
        "history", "SELECT run, final, low, high, round(final - first, 6) AS gain, CASE WHEN four_ago IS NULL THEN 'short' WHEN four_ago > final THEN 'decreasing' ELSE 'increasing' END AS trend FROM (SELECT run, arg_max(score, epoch) AS final, min(score) AS low, max(score) AS high, arg_min(score, epoch) AS first, max(four) FILTER (epoch = top) AS four_ago FROM (SELECT *, lag(score, 4) OVER (PARTITION BY run ORDER BY epoch) AS four, max(epoch) OVER (PARTITION BY run) AS top FROM history) GROUP BY run)",
    ),
}
