"""Ranking metrics, comparisons of runs, and where relevant documents stand.

A run has (qid, docid, score); it is ranked by score descending, then docid descending as a string, whatever rank it
carries. Judgments have (qid, docid, grade), unique on the first two.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("map", "ndcg_5", "ndcg_10", "ndcg_20", "ndcg_100", "mrr", "recall_10", "recall_100", "recall_1000", "p_10", "p_20")


def ranked(run: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.col("docid").cast("string")))
    return run.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order).cast("long"))


def join_qrels(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with the grade of each row, 0 where it isn't judged."""
    return run.join(qrels.select("qid", "docid", "grade"), ["qid", "docid"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(rank: str) -> Column:
    return F.col("grade") / F.log2(F.col(rank) + 1.0)


def per_query(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = ("qid",), counts: DataFrame | None = None) -> DataFrame:
    """(keys, metric, value) for queries that are both in the run and judged; values to 6 decimals. One pass over the ranked
    run; the ideal ranking comes from the judgments alone. An unknown metric is 0.

    With counts (qid, grade, n), how many judgments of a grade a query has, qrels need hold those of the run's pairs only.
    """
    judged = join_qrels(ranked(run, keys).select(*keys, "docid", "rank"), qrels)
    so_far = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    judged = judged.withColumn("relevant", (F.col("grade") > 0).cast("int")).withColumn("so_far", F.sum((F.col("grade") > 0).cast("int")).over(so_far))
    cuts = sorted({int(m.split("_")[1]) for m in metrics if "_" in m})
    sums = [F.sum(F.when(F.col("relevant") == 1, F.col("so_far") / F.col("rank"))).alias("precisions"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first")]
    for k in cuts:
        within = F.col("rank") <= k
        sums += [F.sum(F.when(within, _gain("rank"))).alias(f"dcg_{k}"), F.sum(F.when(within, F.col("relevant"))).alias(f"hits_{k}")]
    of_run = judged.groupBy(*keys).agg(*sums)
    if counts is None:
        best, relevant = qrels.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "docid"))), (F.col("grade") > 0).cast("int")
    else:
        # a row for each of the places that a cut can reach; the first of a grade stands for all that it has
        each = counts.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least("n", F.lit(max(cuts, default=1)).cast("long"))))))
        best = each.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "nth")))
        relevant = F.when(F.col("nth") == 1, F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).otherwise(0)
    ideal = best.groupBy("qid").agg(F.sum(relevant).alias("num_rel"), *(F.sum(F.when((F.col("place") <= k) & (F.col("grade") > 0), _gain("place"))).alias(f"ideal_{k}") for k in cuts))
    joined = of_run.join(ideal, "qid")

    def value(metric: str) -> Column:
        name, _, k = metric.partition("_")
        if name == "map":
            out = F.col("precisions") / F.nullif(F.col("num_rel"), F.lit(0))
        elif name == "mrr":
            out = 1.0 / F.col("first")
        elif name == "ndcg":
            out = F.col(f"dcg_{k}") / F.nullif(F.col(f"ideal_{k}"), F.lit(0.0))
        elif name == "recall":
            out = F.col(f"hits_{k}") / F.nullif(F.col("num_rel"), F.lit(0))
        elif name == "p":
            out = F.col(f"hits_{k}") / float(k)
        else:
            out = F.lit(0.0)
        return F.round(F.coalesce(out, F.lit(0.0)), 6)

    return joined.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics))))


def evaluate(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """(keys, metric, value, n): means over queries. For counts see per_query()."""
    each = per_query(run, qrels, metrics, (*keys, "qid"), counts)
    return each.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def name_runs(runs: dict[str, DataFrame]) -> DataFrame:
    named = [run.select("qid", "docid", "score").withColumn("run", F.lit(name)) for name, run in runs.items()]
    return reduce(DataFrame.unionByName, named)


def compare(evals: DataFrame, baseline: str) -> DataFrame:
    """evals (run, metric, value) with improvement over the baseline run: absolute, and percent (0 where the baseline is 0)."""
    base = evals.where(F.col("run") == baseline).select("metric", F.col("value").alias("base"))
    pct = F.when(F.col("base") > 0, 100 * (F.col("value") - F.col("base")) / F.col("base")).otherwise(0.0)
    absolute = F.when(F.col("base") > 0, F.col("value") - F.col("base")).otherwise(F.col("value"))
    return evals.where(F.col("run") != baseline).join(base, "metric").select("run", "metric", "value", "base", F.round(absolute, 6).alias("absolute"), F.round(pct, 6).alias("percent"))


def results_table(evals: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    return evals.groupBy("run").pivot("metric", list(metrics)).agg(F.first("value"))


def helps_hurts(base: DataFrame, run: DataFrame, delta: float = 0.0) -> DataFrame:
    """(qid, base, value, change, label) of per-query values (qid, value)."""
    both = base.select("qid", F.col("value").alias("base")).join(run.select("qid", "value"), "qid").where("qid IS NOT NULL AND NOT isnan(base) AND NOT isnan(value)")
    change = F.round(F.col("value") - F.col("base"), 6)
    label = F.when(F.col("change") > delta, "improvement").when(F.col("change") < -delta, "degradation").otherwise("unchanged")
    return both.withColumn("change", change).withColumn("label", label)


def label_lists(labelled: DataFrame) -> DataFrame:
    """(label, n, qid): the queries of each label, with how many it has."""
    return labelled.select("label", "qid").join(F.broadcast(labelled.groupBy("label").agg(F.count("*").alias("n"))), "label").select("label", "n", "qid")


def magnitudes(labelled: DataFrame) -> DataFrame:
    """Mean, median, max and min of gains and losses; max of losses is the largest signed change, that is the least loss."""
    return labelled.where("label != 'unchanged'").groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("change"), 6).alias("mean"), F.round(F.percentile("change", F.lit(0.5)), 6).alias("median"), F.max("change").alias("high"), F.min("change").alias("low")
    )


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def ttest(base: DataFrame, run: DataFrame) -> DataFrame:
    """One row: n, mean and sample deviation of differences, t, Cohen's d (0 without deviation)."""
    d = F.col("value") - F.col("base")
    one = base.select("qid", F.col("value").alias("base")).join(run.select("qid", "value"), "qid").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    spread = F.coalesce("s", F.lit(0.0))
    t = F.when(spread > 0, F.col("m") / (F.nullif(spread, F.lit(0.0)) / F.sqrt("n"))).otherwise(0.0)
    return one.select("n", F.round("m", 6).alias("mean"), F.round(spread, 6).alias("std"), F.round(t, 6).alias("t"), F.round(F.when(spread > 0, F.col("m") / F.nullif(spread, F.lit(0.0))).otherwise(0.0), 6).alias("d"))


def with_p(test: DataFrame) -> DataFrame:
    """The row of ttest() with its two-sided p; 1 with fewer than two values."""

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 1) if b > 1 else 1.0 for a, b in zip(t, n, strict=True)], dtype=float)

    return test.withColumn("p", F.round(two_sided("t", "n"), 6))


def best_worst(labelled: DataFrame, n: int = 5) -> DataFrame:
    """The n greatest gains and the n greatest losses, ties by query."""
    up = labelled.where("change > 0").orderBy(F.desc("change"), "qid").limit(n).withColumn("side", F.lit("best"))
    down = labelled.where("change < 0").orderBy("change", "qid").limit(n).withColumn("side", F.lit("worst"))
    return up.unionByName(down).select("side", "qid", "base", "value", "change")


def _bin(rank: Column) -> Column:
    return F.when(rank <= 10, "Top 10").when(rank <= 50, "11-50").when(rank <= 100, "51-100").when(rank <= 1000, "Beyond 100")


def _found(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return ranked(run).select("qid", "docid", "rank").join(qrels.where("grade > 0"), ["qid", "docid"])


def rank_distribution(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(grade, bin, n, percent) of relevant documents found, by grade and overall (grade null); ranks over 1000 are in no bin."""
    binned = _found(run, qrels).withColumn("bin", _bin(F.col("rank"))).where("bin IS NOT NULL")
    counted = binned.groupingSets([["bin"], ["grade", "bin"]], "grade", "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("grade")), 6))


def average_ranks(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(grade, mean, median, n) of the ranks of relevant documents found, by grade and overall (grade null)."""
    return _found(run, qrels).rollup("grade").agg(F.round(F.avg("rank"), 6).alias("mean"), F.percentile("rank", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def per_query_ranks(run: DataFrame, qrels: DataFrame, base: DataFrame) -> DataFrame:
    """For each judged query: relevant documents, found, in the first 10 and 50, mean rank, and how they moved against base."""
    now = ranked(run).select("qid", "docid", F.col("rank").alias("now"))
    then = ranked(base).select("qid", "docid", F.col("rank").alias("then"))
    moved = qrels.where("grade > 0").join(now, ["qid", "docid"], "left").join(then, ["qid", "docid"], "left")
    count = lambda c: F.count_if(F.coalesce(F.expr(c), F.lit(False)))
    return moved.groupBy("qid").agg(
        F.count("*").alias("relevant"), F.count("now").alias("found"), count("now <= 10").alias("top10"), count("now <= 50").alias("top50"), F.round(F.avg("now"), 6).alias("mean_rank"),
        count("now < then").alias("improved"), count("now > then").alias("degraded"), count("now IS NOT NULL AND then IS NULL").alias("gained"), count("now IS NULL AND then IS NOT NULL").alias("lost"),
    )


def improved_docs(run: DataFrame, qrels: DataFrame, base: DataFrame) -> DataFrame:
    now = ranked(run).select("qid", "docid", F.col("rank").alias("now"))
    then = ranked(base).select("qid", "docid", F.col("rank").alias("then"))
    return qrels.where("grade > 0").join(now, ["qid", "docid"]).join(then, ["qid", "docid"]).where("now < then").select("qid", "docid", "grade", "then", "now", (F.col("then") - F.col("now")).alias("gain"))


def pair_runs(base: DataFrame, run: DataFrame) -> DataFrame:
    """Full outer pairing of two runs: (qid, docid, base_rank, base_score, rank, score)."""
    b = base.select("qid", "docid", F.col("rank").alias("base_rank"), F.col("score").alias("base_score"))
    return b.join(run.select("qid", "docid", "rank", "score"), ["qid", "docid"], "full_outer")


def aggregate_folds(values: DataFrame) -> DataFrame:
    """(metric, mean, std, n, values) over folds of (fold, metric, value)."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "value")))
    return values.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda s: F.format_string("%.4f", s["value"])), ",").alias("folds"))


def curve_summary(curves: DataFrame) -> DataFrame:
    """(qid, auc, at_5, at_10, peak, steps) of curves (qid, step, value): trapezoids of width 1, values at 5 and 10 or the last."""
    w = W.partitionBy("qid").orderBy("step")
    staged = curves.withColumn("next", F.lead("value").over(w))
    at = lambda k: F.max_by(F.when(F.col("step") <= k, F.col("value")), F.when(F.col("step") <= k, F.col("step")))
    return staged.groupBy("qid").agg(
        F.round(F.coalesce(F.sum((F.col("value") + F.col("next")) / 2), F.lit(0.0)), 6).alias("auc"), at(5).alias("at_5"), at(10).alias("at_10"), F.max("value").alias("peak"), F.count("*").alias("steps")
    )


def mean_curve(curves: DataFrame) -> DataFrame:
    """(step, value, n): mean over queries, each padded with its last value to the longest curve."""
    last = curves.groupBy("qid").agg(F.max("step").alias("last"), F.max_by("value", "step").alias("final"))
    longest = curves.agg(F.max("step").alias("longest"))
    padded = last.join(F.broadcast(longest), F.lit(True)).select("qid", "last", "final", F.explode(F.sequence(F.lit(1), F.col("longest"))).alias("step"))
    filled = padded.join(curves, ["qid", "step"], "left").select("step", F.coalesce("value", "final").alias("value"))
    return filled.groupBy("step").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def track(history: DataFrame, patience: int = 3) -> DataFrame:
    """(run, epoch, score, best, improved, since, stop): best so far, epochs since the last improvement, early stop."""
    before = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    staged = history.withColumn("improved", F.col("score") > F.coalesce(F.max("score").over(before), F.lit(float("-inf"))))
    staged = staged.withColumn("best", F.max("score").over(until)).withColumn("island", F.sum(F.col("improved").cast("int")).over(until))
    w = W.partitionBy("run", "island").orderBy("epoch")
    return staged.withColumn("since", (F.row_number().over(w) - 1).cast("long")).select("run", "epoch", "score", "best", "improved", "since", (F.col("since") >= patience).alias("stop"))


def track_summary(history: DataFrame) -> DataFrame:
    return history.groupBy("run").agg(
        F.min_by("score", "epoch").alias("first"), F.max_by("score", "epoch").alias("last"), F.max("score").alias("best"), F.min_by("epoch", F.struct(-F.col("score"), "epoch")).alias("best_epoch")
    ).withColumn("gain", F.round(F.col("best") - F.col("first"), 6))


def weight_change(history: DataFrame) -> DataFrame:
    """(run, first, last, change, percent) between the first and the last step."""
    ends = history.groupBy("run").agg(F.min_by("score", "epoch").alias("first"), F.max_by("score", "epoch").alias("last"))
    change = F.col("last") - F.col("first")
    share = F.col("last") / F.sum("last").over(W.partitionBy())
    return ends.select("run", "first", "last", F.round(change, 6).alias("change"), F.round(F.when(F.col("first") != 0, 100 * change / F.col("first")), 6).alias("percent"), F.round(share, 6).alias("share"))


def epoch_summary(history: DataFrame) -> DataFrame:
    """(run, final, low, high, gain, trend): trend over the last five epochs is decreasing if the first of them exceeds the last."""
    staged = history.withColumn("four_ago", F.lag("score", 4).over(W.partitionBy("run").orderBy("epoch")))
    out = staged.groupBy("run").agg(F.max_by("score", "epoch").alias("final"), F.min("score").alias("low"), F.max("score").alias("high"), F.min_by("score", "epoch").alias("first"), F.max_by("four_ago", "epoch").alias("four_ago"))
    trend = F.when(F.col("four_ago").isNull(), "short").when(F.col("four_ago") > F.col("final"), "decreasing").otherwise("increasing")
    return out.select("run", "final", "low", "high", F.round(F.col("final") - F.col("first"), 6).alias("gain"), trend.alias("trend"))
