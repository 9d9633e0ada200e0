"""Searches by blocks of vectors give the rows of plain joins, with ties, copies and odd vectors; judgments by label."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.functions.vectors import dot, similarity, total
from quarry.operators import cells, dense, evaluation, late, nearest, reweighting
from quarry.plans import dense as plans
from quarry.plans.tables import Tables


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(3)
    found = [(i, [float(x) for x in draw.integers(-2, 3, 6)]) for i in range(600)] + [(2000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(300)]
    found += [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, [0.0] * 6), (3003, [math.nan] * 6), (3004, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (3005, [1e-200] * 6), (3006, [1e200] * 6)]
    found += [(-1, found[600][1]), (None, found[600][1])]
    return spark.createDataFrame(found, "docid long, v array<double>").repartition(3).cache()


@pytest.mark.parametrize("kind", ["cosine", "dot", "l2"])
def test_blocks_give_the_rows_of_a_plain_join(spark, odd, kind, monkeypatch):
    q = odd.where("docid % 50 = 0 OR docid >= 3000").select(F.col("docid").alias("qid"), "v")
    for size in (8_192, 150):
        monkeypatch.setattr(nearest, "ROWS", size)
        plain = top_k(dense.pairs(q, odd).select("qid", "docid", F.round(similarity(F.col("q"), F.col("v"), kind), 6).alias("score")), 20)
        assert rows(dense.exact_knn(q, odd, 20, kind)) == rows(plain)


def test_a_block_sends_no_more_than_the_best(spark, odd):
    """Copies are no reason to send more: a plain join would make all pairs."""
    q = odd.where("docid % 50 = 0").select(F.col("docid").alias("qid"), "v")
    found = nearest.near(q, odd, ["docid"], 5)
    assert found.count() <= q.count() * 5 * spark.sparkContext.defaultParallelism and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [3, 100, None])
def test_bags_give_the_rows_of_a_plain_join(spark, odd, k):
    tokens = odd.where("docid >= 0").select(F.floor(F.col("docid") / 4).alias("docid"), (F.col("docid") % 4).cast("int").alias("pos"), F.lit(3).alias("tokid"), "v")
    docs = tokens.where("NOT exists(v, x -> isnan(x) OR abs(x) > 100)")
    q = docs.where("docid % 25 = 0").select(F.col("docid").alias("qid"), F.col("pos").alias("qpos"), "tokid", F.lit(0.7).alias("weight"), "v")
    asked, held = q.groupBy("qid").agg(F.collect_list(F.struct("weight", "v")).alias("q")), docs.groupBy("docid").agg(F.collect_list("v").alias("d"))
    parts = F.transform("q", lambda q: q["weight"] * F.greatest(F.lit(0.0), F.array_max(F.transform("d", lambda d: dot(q["v"], d)))))
    plain = top_k(held.join(F.broadcast(asked), F.lit(True)).select("qid", "docid", F.round(total(parts), 6).alias("score")), k)
    assert rows(late.maxsim(q, docs, None, k)) == rows(plain)


def test_judgments_of_a_run_and_counts_stand_for_all(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    run = plans._run(t)
    assert rows(evaluation.per_query(run, t.judged(run), counts=t.dcounts)) == rows(evaluation.per_query(run, t.dqrels))
    assert rows(plans._choice(t)) == rows(dense.relevant_and_rest(run, t.dqrels.where("grade = 2"), 10))
    assert t.judged(run).count() <= run.count() < t.dqrels.count()


def test_correlation_of_equal_weights_is_no_error(spark):
    found = spark.createDataFrame([(1, 0.5, 0.1, 0.3, True), (1, 0.5, 0.2, 0.3, True), (2, 0.1, 0.2, 0.1, False), (2, 0.2, 0.4, 0.1, False), (3, 0.1, 0.2, 0.1, False)], "qid int, rm_weight double, semantic double, hybrid double, boosted boolean")
    got = {r["qid"]: r["correlation"] for r in reweighting.reweighting_stats(found).collect()}
    assert math.isnan(got[1]) and got[2] == 1.0 and math.isnan(got[3])


def test_cells_are_multiplied_and_give_the_rows_of_a_join(spark, tmp_path):
    draw = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, [float(x) for x in draw.normal(size=8)]) for i in range(800)], "docid long, v array<double>").cache()
    q = docs.where("docid % 40 = 0").select(F.col("docid").alias("qid"), "v")
    cells.write_cells(docs, ("docid",), str(tmp_path / "cells"), 5, 12)
    index = cells.read_cells(spark, str(tmp_path / "cells"), ("docid",))
    found = cells.cell_search(index, q, 5, 3)
    plain = top_k(cells.met(index, q, 3).select("qid", "docid", F.round(similarity(F.col("q"), F.col("v")), 6).alias("score")), 5)
    assert rows(found.select("qid", "docid", "score", "rank")) == rows(plain)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_products_of_all_pairs(spark):
    rows = [(n, [((7 * n + 3 * i) % 13 - 6) / 8 for i in range(4)]) for n in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0, 2.0]), (63, [0.0] * 4), (64, [1e200] * 4), (65, [float("nan"), 1.0, 1.0, 1.0]), (66, [float("inf"), 0.0, 0.0, 0.0]), (67, [5e-7, 0.0, 0.0, 0.0]), (68, [-1e-7, 0.0, 0.0, 0.0]), (69, []), (70, [1e12, -1e12, 0.1, 0.3])]
    docs = spark.createDataFrame(rows, "docid long, v array<double>")
    queries = docs.select(F.col("docid").alias("qid"), "v")
    for add in (0.0, 0.25):
        plain = queries.withColumnRenamed("v", "q").crossJoin(docs).select("qid", "docid", F.round(dot(F.col("q"), F.col("v")) + add, 6).alias("score"))
        want, got = sorted(repr(tuple(r)) for r in plain.collect()), sorted(repr(tuple(r)) for r in nearest.products(queries, docs, add).collect())
        assert got == want


def test_bilinear_scores_are_multiplied_in_blocks(spark):
    plan = plans.QUERIES["bilinear_score"](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "MapInArrow" in plan
