"""Hand-worked cases of metrics, expansion and vectors, and the registered queries against their SQL."""

import math
import random
import re
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as vec
from quarry.functions.scores import minmax_half, top_k
from quarry.functions.text import stem, tokens
from quarry.operators import blocks, cells, dense, evaluation, late, lexical, training
from quarry.plans import evaluation as evaluation_plans
from quarry.plans import registry
from quarry.plans.tables import Tables
from quarry.sources import encoding, files
from quarry.sources.stored import version
from quarry.streaming import intake

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", "doc1", 0.9), ("q1", "doc2", 0.8), ("q1", "doc3", 0.7), ("q2", "doc4", 0.95), ("q2", "doc1", 0.85), ("q2", "doc5", 0.75)], "qid string, docid string, score double")
    qrels = spark.createDataFrame([("q1", "doc1", 2), ("q1", "doc2", 1), ("q1", "doc3", 0), ("q2", "doc4", 2), ("q2", "doc1", 0), ("q2", "doc5", 1), ("q9", "doc1", 1)], "qid string, docid string, grade int")
    got = {r["metric"]: r["value"] for r in evaluation.evaluate(run, qrels).collect()}
    assert got["map"] == pytest.approx(0.916667, abs=1e-6) and got["ndcg_10"] == pytest.approx(0.975117, abs=1e-6)
    assert got["mrr"] == 1 and got["p_10"] == pytest.approx(0.2) and got["recall_10"] == 1


def test_paired_test_by_hand(spark):
    base = spark.createDataFrame([(i, 0.0) for i in range(3)], "qid long, value double")
    run = spark.createDataFrame([(0, 0.1), (1, -0.05), (2, 0.2)], "qid long, value double")
    row = evaluation.with_p(evaluation.ttest(base, run)).first()
    assert (row["mean"], row["std"], row["t"], row["d"]) == pytest.approx((0.083333, 0.125831, 1.147079, 0.662266), abs=1e-6)
    assert row["p"] == pytest.approx(0.370, abs=0.002)
    assert evaluation.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)


def test_leading_steps_equal_a_full_ranking(spark):
    rng = random.Random(5)
    rows, want, lasts = [], set(), {1: 6, 2: 4, 3: 3}
    for q, last in lasts.items():
        held = {}
        for d in range(40 if q < 3 else 1):
            steps, score = sorted(rng.sample(range(1, last + 1), rng.randrange(1, 4))), 0.0
            for s, after in zip(steps, [*steps[1:], None], strict=True):
                score += rng.randrange(3) / 4  # many ties
                rows.append((q, d, s, after, score))
                held |= {(n, d): score for n in range(s, after or last + 1)}
        for n in range(1, last + 1):
            ranked = sorted((-score, d) for (at, d), score in held.items() if at == n)
            want |= {(q, n, d, -score) for score, d in ranked[:6] if sum(other < score for other, _ in ranked) < 3}
    running = spark.createDataFrame(rows, "qid long, docid long, step long, next long, score double")
    limits = spark.createDataFrame(list(lasts.items()), "qid long, last long")
    got = evaluation_plans.leading_steps(running, limits, 3, 6).select("qid", "step", "docid", "score").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_curve_by_hand(spark):
    row = evaluation.curve_summary(spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.4)], "qid long, step int, value double")).first()
    assert row["auc"] == pytest.approx(0.45) and row["peak"] == 0.4 and row["at_5"] == 0.4


def test_rm3_by_hand(spark):
    queries = spark.createDataFrame([(1, "cat dog")], "qid long, query string")
    docs = spark.createDataFrame([(1, "cat cat fish"), (2, "dog bird"), (3, None), (4, "")], "docid long, text string")
    run = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 1.0, 2)], "qid long, docid long, score double, rank int")
    got = {r["term"]: r["weight"] for r in lexical.rm3(queries, lexical.build_postings(docs), run).collect()}
    assert got == {"cat": 0.5, "dog": 0.3125, "fish": 0.125, "bird": 0.0625}


def test_maxsim_and_fusion_by_hand(spark):
    q = spark.createDataFrame([(1, 0, 5, 1.0, [1.0, 0.0]), (1, 1, 6, 1.0, [0.0, 1.0])], "qid long, qpos int, tokid int, weight double, v array<double>")
    d = spark.createDataFrame([(1, 0, 5, [1.0, 0.0]), (1, 1, 6, [0.6, 0.8]), (2, 0, 7, [-1.0, 0.0])], "docid long, pos int, tokid int, v array<double>")
    assert {r["docid"]: r["score"] for r in late.maxsim(q, d).collect()} == {1: 1.8, 2: 0.0}
    query = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "qid long, v array<double>")
    fed = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "docid long, v array<double>")
    run = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, docid long, rank int")
    rocchio = {r["qid"]: r["v"] for r in dense.prf_vectors(query, run, fed, 3, "rocchio").collect()}
    assert rocchio[1] == pytest.approx([1.25, 0.5]) and rocchio[2] == [3.0, 4.0]
    mean = {r["qid"]: r["v"] for r in dense.prf_vectors(query, run, fed, 3, "average").collect()}
    assert mean[1] == pytest.approx([2 / 3, 2 / 3])


def test_text_and_scores(spark):
    row = spark.createDataFrame([("The Élan runs_1 running a1 ed Cats",)], "t string").select(tokens(F.col("t")).alias("t")).first()
    assert row["t"] == ["the", "running", "ed", "cats"]
    assert [r["s"] for r in spark.createDataFrame([("running",), ("walked",), ("cats",), ("ed",)], "t string").select(stem(F.col("t")).alias("s")).collect()] == ["runn", "walk", "cat", ""]
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "qid long, s double").select(minmax_half(F.col("s")).alias("x")).collect()
    assert {r["x"] for r in same} == {0.75}
    ties = top_k(spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0)], "qid long, docid long, score double"), 1).first()
    assert ties["docid"] == 3
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vec.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert zero["s"] == 0.0


def test_run_files_with_bad_lines(spark, tmp_path):
    path = tmp_path / "run.txt"
    path.write_text("1 Q0 a 1 2.5 t\nshort line\n\n1 Q0 b x y t\n2 c 7\n")
    assert [(r["docid"], r["rank"], r["score"]) for r in files.read_trec_run(spark, str(path)).collect()] == [("a", 1, 2.5), ("b", None, None)]
    assert {(r["qid"], r["docid"], r["score"]) for r in files.read_run_short(spark, str(path)).where("rank IS NOT NULL").collect()} == {("1", "a", 2.5), ("2", "c", 7.0)}
    (tmp_path / "qrels.txt").write_text("# c\n1 0 a 1\n1 0 a 2\n1 0 b x\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "qrels.txt")).collect()] == [("1", "a", 2)]
    (tmp_path / "q.tsv").write_text("alpha beta\n\ngamma\n")
    assert [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.tsv")).orderBy("qid").collect()] == [("q1", "alpha beta"), ("q2", "gamma")]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stored_index_is_read_and_not_built_again(spark):
    t = Tables(spark, DATA)
    plan = t.boosted()._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "documents.parquet" not in plan
    assert Tables(spark, DATA).index.postings.inputFiles() == t.index.postings.inputFiles()
    fresh = lexical.build_postings(t.docs)
    assert t.index.postings.exceptAll(fresh.postings).isEmpty() and fresh.postings.exceptAll(t.index.postings).isEmpty()
    assert t.index.stats.first() == fresh.stats.first()
    # joins on the term need no exchange of the postings
    joined = t.index.postings.hint("merge").join(lexical.term_stats(t.index.postings), "term")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in joined


def test_a_changed_part_of_a_folder_is_another_version(spark, tmp_path):
    folder = tmp_path / "data"
    spark.createDataFrame([(1, "alpha")], "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    before = version(spark, str(folder))
    assert version(spark, str(folder)) == before
    spark.createDataFrame([(2, "beta")], "doc_id long, text string").write.mode("append").parquet(str(folder / "documents.parquet"))
    assert version(spark, str(folder)) != before


def test_a_changed_table_is_another_version(spark, tmp_path):
    folder = str(tmp_path / "data")
    for rows, n in (([(1, "alpha beta")], 2), ([(1, "alpha beta"), (2, "gamma")], 3)):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        assert Tables(spark, folder).index.postings.count() == n


def test_recall_of_approximate_search(spark):
    t = Tables(spark, DATA)
    exact = dense.exact_knn(t.dq, t.dd, 10)
    indexed, centres = dense.ivf_build(t.dd.select("docid", "v"), 12)
    probes = dense.probes_for(t.dq, indexed, centres)
    assert dense.recall(dense.ivf_search(t.dq, indexed, centres, 10, probes), exact).first()["recall"] >= 0.9
    assert dense.recall(dense.lsh_knn(t.dq, t.dd), exact).first()["recall"] >= 0.9
    assert dense.recall(exact.where("rank <= 5"), exact).first()["recall"] == 0.5


def clustered(spark, n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dim)) / dim**0.5
    return spark.createDataFrame([(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())], "docid long, v array<double>")


def test_cells_are_pruned_and_measured(spark, tmp_path):
    docs = clustered(spark, 4000, 24, 1)
    queries = docs.where("docid % 100 = 0").withColumnRenamed("docid", "qid")
    cells.write_cells(docs, ("docid",), str(tmp_path / "cells"), 10, 40)
    index = cells.read_cells(spark, str(tmp_path / "cells"), ("docid",))
    found = cells.cell_search(index, queries, 10)
    assert dense.recall(found, dense.exact_knn(queries, docs, 10)).first()["recall"] >= 0.9 and index.recall >= 0.95
    assert cells.looked_at(index, queries).first()["looked_at"] < 0.2
    one = cells.cell_search(index, queries.limit(1), 10)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # the scan of one query's search is cut to the cells that it probes
    assert re.search(r"PartitionFilters: \[.*cell#\d+", plan)
    assert cells.met(index, queries.limit(1)).select("docid").distinct().count() < 0.3 * 4000


def test_token_cells_find_the_documents(spark, tmp_path):
    flat = clustered(spark, 3000, 24, 2)
    tokens = flat.select(F.floor(F.col("docid") / 5).alias("docid"), (F.col("docid") % 5).cast("int").alias("pos"), (F.col("docid") % 11).cast("int").alias("tokid"), "v")
    asked = tokens.where("docid % 40 = 0").select(F.col("docid").alias("qid"), F.col("pos").alias("qpos"), "tokid", F.lit(1.0).alias("weight"), "v")
    cells.write_cells(tokens, late.TOKEN, str(tmp_path / "cells"), 20, 40)
    index = cells.read_cells(spark, str(tmp_path / "cells"), late.TOKEN)
    row = late.token_recall(asked, tokens, index, 20).first()
    assert row["queries"] == asked.count() and row["looked_at"] < 0.2 and row["recall"] >= 0.9
    full, fast = late.end_to_end(asked, tokens, 20, 10), late.end_to_end(asked, index, 20, 10)
    assert dense.recall(fast, full).first()["recall"] >= 0.9
    assert late.nearest_tokens(asked, index).count() > 0
    assert {(r["qid"], r["docid"]): r["score"] for r in late.ann_score(asked, index, 20, 1).collect()}.items() <= {(r["qid"], r["docid"]): r["score"] for r in late.ann_score(asked, tokens, 20).collect()}.items()


def test_hyperplanes_compare_few_pairs(spark):
    docs = clustered(spark, 4000, 24, 3).unionByName(spark.createDataFrame([(10_000 + i, [1.0] + [0.0] * 23) for i in range(700)], "docid long, v array<double>"))
    queries = docs.where("docid % 100 = 0").withColumnRenamed("docid", "qid")
    index = dense.lsh_build(docs)
    pairs, n = dense.lsh_pairs(index, queries), queries.count()
    assert pairs.count() < 0.3 * n * docs.count() and pairs.distinct().count() == pairs.count()
    found, exact = dense.lsh_search(index, queries, 10), dense.exact_knn(queries, docs, 10)
    assert dense.recall(found.where("qid < 10000"), exact.where("qid < 10000")).first()["recall"] >= 0.9
    # copies can't be parted by bits, so their bucket is cut into parts
    largest = index.postings.groupBy("table", "depth", "prefix", "part").count().agg(F.max("count")).first()[0]
    assert index.buckets.agg(F.max("n")).first()[0] >= 700 and largest < 2 * index.bound
    assert found.where("qid >= 10000 AND rank <= 10 AND score < 1").isEmpty()


def test_blocks_leave_out_what_cannot_matter(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["common"] + [f"term{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(60)]
    rows = [(i, " ".join(["common"] * int(rng.integers(1, 9)) + list(rng.choice(words[1:], 12)))) for i in range(3000)]
    index = lexical.build_postings(spark.createDataFrame(rows, "docid long, text string"))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    blocks.write_blocks(index, str(tmp_path / "blocks"), "blocks_of_a_test", 4)
    held = blocks.read_blocks(spark, str(tmp_path / "blocks"), "blocks_of_a_test")
    queries = spark.createDataFrame([(1, "common"), (2, "common termab"), (3, "termcd termef termab"), (4, "nothing"), (5, "common common termaa")], "qid long, query string")
    terms = lexical.query_terms(queries)
    same = lambda df: [tuple(r) for r in df.orderBy("qid", "rank").select("qid", "docid", "score", "rank").collect()]
    for k in (1, 10, 5000):
        assert same(blocks.retrieve_blocks(terms, held, k)) == same(lexical.retrieve(terms, index, k))
    report = blocks.block_report(terms, held, 10).first()
    assert report["read"] < 0.7 * report["blocks"] and report["postings_read"] < report["postings"]
    # every document holds `common`, and its postings are dealt over all shards
    of_common = held.blocks.where("term = 'common'").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(of_common) == 4 and max(r["n"] for r in of_common) < 1000


def test_segments_merge_like_a_full_build(spark, tmp_path):
    first = spark.createDataFrame([(1, "cats dogs"), (2, "fish"), (3, "birds birds"), (4, "old words")], "doc_id long, text string")
    second = spark.createDataFrame([(2, "fish cats cats"), (4, None), (5, "dogs"), (5, "a late dog")], "doc_id long, text string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in (first, second):
        rows.coalesce(1).write.mode("append").parquet(source)
        intake.stream_segments(intake.stream_documents(spark, source), out, state).awaitTermination()
        index = intake.merge_segments(spark, out)
    full = lexical.build_postings(spark.createDataFrame([(1, "cats dogs"), (2, "fish cats cats"), (3, "birds birds"), (4, None), (5, "a late dog")], "docid long, text string"))
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(index.postings) == rows(full.postings) and rows(index.doclen) == rows(full.doclen) and rows(index.stats) == rows(full.stats)
    assert rows(intake.merged_terms(spark, out)) == rows(lexical.term_stats(full.postings))
    queries = spark.createDataFrame([(1, "cat dog fish"), (2, "old")], "qid long, query string")
    assert rows(lexical.bm25(queries, index)) == rows(lexical.bm25(queries, full))
    again = intake.merge_segments(spark, out)  # nothing came since
    assert rows(again.postings) == rows(index.postings) and rows(again.stats) == rows(index.stats)


def test_an_encoding_job_is_taken_up_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{'abcdefghij'[i % 10]} and more" if i % 7 else None) for i in range(200)], "docid long, text string")
    seen = []

    def encoder(rows, key, text):
        seen.extend(r[key] for r in rows.select(key).collect())
        return dense.hashed_terms(rows, key, text)

    def dying(rows, key, text):
        if len(seen) > 60:
            raise RuntimeError("killed")
        return encoder(rows, key, text)

    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    with pytest.raises(RuntimeError):
        encoding.encode(docs, dying, parts, shards=8)
    before = len(seen)
    assert 60 < before < 200 and encoding.encoded(spark, parts)[0].count() == before
    assert encoding.encode(docs, encoder, parts, shards=8) and encoding.encode(docs, encoder, parts, shards=8) == []
    assert sorted(seen) == list(range(200))  # nothing twice
    encoding.encode(docs, dense.hashed_terms, whole, shards=1)
    rows = lambda out: sorted((r["docid"], tuple(r["v"])) for r in encoding.encoded(spark, out)[0].collect())
    assert rows(parts) == rows(whole) and encoding.encoded(spark, parts)[1].first()["n"] == 200


def test_pairwise_fit_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x, grade = rng.normal(size=(120, 3)), rng.integers(0, 3, 120)
    x[:, 0] += grade
    rows = [(int(i % 6), int(i), x[i].tolist()) for i in range(120)]
    features = spark.createDataFrame(rows, "qid long, docid long, x array<double>")
    qrels = spark.createDataFrame([(int(i % 6), int(i), int(grade[i])) for i in range(120) if grade[i]], "qid long, docid long, grade int")
    got = [r["weight"] for r in dense.fit_pairwise(features, qrels).orderBy("feature").collect()]
    d = np.array([x[i] - x[j] for i in range(120) for j in range(120) if i % 6 == j % 6 and grade[i] > grade[j]])
    w = np.zeros(3)
    for _ in range(200):  # plain gradient steps, to the same optimum
        w += 0.5 * ((1 / (1 + np.exp(d @ w)))[:, None] * d).mean(0) - 0.5 * 2e-3 * w
    assert got == pytest.approx(w.tolist(), abs=1e-4)
    ranked = dense.weighted_rank(features, dense.fit_pairwise(features, qrels))
    plain = dense.weighted_rank(features, spark.createDataFrame([(0, 0.1), (1, 1.0), (2, -1.0)], "feature int, weight double"))
    value = lambda run: [r["value"] for r in evaluation.evaluate(run, qrels, ("ndcg_10",)).collect()][0]
    assert value(ranked) > value(plain)


def test_pairwise_fit_is_as_good_as_the_grid(spark):
    known = registry.queries()
    from quarry.plans import dense as plans

    t = Tables(spark, DATA)
    best = known["fit_weights"](spark, DATA).agg(F.max("value")).first()[0]
    features = plans._pair_features(t)
    fitted = evaluation.evaluate(dense.weighted_rank(features, dense.fit_pairwise(features, t.dqrels)), t.dqrels, ("ndcg_10",)).first()["value"]
    assert fitted >= best - 1e-9


def test_projection_of_queries_equals_numpy(spark):
    t = Tables(spark, DATA)
    from quarry.plans import dense as plans

    chosen = plans._choice(t)
    got = dense.project_queries(chosen, t.dq, t.dd).collect()
    vectors = {r["docid"]: np.array(r["v"]) for r in t.dd.collect()}
    for qid in {r["qid"] for r in got}:
        own = [r for r in got if r["qid"] == qid]
        assert sum(r["kind"] == "query" for r in own) == 1
        x = np.array([vectors[qid if r["docid"] is None else r["docid"]] for r in own])
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        assert np.abs(np.array([r["xy"] for r in own])) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-8)


def test_batch_losses_by_hand(spark):
    rows = [(0, 1, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), (0, 2, [0.0, 1.0], [0.0, 2.0], [1.0, 0.0]), (1, 3, [1.0, 0.0], [0.0, 1.0], [1.0, 0.0])]
    row = training.batch_losses(spark.createDataFrame(rows, "batch int, qid long, q array<double>, p array<double>, n array<double>"), temperature=1.0).first()
    assert row["in_batch_nce"] == pytest.approx(2 * math.log(1 + math.exp(-1)) / 3, abs=1e-6)
    assert row["triplet"] == pytest.approx((0 + max(0, 1 - 2**0.5 + 0.2) + 2**0.5 + 0.2) / 3, abs=1e-5)


def test_preprocessing_counts_in_one_reading(spark, tmp_path):
    rows = [(i, "same words here" if i < 4 else f"query number {i} of these", ["long enough text"], int(i != 9), 1) for i in range(30)] + [(50, "no", ["long enough text"], 1, 1)]
    rows = spark.createDataFrame(rows, "qid long, query string, texts array<string>, n_positive long, n_negative long")
    rows.write.parquet(str(tmp_path / "in"))
    df, steps = training.preprocess(spark.read.parquet(str(tmp_path / "in")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") in (1, 2) and len(set(re.findall(r"FileScan parquet [^\n]*#(\d+)", plan))) <= 1
    df.write.parquet(str(tmp_path / "out"))
    found, out = steps(), spark.read.parquet(str(tmp_path / "out"))
    assert (found["0 input"], found["1 quality"], found["2 length"], found["3 dedup"]) == (31, 30, 29, 26)
    assert found["4 sampling"] == out.where("method = 'none'").count() and found["5 augmentation"] == out.count() and 15 < found["4 sampling"] < 26


def test_format_check_raises_the_alarm(spark):
    good, bad = '{"doc_id": "a", "doc_text": "x"}', '{"docno": "a", "body": "x"}'
    check = lambda lines: files.validate_documents(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).first()
    row = check([good] * 17 + [bad, "no json", good])
    assert (row["valid"], row["invalid"], row["rate"], row["alarm"], row["samples"]) == (18, 2, 0.9, False, [good] * 3)
    row = check([bad, good])
    assert row["alarm"] and row["samples"] == [bad, good]


def test_principal_components_keep_the_most_variance(spark):
    t = Tables(spark, DATA)
    rows = t.vectors.orderBy("vec_id").select("v").toArrow().column(0).to_pylist()
    x = np.array(rows)
    own = np.array([r["xy"] for r in dense.project(t.vectors, "vec_id").orderBy("vec_id").collect()])
    most = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert own.var(axis=0, ddof=1) == pytest.approx(most, rel=1e-6)


def test_late_feedback_keeps_its_promises(spark):
    t = Tables(spark, DATA)
    found = late.late_prf(t.qtok, late.end_to_end(t.qtok, t.tokvec, 20), t.tokvec)
    own, all_rows = t.qtok.groupBy("qid").count(), found.groupBy("qid").agg(F.count("*").alias("n"), F.min("weight").alias("low"))
    joined = own.join(all_rows, "qid")
    assert joined.count() == own.count() and joined.where("n < count OR n > count + 10").isEmpty()
    run = late.late_prf_pipeline(t.qtok, t.tokvec, token_k=20)
    assert run.groupBy("qid").agg(F.max("rank").alias("last"), F.count("*").alias("n")).where("last != n OR n > 1000").isEmpty()


def test_numbers_and_firsts(spark):
    ids = spark.createDataFrame([(i * i * 7 - 50,) for i in range(300)] + [(10**12,)], "k long")
    got = [r["place"] for r in training.numbered(ids, "k", chunks=16).orderBy("k").collect()]
    assert got == list(range(1, 302))
    assert training.numbered(ids.where("k > 1e13"), "k").count() == 0
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, " "), (5, None), (1, "a")], "n long, t string")
    assert sorted(tuple(r) for r in training.dedup(rows, "t", "n").collect()) == [(1, "a"), (2, "b")]


def test_profiles_side_by_side(spark):
    a = training.field_profile(spark.createDataFrame([("Word here", None), ("", "x")], "t string, u string"), ("t", "u"), "word")
    assert {tuple(r) for r in a.collect()} == {("t", 1, 9.0, 1, 1), ("u", 1, 1.0, 1, 0)}
    b = training.field_profile(spark.createDataFrame([("long text " * 20, "", "z")], "t string, u string, w string"), ("t", "u", "w"))
    assert {(r["field"], r["status"], r["short"]) for r in training.compare_profiles(a, b).collect()} == {("t", "both", True), ("u", "only a", False), ("w", "only b", False)}


def test_hashed_terms_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "cat cat"), (2, None), (3, ""), (4, "cat")], "docid long, text string")
    got = {r["docid"]: r["v"] for r in dense.hashed_terms(rows, "docid", "text").collect()}
    assert got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == got[3] == [0.0] * 64


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def _close(a, b):
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(map(_close, a, b))
    numbers = isinstance(a, int | float | Decimal) and isinstance(b, int | float | Decimal)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) if numbers else a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql())[::3])  # a third of them, for time
def test_query_equals_sql(spark, tables, name):
    df, found = registry.queries()[name](spark, DATA), tables.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    key = lambda row: repr([round(float(x), 3) if isinstance(x, int | float | Decimal) else x for x in row])
    got, want = sorted(([r[c] for c in columns] for r in df.collect()), key=key), sorted(([r[i] for i in at] for r in found.fetchall()), key=key)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not _close(a, b)] == []


@pytest.mark.parametrize("name", ["pool_tokens", "vector_mean", "interaction_matrix"])
def test_rounded_zeros_have_no_sign(spark, tmp_path, name):
    rows = [(n, [1.0, 0.0] if n < 4 else [-1e-7 * (1 + n % 4), 0.5], 0) for n in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df, found = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    got, want = sorted(repr([r[c] for c in columns]) for r in df.collect()), sorted(repr([r[i] for i in at]) for r in found.fetchall())
    assert got == want and "-0.0" not in str(got)
