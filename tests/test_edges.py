"""Edges at which queries and their SQL differed or took too long: signs of zero, steps without rows, all pairs by blocks."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.functions.vectors import similarity
from quarry.llm import phrases
from quarry.operators import dense, evaluation, hyperplanes, lexical, nearest
from quarry.plans import dense as vectors
from quarry.plans import files, training
from quarry.plans.tables import Tables

DATA = "/root/testdata/sf0.001"


def test_stored_vectors_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    values = [-1e-7, 1e-7, -0.0, 0.0, 0.25, -4e-7, -6e-7, float("nan"), float("-inf"), -3e38, None]
    spark.createDataFrame([(1, values, 0), (2, None, 0), (3, [], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["v"] for r in files.QUERIES["save_load_embeddings"](Tables(spark, str(tmp_path))).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert repr(sorted(got.items())) == repr(sorted(con.execute(files.SQL["save_load_embeddings"]).fetchall()))


def test_a_sum_over_no_sampled_rows_is_null(spark, monkeypatch):
    good = [(i, f"query number {i} of these", ["long enough text"], 1, 1) for i in range(30)]
    for rows, last in (([(*r[:4], 0) for r in good], None), ([], None), (good, 30)):
        monkeypatch.setattr(training, "_rows", lambda t, rows=rows: spark.createDataFrame(rows, "qid long, query string, texts array<string>, n_positive long, n_negative long"))
        got = dict(map(tuple, training.QUERIES["preprocess_pipeline"](Tables(spark, DATA)).collect()))
        assert got["0 input"] == len(rows) and (got["5 augmentation"] is None if last is None else got["5 augmentation"] >= got["4 sampling"] > 0)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(7)
    found = [(n, [float(x) for x in draw.normal(size=4)]) for n in range(80)] + [(80 + n, [((7 * n + 3 * i) % 13 - 6) / 8 for i in range(4)]) for n in range(40)]
    found += [(120, None), (121, [1.0, None, 2.0, 3.0]), (122, [1.0, 2.0]), (123, [0.0] * 4), (124, [1e200] * 4), (125, [float("nan"), 1.0, 1.0, 1.0]), (126, [float("inf"), 0.0, 0.0, 0.0])]
    found += [(127, [5e-7, 0.0, 0.0, 0.0]), (128, [-1e-7, 0.0, 0.0, 0.0]), (129, []), (130, [1e12, -1e12, 0.1, 0.3]), (131, [0.0, 0.0]), (132, [None] * 4), (133, [1e-200] * 4), (134, [-0.0] * 4), (None, [0.5] * 4)]
    return spark.createDataFrame(found, "docid long, v array<double>").repartition(3).cache()


def test_all_measures_of_all_pairs(spark, odd, monkeypatch):
    queries = odd.select(F.col("docid").alias("qid"), "v")
    plain = dense.pairs(queries, odd).select("qid", "docid", *(F.round(similarity(F.col("q"), F.col("v"), k), 6).alias(k) for k in nearest.MEASURES))
    assert rows(nearest.measures(queries, odd)) == rows(plain)
    # the same by smaller blocks, in this process
    table = odd.toArrow()
    asked = SimpleNamespace(value=table.rename_columns(["qid", "v"]))
    monkeypatch.setattr(nearest, "SOME", 7)
    monkeypatch.setattr(nearest, "SENT", 50)
    parts = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in nearest._measured(asked)(iter(table.combine_chunks().to_batches()))]
    assert max(map(len, parts)) <= 50 and sorted(repr(r) for part in parts for r in part) == rows(plain)
    alike = odd.where("size(v) = 4 AND docid < 120")
    assert rows(nearest.measures(queries.where("qid < 30"), alike)) == rows(plain.where("qid < 30 AND docid < 120"))
    plan = vectors.QUERIES["vector_similarity"](Tables(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "MapInArrow" in plan


def clusters(spark, n, dim, centres, seed=1):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(centres, dim))
    x = at[draw.integers(0, centres, n)] + 0.3 * draw.normal(size=(n, dim)) / dim**0.5
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(n + i, x[0].tolist()) for i in range(300)] + [(n + 300, None), (n + 301, [1.0])], "docid long, v array<double>").cache()


@pytest.mark.parametrize(("centres", "bound"), [(40, 64), (1, 64), (40, 8)])
def test_hyperplanes_find_what_a_join_of_their_buckets_finds(spark, centres, bound, monkeypatch):
    """Pairs, their number and the best of them, by blocks, are those of a join of the probes with the postings."""
    docs = clusters(spark, 2000, 8, centres)
    queries = docs.where("docid % 100 = 0 OR docid >= 2300").select(F.col("docid").alias("qid"), "v")
    index = hyperplanes.lsh_build(docs, bound=bound)
    sizes = index.buckets
    assert index.recall >= 0.95 or index.bound >= 2302
    assert sizes.where(f"n > {index.bound} AND depth < 24").isEmpty() and sizes.groupBy("table").agg(F.sum("n").alias("n")).where("n != 2300").isEmpty()
    asked = queries.where("qid < 2300").collect()
    probes, _ = hyperplanes._coded(nearest.Vectors(pa.array([r["v"] for r in asked])), index.planes, 6)
    known = {(r["table"], r["depth"], r["prefix"]) for r in sizes.collect()}
    probed = {(r["qid"], t, d, int(c) >> (24 - d)) for r, codes in zip(asked, probes, strict=True) for t in range(8) for c in codes[t] for d in range(4, 25, 2)}
    wanted = spark.createDataFrame([p for p in probed if p[1:] in known], "qid long, table long, depth long, prefix long")
    pairs = wanted.join(index.postings, ["table", "depth", "prefix"]).select("qid", "docid").distinct()
    scored = pairs.join(docs, "docid").join(queries.select("qid", F.col("v").alias("q")), "qid").select("qid", "docid", F.round(similarity(F.col("q"), F.col("v")), 6).alias("score"))
    for block in (4_096, 7):
        monkeypatch.setattr(hyperplanes, "ASKED", block)
        assert rows(hyperplanes.lsh_pairs(index, queries)) == rows(pairs) and hyperplanes.lsh_compared(index, queries).first()["n"] == pairs.count()
        assert rows(hyperplanes.lsh_search(index, queries, 10)) == rows(top_k(scored, 10))


@pytest.mark.parametrize("share", [0.002, 0.3, 1.0])
def test_pairs_that_meet_by_product_or_one_by_one(share, monkeypatch):
    draw = np.random.default_rng(9)
    side = lambda n: nearest.Vectors(pa.array([[float(x) for x in row] for row in draw.integers(-2, 3, (n, 6))] + [None, [0.0] * 6, [float("nan")] * 6, [1e200] * 6]))
    q, d = side(300), side(900)
    met = draw.random((304, 904)) < share
    found = []
    for few in (64, 0, 10**9):  # as it is, all one by one, all by product
        monkeypatch.setattr(nearest, "FEW", few)
        best, got = nearest._Best(304, 5), []
        for i, j, score in nearest._met(q, np.arange(304), d, best, "cosine", lambda a, b: met[a:b]):
            got += list(zip(i.tolist(), j.tolist(), map(repr, score), strict=True))
        found.append(sorted(got))
    i, j = np.nonzero(met)
    score = np.where(q.null[i] | d.null[j], -np.inf, nearest._rounded(nearest._score(q, d, i, j, "cosine")))
    order = np.lexsort((j, -score, i))
    order = order[nearest._leading(i[order], 5)]
    real = {(a, b) for a, b, s in zip(i[order].tolist(), j[order].tolist(), score[order], strict=True) if s != -np.inf}
    assert found[0] == found[1] == found[2] and real <= {r[:2] for r in found[0]} and all(met[r[:2]] for r in found[0])


def test_hyperplanes_send_no_pairs(spark):
    t = Tables(spark, DATA)
    plan = vectors.QUERIES["lsh_knn"](t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInArrow") >= 2


def test_quality_of_all_pairs(spark, odd):
    """By sums and blocks as by a plain join, with copies, null labels, zero and odd vectors."""
    labelled = odd.where("size(v) = 4").withColumn("label", F.when(F.col("docid") % 7 != 0, F.col("docid") % 3).cast("int"))
    labelled = labelled.unionByName(labelled.where("docid % 5 = 0")).cache()
    plain = labelled.where("docid < 120 OR docid IN (121, 123, 132, 134)")
    for docs in (plain, labelled.where("docid != 126"), labelled, plain.where("label = 1"), plain.where("label IS NULL"), plain.limit(0)):
        queries = docs.where("docid % 2 = 1").withColumnRenamed("docid", "qid")
        pairs = queries.select("qid", F.col("v").alias("q"), F.col("label").alias("ql")).crossJoin(docs).select(similarity(F.col("q"), F.col("v")).alias("c"), (F.col("label") == F.col("ql")).alias("hit"))
        good, bad = F.avg(F.when(F.col("hit"), F.col("c"))), F.avg(F.when(~F.col("hit"), F.col("c")))
        want = pairs.agg(*(F.round(c, 6).alias(n) for c, n in ((F.min("c"), "low"), (F.max("c"), "high"), (good, "positive"), (bad, "negative"), (good - bad, "separation"))))
        assert repr(tuple(dense.embedding_quality(queries, docs).first())[:5]) == repr(tuple(want.first()))
    plan = vectors.QUERIES["embedding_quality"](Tables(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_runs_of_all_alphas_that_reach_the_first_ten(spark):
    """Rows and ranks are those of the whole runs, ties of the last included, and the metric is the same."""
    t = Tables(spark, DATA)
    whole, near = lexical.tune_alpha(t.queries, t.index, t.run_a).cache(), lexical.tune_alpha(t.queries, t.index, t.run_a, reach=10).cache()
    last = whole.where("rank <= 10").groupBy("alpha", "qid").agg(F.min("score").alias("last"))
    assert rows(near.select("alpha", "qid", "docid", "score", "rank")) == rows(whole.join(last, ["alpha", "qid"]).where("score >= last").select("alpha", "qid", "docid", "score", "rank"))
    value = lambda run: rows(evaluation.evaluate(run, t.qrels, ("ndcg_10",), ("alpha",)))
    assert value(near) == value(whole) and near.count() < whole.count()


def test_ties_at_the_reach_are_kept_up_to_k(spark, monkeypatch):
    texts = [(i, "same words here") for i in range(300)] + [(300 + i, f"words {'more ' * i}") for i in range(60)] + [(400, None), (401, "else")]
    index = lexical.build_postings(spark.createDataFrame(texts, "docid long, text string").repartition(5))
    terms = spark.createDataFrame([(0.1, 1, "word", 1.0), (0.9, 1, "word", 0.3), (0.1, 1, "same", 1e-6), (0.9, 1, "more", 2.0), (0.1, 2, "nothing", 1.0), (0.1, 3, "els", 1.0), (0.1, 3, "else", 1.0)], "alpha double, qid long, term string, weight double")
    for k, block in ((1000, 60_000), (50, 60_000), (7, 2)):
        monkeypatch.setattr(lexical, "ROWS", block)
        whole = lexical.retrieve(terms, index, k, ("alpha", "qid"))
        last = whole.where("rank <= 10").groupBy("alpha", "qid").agg(F.min("score").alias("last"))
        want = whole.join(last, ["alpha", "qid"]).where("score >= last").select("alpha", "qid", "docid", "score", "rank")
        assert rows(lexical.retrieve_reaching(terms, index, 10, k, ("alpha", "qid")).select(*want.columns)) == rows(want) and want.count() > 1


def test_texts_are_read_once_however_many_tries(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{(i * j) % 7}" for j in range(1, 30)) + ". end of it", "en" if i % 2 else None) for i in range(60)], "text string, lang string")
    seen, real = [], phrases._phrase_counts
    monkeypatch.setattr(phrases, "_phrase_counts", lambda *given: seen.append(real(*given)) or seen[-1])
    many, one = phrases.collocations(docs, least=3, per_trie=5), phrases.collocations(docs, least=3)
    assert rows(many) == rows(one) and many.count() > 20
    assert [df._jdf.queryExecution().analyzed().toString().count("MapInArrow") for df in seen] == [1, 1]
