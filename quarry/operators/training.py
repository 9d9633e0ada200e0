"""Training data for rankers: splits, samples, examples, pairs, filters, deduplication, augmentation, losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.vectors import similarity


def hashed(seed: int, *keys: str) -> Column:
    """The order in which samples are drawn: the same in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def place(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "place") -> DataFrame:
    w = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def numbered(df: DataFrame, key: str, chunks: int = 4096, name: str = "place") -> DataFrame:
    """df with its place from 1 in the order of a whole-number key. Rows are ordered within chunks of the key's range, whose
    counts are added up, so that no task orders the whole table."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // chunks))
    parts = df.withColumn("_chunk", F.floor((F.col(key) - F.lit(low or 0)) / width))
    starts = parts.groupBy("_chunk").agg(F.count("*").alias("_n"))
    starts = starts.select("_chunk", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row a chunk
    within = place(parts, [F.col(key)], ["_chunk"], name)
    return within.join(F.broadcast(starts), "_chunk").withColumn(name, F.col(name) + F.col("_start")).drop("_chunk", "_start")


def components(queries: DataFrame, run: DataFrame, qrels: DataFrame, docs: DataFrame, subset: DataFrame | None = None) -> dict[str, DataFrame]:
    """The queries, run, judgments and documents of a data set, cut to a subset of queries (qid) if one is given: documents
    are those that the run or the judgments name."""
    kept = queries if subset is None else queries.join(subset.select("qid"), "qid", "left_semi")
    of_run, judged = (df.join(kept.select("qid"), "qid", "left_semi") for df in (run, qrels))
    named = of_run.select("docid").union(judged.select("docid")).distinct()
    return {"queries": kept, "run": of_run, "qrels": judged, "documents": docs.join(named, "docid", "left_semi")}


def field_profile(docs: DataFrame, fields: tuple[str, ...], probe: str | None = None) -> DataFrame:
    """(field, filled, mean_length, values, hits): for each field the rows that fill it, their mean length and distinct values,
    and the rows in which the probe occurs in any case. Values are told apart by a digest."""
    long = docs.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))))
    filled = F.trim("value") != ""
    hit = F.contains(F.lower("value"), F.lit((probe or "").lower())) if probe else F.lit(False)
    return long.groupBy("field").agg(F.count_if(filled).alias("filled"), F.round(F.avg(F.when(filled, F.length("value"))), 6).alias("mean_length"), F.count_distinct(F.when(filled, F.md5("value"))).alias("values"), F.count_if(hit).alias("hits"))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, status, filled_a, filled_b, mean_a, mean_b, short): two profiles side by side; a field is in both, or only in
    one; short marks those whose mean in a is under a tenth of that in b."""
    left, right = (df.where("filled > 0").select("field", F.col("filled").alias(f"filled_{n}"), F.col("mean_length").alias(f"mean_{n}")) for n, df in (("a", a), ("b", b)))
    status = F.when(F.col("filled_b").isNull(), "only a").when(F.col("filled_a").isNull(), "only b").otherwise("both")
    return left.join(right, "field", "full").select("field", status.alias("status"), "filled_a", "filled_b", "mean_a", "mean_b", F.coalesce(F.col("mean_a") < 0.1 * F.col("mean_b"), F.lit(False)).alias("short"))


def kfold(queries: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """(fold, split, qid): each query tests in one fold and trains in the others. Query sets are small tables; one window numbers them."""
    numbered = place(queries.select("qid"), [hashed(seed, "qid"), F.col("qid")]).withColumn("own", F.col("place") % k)
    return numbered.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"), "qid", "own").select(F.col("fold").cast("long"), F.when(F.col("own") == F.col("fold"), "testing").otherwise("training").alias("split"), "qid")


def val_split(queries: DataFrame, size: float = 0.2, strategy: str = "random_split", seed: int = 1) -> DataFrame:
    """(qid, split): the first floor(n * size) by hash order, or by id, validate; none with no_val."""
    if strategy == "no_val":
        return queries.select("qid", F.lit("train").alias("split"))
    order = [hashed(seed, "qid"), F.col("qid")] if strategy == "random_split" else [F.col("qid")]
    numbered = place(queries.select("qid"), order).withColumn("n", F.count("*").over(W.partitionBy()))
    return numbered.select("qid", F.when(F.col("place") <= F.floor(F.col("n") * size), "val").otherwise("train").alias("split"))


def training_examples(queries: DataFrame, run: DataFrame, qrels: DataFrame, docs: DataFrame, require_positive: bool = True, cap: int | None = None) -> DataFrame:
    """One row for each query with candidates array<struct<rank, docid, score, grade, text>>, n_candidates, n_positive.

    Candidates without text are left out; the need of a positive is tested before that, and the cap is off by default.
    """
    judged = run.select("qid", "docid", "rank", "score").join(qrels.select("qid", "docid", "grade"), ["qid", "docid"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    if cap is not None:
        judged = judged.where(F.col("rank") <= cap)
    if require_positive:
        judged = judged.join(judged.where("grade > 0").select("qid").distinct(), "qid", "left_semi")
    texts = judged.join(docs.where("text IS NOT NULL AND trim(text) != ''").select("docid", "text"), "docid")
    rows = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "docid", "score", "grade", "text"))).alias("candidates"))
    return rows.join(queries, "qid").withColumn("n_candidates", F.size("candidates").cast("long")).withColumn("n_positive", F.size(F.filter("candidates", lambda c: c["grade"] > 0)).cast("long"))


def unnest(examples: DataFrame) -> DataFrame:
    """(qid, docid, rank, score, grade, text) of nested examples."""
    return examples.select("qid", F.inline("candidates")).select("qid", "docid", "rank", "score", "grade", "text")


def data_stats(examples: DataFrame) -> DataFrame:
    flat = examples.select(F.size("candidates").alias("n"), F.col("n_positive").alias("p"))
    return flat.agg(F.count("*").alias("queries"), F.sum("n").alias("candidates"), F.sum("p").alias("positives"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.round(F.sum("p") / F.sum("n"), 6).alias("positive_rate"))


def pointwise(flat: DataFrame, most: int = 100, most_negative: int = 50) -> DataFrame:
    """All positives, then the first negatives, `most` rows a query."""
    kind = flat.withColumn("positive", F.col("grade") > 0)
    kept = place(kind, [F.col("rank")], ["qid", "positive"], "nth").where(F.col("positive") | (F.col("nth") <= most_negative))
    return place(kept, [F.desc("positive"), F.col("rank")], ["qid"]).where(F.col("place") <= most).select("qid", "docid", "grade", "place")


def pairwise(flat: DataFrame, cap: int = 50) -> DataFrame:
    """(qid, positive, negative): pairs in order of both ranks, at most `cap` a query. Only the first of either side that the
    cap can reach are paired."""
    p = place(flat.where("grade > 0"), [F.col("rank")], ["qid"], "i").where(F.col("i") <= cap).select("qid", F.col("docid").alias("positive"), "i")
    n = place(flat.where("grade <= 0"), [F.col("rank")], ["qid"], "j").where(F.col("j") <= cap).select("qid", F.col("docid").alias("negative"), "j")
    return place(p.join(n, "qid"), [F.col("i"), F.col("j")], ["qid"]).where(F.col("place") <= cap).select("qid", "positive", "negative", "place")


def sampled_pairs(flat: DataFrame, negatives: int = 10, least: int = 10, seed: int = 1) -> DataFrame:
    """Each positive with at most so many sampled negatives, of queries with enough candidates and both classes."""
    sizes = flat.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("p")).where((F.col("n") >= least) & (F.col("p") > 0) & (F.col("p") < F.col("n"))).select("qid")
    fit = flat.join(sizes, "qid", "left_semi")
    # a query's negatives are at most its candidates; each positive takes its own from that list, so pairs aren't rows
    pool = fit.where("grade <= 0").groupBy("qid").agg(F.collect_list("docid").alias("pool"))
    met = fit.where("grade > 0").select("qid", F.col("docid").alias("positive")).join(pool, "qid")
    draw = lambda d: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("qid").cast("string"), F.col("positive").cast("string"), d.cast("string"))).alias("h"), d.alias("docid"))
    drawn = met.select("qid", "positive", F.posexplode(F.slice(F.array_sort(F.transform("pool", draw)), 1, negatives)).alias("nth", "drawn"))
    return drawn.select("qid", "positive", F.col("drawn.docid").alias("negative"), (F.col("nth") + 1).cast("long").alias("place"))


def relevance_class(grade: Column, score: Column, least: int = 1, hard: float = 0.5) -> Column:
    return F.when(grade >= least, "positive").when((grade == 0) & (score >= hard), "hard_negative").otherwise("negative")


def sample_docs(flat: DataFrame, n: int = 3, strategy: str = "random", seed: int = 1) -> DataFrame:
    """At most n documents of each query: random, top_scored, longest, shortest, evenly (spaced by rank), diverse (spaced by length and distinct words)."""
    length = F.length("text")
    words = F.size(F.array_distinct(F.split(F.lower("text"), r"\s+")))
    orders = {
        "random": [hashed(seed, "qid", "docid")], "top_scored": [F.desc("score"), F.col("docid")], "longest": [F.desc(length), F.col("docid")],
        "shortest": [length, F.col("docid")], "evenly": [F.col("rank")], "diverse": [F.desc(0.1 * length + words), F.col("docid")],
    }
    placed = place(flat, orders[strategy], ["qid"])
    if strategy in ("evenly", "diverse"):
        step = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("qid")) / n))
        placed = placed.withColumn("step", step).where((F.col("place") - 1) % F.col("step") == 0).where((F.col("place") - 1) / F.col("step") < n)
    else:
        placed = placed.where(F.col("place") <= n)
    return placed.select("qid", "docid", "place")


def sample_negatives(flat: DataFrame, n_random: int = 5, n_hard: int = 5, strategy: str = "mixed", seed: int = 1) -> DataFrame:
    """Negatives by class quotas: hard ones by score, others at random; hard_only or random_only take one class."""
    kind = flat.withColumn("kind", relevance_class(F.col("grade"), F.col("score"), hard=5.0)).where("kind != 'positive'")
    quota = {"hard_negative": n_hard if strategy != "random_only" else 0, "negative": n_random if strategy != "hard_only" else 0}
    key = F.when(F.col("kind") == "hard_negative", F.format_string("%020.6f", 1e9 - F.col("score"))).otherwise(hashed(seed, "qid", "docid"))
    limit = F.when(F.col("kind") == "hard_negative", quota["hard_negative"]).otherwise(quota["negative"])
    return place(kind, [key, F.col("docid")], ["qid", "kind"]).where(F.col("place") <= limit).select("qid", "docid", "kind", "place")


def contrastive(flat: DataFrame, positives: int = 3, negatives: int = 7, hard: int = 5, seed: int = 1) -> DataFrame:
    """One row for each query with a positive: document ids of its positives, negatives and hard negatives, and how many there were."""
    kind = flat.withColumn("kind", relevance_class(F.col("grade"), F.col("score"), hard=5.0))
    placed = place(kind, [hashed(seed, "qid", "docid")], ["qid", "kind"])
    quota = F.when(F.col("kind") == "positive", positives).when(F.col("kind") == "negative", negatives).otherwise(hard)

    def ids(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("place") <= quota), F.struct("place", "docid"))))
        return F.array_join(F.transform(rows, lambda s: s["docid"].cast("string")), ",")

    out = placed.groupBy("qid").agg(ids("positive").alias("positive_docs"), ids("negative").alias("negative_docs"), ids("hard_negative").alias("hard_negatives"), *(F.count_if(F.col("kind") == k).alias(f"available_{k}") for k in ("positive", "negative", "hard_negative")))
    return out.where("available_positive > 0")


def in_batch(positives: DataFrame, batch: int = 4) -> DataFrame:
    """(batch, qid, negative): each query of a batch has the positives of the batch's other queries as negatives."""
    numbered = place(positives.select("qid").distinct(), [F.col("qid")]).select("qid", F.floor((F.col("place") - 1) / batch).alias("batch"))
    rows = positives.join(numbered, "qid")
    other = rows.select("batch", F.col("qid").alias("of"), F.col("docid").alias("negative"))
    return rows.select("batch", "qid").distinct().join(other, "batch").where("qid != of").select("batch", "qid", "negative").distinct()


def filter_length(rows: DataFrame, query: tuple[int, int] = (3, 200), doc: tuple[int, int] = (10, 2000)) -> DataFrame:
    """Queries of a fit length all of whose documents (array texts) have a fit length."""
    return rows.where(F.length("query").between(*query) & F.forall("texts", lambda d: F.length(d).between(*doc)))


def filter_quality(rows: DataFrame) -> DataFrame:
    """At least one positive and one negative, and neither a blank query nor a blank positive."""
    return rows.where((F.col("n_positive") > 0) & (F.col("n_negative") > 0) & (F.trim("query") != "") & F.forall("texts", lambda d: F.trim(d) != ""))


def dedup(rows: DataFrame, key: str, order: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) of the first row of each key by order; blank and null keys go. Keys are told
    apart by a digest, and firsts are taken within tasks before the exchange, so equal rows and long keys aren't sorted."""
    wanted = rows.where(F.trim(F.col(key).cast("string")) != "").select(F.sha2(F.col(key).cast("string"), 256).alias("_key"), F.col(order).alias("_order"), F.struct(*(keep or rows.columns)).alias("_row"))
    return wanted.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def augment(queries: DataFrame, share: float = 0.5, drop: int = 10, seed: int = 1) -> DataFrame:
    """(qid, query, method): the queries, and for a sampled share a copy without some words and one with two neighbours
    swapped. Words are dropped where the hash of their place falls under drop percent; a copy of two words or fewer, or of
    half the words or fewer, is the query itself."""
    bucket = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 4), 16, 10).cast("int") % 100
    w, qid = F.split("query", " "), F.col("qid").cast("string")
    kept = F.filter(w, lambda x, i: bucket(F.lit("d"), qid, i.cast("string")) >= drop)
    dropped = F.when((F.size(w) > 2) & (2 * F.size(kept) > F.size(w)), F.array_join(kept, " ")).otherwise(F.col("query"))
    at = F.when(F.size(w) > 1, 1 + bucket(F.lit("w"), qid) % (F.size(w) - 1)).otherwise(1)
    swap = F.concat(F.slice(w, F.lit(1), at - 1), F.array(F.get(w, at), F.get(w, at - 1)), F.slice(w, at + 2, F.size(w)))
    swapped = F.when(F.size(w) > 2, F.array_join(swap, " ")).otherwise(F.col("query"))
    copy = lambda text, method: F.struct(text.alias("query"), F.lit(method).alias("method"))
    own, sampled = copy(F.col("query"), "none"), bucket(F.lit("s"), qid) < int(100 * share)
    copies = F.when(sampled, F.array(own, copy(dropped, "drop"), copy(swapped, "swap"))).otherwise(F.array(own))
    return queries.select("qid", *(c for c in queries.columns if c not in ("qid", "query", "method")), F.inline(copies)).select("qid", "query", "method", *(c for c in queries.columns if c not in ("qid", "query", "method")))


def preprocess(rows: DataFrame, query: tuple[int, int] = (3, 400), doc: tuple[int, int] = (10, 12000), sampled: float = 0.8, share: float = 0.5, seed: int = 1) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """rows (qid, query, texts, n_positive, n_negative, any others) through the filters of quality and length, the first row of each query
    text, a sample, and augmentation: the result, with the column method, and what gives the rows after each step.

    The counts are observed as the rows go by, so the input is read once; they are there when the result has been written.
    """
    counts: dict[str, Observation] = {}

    def step(name: str, df: DataFrame) -> DataFrame:
        counts[name] = Observation(f"preprocess {name}")
        return df.observe(counts[name], F.count(F.lit(1)).alias("rows"))

    df = step("1 quality", filter_quality(step("0 input", rows)))
    df = step("3 dedup", dedup(step("2 length", filter_length(df, query, doc)), "query", "qid"))
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("k"), F.col("qid").cast("string"))), 1, 4), 16, 10).cast("int") % 100
    df = step("5 augmentation", augment(step("4 sampling", df.where(bucket < int(100 * sampled))), share, seed=seed))
    return df, lambda: {name: one.get["rows"] for name, one in counts.items()}


def balance(counts: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """(bucket, qid): at most n sampled queries of each bucket of relevant counts."""
    bucket = F.when(F.col("n") <= 2, "few").when(F.col("n") <= 10, "some").otherwise("many")
    return place(counts.withColumn("bucket", bucket), [hashed(seed, "qid")], ["bucket"]).where(F.col("place") <= n).select("bucket", "qid")


def batch_losses(triples: DataFrame, temperature: float = 0.05, margin: float = 0.2) -> DataFrame:
    """One row of losses of vectors (batch, qid, q, p, n), a query with its positive and its negative: InfoNCE by cosine with
    the batch's other positives as negatives, and the triplet loss by Euclidean distance (every difference plus 0.000001, as
    the usual definition has it).

    A batch's positives are gathered once and each query is compared with them where it lies, so there is no row for a pair;
    batches are of the size that training uses.
    """
    held = triples.groupBy("batch").agg(F.collect_list(F.struct("qid", "p")).alias("positives"))
    scaled = lambda p: similarity(F.col("q"), p) / temperature
    raised = F.aggregate(F.transform("positives", lambda c: F.exp(scaled(c["p"]) - scaled(F.col("p")))), F.lit(0.0), lambda a, x: a + x)
    distance = lambda other: F.sqrt(F.aggregate(F.zip_with("q", other, lambda a, b: (a - b + 1e-6) * (a - b + 1e-6)), F.lit(0.0), lambda a, x: a + x))
    triplet = F.greatest(F.lit(0.0), distance("p") - distance("n") + margin)
    return triples.join(held, "batch").agg(F.round(F.avg(F.log(raised)), 6).alias("in_batch_nce"), F.round(F.avg(triplet), 6).alias("triplet"))


def losses(scored: DataFrame, temperature: float = 0.05, margin: float = 0.2) -> DataFrame:
    """One row of batch losses of (qid, docid, score, grade): mean squared error, cross entropy of logits, hinge and InfoNCE
    over a query's rows, each query's best positive against its negatives."""
    y = (F.col("grade") > 0).cast("double")
    s = F.col("score")
    point = scored.agg(F.round(F.avg((s - y) * (s - y)), 6).alias("mse"), F.round(F.avg(F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))), 6).alias("bce"))
    best = scored.where("grade > 0").groupBy("qid").agg(F.max("score").alias("p"))
    against = best.join(scored.where("grade <= 0").select("qid", F.col("score").alias("n")), "qid")
    per = against.groupBy("qid", "p").agg(F.avg(F.greatest(F.lit(0.0), margin - F.col("p") + F.col("n"))).alias("hinge"), F.sum(F.exp((F.col("n") - F.col("p")) / temperature)).alias("rest"))
    pair = per.agg(F.round(F.avg("hinge"), 6).alias("hinge"), F.round(F.avg(F.log1p("rest")), 6).alias("info_nce"))
    return point.join(pair, F.lit(True))
