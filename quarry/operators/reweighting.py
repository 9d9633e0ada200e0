"""How semantic evidence reweighs expansion terms: per term, per query and over all queries.

Terms are (qid, term, rm_weight, semantic); bands and flags follow the ladders of quarry.functions.text.band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scores import top_k
from quarry.functions.text import band

# What a rescued term is.
RM_MAX, SEM_MIN = 0.01, 0.3
# Categories in the order in which they are tried, with their key words.
CATEGORIES = (
    ("Geographic/Locational", (
        "city", "country", "state", "region", "area", "location", "place", "national", "international", "local", "european", "american", "asian", "north", "south", "east",
        "west", "central", "german", "french", "british", "chinese", "japanese", "russian", "african",
    )),
    ("Temporal", (
        "year", "month", "day", "time", "period", "era", "century", "decade", "recent", "modern", "current", "contemporary", "historical", "past", "future", "present",
        "old", "new", "early", "late", "today", "yesterday", "tomorrow", "annual", "yearly",
    )),
    ("Conceptual/Synonyms", (
        "issue", "problem", "concern", "matter", "aspect", "factor", "development", "situation", "condition", "status", "state", "process", "system", "method", "approach", "way",
    )),
    ("Entities", (
        "organization", "company", "government", "agency", "department", "institution", "group", "party", "association", "union", "people", "person", "individual", "population", "community",
    )),
    ("Technical/Domain", (
        "technology", "system", "program", "project", "research", "study", "analysis", "data", "information", "report", "science", "scientific", "technical", "medical", "legal",
    )),
)


def reweighting(features: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """features with the hybrid weight, bands, ratio to the RM3 weight (at least 1e-6), whether semantics is the greater, and by how much; place by hybrid weight."""
    hybrid = F.round(alpha * F.col("rm_weight") + beta * F.col("semantic"), 7)
    out = features.select("qid", "term", "rm_weight", "semantic").withColumn("hybrid", hybrid)
    out = out.withColumn("rm_band", band(F.col("rm_weight"), "rm3")).withColumn("semantic_band", band(F.col("semantic"), "semantic")).withColumn("hybrid_band", band(F.col("hybrid"), "combined"))
    out = out.withColumn("ratio", F.round(F.col("hybrid") / F.greatest("rm_weight", F.lit(1e-6)), 6)).withColumn("boosted", F.col("semantic") > F.col("rm_weight")).withColumn("difference", F.round(F.col("semantic") - F.col("rm_weight"), 6))
    return top_k(out, None, "qid", "hybrid", "term", "place")


def insights(rw: DataFrame) -> DataFrame:
    """(qid, kind, term, place): the lists of notable terms of each query, each in its own order."""
    high, low = ("High", "Very High"), ("Low", "Very Low")
    kinds = (
        ("top", F.col("place") <= 5, F.col("hybrid")),
        ("boosted", F.col("boosted") & (F.col("difference") > 0.1), F.col("semantic")),
        ("penalised", ~F.col("boosted") & (F.col("difference") < -0.1), F.col("rm_weight")),
        ("high_rm_low_semantic", F.col("rm_band").isin(*high) & F.col("semantic_band").isin(*low), F.col("rm_weight")),
        ("high_semantic_low_rm", F.col("semantic_band").isin(*high) & F.col("rm_band").isin(*low), F.col("semantic")),
        ("most_reweighted", F.abs(F.col("ratio") - 1) > 0.5, F.abs(F.col("ratio") - 1)),
    )
    flags = F.filter(F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), order.alias("key"))) for kind, test, order in kinds)), lambda s: s.isNotNull())
    listed = rw.select("qid", "term", F.explode(flags).alias("s")).select("qid", "term", "s.kind", "s.key")
    return top_k(listed, None, ["qid", "kind"], "key", "term", "place").select("qid", "kind", "term", "place")


def reweighting_stats(rw: DataFrame) -> DataFrame:
    """What each query's terms look like; the correlation is NaN where either weight is the same for all of its terms."""
    r = lambda c: F.round(c, 6)
    # corr() divides by zero there, which is an error
    spread = F.stddev_pop("rm_weight") * F.stddev_pop("semantic")
    correlation = F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop("rm_weight", "semantic") / F.nullif(spread, F.lit(0.0)))
    return rw.groupBy("qid").agg(
        F.count("*").alias("n"), r(F.avg("rm_weight")).alias("rm_mean"), r(F.stddev_pop("rm_weight")).alias("rm_std"), r(F.avg("semantic")).alias("semantic_mean"), r(F.stddev_pop("semantic")).alias("semantic_std"),
        r(F.avg("hybrid")).alias("hybrid_mean"), r(correlation).alias("correlation"), F.count_if("boosted").alias("boosted"), F.count_if(~F.col("boosted")).alias("penalised"),
    )


def totals(rw: DataFrame) -> DataFrame:
    """One row for each band of the hybrid weight and one for all (band null)."""
    ratio = F.col("ratio")
    return rw.rollup(F.col("hybrid_band").alias("band")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("boosted").cast("int")), 6).alias("boost_rate"), F.round(F.avg(ratio), 4).alias("mean"), F.min(ratio).alias("low"), F.max(ratio).alias("high")
    )


def case_table(rw: DataFrame, n: int = 10) -> DataFrame:
    return rw.where(F.col("place") <= n).select("qid", "place", "term", F.format_string("%.6f", "rm_weight").alias("rm3"), F.format_string("%.6f", "semantic").alias("semantic"), F.when(F.col("boosted"), "up").otherwise("down").alias("direction"))


def with_boost(rw: DataFrame, rm_max: float = RM_MAX, sem_min: float = SEM_MIN) -> DataFrame:
    """rw with whether a term is rescued, and its boost factor (null where the RM3 weight is 0)."""
    return rw.withColumn("rescued", (F.col("rm_weight") < rm_max) & (F.col("semantic") > sem_min)).withColumn("boost", F.round(F.col("hybrid") / F.nullif("rm_weight", F.lit(0.0)), 4))


def term_rescue(terms: DataFrame) -> DataFrame:
    hit = F.col("rescued")
    boost = F.when(hit, F.col("boost"))
    return terms.agg(
        F.count("*").alias("terms"), F.count_if(hit).alias("rescued"), F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("percent"), F.count_distinct(F.when(hit, F.col("qid"))).alias("queries"),
        F.round(F.avg(boost), 4).alias("mean"), F.percentile(boost, F.lit(0.5)).alias("median"), F.max(boost).alias("high"), F.min(boost).alias("low"),
    )


def rescue_patterns(terms: DataFrame) -> DataFrame:
    """(qid, rescued, high_rm, best_boost, pattern) of queries with a rescued term."""
    out = terms.groupBy("qid").agg(F.count_if("rescued").alias("rescued"), F.count_if(F.col("rm_weight") > 0.1).alias("high_rm"), F.max(F.when(F.col("rescued"), F.col("boost"))).alias("best_boost"))
    pattern = F.when((F.col("rescued") > 2) & (F.col("high_rm") > 2), "balanced").when(F.col("rescued") > F.col("high_rm"), "rescue").otherwise("preserve")
    return out.where("rescued > 0").withColumn("pattern", pattern)


def histogram(terms: DataFrame, bins: int = 30) -> DataFrame:
    """(rm_bin, semantic_bin, n): two-dimensional density over bins of width 1 / bins."""
    b = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins)).cast("long")
    return terms.groupBy(b("rm_weight").alias("rm_bin"), b("semantic").alias("semantic_bin")).agg(F.count("*").alias("n"))


def categorize(terms: DataFrame) -> DataFrame:
    """terms with `category`: the first whose key word holds the term or is held by it, else Uncategorized."""
    spark = terms.sparkSession
    listed = [(i, name, w) for i, (name, words) in enumerate(CATEGORIES) for w in words]
    table = F.broadcast(spark.createDataFrame(listed, "place int, name string, word string"))  # some hundred rows
    distinct = terms.select("term").distinct()
    met = distinct.join(table, F.contains("term", "word") | F.contains("word", "term")).groupBy("term").agg(F.min_by("name", "place").alias("category"))
    return terms.join(met, "term", "left").withColumn("category", F.coalesce("category", F.lit("Uncategorized")))

