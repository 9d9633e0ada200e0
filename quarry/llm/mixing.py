"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, table, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST_PASSES = 3
#: Tokens of a block at most; small corpora take smaller blocks, so that about LEAST_SLOTS slots are drawn, and small sources
#: smaller ones, so that each has LEAST_BLOCKS blocks if it has as many words.
BLOCK_TOKENS, LEAST_SLOTS, LEAST_BLOCKS = 1024, 20_000, 64
#: Fractional part of the golden ratio, scaled to 2 ** 32 and odd: slot k lies at k * PHI mod 2 ** 32.
PHI, UNIT = 2654435769, 1 << 32
#: Chunks in which ranks and running sums are taken, so that no source is sorted by one task.
CHUNKS = 4096
#: Equal parts of [0, 1) by which a slot finds its source.
SLICES = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares of the whole by weight, capped and reshared.

    A target stops at passes times its source's size; the excess goes to the others by weight until none is above. This
    has a closed order: sources reach their cap by source_size / weight ascending, so the level is found in one pass over
    the sorted sources. A table of sources has one row for each source, so one window over it is small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    repeated = F.array(*(F.lit(w) for w in weights))
    ranked = sizes.withColumn("weight", F.get(repeated, (F.row_number().over(order) - 1) % len(weights)).cast("double"))
    by_fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * passes)
    ranked = ranked.withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("full")) / F.col("weight_left"))
    capped = F.col("level") * F.col("weight") >= passes * F.col("source_size")
    ranked = ranked.withColumn("capped", capped).withColumn("final_level", F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("f"), F.col("level").alias("l")))).over(everything)["l"])
    target = F.when(F.col("capped"), F.lit(float(passes)) * F.col("source_size")).otherwise(F.col("final_level") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _running(df: DataFrame, keys: list[str], chunk: str, inner: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over earlier rows of its key, by chunk and then inner: sums of chunks are added up first,
    so a window holds one chunk of one key only."""
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    same = F.col(chunk) == F.col("_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.coalesce(F.sum(value).over(W.partitionBy(*keys, chunk).orderBy(*inner).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(name, within).join(starts, same).withColumn(name, F.col(name) + F.col("_start")).drop("_sum", "_chunk", "_start", *(f"_{k}" for k in keys))


def _word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(slot, source_no, rank) for slots 0 to slots - 1: slot k goes to the source whose share of [0, 1) holds the k-th
    golden-ratio point; rank counts the source's earlier slots. plan has (source_no, low, high) in units of 2 ** 32.

    Slots are made by spark.range over all tasks. Ranks are counted within chunks of slots and added up over chunks, so
    a source with most of the slots isn't one task's work.
    """
    spark = plan.sparkSession
    width = max(1, -(-slots // CHUNKS))
    made = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % UNIT) * PHI % UNIT).alias("point"), F.floor(F.col("id") / width).alias("chunk"))
    # an equal join by the bucket of the point; a source is in each bucket that its share reaches, at most SLICES + sources rows
    slice_of = lambda c: F.floor(c / (UNIT // SLICES))
    shares = plan.where("low < high").select("source_no", "low", "high", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high") - 1))).alias("slice"))
    joined = made.withColumn("slice", slice_of(F.col("point"))).join(F.broadcast(shares), "slice")
    placed = joined.where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "chunk", "source_no")
    return _running(placed, ["source_no"], "chunk", ["slot"], F.lit(1), "rank").drop("chunk")


def mix(docs: DataFrame, size: Column | None = None, seed: int = 1, text: str = "text", weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """The mix of a table (doc_id, text, source): documents with what is taken of them, and the schedule.

    Returns (documents, slots). documents: doc_id, source, size, source_size, target, taken (words, repeats counted), and
    pieces, the word ranges of the document by block with the number of times each is taken; slots: slot, source, block.
    A source's documents are put in a seeded order and cut into blocks of equal tokens of its own (within one); its share of
    the slots is its target over the size of its blocks, and its slot number k takes block k modulo its blocks. All sources
    end within a few of their blocks of their targets, small ones as well, and no document is taken more than `passes` times
    its size. Null source is a source, last in order. Null and empty texts have size 0 and are never taken.
    Rows with the same doc_id are separate rows, told apart by their place. An empty table gives empty results.
    Extra columns are left out. The number of sources is taken to be small (checked: at most 100,000).
    """
    measured = docs.select(F.col("doc_id"), F.col("source"), (size if size is not None else _word_count(F.col(text))).alias("size"))
    sized = cut(measured.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    plan = cut(targets(sums, weights, passes))
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    known = plan.agg(F.count("*").alias("n"), F.sum("target").alias("t")).first()
    if known["n"] > 100_000:
        raise ValueError(f"{known['n']} sources: a source must be a small vocabulary")
    block = max(1, min(BLOCK_TOKENS, int(known["t"] or 0) // LEAST_SLOTS))
    of = F.col("source_size")
    blocks = F.greatest(F.ceil(of / block), F.least(of, F.lit(LEAST_BLOCKS))).cast("long")
    plan = plan.withColumn("source_no", F.row_number().over(by_source)).withColumn("blocks", blocks)
    plan = plan.withColumn("slots", F.when(of > 0, F.col("target") * F.col("blocks") / of).otherwise(0.0))
    total, reach = F.sum("slots").over(W.partitionBy()), F.sum("slots").over(by_source.rowsBetween(W.unboundedPreceding, 0))
    plan = plan.withColumn("high", F.when(total > 0, F.round(reach / total * UNIT)).otherwise(0).cast("long"))
    # the first `longer` blocks of a source have width + 1 tokens, the others width
    plan = plan.withColumn("width", F.when(of > 0, F.expr("source_size DIV blocks")).otherwise(1)).withColumn("longer", F.when(of > 0, of % F.col("blocks")).otherwise(0))
    plan = cut(plan.withColumn("low", F.coalesce(F.lag("high").over(by_source), F.lit(0))))
    slots = int(math.ceil(plan.agg(F.sum("slots")).first()[0] or 0))

    placed = sized.join(F.broadcast(plan.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "width", "longer")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    fine = placed.withColumn("chunk", F.shiftrightunsigned(F.col("key"), 52))
    fine = _running(fine, ["source_no"], "chunk", ["key", "doc_id", "size"], F.col("size"), "start")
    filled = fine.where(F.col("size") > 0)
    filled = filled.withColumn("end", F.col("start") + F.col("size"))
    at = lambda x: F.expr(f"CASE WHEN {x} < longer * (width + 1) THEN {x} DIV (width + 1) ELSE longer + ({x} - longer * (width + 1)) DIV width END")
    edge = lambda b: b * F.col("width") + F.least(b, F.col("longer"))
    pieces = filled.select("source_no", "start", "end", "width", "longer", F.explode(F.sequence(at("start"), at("(end - 1)"))).alias("block"))
    pieces = pieces.withColumn("from", F.greatest(edge(F.col("block")), F.col("start")) - F.col("start")).withColumn("to", F.least(edge(F.col("block") + 1), F.col("end")) - F.col("start"))

    drawn = schedule(plan, slots).join(F.broadcast(plan.select("source_no", "source", "blocks")), "source_no").where(F.col("rank") < passes * F.col("blocks")).select("slot", "source_no", "source", (F.col("rank") % F.col("blocks")).alias("block"))
    times = drawn.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    joined = pieces.join(times, ["source_no", "block"])
    found = joined.groupBy("source_no", "start").agg(
        F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("from", "to", "times"))).alias("pieces")
    )
    columns = ("doc_id", "source", "size", "source_size", "target")
    taken = fine.where(F.col("size") > 0).join(found, ["source_no", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces")
    empty = fine.where(F.col("size") <= 0).select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast(taken.schema["pieces"].dataType).alias("pieces"))
    return taken.unionByName(empty), drawn.select("slot", "source", "block")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    documents, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
