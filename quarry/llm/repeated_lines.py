"""Substring deduplication by hashing sentences, lines or paragraphs.

Units are normalised to their words, digests are grouped over all documents, the earliest occurrence of each stays, and
neighbouring repeated units of a document are joined into one span of its original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import runs, table, text_bytes, written
from quarry.llm.hashing import Words, run_digests, split_words

#: Spans of fewer words are left alone: headings, greetings and licence lines repeat in clean documents.
LEAST_WORDS = 30
#: Words that a sentence or clause has at least, so that no single words are units. Texts are cut into sentences, a shorter
#: one going on into the next, and into clauses as well, shorter ones left out: so a repeated sentence is found behind
#: whatever short words lead to it, and short words between repeated sentences are part of the repeat.
SENTENCE_WORDS = 4
AT_ONCE = 1 << 18

#: Bytes that end a sentence, or a clause, if a word ends with one.
_ENDS, _CLAUSE_ENDS = (np.isin(np.arange(256), list(marks)) for marks in (b".!?", b".!?:;"))


def _cuts(data: np.ndarray, words: Words, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and one past the last word of all units, in order. A unit ends with its document and at a line
    break (a paragraph: at two with nothing but space between). A sentence of SENTENCE_WORDS or more also ends with a word
    that ends one; clauses of as many words, which end with a word that ends a clause, are units beside the sentences."""
    begins = np.zeros(len(words.start), bool)
    begins[words.first[:-1][words.first[:-1] < len(begins)]] = True
    breaks = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == 10)))
    begins[1:] |= breaks[words.start[1:]] - breaks[words.end[:-1]] >= (2 if unit == "paragraph" else 1)
    if unit != "sentence":
        first = np.flatnonzero(begins)
        return first, np.append(first[1:], len(begins))
    after_end, clauses = begins.copy(), begins.copy()
    after_end[1:] |= _ENDS[data[words.end[:-1] - 1]]
    clauses[1:] |= _CLAUSE_ENDS[data[words.end[:-1] - 1]]
    likely = np.flatnonzero(after_end)
    first, last = [], 0
    for place, sure in zip(likely.tolist(), begins[likely].tolist(), strict=True):
        if sure or place - last >= SENTENCE_WORDS:
            first.append(place)
            last = place
    whole = np.array(first, np.int64)
    part = np.flatnonzero(clauses)
    both = np.column_stack((np.concatenate((whole, part)), np.concatenate((np.append(whole[1:], len(begins)), np.append(part[1:], len(begins))))))
    both = both[(both[:, 1] - both[:, 0] >= SENTENCE_WORDS) | (np.arange(len(both)) < len(whole))]
    return tuple(np.unique(both, axis=0).T)


def _units(unit: str):  # noqa: ANN202  a function of batches
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for i, j in runs(at, AT_ONCE):
                piece, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
                words = split_words(piece, offsets, lower=True)
                first, last = _cuts(piece, words, unit)
                begin, finish = words.start[first], words.end[last - 1]
                high, low = run_digests(words.digest, first, last)
                owner = np.searchsorted(words.first, first, "right") - 1
                points = np.concatenate((np.zeros(1, np.int64), np.cumsum((piece & 0xC0) != 0x80)))
                base, place = points[offsets[owner]], words.first[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(owner + i)) for k in (1, 2)), pa.array(first - place), pa.array(last - place),
                        pa.array(points[begin] - base), pa.array(points[finish] - base), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                    ],
                    names=["doc_id", "body", "word", "next_word", "start", "end", "high", "low"],
                )

    return cut_up


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, unit: str = "sentence") -> DataFrame:
    """Every span that repeats what came before: (doc_id, start, end, n_words, n_units, first_doc_id, first_start, body).

    A unit is a sentence (of SENTENCE_WORDS or more, up to a word that ends with a full stop, an exclamation or question mark,
    or to the end of the line) and a clause (likewise, up to a colon or semicolon too, and never going on), or a line, or a
    paragraph (what lies between blank lines). It is normalised to its words, A to Z in lower case, so
    spacing doesn't count. Of equal units that of the least doc_id stays, nulls last, then that which begins first, also
    within a document; the others are repeats. Repeats of a document that touch or overlap form one span, which is returned
    if it has least_words words or more. A repeat behind short words that no mark parts from it is not found. Offsets are code points of the original text, from the first word to the end of the
    last, end exclusive; first_doc_id and first_start are the place that the span's first unit repeats; body is the
    xxhash64 of the text, by which rows of one doc_id with different texts are told apart.

    Repeated rows of a document have one place and so are one occurrence. Null and empty texts have no units. Rows with a
    null doc_id take part, told apart by their text. Extra columns are left out; an empty table gives an empty result.

    Units travel as 128-bit digests. The earliest occurrence is pre-aggregated before the exchange, so a line that a third
    of all documents share is not one task's work; the join back has one row for each digest on one side.
    """
    schema = "doc_id long, body long, word long, next_word long, start long, end long, high long, low long"
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"))
    units = written(rows.mapInArrow(_units(unit), schema))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "body")
    # a table of its own, so that the join can split a digest that very many units share
    first = written(units.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = units.join(first, ["high", "low"]).where(F.col("first") != place)
    # a document's repeats in order; equal rows of the table are one document
    own = again.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set(F.struct("word", "next_word", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")))).alias("units"))
    placed = own.select("doc_id", "body", F.explode("units").alias("u"))
    before = W.partitionBy("doc_id", "body").orderBy("u.word", "u.next_word")
    apart = F.col("u.word") > F.coalesce(F.max("u.next_word").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    joined = placed.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(before))
    spans = joined.groupBy("doc_id", "body", "run").agg(
        F.min("u.start").alias("start"), F.max("u.end").alias("end"), (F.max("u.next_word") - F.min("u.word")).alias("n_words"), F.count("*").alias("n_units"), F.min("u").alias("u")
    )
    return spans.where(F.col("n_words") >= least_words).select(F.col("doc_id").alias(doc_id), "start", "end", "n_words", "n_units", "u.first_doc_id", "u.first_start", "body")


def remove_repeats(docs: DataFrame, repeats: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated spans cut out of text, and `removed`, their original offsets in order.

    repeats is what repeated_units gives for docs. Rows without repeats, with null or empty texts among them, are returned
    as they are with an empty `removed`; repeated rows are each returned; a column `removed` of docs is replaced, all others
    are kept whatever their names. An empty table gives an empty result.
    """
    spans = repeats.groupBy(F.col(doc_id).alias("id"), "body").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    rows = docs.drop("removed").select(F.struct("*").alias("row"))
    joined = rows.join(spans, F.col("row")[doc_id].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")[text]) == F.col("body")), "left")
    removed, whole = F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.col("row")[text]
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(removed, lambda s: s["end"]))
    starts = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.char_length(whole).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int")))
    shown = (F.when(F.size(removed) > 0, F.array_join(kept, "")).otherwise(whole).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "removed")
    return joined.select(*shown, removed.alias("removed"))


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of 30 words or more of all documents that repeats earlier sentences or lines."""
    return repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("body")


OP9_SQL = r"""
WITH cut_up AS (
  SELECT doc_id, 1 AS cut, regexp_extract_all(coalesce(text, ''), '(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+){3}(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+)*[^\x20\x09-\x0D]+|(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+)*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents
  UNION ALL SELECT doc_id, 2, regexp_extract_all(coalesce(text, ''), '(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?:;][\x20\x09\x0B-\x0D]+)*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') FROM documents
), pieces AS (
  SELECT doc_id, cut, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cut_up
), measured AS (
  SELECT doc_id, cut, i, length(piece) AS chars, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM pieces
), placed AS (
  SELECT doc_id, cut, chars, words, coalesce(sum(chars) OVER before, 0)::BIGINT AS start, coalesce(sum(len(words)) OVER before, 0)::BIGINT AS word FROM measured
  WINDOW before AS (PARTITION BY doc_id, cut ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), units AS (
  SELECT DISTINCT doc_id, word, word + len(words) AS next_word, start, start + chars AS "end", array_to_string(words, ' ') AS unit FROM placed WHERE len(words) >= CASE cut WHEN 1 THEN 1 ELSE 4 END
), ranked AS (
  SELECT *, first(doc_id) OVER (PARTITION BY unit ORDER BY doc_id, start) AS first_doc_id, first(start) OVER (PARTITION BY unit ORDER BY doc_id, start) AS first_start FROM units
), again AS (
  SELECT *, coalesce(max(next_word) OVER (PARTITION BY doc_id ORDER BY word, next_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reached FROM ranked WHERE NOT (doc_id = first_doc_id AND start = first_start)
), joined AS (
  SELECT *, sum((word > reached)::INT) OVER (PARTITION BY doc_id ORDER BY word, next_word) AS run FROM again
)
SELECT doc_id, min(start) AS start, max("end") AS "end", (max(next_word) - min(word))::BIGINT AS n_words, count(*) AS n_units, arg_min(first_doc_id, (word, next_word)) AS first_doc_id, arg_min(first_start, (word, next_word)) AS first_start
FROM joined GROUP BY doc_id, run HAVING max(next_word) - min(word) >= 30
"""
