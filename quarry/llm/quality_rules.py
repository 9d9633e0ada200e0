"""Quality rules as a ledger of failure bits: each rule is evaluated once, policies and ablations are bit arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, table, words

WINDOW = 8

#: Name of each rule and when a document fails it, over the measurements; the bit is the place in this list.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("some_symbols", "10 * n_symbols > n_words"),
    ("some_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("one_line", "n_lines < 2"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A version of what is required: the rules a document must not fail, and how many others it may fail."""

    version: str
    required: int
    counted: int = 0
    most_counted: int = 0

    def keeps(self, bits: Column) -> Column:
        return (bits.bitwiseAND(F.lit(self.required)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(self.counted))) <= self.most_counted)


POLICIES = (
    Policy("v1", BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"] | BIT["short_words"]),
    Policy("v2", BASE | BIT["symbols"] | BIT["repeated_lines"], BIT["some_symbols"] | BIT["some_repeated_lines"] | BIT["one_line"] | BIT["long_words"] | BIT["short_words"], 1),
)


def _covered(starts: Column) -> Column:
    """Words under windows that begin at these sorted places."""
    return F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(WINDOW).cast("long"), lambda n, k: n + F.least(F.lit(WINDOW), starts[k] - starts[k - 1]))


def _starts_of_repeats(windows: Column) -> Column:
    """Sorted places of the window digests that occur twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return let(
        pairs,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))),
                lambda e: e["i"],
            )
        ),
    )


def repeated_words(tokens: Column) -> Column:
    """Number of words in 8-word windows that occur twice or more, by 64-bit window digests."""
    digests = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = let(digests, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    counted = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(_starts_of_repeats(w), _covered)),
    )
    return F.when(F.size(tokens) <= WINDOW, F.lit(0).cast("long")).otherwise(counted)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `measured`. A null text has no words and one empty line; no row is dropped or merged."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return docs.withColumn(
        "measured",
        let(
            words(F.col(text)),
            lambda w: let(
                lines,
                lambda found: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    (F.char_length(body) - F.char_length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                    F.size(found).cast("long").alias("n_lines"),
                    (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
                    repeated_words(w).alias("n_repeat_words"),
                ),
            ),
        ),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `measured` and `failed_bits`, every rule evaluated once.

    Null and empty texts have no words and so fail few_words. Repeated rows each keep their row, extra columns pass
    through, an empty table gives an empty ledger. Columns of docs named measured or failed_bits are replaced.
    """
    measured = measure(docs, text)
    bits = [F.when(F.expr(rule.replace("n_", "measured.n_").replace("word_chars", "measured.word_chars")), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total.cast("long"))


def apply_policy(entries: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    return entries.withColumn(name, policy.keeps(F.col("failed_bits")))


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each rule it requires: documents kept, and kept if that rule were left out.

    The ledger is first counted by bit pattern, of which there are at most 2 ** len(RULES).
    """
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    bits = F.col("failed_bits")
    sums, rows = [F.sum("n").alias("documents")], []
    for p in policies:
        sums.append(F.sum(F.when(p.keeps(bits), F.col("n")).otherwise(0)).alias(f"{p.version}_all"))
        for name, bit in BIT.items():
            if p.required & bit:
                without = Policy(p.version, p.required & ~bit, p.counted, p.most_counted)
                sums.append(F.sum(F.when(without.keeps(bits), F.col("n")).otherwise(0)).alias(f"{p.version}_{name}"))
                rows.append(F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.coalesce(F.col(f"{p.version}_all"), F.lit(0)).alias("kept"), F.coalesce(F.col(f"{p.version}_{name}"), F.lit(0)).alias("kept_without")))
    return patterns.agg(*sums).select(F.inline(F.array(*rows)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy v1 for every document."""
    entries = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), POLICIES[0])
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return entries.select("doc_id", *(F.col(f"measured.{m}").alias(m) for m in measured), (F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failed_bits")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeats, range(8) AS offs(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (2 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars > 15 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT
    + 64 * (10 * n_symbols > n_words)::INT + 128 * (10 * n_dup_lines > 3 * n_lines)::INT + 256 * (n_lines < 2)::INT)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) != 0 AS base_failed,
       (failed_bits & 63) = 0 AS kept, failed_bits
FROM bits
"""
