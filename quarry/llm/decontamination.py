"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, and exact verification.

For each length of a benchmark item, every window of a document that has as many words (the whole document if it has fewer) gets a 64-bit SimHash of its
five-word shingles, each weighted by its occurrences. The multi-index cuts fingerprints into blocks: two fingerprints
within the radius differ by at most radius // BLOCKS in some block, so looking up each block's neighbourhood finds all of
them. Candidates within the radius are verified by the weighted similarity of their shingles.

A window without any shingle of the benchmark has similarity 0 with every item, so it is not fingerprinted; nothing that
verification could keep is lost by that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import runs, small_batches, table, text_bytes, without, written
from quarry.llm.hashing import grams, split_words

#: Words of a shingle; a window matches an item if 100 times the weight of what they share is at least 75 times that of what either has.
SHINGLE, SIMILAR, DIFFERENT = 5, 75, 100
#: Hamming radius and blocks of the multi-index. At similarity 0.75 fingerprints differ by 11 of 64 bits with a standard deviation of 3.
RADIUS, BLOCKS = 22, 8
#: Words of benchmark that are held by a task at once; a larger benchmark is taken in slices.
SLICE_WORDS = 500_000
AT_ONCE = 1 << 18

_BITS = 64 // BLOCKS
_LANES = [np.uint64(k) for k in range(8)]
_ONES = np.uint64(0x0101010101010101)


def simhash(shingles: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each of the given places on: bit b is set if at least half of them have it.

    Counts of eight bits lie in the bytes of one integer, so eight running sums hold all 64 counts. Runs of over 127
    shingles are summed in parts of 127 or fewer.
    """
    out = np.zeros(len(first), np.uint64)
    for lane in _LANES:
        bits = (shingles >> lane) & _ONES
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bits, dtype=np.uint64)))
        if n <= 127:
            count = total[first + n] - total[first]
            over = (count + _ONES * np.uint64(128 - (n + 1) // 2)) & (_ONES << np.uint64(7))
            out |= over >> (np.uint64(7) - lane)
        else:
            counts = np.zeros((len(first), 8), np.int64)
            for a in range(0, n, 127):
                part = total[first + min(n, a + 127)] - total[first + a]
                counts += part.view(np.uint8).reshape(-1, 8)
            for byte in range(8):
                out |= (2 * counts[:, byte] >= n).astype(np.uint64) << np.uint64(8 * byte + int(lane))
    return out


@dataclass
class Index:
    """Items of one length: their fingerprints, and for each block and value there the items with a near one."""

    items: np.ndarray
    prints: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, items: list[int], prints: np.ndarray, radius: int = RADIUS) -> Index:
        values = np.arange(1 << _BITS)
        flips = np.array([sum(1 << b for b in bits) for e in range(radius // BLOCKS + 1) for bits in itertools.combinations(range(_BITS), e)])
        close = np.zeros((1 << _BITS, 1 << _BITS), bool)
        close[values[:, None], values[:, None] ^ flips[None, :]] = True
        return cls(np.array(items), prints, np.stack([close[:, _block(prints, k)] for k in range(BLOCKS)]))

    def within(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of prints, row of items) within the radius."""
        likely = self.near[0][_block(prints, 0)]
        for k in range(1, BLOCKS):
            likely |= self.near[k][_block(prints, k)]
        rows, items = np.nonzero(likely)
        right = np.bitwise_count(prints[rows] ^ self.prints[items]) <= radius
        return rows[right], items[right]


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    return ((prints >> np.uint64(k * _BITS)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _similar(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Weight in common and of the union of two runs of shingles, each weighted by its occurrences."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common, len(a) + len(b) - common


class _Benchmark:
    """Items of a slice as shingles, by number of words."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.shingles: list[np.ndarray] = []
        self.ids: list[int] = []
        self.words: list[int] = []
        for item, text in rows:
            data = np.frombuffer(text.encode(), np.uint8)
            words = split_words(data, np.array([0, len(data)]), lower=True)
            if len(words.digest):
                self.ids.append(item)
                self.words.append(len(words.digest))
                self.shingles.append(grams(words.digest, min(SHINGLE, len(words.digest))))
        self.lengths: dict[int, Index] = {}
        for n in sorted(set(self.words)):
            at = [i for i, w in enumerate(self.words) if w == n]
            size = len(self.shingles[at[0]])
            joined = np.concatenate([self.shingles[i] for i in at])
            self.lengths[n] = Index.of(at, simhash(joined, np.arange(len(at)) * size, size))
        # a window can only match an item that it shares a shingle with, so each shingle leads to the lengths of its items
        self.lengths_of: dict[int, tuple[int, ...]] = {}
        for shingles, n in zip(self.shingles, self.words, strict=True):
            for x in set(shingles.tolist()):
                if n not in self.lengths_of.get(x, ()):
                    self.lengths_of[x] = (*self.lengths_of.get(x, ()), n)
        self.known = {k: np.unique(np.concatenate(parts)) for k in range(1, SHINGLE + 1) if (parts := [s for s, w in zip(self.shingles, self.words, strict=True) if min(SHINGLE, w) == k])}
        self.filter = {k: np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for k, v in self.known.items()}

    def shared(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """Places of shingles that some item has."""
        likely = np.flatnonzero(self.filter[k][(shingles >> np.uint64(44)).astype(np.int64)])
        return likely[np.isin(shingles[likely], self.known[k])]

    def matches(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, first word, words, weight in common, weight of the union) of the best window for each item of a document."""
        places: dict[int, list[int]] = {}
        for place, shingle in zip(hits.tolist(), shingles[hits].tolist(), strict=True):
            for n in self.lengths_of[shingle]:
                places.setdefault(n, []).append(place)
        for n, own in places.items():
            if min(SHINGLE, n) != k:
                continue
            # a document of fewer words than the item is its own only window
            index, size, hits = self.lengths[n], min(n, n_words) - k + 1, np.array(own)
            # windows over a shingle that they share with an item of their length
            begin = np.unique((hits[:, None] - np.arange(size)[None, :]).ravel()) if len(hits) * size < 4 * len(shingles) else np.arange(len(shingles))
            begin = begin[(begin >= 0) & (begin + size <= len(shingles))]
            if not len(begin):
                continue
            rows, items = index.within(simhash(shingles, begin, size))
            best: dict[int, tuple[int, int, int]] = {}
            for r, i in zip(begin[rows].tolist(), index.items[items].tolist(), strict=True):
                common, union = _similar(shingles[r : r + size], self.shingles[i])
                if DIFFERENT * common >= SIMILAR * union and (i not in best or common * best[i][2] > best[i][1] * union):
                    best[i] = r, common, union
            for i, (r, common, union) in best.items():
                yield self.ids[i], r, min(n, n_words), common, union


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of a document for each item it leaks.

    A window has as many words as the item, or is the whole document if that has fewer words; words and case as for near duplicates, and matches at a weighted similarity of
    0.75 or more; ties go to the earliest window. Items of fewer than five words are one shingle and match where they
    occur. Items and documents that are null or have no word match nothing. Repeated documents and items give a row each;
    items are told apart by item_id, so equal texts under two ids give two rows. Null ids are carried through. Extra
    columns are left out. An empty benchmark or table gives an empty result.

    The benchmark goes to the tasks in slices of at most slice_words words (an item of more is a slice of its own), each
    read in order of item_id; the documents are read once for each slice.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    sized = items.withColumn("words", F.size(F.split("text", r"[\x20\x09-\x0D]+")))
    slices = max(1, -(-int(sized.agg(F.sum("words")).first()[0] or 0) // slice_words))
    numbered = sized.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    small_batches(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    found = []
    for k in range(slices):
        part = numbered.where(F.col("slice") == k).select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
        known = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])
        found.append(rows.mapInArrow(_searcher(known), schema))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "similarity", "first_word", "n_words")


def _searcher(known):  # noqa: ANN001, ANN202  a broadcast value, and a function of batches
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Benchmark(known.value)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            ids = batch.column(1)
            out: list[tuple] = []
            for i, j in runs(at, AT_ONCE):
                words = split_words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True)
                for k in held.known:
                    shingles = grams(words.digest, k)
                    hits = held.shared(shingles, k) if len(shingles) else np.empty(0, np.int64)
                    owner = np.searchsorted(words.first, hits, "right") - 1
                    for d in np.unique(owner).tolist():
                        a, b = int(words.first[d]), int(words.first[d + 1])
                        own = hits[owner == d]
                        own = own[own + k <= b] - a
                        if len(own):
                            for item, first, n, common, union in held.matches(shingles[a : b - k + 1], own, b - a, k):
                                out.append((ids[i + d].as_py(), item, common / union, first, n))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return search


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) without the documents that leak an item. Rows of one doc_id go together;
    rows with a null doc_id can't be told apart by it and stay. Repeated rows stay or go together; extra columns are kept whatever
    their names; an empty table gives an empty result. The texts aren't shuffled unless the ids that go are very many."""
    leaks = written(find_leaks(docs, benchmark).select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct())
    return without(docs, leaks)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and where."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, words, len(words) AS m FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents)
), b AS (
  SELECT item_id, words, len(words) AS n, least(len(words), 5) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM benchmark) WHERE len(words) > 0
), bw AS (
  SELECT item_id, n, k, gram, count(*) AS w FROM (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS gram FROM b) GROUP BY ALL
), ds AS (
  SELECT doc_id, m, k, i, array_to_string(words[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, words, m, k, unnest(range(1, m - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE m >= k)
), hits AS (
  SELECT doc_id, m, i, item_id, n, least(n, m) AS size, k, gram, w FROM ds JOIN bw USING (k, gram)
), begins AS (
  SELECT DISTINCT doc_id, item_id, n, size, k, unnest(range(greatest(1, i - size + k), least(i, m - size + 1) + 1)) AS f FROM hits
), common AS (
  SELECT doc_id, item_id, n, size, k, f, sum(least(c, w)) AS common FROM (
    SELECT doc_id, item_id, begins.n AS n, begins.size AS size, begins.k AS k, f, gram, w, count(*) AS c FROM begins JOIN hits USING (doc_id, item_id) WHERE i BETWEEN f AND f + begins.size - begins.k GROUP BY ALL
  ) GROUP BY ALL
), alike AS (
  SELECT *, (n - k + 1) + (size - k + 1) - common AS whole FROM common
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common DESC, f) AS place FROM alike WHERE 100 * common >= 75 * whole
)
SELECT doc_id, item_id, common / whole AS similarity, (f - 1)::BIGINT AS first_word, size::BIGINT AS n_words FROM best WHERE place = 1
"""
