"""Collocations: phrases of a language whose words occur together more often than alone.

Candidates grow word by word as Apriori has it: a phrase can only be frequent if all shorter phrases in it are. They are put
into double-array tries of bounded size, shared out by their first two words, and the words at a text position go to the one
trie that can hold its phrases; a task advances the states of all positions of a trie at once, word by word, and counts the
accepting states. So texts are read once, however many tries there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, runs, small_batches, table, text_bytes
from quarry.llm.hashing import Spans, grams, mix

LEAST, LONGEST, BEST = 10, 3, 2000
#: Phrases of a trie, about. More candidates make more tries; each is built and used in one task.
PHRASES_PER_TRIE = 1 << 15
#: Bits of the filter of frequent words or phrases: a fixed size, whatever the corpus. A bit that is set by another phrase
#: only lets a needless candidate through.
FILTER_BITS = 26
AT_ONCE = 1 << 19
#: Bits by which documents are told apart when a phrase is named in one of them.
MARK_BITS = 16
#: Phrases that a task remembers to have named; beyond, it begins anew and names some again.
MOST_SHOWN = 1 << 20
#: Bits of a symbol of the tries: with few symbols, states fit between each other.
BITS = 4

#: A to Z in lower case, tab as space, and what ends a piece as a line break.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = 10


@dataclass
class Text:
    """The words of some documents: byte ranges in data, digests (of the language too), the document, and whether the next
    word follows in the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    owner: np.ndarray
    joined: np.ndarray


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _texts(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[tuple[Text, pa.Array]]:
    """Words of all documents in batches (text, lang), some bytes at a time, with the languages of their documents."""
    for batch in batches:
        whole, at = text_bytes(batch.column(0))
        names = batch.column(1).dictionary_encode()
        seeds = np.array([_language(n) for n in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy(zero_copy_only=False)]
        for i, j in runs(at, at_once):
            data, offsets = _FOLD[whole[at[i] : at[j]]], at[i : j + 1] - at[i]
            # a place before the first byte and after the last, so that edges need no care
            word = np.zeros(len(data) + 2, bool)
            word[1:-1] = (data != 10) & (data != 32)
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            start = np.flatnonzero(word[1:] & (~word[:-1] | first))
            end = np.flatnonzero(word[:-1] & (~word[1:] | first))
            owner = np.searchsorted(offsets, start, "right") - 1
            breaks = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == 10)))
            joined = np.zeros(len(start), bool)
            joined[:-1] = (breaks[start[1:]] == breaks[end[:-1]]) & (owner[1:] == owner[:-1])
            yield Text(data, start, end, mix(Spans(data).of(start, end) ^ seeds[owner + i]), owner, joined), batch.column(1).slice(i, j - i)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[places])).cast(pa.string())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for text, langs in _texts(batches, 2 * AT_ONCE):
        digest, at, n = np.unique(text.digest, return_index=True, return_counts=True)
        word = _strings(text.data, text.start[at], text.end[at])
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(text.owner[at])).cast(pa.string()), word, pa.array(digest.view(np.int64)), pa.array(n)], names=["lang", "word", "d", "n"])


def _bit(digest: np.ndarray) -> np.ndarray:
    return digest >> np.uint64(64 - FILTER_BITS)


def _marked_bit(digest: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (digest & np.uint64((1 << FILTER_BITS) - 1)) ^ (mark << np.uint64(FILTER_BITS - MARK_BITS))


def _holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(bits: DataFrame) -> np.ndarray:
    """The bits that are numbered in the column `bit`: at most 2 ** (FILTER_BITS - 6) rows for the driver."""
    found = bits.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _digest_filter(frequent: DataFrame, digest: str) -> np.ndarray:
    return _filter(frequent.select(F.shiftrightunsigned(digest, 64 - FILTER_BITS).alias("bit")))


def _marked_filter(frequent: DataFrame) -> np.ndarray:
    return _filter(frequent.select(F.expr(f"(g & {(1 << FILTER_BITS) - 1}L) ^ shiftleft(mark, {FILTER_BITS - MARK_BITS})").alias("bit")))


def _marks(text: Text) -> np.ndarray:
    """MARK_BITS of a digest of each word's document: the same wherever and whenever the document is read."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text.digest, dtype=np.uint64)))
    first = np.searchsorted(text.owner, text.owner)
    last = np.searchsorted(text.owner, text.owner, "right")
    return mix(sums[last] - sums[first]) >> np.uint64(64 - MARK_BITS)


def _chains(text: Text, n: int, on: np.ndarray) -> np.ndarray:
    """Places at which n words follow each other in a piece, of those that are on."""
    on = on[: max(0, len(text.start) - n + 1)].copy()
    for k in range(n - 1):
        on &= text.joined[k : len(on) + k]
    return np.flatnonzero(on)


def _longer(n: int, bits):  # noqa: ANN001, ANN202  a broadcast; a function of batches
    """Digests of phrases of n words whose two parts of n - 1 words pass the filter, counted, with the mark of a document that
    holds them: (g, mark, n)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, _ in _texts(batches):
            part = _holds(bits.value, _bit(text.digest if n == 2 else grams(text.digest, n - 1)))
            at = _chains(text, n, part[:-1] & part[1:])
            gram, first, times = np.unique(grams(text.digest, n)[at], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(_marks(text)[at[first]].view(np.int64)), pa.array(times)], names=["g", "mark", "n"])

    return grow


def _names(filters):  # noqa: ANN001, ANN202  a broadcast of two filters for each number of words; a function of batches
    """Phrases that pass the filter of their length, in documents with the mark that was kept for them: (g, d), the phrase's
    digest and its words'. So each is named in about one document."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = {n: np.empty(0, np.uint64) for n in filters.value}
        for text, _ in _texts(batches):
            marks = _marks(text)
            for n, (bits, marked) in filters.value.items():
                whole = grams(text.digest, n)
                at = _chains(text, n, _holds(bits, _bit(whole)))
                at = at[_holds(marked, _marked_bit(whole[at], marks[at]))]
                gram, first = np.unique(whole[at], return_index=True)
                fresh = ~np.isin(gram, shown[n], assume_unique=True)
                gram, at = gram[fresh], at[first[fresh]]
                shown[n] = np.concatenate((shown[n] if len(shown[n]) < MOST_SHOWN else shown[n][:0], gram))
                digests = np.stack([text.digest[at + k] for k in range(n)], 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(gram) + 1, dtype=np.int32) * n), pa.array(digests.view(np.int64)))], names=["g", "d"])

    return name


@dataclass
class Trie:
    """A double array: from state s, symbol c leads to base[s] + c if check there is s. Symbols are BITS bits of a word number,
    `width` for a word; words are the sorted digests of the vocabulary, longest the words of the longest phrase, accepts the number
    of the phrase that ends in a state, or -1."""

    words: np.ndarray
    longest: int
    width: int
    root: int
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of `state` that go on with a word, and where they lead."""
        at = np.arange(len(state))
        for k in range(self.width):
            to = self.base[state] + ((word[at] >> (BITS * k)) & ((1 << BITS) - 1))
            on = self.check[to] == state
            at, state = at[on], to[on]
        return at, state

    def count(self, words: list[np.ndarray], size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The occurrences of all phrases at the beginnings of texts of `size` words, words[0] first, each found n times."""
        counts = np.zeros(int(self.accepts.max()) + 1, np.int64)
        place, state = np.arange(len(size)), np.full(len(size), self.root, np.int32)
        for k in range(self.longest):
            on = size[place] > k
            place, state = place[on], state[on]
            number = np.minimum(np.searchsorted(self.words, words[k][place]), len(self.words) - 1)
            known = self.words[number] == words[k][place]
            at, state = self.step(state[known], number[known])
            place = place[known][at]
            end = self.accepts[state]
            np.add.at(counts, end[end >= 0], n[place[end >= 0]])
        return counts


def build_trie(digests: np.ndarray, size: np.ndarray) -> Trie:
    """The trie of phrases: the digests of their words, one phrase after another, and the number of words of each."""
    words, flat = np.unique(digests, return_inverse=True)
    phrases = np.full((len(size), int(size.max())), -1, np.int32)
    phrases[np.arange(phrases.shape[1])[None] < size[:, None]] = flat
    width, symbols = max(1, -(-int(len(words) - 1).bit_length() // BITS)), 1 << BITS
    # nodes level by level: a node for each different beginning; child k is node k + 1
    node, n_nodes, parents, symbol = np.zeros(len(size), np.int64), 1, [], []
    for level in range(phrases.shape[1] * width):
        live = np.flatnonzero(size > level // width)
        chosen = (phrases[live, level // width] >> (BITS * (level % width))) & (symbols - 1)
        fresh, child = np.unique(node[live] * symbols + chosen, return_inverse=True)
        parents.append((fresh // symbols).astype(np.int32))
        symbol.append((fresh % symbols).astype(np.int32))
        node[live] = child + n_nodes
        n_nodes += len(fresh)
    parent, symbol, child = np.concatenate(parents), np.concatenate(symbol), np.arange(1, n_nodes, dtype=np.int32)
    del parents
    base = _placed(parent, symbol, n_nodes)
    slot = np.full(n_nodes, base.max() + symbols, np.int32)
    root = int(slot[0])
    slot[child] = base[parent] + symbol
    out = Trie(words, phrases.shape[1], width, root, np.zeros(root + 1, np.int32), np.full(root + 1, -1, np.int32), np.full(root + 1, -1, np.int32))
    out.base[slot], out.check[slot[child]], out.accepts[slot[node]] = base, slot[parent], np.arange(len(size))
    return out


def _placed(parent: np.ndarray, symbol: np.ndarray, n_nodes: int) -> np.ndarray:
    """A base for each node so that no two children share a place. Nodes with most symbols get places of their own; the others
    are placed between and behind them, those of many children first: many are tried at random at once, and those that
    collide are tried again, with more space after every hundred tries without success."""
    draw, base, symbols = np.random.default_rng(1), np.zeros(n_nodes, np.int32), 1 << BITS
    order = np.argsort(parent, kind="stable")
    parent, symbol = parent[order], symbol[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), parent[1:] != parent[:-1])))
    nodes, degree = parent[first], np.diff(np.append(first, len(parent)))
    full = degree > symbols // 2
    base[nodes[full]] = np.arange(full.sum()) * symbols
    spread, tries = max(512, int(full.sum()) * symbols + 2 * int(degree[~full].sum())), 0
    used = np.zeros(spread + symbols, bool)
    dense = np.repeat(full, degree)
    used[base[parent[dense]] + symbol[dense]] = True
    todo = np.flatnonzero(~full)
    todo = todo[np.argsort(-degree[todo], kind="stable")]
    while len(todo):
        some = todo[: max(1, int(np.searchsorted(np.cumsum(degree[todo]), spread // 8)))]
        length = degree[some]
        of = np.repeat(np.arange(len(some)), length)
        edge = np.arange(len(of)) + np.repeat(first[some] - np.cumsum(length) + length, length)
        slot = draw.integers(0, spread, len(some))[of] + symbol[edge]
        by = np.argsort(slot, kind="stable")
        taken = used[slot]
        taken[by[1:]] |= slot[by[1:]] == slot[by[:-1]]
        lost = np.zeros(len(some), bool)
        lost[of[taken]] = True
        won = ~lost[of]
        used[slot[won]] = True
        base[parent[edge[won]]] = slot[won] - symbol[edge[won]]
        todo = np.concatenate((some[lost], todo[len(some) :]))
        tries = tries + 1 if lost.all() else 0
        if tries == 100:
            used, spread, tries = np.concatenate((used, np.zeros(spread, bool))), 2 * spread, 0
    return base


def _windows(longest: int, filters):  # noqa: ANN001, ANN202  a broadcast of two filters for each number of words; a function of batches
    """The words that follow at each place, as many as may be a candidate, those of a megabyte counted: (size, n, w0, w1, ...). All
    beginnings of a frequent phrase are frequent, so what passes no filter ends it."""

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, _ in _texts(batches, 2 * AT_ONCE):
            size, whole = np.ones(len(text.start), np.int32), text.digest.copy()
            for n in range(2, longest + 1):
                gram = grams(text.digest, n)
                at = _chains(text, n, size == n - 1)
                at = at[_holds(filters.value[n][0], _bit(gram[at]))]
                size[at], whole[at] = n, gram[at]
            at = np.flatnonzero(size > 1)
            _, first, times = np.unique(whole[at], return_index=True, return_counts=True)
            at = at[first]
            words = [pa.array(np.where(size[at] > k, text.digest[np.minimum(at + k, len(text.digest) - 1)], 0).view(np.int64)) for k in range(longest)]
            yield pa.RecordBatch.from_arrays([pa.array(size[at]), pa.array(times), *words], names=["size", "n", *(f"w{k}" for k in range(longest))])

    return window


def _matched(longest: int):  # noqa: ANN202  a function of the phrases (id, d) and the windows of a trie
    def match(phrases: pa.Table, windows: pa.Table) -> pa.Table:
        if not len(phrases) or not len(windows):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        found = phrases.column("d").combine_chunks()
        trie = build_trie(found.flatten().to_numpy().view(np.uint64), pc.list_value_length(found).to_numpy())
        counts = trie.count([windows.column(f"w{k}").to_numpy().view(np.uint64) for k in range(longest)], windows.column("size").to_numpy(), windows.column("n").to_numpy())
        met = np.flatnonzero(counts)
        return pa.table({"id": phrases.column("id").take(pa.array(met)), "n": pa.array(counts[met])})

    return match


def _phrase_counts(rows: DataFrame, candidates: DataFrame, per_trie: int, longest: int, filters) -> DataFrame:  # noqa: ANN001
    """(d, f): occurrences of every candidate (id, g, d). A trie holds the candidates whose first two words fall to its share, and
    the words at all text positions go where their first two fall."""
    shares = max(1, -(-candidates.count() // per_trie))
    share = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(shares)).cast("int").alias("share")
    windows = rows.mapInArrow(_windows(longest, filters), "size int, n long, " + ", ".join(f"w{k} long" for k in range(longest)))
    phrases = candidates.select(share(F.col("d")[0], F.col("d")[1]), "id", "d").repartition(shares, "share")
    sent = windows.select(share(F.col("w0"), F.col("w1")), "*").repartition(shares, "share")
    counted = phrases.groupBy("share").cogroup(sent.groupBy("share")).applyInArrow(_matched(longest), "id long, n long")
    return candidates.select("id", "d").join(counted.withColumnRenamed("n", "f"), "id").select("d", "f")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int | None = BEST, per_trie: int = PHRASES_PER_TRIE
) -> DataFrame:
    """The best phrases of 2 to `longest` words of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are cut at .,;:!? and line breaks into pieces, and these at spaces and tabs into words, A to Z in lower case. A
    phrase is a candidate with a >= least occurrences, overlaps included; l and r count the two parts of the cut with the
    least score floor(1000000 a a / (l r)), the first of equal ones; n counts all words of the language. A candidate is
    dropped if a longer one holds it and occurs half as often or more. rank goes by score and a, greatest first, then by
    phrase; best=None returns all.

    Null and empty texts have no words; a null language is `und`; repeated rows count each; other columns are left out; an
    empty table gives an empty result. Words are known by 64-bit digests of word and language.

    Every level reads the texts once and exchanges only phrases whose parts pass a filter of fixed size. Tries hold about
    per_trie phrases, so a task's memory is bounded; their number grows with the candidates, the readings of the texts do not:
    one reading sends each position's words to the one trie that can hold them. The tables made on the way are deleted when
    the result has been written.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    words = scratch.written(rows.mapInArrow(_words, "lang string, word string, d long, n long").groupBy("lang", "word").agg(F.first("d").alias("d"), F.sum("n").alias("f")))
    frequent = words.where(F.col("f") >= least)
    bits, filters, levels = _digest_filter(frequent, "d"), {}, []
    for n in range(2, longest + 1):
        counts = rows.mapInArrow(_longer(n, spark.sparkContext.broadcast(bits)), "g long, mark long, n long").groupBy("g").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))
        levels.append(scratch.written(counts.where(F.col("n") >= least).select("g", "mark")))
        bits = _digest_filter(levels[-1], "g")
        filters[n] = bits, _marked_filter(levels[-1])
    # far more phrases are counted than turn out frequent, so they are counted by digest and only the frequent ones are named
    sent = spark.sparkContext.broadcast(filters)
    named = rows.mapInArrow(_names(sent), "g long, d array<bigint>").distinct()
    candidates = named.join(reduce(DataFrame.unionByName, levels).select("g"), "g", "left_semi")
    candidates = scratch.written(candidates.withColumn("id", F.monotonically_increasing_id()))
    counted = scratch.written(_phrase_counts(rows, candidates, per_trie, longest, sent).where(F.col("f") >= least))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    out = scratch.written(_scored(counted, frequent, totals, best))
    scratch.paths.pop()
    scratch.drop()
    return out


def _scored(counted: DataFrame, frequent: DataFrame, totals: DataFrame, best: int | None) -> DataFrame:
    parts = counted.select("d", "f", F.lit(None).cast("string").alias("lang")).unionByName(frequent.select(F.array("d").alias("d"), "f", "lang"))
    cuts = counted.select("d", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("d") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(d, 1, k)")).withColumn("right", F.expr("slice(d, k + 1, size(d) - k)"))
    # the cut after the first word brings the language
    cuts = cuts.join(parts.select(F.col("d").alias("left"), F.col("f").alias("l"), "lang"), "left").join(parts.select(F.col("d").alias("right"), F.col("f").alias("r")), "right")
    # a is at most l and r, so the quotient is at most 1,000,000; decimals of 38 digits hold the products of counts below 10^16
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("1000000BD * wide.a * wide.a div (wide.l * wide.r)").cast("long")
    cuts = cuts.withColumn("wide", F.struct(*(c.alias(k) for k, c in wide.items()))).withColumn("score", score)
    lowest = cuts.groupBy("d", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"), F.max("lang").alias("lang"))
    inner = F.expr("flatten(transform(sequence(2, size(d) - 1), n -> transform(sequence(1, size(d) - n + 1), i -> slice(d, i, n))))")
    over = counted.where(F.size("d") > 2).select("f", F.explode(inner).alias("d")).groupBy("d").agg(F.max("f").alias("longer"))
    kept = lowest.join(over, "d", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).select("lang", "d", "a", "cut.*")
    if best is not None:  # with all that tie with the last, so that only these need their words
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        kept = kept.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= best).drop("_rank")
    named = kept.select("*", F.posexplode("d").alias("place", "one")).join(frequent.select(F.col("d").alias("one"), "lang", "word"), ["one", "lang"])
    whole = named.groupBy("d", "a", "l", "r", "score", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = whole.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    ranked = ranked if best is None else ranked.where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH ps AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), ws AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM ps
), places AS (
  SELECT lang, id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM ws
), three AS (
  SELECT lang, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM places WINDOW p AS (PARTITION BY id ORDER BY i)
), counts AS (
  SELECT lang, 1 AS k, a AS phrase, count(*)::HUGEINT AS f FROM three GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM three WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM three WHERE c IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, t.cut, l.f AS l, r.f AS r, 1000000 * c.a * c.a // (l.f * r.f) AS score
  FROM candidates c JOIN (VALUES (1), (2)) AS t(cut) ON t.cut < c.k
  JOIN counts l ON l.lang = c.lang AND l.k = t.cut AND l.phrase = array_to_string(c.w[1 : t.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - t.cut AND r.phrase = array_to_string(c.w[t.cut + 1 : c.k], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase AND s.k = 2
  WHERE g.a IS NULL OR 100 * g.a < 50 * s.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
