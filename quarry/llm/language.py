"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import table, text_bytes, written

#: n-grams of one to so many characters, and how many of the most frequent make a profile.
LONGEST, PROFILE = 3, 400
#: Documents up to this many characters are counted by sorting, longer ones by direct addressing.
SORTED_CHARS, LEAST_CELLS = 4096, 8
#: Grams that a task counts before it gives them out.
MOST_HELD = 2_000_000
#: An edge of a word: every run of characters that are not letters.
EDGE = 32


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, EDGE for everything else."""
    out = np.full(0x10000, EDGE, np.uint32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


_TABLE: list[np.ndarray] = []


def _stream(raw: bytes) -> np.ndarray:
    """Letters of a text as lower-case code points, words parted and surrounded by one EDGE; empty without letters.
    Letters beyond the basic plane count as themselves, so scripts there are told apart too."""
    if not _TABLE:
        _TABLE.append(_letters())
    if raw.isascii():
        codes = _TABLE[0][np.frombuffer(raw, np.uint8)]
    else:
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes = _TABLE[0][np.minimum(points, 0xFFFF)]
        far = points > 0xFFFF
        if far.any():
            codes[far] = [c if chr(c).isalpha() else EDGE for c in points[far].tolist()]
    codes = np.concatenate(([EDGE], codes, [EDGE])).astype(np.uint32)
    edge = codes == EDGE
    keep = ~(edge[1:] & edge[:-1])
    return codes[1:][keep] if not edge[0] else np.concatenate(([EDGE], codes[1:][keep])) if keep.any() and not edge.all() else np.empty(0, np.uint32)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a character, and their counts; the lone edge and grams across an edge are none."""
    alphabet, at = np.unique(codes, return_inverse=True)
    size, edge = len(alphabet), int(np.searchsorted(alphabet, EDGE))
    inside = at != edge
    packed, counts = [], []
    key = at.astype(np.int64)
    for n in range(1, LONGEST + 1):
        if n > 1:
            key = key[:-1] * size + at[n - 1 :]
        # an edge may only begin or end a gram
        good = np.ones(len(key), bool) if n > 1 else inside
        for k in range(1, n - 1):
            good &= inside[k : k + len(key)]
        found = key[good]
        if size**n <= max(LEAST_CELLS * len(found), SORTED_CHARS):
            tally = np.bincount(found)
            distinct = np.flatnonzero(tally)
            number = tally[distinct]
        else:
            distinct, number = np.unique(found, return_counts=True)
        out, rest = np.zeros(len(distinct), np.int64), distinct
        for k in range(n):
            out |= (alphabet[rest % size].astype(np.int64) + 1) << (21 * k)
            rest = rest // size
        packed.append(out)
        counts.append(number)
    return np.concatenate(packed), np.concatenate(counts)


def _top(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent grams, ties by packed value."""
    if len(counts) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts by language of each task, merged as they come, and given out whenever they are more than MOST_HELD."""
    merged: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if lang in merged:
            parts.append(merged[lang])
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        merged[lang] = grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in merged.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(counts)})
        merged.clear()

    for batch in batches:
        data, at = text_bytes(batch.column(0))
        held: dict[str, list] = {}
        for i, lang in enumerate(batch.column(1).to_pylist()):
            codes = _stream(data[at[i] : at[i + 1]].tobytes())
            if len(codes):
                held.setdefault(lang, []).append(_grams(codes))
                if len(held[lang]) == 256:
                    add(lang, held.pop(lang))
        for lang, parts in held.items():
            add(lang, parts)
        if sum(len(grams) for grams, _ in merged.values()) > MOST_HELD:
            yield from emptied()
    yield from emptied()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, place) of the languages of a labelled table: the `size` most frequent n-grams of each, by
    rank from 0, ties by gram. Counts cover every row with a language. Null and empty texts add nothing."""
    rows = labelled.select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a plain row_number() <= size is cut within each task before a language's grams meet
    return counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select("lang", "gram", (F.col("nth") - 1).alias("place"))


def _profiles(rows: list, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted distinct grams, and the place of each gram in each profile (size if it isn't there)."""
    langs = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
    places = np.full((len(langs), len(grams) + 1), size, np.int32)
    for r in rows:
        places[langs.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["place"]
    return langs, grams, places


def _ranked(size: int):  # noqa: ANN202  a function of batches
    """(at, gram, nth, own): the ranks of each document's most frequent grams, and how many it has."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for i, row in enumerate(batch.column(1).to_pylist()):
                codes = _stream(data[at[i] : at[i + 1]].tobytes())
                if len(codes):
                    own = _top(*_grams(codes), size)
                    numbers = [np.full(len(own), row), own.astype(np.int64), np.arange(len(own)), np.full(len(own), len(own))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in numbers], names=["at", "gram", "nth", "own"])

    return ranked


def _joined(docs: DataFrame, profiles: DataFrame, text: str, size: int) -> DataFrame:
    """docs with lang_pred and score as predict() gives them, by a join on grams: for more languages than tasks can hold."""
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    grams = rows.select(F.col("row")[text].alias("text"), "at").mapInArrow(_ranked(size), "at long, gram long, nth long, own long")
    near = F.lit(size) - F.least(F.abs(F.col("place") - F.col("nth")), F.lit(size))
    # a language without any of a document's grams is at the greatest distance; the first of all stands for these
    first = profiles.agg(F.min("lang").alias("lang"))
    gains = grams.join(profiles.select("lang", F.col("gram").cast("long").alias("gram"), "place"), "gram").groupBy("at", "lang", "own").agg(F.sum(near).alias("gain"))
    none = grams.select("at", "own").distinct().join(F.broadcast(first), F.lit(True)).select("at", "lang", "own", F.lit(0).cast("long").alias("gain"))
    best = gains.unionByName(none).groupBy("at", "own").agg(F.max(F.struct("gain")).alias("top"), F.min_by("lang", F.struct(-F.col("gain"), "lang")).alias("lang"))
    found = rows.join(best, "at", "left")
    score = F.when(F.col("lang").isNull(), 0.0).otherwise(1 - (F.col("own") * size - F.col("top.gain")).cast("double") / (F.col("own") * size))
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE, most_held: int = 2_000) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    A document's most frequent n-grams are ranked like a profile; the out-of-place distance to a language sums, over
    them, how far each stands from its place there, `size` at most and where it is missing. The nearest language wins,
    ties by name. score is 1 minus the mean distance over `size`. Texts that are null or have no letter get und and 0,
    as all do if there is no profile. Rows map one to one, repeated ones too. Profiles are languages x size rows, so
    they go to the tasks as a broadcast value if they are no more than most_held languages have; of more languages they are
    joined with the documents' n-grams, with the same result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = profiles.limit(most_held * size + 1).collect()
    if len(rows) > most_held * size:
        return _joined(docs.select(*kept), profiles, text, size)
    known = docs.sparkSession.sparkContext.broadcast(_profiles(rows, size))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    place = kept.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, places = known.value
        for batch in batches:
            data, at = text_bytes(batch.column(place))
            found, scores = [], []
            for i in range(batch.num_rows):
                codes = _stream(data[at[i] : at[i + 1]].tobytes())
                if not len(codes) or not langs:
                    found.append("und")
                    scores.append(0.0)
                    continue
                own = _top(*_grams(codes), size)
                where = np.searchsorted(grams, own)
                where[where == len(grams)] = 0
                where = np.where(grams[where] == own, where, len(grams))
                away = np.minimum(np.abs(places[:, where] - np.arange(len(own))), size)
                away[places[:, where] == size] = size
                total = away.sum(axis=1)
                best = int(total.argmin())
                found.append(langs[best])
                scores.append(1.0 - float(total[best]) / (len(own) * size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*kept).mapInArrow(scored, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of an id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    profiles = learn(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
