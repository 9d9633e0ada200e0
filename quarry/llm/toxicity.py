"""Toxicity by a noisy channel: tokens that look disguised are restored, then words are scored.

A token that holds a sign or a repeated letter, or a run of letters spaced out, is a lattice of what each sign may stand
for; spaces and punctuation are part of it and are read as nothing or as a break between words. Viterbi decoding picks the
path that a character trigram model of the corpus and the channel make likeliest. Restored and plain words are then looked up in a lexicon learned from labelled rows, and a logistic model
of what was found gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.samples import bounded
from quarry.llm.common import cut, runs, small, small_batches, table, text_bytes, written
from quarry.llm.hashing import grams, split_words
from quarry.llm.language import held_out

# What a sign may stand for, with the channel's log probability of that reading.
READINGS: dict[str, tuple[tuple[str, float], ...]] = {
    "0": (("o", -0.1), ("", -9.0)),
    "1": (("i", -0.6), ("l", -0.9), ("", -9.0)),
    "2": (("z", -1.5), ("", -6.0)),
    "3": (("e", -0.1), ("", -9.0)),
    "4": (("a", -0.1), ("", -9.0)),
    "5": (("s", -0.1), ("", -9.0)),
    "6": (("g", -0.7), ("b", -1.2), ("", -9.0)),
    "7": (("t", -0.1), ("", -9.0)),
    "8": (("b", -0.1), ("", -9.0)),
    "9": (("g", -0.3), ("", -9.0)),
    "@": (("a", -0.1), ("", -9.0)),
    "$": (("s", -0.1), ("", -6.0)),
    "!": (("i", -0.4), ("l", -1.5), ("", -6.0)),
    "|": (("i", -0.7), ("l", -0.7), ("", -6.0)),
    "+": (("t", -0.2), ("", -6.0)),
    "(": (("c", -0.2), ("", -6.0)),
    "*": (("", -0.7), ("i", -2.0), ("u", -2.0), ("a", -2.0), ("o", -2.0), ("e", -2.0)),
    "#": (("", -0.7), ("h", -2.0)),
}
#: Signs that stand for nothing or for a break between words, and the blank between spaced letters. A break is " ".
SEPARATORS = "._-~^`'\"/\\,:;?%&=()[]{}<>"
READINGS |= {c: (("", -0.1), (" ", -0.5)) for c in SEPARATORS if c not in READINGS}
READINGS |= {" ": (("", 0.0), (" ", -0.5))}
#: A sign at the edge of a token may also be punctuation, and a letter or sign that is there twice may stand for one.
AT_EDGE, DOUBLED = ("", -0.7), -1.0

#: Letters beyond a to z are one symbol of the model; 0 is the edge of a word.
OTHER, SYMBOLS = 27, 28
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = OTHER
#: Bytes as they are matched: A to Z in lower case, ASCII that is neither letter nor digit as a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

#: Letters, digits and signs that a run of spaced letters has at least.
LEAST_SPACED = 3
#: What is stripped from tokens before they are looked at: separators without a reading as a letter.
_AROUND = "".join(c for c in SEPARATORS if c != "(").encode()
_SIGN, _LETTER, _TWICE = re.compile(rb"[^A-Za-z\x80-\xff]"), re.compile(rb"[A-Za-z\x80-\xff]"), re.compile(rb"([a-z])\1", re.I)
_PUNCTUATION = set(SEPARATORS) - {"("}
#: The same by byte, for whole batches: white space as split() takes it, what is stripped, letters, and lower case.
_BYTES = [bytes([c]) for c in range(256)]
_SPACE, _STRIPPED = (np.array([test(c) for c in _BYTES]) for test in (bytes.isspace, lambda c: c.isspace() or c in _AROUND))
_ASCII_LETTER, _ALNUM, _LOWER = np.array([c.isalpha() for c in _BYTES]), np.array([c.isalnum() for c in _BYTES]), np.frombuffer(bytes(range(256)).lower(), np.uint8)
_ANY_LETTER = _ASCII_LETTER | (np.arange(256) >= 128)

#: Labelled rows that the logistic model of three features is fitted on, at most.
MOST_FITTED = 50_000
#: Words of a lexicon that is broadcast, at most; a larger one is joined.
MOST_HELD = 200_000
#: Longest token, in bytes, whose reading is remembered; tokens, and decoded ones, that are remembered at once.
REMEMBERED, DECODED = 64, 20_000
#: Bytes of texts whose tokens are told apart at once.
AT_ONCE = 1 << 16
#: Words that a task counts before it gives them out.
MOST_COUNTED = 60_000


#: A reading as text, log probability and symbols.
Reading = tuple[str, float, tuple[int, ...]]
_STATES = SYMBOLS * SYMBOLS


def _reading(letters: str, cost: float) -> Reading:
    return letters, cost, tuple(0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else OTHER for c in letters)


_OTHERS = lru_cache(4096)(lambda c: (_reading(c, 0.0),))
_SIGNS = {c: tuple(_reading(*x) for x in readings) for c, readings in READINGS.items()}
#: Where there is a choice: a sign, or what is there twice or more.
_UNSURE = re.compile("(?:" + "|".join(map(re.escape, READINGS)) + r")+|(.)\1+", re.S)
_LETTERS = {chr(c): (_reading(chr(c), 0.0),) for c in range(97, 123)}
#: What read() says of a token that is one plain word.
_NOTHING: tuple[int, list[bytes]] = 0, []


class CharacterModel:
    """Interpolated trigram log probabilities of the symbols of words."""

    def __init__(self, counts: np.ndarray) -> None:
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = cube.sum((0, 1)) + 1.0
        one /= one.sum()
        pairs = cube.sum(0)
        two = (pairs + 5.0 * one[None, :]) / (pairs.sum(1, keepdims=True) + 5.0)
        three = (cube + 5.0 * two[None, :, :]) / (cube.sum(2, keepdims=True) + 5.0)
        # by state (the last two symbols) and next symbol; 2.5 is about what a letter costs, so that dropping one gains nothing
        log = np.log(three)
        log[:, :, 1:] += 2.5
        self.log = log.ravel().tolist()
        # by the symbols before, of, and behind a letter that is there twice: whether two are likelier than one, by a margin for
        # rounding. Such choices don't touch each other, as each is in the trigrams that end in the second letter and next to it
        same = np.arange(SYMBOLS)
        self.stays = (log[:, same, same][:, :, None] + log[same, same, :][None, :, :] - log > DOUBLED + 1e-9).ravel()

    def restore(self, token: str, fold: bool = True) -> str:
        """The likeliest word or words behind a token or a spaced run, letters a to z and whatever else has no reading as it
        is. fold: what is there twice may stand for one, and signs at the edges for nothing."""
        low = token.lower()
        unsure = [m.span() for m in _UNSURE.finditer(low)]
        if not unsure:
            return low
        # letters before the first choice give its context, and two behind the last one make all ways one again
        begin, close = unsure[0][0], min(len(low), unsure[-1][1] + 2)
        steps: list[tuple[Reading, ...]] = []
        i, start = begin, 0
        for c in low[max(0, begin - 2) : begin]:
            start = start * SYMBOLS + (_LETTERS.get(c) or _OTHERS(c))[0][2][0]
        while i < close:
            c, j = low[i], i + 1
            while j < len(low) and low[j] == c:
                j += 1
            run = j - i
            if c in _SIGNS:
                readings = _SIGNS[c]
                if fold and c not in _PUNCTUATION and c != " " and not c.isdigit() and (low[i - 1 : i] in ("", " ")) != (low[j : j + 1] in ("", " ")):
                    readings = (*readings, _reading(*AT_EDGE))
                steps.append(readings)
                if run > 1 and c != " ":
                    steps.append((*readings, _reading("", DOUBLED)) if fold else readings)
            elif run >= 3:  # a stretched letter stands for one or two
                steps.append((_reading(c, -0.3), _reading(c + c, -1.5)))
            elif run == 2:
                steps.append((_reading(c + c, 0.0), _reading(c, DOUBLED)) if fold else (_reading(c + c, 0.0),))
            else:
                steps.append(_LETTERS.get(c) or _OTHERS(c))
            i = j
        # each state keeps its best score and the way to it, a list from its end
        log = self.log
        best: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
        for step in steps:
            after: dict[int, tuple[float, tuple | None]] = {}
            if len(step) == 1 and step[0][0] in _LETTERS:  # as below, for the letters that most steps are
                letters, x = step[0][0], step[0][2][0]
                for state, (score, way) in best.items():
                    at = state * SYMBOLS + x
                    total = score + log[at]
                    at %= _STATES
                    if at not in after or total > after[at][0]:
                        after[at] = total, (way, letters)
                best = after
                continue
            for state, (score, way) in best.items():
                for letters, cost, symbols in step:
                    at, total = state, score + cost
                    for x in symbols:
                        if x:
                            at = at * SYMBOLS + x
                            total += log[at]
                            at %= _STATES
                        elif at:
                            total += log[at * SYMBOLS]
                            at = 0
                    if at not in after or total > after[at][0]:
                        after[at] = total, ((way, letters) if letters else way)
            best = after
        way = max(((score + (log[at * SYMBOLS] if at and close == len(low) else 0.0), k, way) for k, (at, (score, way)) in enumerate(best.items())), default=(0.0, 0, None))[2]
        out: list[str] = []
        while way:
            way, letters = way
            out.append(letters)
        return low[:begin] + "".join(reversed(out)) + low[close:]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        for i, j in runs(at, 1 << 18):
            plain = np.frombuffer(b" " + b"  ".join(data[at[k] : at[k + 1]].tobytes().translate(PLAIN) for k in range(i, j)) + b" ", np.uint8)
            # two edges before each word, so its first letters have a context of their own
            edge = plain == 32
            code = _SYMBOL[plain[~(edge & np.concatenate(([False], edge[:-1])))]].astype(np.int64)
            code = np.insert(code, np.flatnonzero(code == 0), 0)
            if len(code) > 2:
                total += np.bincount(code[:-2] * SYMBOLS**2 + code[1:-1] * SYMBOLS + code[2:], minlength=SYMBOLS**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(some), "n": pa.array(total[some])})


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): character trigrams of the words of all documents, 28 ** 3 rows at most."""
    return docs.select(text).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class _Recent(dict):
    """What was looked up last, DECODED entries at most: the newer half, and the older one that it replaced."""

    def __init__(self) -> None:
        self.older: dict = {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.older.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:  # noqa: ANN001
        if len(self) >= DECODED // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value


def _looked_at(raw: bytes, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of the tokens of raw, which begins and ends with a space, but for those of which _Restorer.read()
    is known to say _NOTHING: words without a sign whose repeated letters stay, and two different letters or digits."""
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    inner = np.flatnonzero(~_STRIPPED[b])
    if not len(start) or not len(inner):
        return np.arange(len(start)), start, end
    first, behind = np.searchsorted(inner, start), np.searchsorted(inner, end)
    filled = behind > first
    lo, hi = inner[np.minimum(first, len(inner) - 1)], inner[behind - 1] + 1
    low = _LOWER[b]
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
    signs, ascii_letters = upto(~_ANY_LETTER[b]), upto(_ASCII_LETTER[b])
    twice = upto((low[1:] == low[:-1]) & _ASCII_LETTER[b[1:]])
    size, head = hi - lo, b[lo]
    # the sign for kelvin, which begins with 0xE2, is k in lower case; no other letter beyond ASCII becomes an ASCII one alone
    word = (size > 2) & (signs[hi] == signs[lo]) & ((head < 128) | ((head != 0xE2) & (ascii_letters[hi] > ascii_letters[lo])))
    once = twice[hi - 1] == twice[lo]
    # pairs of letters that are one choice each: no letter is there three times, and those beyond ASCII are Latin ones that stand alone
    pair = np.flatnonzero((low[1:] == low[:-1]) & _ASCII_LETTER[b[1:]])
    symbol = _SYMBOL[low].astype(np.int64)
    fixed = stays[symbol[pair - 1] * _STATES + symbol[pair] * SYMBOLS + symbol[pair + 2]] & (low[pair - 1] != low[pair]) & (low[pair + 2] != low[pair])
    moved = np.zeros(len(b), bool)
    moved[pair[~fixed]] = True
    far = b >= 128
    latin = np.flatnonzero((b[1:-2] == 0xC3) & far[2:-1] & (b[2:-1] < 0xC0) & ~far[:-3] & ~far[3:]) + 1
    far[latin] = far[latin + 1] = False
    unclear = upto(moved | far)
    word &= once | (unclear[hi] == unclear[lo])
    two = (size == 2) & _ALNUM[head] & _ALNUM[b[hi - 1]] & (low[lo] != low[hi - 1])
    some = np.flatnonzero(~(filled & (word | two)))
    return some, start[some], end[some]


class _Restorer:
    """The words of a text, with disguised ones restored; remembers what it has decoded, up to a bound."""

    def __init__(self, counts: list[tuple[int, int]]) -> None:
        cube = np.zeros(SYMBOLS**3, np.int64)
        for gram, n in counts:
            cube[gram] = n
        self.model = CharacterModel(cube)
        self.memory, self.decoded = _Recent(), _Recent()

    def decode(self, token: bytes) -> list[bytes]:
        """The words behind a token or spaced run that it doesn't show openly."""
        text = token.decode("utf-8", "replace").lower()
        known = self.decoded[text]
        if known is not None:
            return known
        shown = set(text.encode().translate(PLAIN).split())
        found = self.model.restore(text).encode().split()
        if _SIGN.search(token):  # a doubled letter or a sign at the edge may belong to the word
            found += [w for w in self.model.restore(text, fold=False).encode().split() if w not in found]
        hidden = [w for w in found if w not in shown]
        if len(text) <= REMEMBERED:
            self.decoded.keep(text, hidden)
        return hidden

    def read(self, token: bytes) -> tuple[int, list[bytes]]:
        """What a token is in a spaced run (2 a letter or sign, 1 punctuation, 0 neither), and its restored words."""
        core = token.strip(_AROUND)
        signed, twice = not core.isalpha() and _SIGN.search(core), _TWICE.search(core)
        if len(core) > 2 and not signed and not twice and core[0] < 128:
            value = _NOTHING
        else:
            text = core.decode("utf-8", "replace").lower()
            solid = {c for c in text if c.isalnum() or ord(c) >= 128}
            part = 0 if len(solid) > 1 else 2 if core else 1
            value = part, self.decode(core) if len(core) > 2 and _LETTER.search(core) and (signed or twice) else []
            value = value if part or value[1] else _NOTHING
        if len(token) <= REMEMBERED:
            self.memory.keep(token, value)
        return value

    def words(self, raw: bytes) -> tuple[list[bytes], int]:
        """Words of the text and after them the restored ones; and the number of the latter."""
        return next(self.texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))

    def texts(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[bytes], int]]:
        """words() of each text of a batch."""
        for i, j in runs(at, AT_ONCE):
            texts = [data[at[k] : at[k + 1]].tobytes() for k in range(i, j)]
            raw = b" " + b" ".join(texts) + b" "
            number, start, end = _looked_at(raw, self.model.stays)
            # a text lies behind the spaces of those before it
            edges = np.searchsorted(start, at[i : j + 1] - at[i] + np.arange(1, j - i + 2)).tolist()
            number, start, end = number.tolist(), start.tolist(), end.tolist()
            for k, text in enumerate(texts):
                some = slice(edges[k], edges[k + 1])
                found, restored = text.translate(PLAIN).split(), self._restored(raw, number[some], start[some], end[some])
                yield found + restored, len(restored)

    def _restored(self, raw: bytes, number: list[int], start: list[int], end: list[int]) -> list[bytes]:
        """What is behind a text's tokens that are looked at; one that isn't looked at ends a spaced run."""
        restored: list[bytes] = []
        run: list[bytes] = []
        solid, last, memory = 0, -1, self.memory
        for nth, a, b in zip(number, start, end, strict=True):
            token = raw[a:b]
            part, own = memory[token] or self.read(token)
            if run and (nth != last + 1 or not part):
                # words of a token that ends a run come before those of the run
                if not part and nth == last + 1:
                    restored += own
                    own = []
                if solid >= LEAST_SPACED:
                    restored += self.spaced(run)
                run, solid = [], 0
            restored += own
            if part:
                run.append(token)
                solid += part == 2
            last = nth
        if solid >= LEAST_SPACED:
            restored += self.spaced(run)
        return restored

    def spaced(self, run: list[bytes]) -> list[bytes]:
        text = b" ".join(run)
        return self.decode(text) if _LETTER.search(text) else []


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle of each text, which near copies share."""
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        groups = []
        for i in range(batch.num_rows):
            raw = data[at[i] : at[i + 1]]
            words = split_words(raw, np.array([0, len(raw)]), lower=True).digest
            groups.append(int(grams(words, min(5, len(words))).min().astype(np.int64)) if len(words) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64())], names=["text", "toxic", "group"])


def _word_counts(counts: list[tuple[int, int]]):  # noqa: ANN202  a function of batches
    """(word, hits, seen): texts and toxic texts that hold a word, summed over a task or as far as its table may grow."""

    def emptied(table: dict[bytes, list[int]]) -> pa.RecordBatch:
        words = pa.array([w.decode("utf-8", "replace") for w in table], pa.string())
        columns = [pa.array([v[k] for v in table.values()], pa.int64()) for k in range(2)]
        table.clear()
        return pa.RecordBatch.from_arrays([words, *columns], names=["word", "hits", "seen"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _Restorer(counts)
        table: dict[bytes, list[int]] = {}
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for label, (words, _) in zip(batch.column(1).to_pylist(), restorer.texts(data, at), strict=True):
                for w in set(words):
                    if len(w) >= 3:
                        both = table.setdefault(w, [0, 0])
                        both[0] += label
                        both[1] += 1
                if len(table) > MOST_COUNTED:
                    yield emptied(table)
        yield emptied(table)

    return counted


def labelled_texts(docs: DataFrame, labels: DataFrame, parts: int, part: int, text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, toxic, group, row): labelled documents that aren't held out, as a table in the shared folder. Documents and
    labels are joined by doc_id; a null id or label joins nothing; repeated ones give a row each."""
    small_batches(docs.sparkSession)
    own = labels.where(~held_out(F.col("doc_id"), parts, part) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("toxic"))
    joined = docs.select("doc_id", F.col(text).alias("text")).join(small(own), "doc_id").select("text", "toxic")
    return written(joined.mapInArrow(_grouped, "text string, toxic int, group long").withColumn("row", F.monotonically_increasing_id()))


def learn_lexicon(labelled: DataFrame, counts: list[tuple[int, int]]) -> DataFrame:
    """(word, weight) of words that mark toxic texts, from all of labelled_texts().

    Of near copies, told by their least shingle, one counts. A word is kept if the lower bound (two standard errors) of
    its share of toxic texts is at least 0.6 and its count is too large for chance over all words tested (Chernoff bound
    below 1 in 100). weight is its smoothed log odds over the base rate.
    """
    one_each = labelled.groupBy("group").agg(F.min("row").alias("row")).select("row")
    once = labelled.join(small(one_each), "row", "left_semi").select("text", "toxic")
    n = once.mapInArrow(_word_counts(counts), "word string, hits long, seen long").groupBy("word").agg(F.sum("hits").cast("double").alias("hits"), F.sum("seen").cast("double").alias("seen"))
    n = cut(n.where("seen >= 3"))
    base = once.agg(F.avg("toxic").alias("rate"))
    tested = n.agg(F.count("*").alias("tested"))
    share = F.col("hits") / F.col("seen")
    low = (share + 2 / F.col("seen") - 2 * F.sqrt(share * (1 - share) / F.col("seen") + 1 / (F.col("seen") * F.col("seen")))) / (1 + 4 / F.col("seen"))
    at_most_one = F.least(share, F.lit(1 - 1e-9))
    bound = F.col("seen") * (at_most_one * F.log(at_most_one / F.col("rate")) + (1 - at_most_one) * F.log((1 - at_most_one) / (1 - F.col("rate"))))
    one_row = base.join(tested, F.lit(True))
    scored = n.join(F.broadcast(one_row), F.lit(True))
    kept = scored.where((low >= 0.6) & (share > F.col("rate")) & (bound > F.log(100 * F.col("tested"))))
    odds = F.log((F.col("hits") + 0.5) / (F.col("seen") - F.col("hits") + 0.5)) - F.log(F.col("rate") / (1 - F.col("rate")))
    return cut(kept.select("word", odds.alias("weight")))


#: What the logistic model sees of a text.
FEATURES = ("found", "weight", "density")


def _features(counts: list[tuple[int, int]], lexicon):  # noqa: ANN001, ANN202  a broadcast value, and a function of batches
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weights = _Restorer(counts), lexicon.value
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            rows = np.zeros((batch.num_rows, 4))
            for i, (words, restored) in enumerate(restorer.texts(data, at)):
                hits = [weights[w] for w in words if w in weights]
                rows[i] = bool(hits), np.log1p(sum(hits)), np.sqrt(len(hits) / max(20, len(words))), restored
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, k]) for k in range(4))], names=[*batch.schema.names[1:], *FEATURES, "restored"])

    return measured


def _listed(counts: list[tuple[int, int]]):  # noqa: ANN202  a function of batches
    """(at, word, n, words, restored): the words of each text, and once for each, under a null word, their numbers."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _Restorer(counts)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for row, (words, restored) in zip(batch.column(1).to_pylist(), restorer.texts(data, at), strict=True):
                table = Counter(words)
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array([row] * (len(table) + 1), pa.int64()), "word": pa.array([None, *(w.decode("utf-8", "replace") for w in table)], pa.string()),
                    "n": pa.array([0, *table.values()], pa.int64()), "words": pa.array([len(words)] + [0] * len(table), pa.int64()), "restored": pa.array([restored] + [0] * len(table), pa.int64()),
                })

    return listed


def _measure(rows: DataFrame, counts: list[tuple[int, int]], lexicon: DataFrame, held: bool, fields: T.StructType) -> DataFrame:
    """rows (a text and other columns) with FEATURES and `restored` for the text, by a broadcast lexicon or by a join."""
    if held:
        known = rows.sparkSession.sparkContext.broadcast({r["word"].encode(): r["weight"] for r in lexicon.collect()})
        return rows.mapInArrow(_features(counts, known), fields)
    text, *others = rows.columns
    numbered = written(rows.withColumn("_at", F.monotonically_increasing_id()))
    listed = numbered.select(text, "_at").mapInArrow(_listed(counts), "at long, word string, n long, words long, restored long")
    hit = listed.join(lexicon, "word", "left").groupBy("at").agg(
        F.sum(F.when(F.col("weight").isNotNull(), F.col("n")).otherwise(0)).alias("hits"), F.coalesce(F.sum(F.col("n") * F.col("weight")), F.lit(0.0)).alias("sum"), F.sum("words").alias("words"), F.sum("restored").cast("double").alias("restored")
    )
    values = hit.select("at", (F.col("hits") > 0).cast("double").alias("found"), F.log1p("sum").alias("weight"), F.sqrt(F.col("hits") / F.greatest(F.lit(20), "words")).alias("density"), "restored")
    return numbered.join(values, numbered["_at"] == values["at"]).select(*others, *FEATURES, "restored")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps, with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measures() -> list[T.StructField]:
    return [T.StructField(f, T.DoubleType()) for f in (*FEATURES, "restored")]


def score_texts(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns `keep` of every row of docs with `score` (0 to 1), `predicted` (1 from 0.5 on) and `restored`, the
    number of restored tokens. labelled: what labelled_texts() gives of the rows that may be learned from.

    The character model counts all of docs; the lexicon counts all labelled rows; the logistic model is fitted on
    MOST_FITTED labelled rows at most, by hash order. Null and empty texts get the score of a text without finds. Without
    labelled rows of both classes the lexicon is empty and every score is the base rate, 0.5 at most. Rows map one to one,
    repeated ones too. The trigram table goes to the tasks as a closure; the lexicon is broadcast if it is counted to have
    MOST_HELD words or fewer, and joined to the words of the texts otherwise.
    """
    small_batches(docs.sparkSession)
    counts = [(r["gram"], r["n"]) for r in character_counts(docs, text).collect()]  # 28 ** 3 rows at most
    lexicon = learn_lexicon(labelled, counts)
    n_words = lexicon.count()
    held = n_words <= MOST_HELD
    chosen = bounded(labelled.select("row"), MOST_FITTED, "row")
    fitted = labelled.join(F.broadcast(chosen), "row", "left_semi").select("text", F.col("toxic").alias("label"))
    fields = T.StructType([T.StructField("label", T.IntegerType()), *_measures()])
    seen = _measure(fitted, counts, lexicon, held, fields).groupBy("label", *FEATURES).count().toArrow()
    x = np.column_stack([seen.column(f).to_numpy() for f in FEATURES]) if seen.num_rows else np.zeros((0, 3))
    y, n = seen.column("label").to_numpy(), seen.column("count").to_numpy()
    if len(set(y.tolist())) == 2 and n_words:
        w = _fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    else:
        rate = min(0.49, max(0.01, float((y * n).sum()) / max(1, n.sum())))
        w = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
    # what is kept goes as one struct, so that no name of it clashes with ours
    kept = docs.select(F.col(text).alias("_text"), F.struct(*keep).alias("_row"))
    fields = T.StructType([*kept.select("_row").schema.fields, *_measures()])
    measured = _measure(kept, counts, lexicon, held, fields)
    total: Column = F.lit(float(w[0]))
    for k, f in enumerate(FEATURES):
        total = total + F.lit(float(w[k + 1])) * F.col(f)
    score = 1 / (1 + F.exp(-total))
    return measured.select(*(F.col("_row")[k].alias(k) for k in keep if k not in ("score", "predicted", "restored")), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("restored").cast("long").alias("restored"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, same columns."""
    labelled = labelled_texts(docs, labels, 5, 0)
    scored = score_texts(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), labelled, ("_doc",))
    return scored.where("predicted = 0").select("_doc.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    labelled = labelled_texts(docs, table(spark, sf_dir, "labels"), 5, 0)
    return score_texts(docs, labelled, ("doc_id", "held_out"))
