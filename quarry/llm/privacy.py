"""Personal data by candidate boosting: generators propose overlapping spans, boosted trees score them by format and
context, and a calibrated threshold selects what is redacted. Spans of the four base kinds are always selected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.samples import bounded
from quarry.llm.common import cut, let, runs, small_batches, table, text_bytes, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled", "local_phone", "id_number", "account", "secret", "number")
KINDS = BASE + ADDED
#: Candidates that the trees are fitted on, at most, by hash order; a third of them calibrate.
MOST_FITTED = 20_000
#: Share of right redactions that the threshold must reach on the calibration part.
PRECISION = 0.95
#: Bytes of text that go back from a worker at once, about.
AT_ONCE = 1 << 20
#: What is written before a candidate for an example of a kind in its right surroundings, and before a near miss.
_PLANTED = {
    "spelled": ("mail: ", "please write to "), "local_phone": ("phone: ", "call "), "id_number": ("SSN: ", "the social security number is "), "account": ("IBAN: ", "my account "),
    "secret": ('token = "', "the key is "), "number": ("account number: ", "with passport "),
}
_NEUTRAL = "a total of "

# Fixed patterns of the base kinds. Emails begin at an @ and are read outwards, so that long runs cost linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_GENERATORS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("spelled", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z0-9-]++)+", re.I)),
    ("local_phone", re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?![0-9.-])")),
    ("id_number", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+(?![A-Za-z0-9_/+=-])")),
    ("number", re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){7,}+")),
)
#: Characters before and after a span that are looked at, and words that speak for a kind when they stand there.
NEAR = 24
_HINTS = (
    ("secret", re.compile(r"token|key|secret|passw|api|auth|bearer", re.I)),
    ("phone", re.compile(r"tel|phone|call|fax|mobile|cell|whatsapp", re.I)),
    ("identity", re.compile(r"ssn|social|passport|identity|tax|insurance", re.I)),
    ("money", re.compile(r"iban|account|card|visa|bank|konto|cuenta|compte", re.I)),
    ("mail", re.compile(r"mail|contact|write|reach", re.I)),
)
_ANY_HINT = re.compile("|".join(pattern.pattern for _, pattern in _HINTS), re.I)
#: Admits all that any generator or base kind can match: each needs a digit, an @ or a spelled one.
_MAY_HOLD = re.compile(rb"[0-9@]|[\[( ]at[\]) ]", re.I)

FEATURES = (
    "length", "digits", "letters", "upper", "hex", "separators", "distinct", "switches", "groups", "luhn", "octets", "mod97", "has_at", "has_dot",
    "bracketed", "after_quote", "after_equals", "after_plus", "before_letter", "line_start", "id_shape", "phone_shape", "round", *(f"hint_{name}" for name, _ in _HINTS), "hint_after", *(f"is_{kind}" for kind in KINDS),
)
_SCHEMA = "kind string, start long, end long, label int, features array<double>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run before the @, not reaching into an earlier email
        begin = at
        while begin > done and _LOCAL.fullmatch(text, begin - 1, begin):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of the leftmost matches that don't overlap, for each base kind; invalid ones are dropped by the caller."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        yield "card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def _id_shape(span: str) -> bool:
    """Three groups as a social security number has them: none all zeros, the first not 666 and not from 900 on."""
    m = re.fullmatch(r"([0-9]{3})-([0-9]{2})-([0-9]{4})", span)
    return bool(m) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def near_miss(kind: str, span: str) -> str:
    """What looks like a span of a kind and is none: an account that fails its check, an impossible identity number, a number
    of too few digits for a telephone, hyphenated words with a year for a secret, a round number, a place and a file name for
    a spelled address."""
    d = _digits(span)
    if kind == "account":
        return span[:-1] + ("1" if span[-1] == "0" else "0")
    if kind == "id_number":
        return "000" + span[3:]
    if kind == "local_phone":
        return f"{d[:2]} {d[2:4]} {d[4:7]}"
    if kind == "secret":
        letters = "".join(chr(97 + (7 * ord(c) + 3 * i) % 26) for i, c in enumerate(span))
        return "-".join(letters[i : i + 6] for i in range(0, len(span), 7))[: len(span) - 5] + "-2024"
    if kind == "number":
        return d[:1] + "0" * (len(d) - 1)
    return "left at noon.today"


def measure(kind: str, text: str, start: int, end: int) -> list[float]:
    """FEATURES of a span that is proposed as one of a kind."""
    span, before = text[start:end], text[max(0, start - NEAR) : start]
    d = _digits(span)
    n = max(1, len(span))
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    compact = span.replace(" ", "")
    mod97 = False
    if 15 <= len(compact) <= 34 and compact.isascii() and compact.isalnum() and compact[:2].isalpha():
        mod97 = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    letters = sum(c.isalpha() for c in span)
    kinds = [c.isdigit() * 1 + c.isalpha() * 2 for c in span]
    near = before[-1:]
    return [
        float(min(len(span), 300)), len(d) / n, letters / n, sum(c.isupper() for c in span) / n, sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        float(sum(c in " -.()" for c in span)), len(set(span)) / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(len(re.split(r"[ .()-]+", span))),
        float(13 <= len(d) <= 19 and luhn(d)), float(octets), float(mod97), float("@" in span), float("." in span), float("[" in span or "(" in span),
        float(near in ("'", '"')), float("=" in before[-4:] or ":" in before[-4:]), float("+" in span[:1] or near == "+"), float(text[end : end + 1].isalpha()), float(start == 0 or near == "\n"),
        float(_id_shape(span)), float(9 <= len(d) <= 12), float(len(d) > 3 and (len(set(d)) < 3 or d.endswith("000"))),
        *(float(bool(hint.search(before))) for _, hint in _HINTS), float(bool(_ANY_HINT.search(text, end, end + NEAR))), *(float(k == kind) for k in KINDS),
    ]


def _silver(kind: str, features: list[float]) -> int:
    """What is sure of a candidate where it stands, without a model: 1 or 0, and -1 if nothing is."""
    of = dict(zip(FEATURES, features, strict=True))
    hinted = any(of[f"hint_{name}"] for name, _ in _HINTS) or of["hint_after"]
    if kind == "account":
        return int(of["mod97"])
    if kind == "spelled":
        return 1 if of["bracketed"] else 0 if not of["hint_mail"] else -1
    if kind == "secret":
        return 1 if of["hint_secret"] and of["digits"] > 0.1 else 0 if of["digits"] < 0.05 else -1
    if kind == "local_phone":
        return 0 if not of["phone_shape"] else 1 if of["hint_phone"] else -1
    if kind == "id_number":
        return 0 if not of["id_shape"] else 1 if of["hint_identity"] else -1
    return 1 if (of["hint_money"] or of["hint_identity"]) and not of["round"] else 0 if not hinted and not of["luhn"] else -1


def counterparts(kind: str, span: str) -> list[tuple[str, int, int, int]]:
    """A candidate in the surroundings of its kind, label 1, if it has the kind's form, and its near miss in neutral ones and in
    those of its kind, label 0: (text, start, end, label). So every kind that occurs is learned and calibrated from both
    classes, however many there are."""
    out, wrong = [], near_miss(kind, span)
    for before in _PLANTED[kind]:
        sound = dict(zip(FEATURES, measure(kind, before + span, len(before), len(before) + len(span)), strict=True))
        form = {"account": sound["mod97"], "id_number": sound["id_shape"], "local_phone": sound["phone_shape"], "secret": sound["digits"] > 0.1, "number": not sound["round"], "spelled": sound["bracketed"]}
        if form[kind]:
            out.append((before + span, len(before), len(before) + len(span), 1))
    return out + [(b + wrong, len(b), len(b) + len(wrong), 0) for b in (_NEUTRAL, *_PLANTED[kind])]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans of a text, and the spans that the generators propose beside them."""
    base, more = [], []
    for kind, a, b, valid in base_matches(text):
        if valid:
            base.append((kind, a, b))
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            more.append((kind, m.start(), m.end()))
    # what has the form of an identity number or of an account is not taken for a telephone, a plain number or a secret too
    special = {(a, b) for kind, a, b in more if kind in ("id_number", "account")}
    more = [(kind, a, b) for kind, a, b in more if kind in ("id_number", "account") or (a, b) not in special]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    free = []
    for kind, a, b in more:
        k = int(np.searchsorted(starts, b)) - 1
        if not any(x < b and a < y for x, y in taken[max(0, k - 3) : k + 1]):
            free.append((kind, a, b))
    return base, free


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled candidates: base spans and their failed matches, what is sure of the generators' spans, and their counterparts."""
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            raw = data[at[i] : at[i + 1]].tobytes()
            if not _MAY_HOLD.search(raw):
                continue
            text = raw.decode("utf-8", "replace")
            for kind, a, b, valid in base_matches(text):
                if valid or b - a > 6:
                    rows.append((kind, a, b, int(valid), measure(kind, text, a, b)))
                if kind == "phone" and valid and (cut_at := text.find(" ", a, b)) > 0:  # the same number without its country
                    rows.append(("local_phone", cut_at + 1, b, 1, measure("local_phone", text, cut_at + 1, b)))
            for kind, a, b in candidates(text)[1]:
                features = measure(kind, text, a, b)
                rows += [(kind, x, y, label, measure(kind, made, x, y)) for made, x, y, label in counterparts(kind, text[a:b])]
                label = _silver(kind, features)
                if label >= 0:
                    blind = [0.0 if f.startswith(("hint_", "after_")) else v for f, v in zip(FEATURES, features, strict=True)]
                    rows.append((kind, a, b, label, features))
                    if kind != "number":  # a plain number is personal by its surroundings alone
                        rows.append((kind, a, b, label, blind))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "start", "end", "label", "features"])


@dataclass
class Trees:
    """Boosted trees as arrays, their calibration, and the thresholds on the calibrated probability: those of the kinds that have
    calibration examples of both classes, and one of all kinds together for the others."""

    nodes: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree, weight in zip(self.nodes, self.weights, strict=True):
            feature, cut_at, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                down = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut_at[at], left[at], right[at])
                at = np.where(inner, down, at)
            out += weight * value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def _flat(root) -> list[tuple[int, float, int, int, float]]:  # noqa: ANN001  a node of Spark's tree model
    nodes: list = []

    def walk(node) -> int:  # noqa: ANN001
        at = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, float(node.prediction()))
        else:
            split = node.split()
            nodes[at] = (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()), 0.0)
        return at

    walk(root)
    return nodes


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton's steps on smoothed labels."""
    y = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    w = np.array([1.0, 0.0])
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, text: str = "text", most_fitted: int = MOST_FITTED) -> Trees:
    """Boosted trees for candidates like those of docs.

    Examples are found in all documents; the first most_fitted by hash of what they look like are taken, a third of them to
    calibrate. What validators and plain hints are sure of labels them, and every candidate has counterparts of sure labels. A
    kind with calibration examples of both classes has the least threshold above which PRECISION of them are right; the others
    have that of all kinds together. This doesn't depend on how many examples there are. Without
    examples of both classes there is no model and only base kinds are found.
    """
    small_batches(docs.sparkSession)
    found = docs.select(text).mapInArrow(_examples, _SCHEMA).withColumn("order", F.xxhash64("features", "label", "start"))
    sample = cut(bounded(written(found), most_fitted, "order", "kind", "start").select("kind", "label", array_to_vector("features").alias("features"), (F.pmod("order", F.lit(3)) == 0).alias("calibrates")))
    classes = {(r["calibrates"], r["label"]): r["count"] for r in sample.groupBy("calibrates", "label").count().collect()}
    if any(classes.get((part, label), 0) < 5 for part in (False, True) for label in (0, 1)):
        return Trees()
    model = GBTClassifier(maxIter=30, maxDepth=5, stepSize=0.5, seed=1, labelCol="label").fit(sample.where("NOT calibrates").withColumn("label", F.col("label").cast("double")))
    trees = Trees([_flat(t._call_java("rootNode")) for t in model.trees], [float(w) for w in model.treeWeights])
    rest = sample.where("calibrates").collect()
    x, y = np.array([r["features"].toArray() for r in rest]), np.array([r["label"] for r in rest])
    trees.slope, trees.offset = _calibrate(trees.margin(x), y)
    p, kinds = trees.probability(x), np.array([r["kind"] for r in rest])
    trees.threshold = _threshold(p, y)
    trees.thresholds = {kind: _threshold(p[kinds == kind], y[kinds == kind]) for kind in sorted(set(kinds.tolist())) if len(set(y[kinds == kind].tolist())) == 2}
    return trees


def _threshold(p: np.ndarray, label: np.ndarray) -> float:
    """The least probability, 0.5 at least, above which PRECISION of the examples are right: 0.5 if they all together are, and
    2 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(label[order]) / np.arange(1, len(label) + 1)
    good = np.flatnonzero(right >= PRECISION)
    if not len(good):
        return 2.0
    return 0.5 if good[-1] == len(label) - 1 else max(0.5, float(p[order][good[-1]]))


def select_spans(text: str, trees: Trees) -> list[tuple[str, int, int, float]]:
    """Spans of a text by kind as listed, then start: all of the base kinds, and of the others those over their threshold that overlap none longer, or as long and of a kind listed earlier."""
    base, more = candidates(text)
    spans = [(kind, a, b, 1.0) for kind, a, b in base]
    if more and trees.nodes:
        p = trees.probability(np.array([measure(kind, text, a, b) for kind, a, b in more]))
        chosen: list[tuple[str, int, int, float]] = []
        for k in np.lexsort((-p, [KINDS.index(kind) for kind, _, _ in more], [a - b for _, a, b in more])).tolist():
            kind, a, b = more[k]
            if p[k] >= trees.thresholds.get(kind, trees.threshold) and not any(x < b and a < y for _, x, y, _ in chosen):
                chosen.append((kind, a, b, float(p[k])))
        spans += chosen
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with `spans` array<struct<kind, start, end, score>>, code points, end exclusive.

    Null and empty texts have no spans. Rows map one to one; extra columns pass through, one named spans is replaced. Whole
    texts are searched, whatever their length. The trees (30 of 63 nodes at most) go to the tasks as a closure.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("spans")
    schema = kept.select("*").schema.add("spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")))
    place = kept.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(place))
            for first, last in runs(at, AT_ONCE):  # small batches go back, so that a worker holds little besides its input
                spans = []
                for i in range(first, last):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    found = select_spans(raw.decode("utf-8", "replace"), trees) if _MAY_HOLD.search(raw) else []
                    spans.append([{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in found])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _SPAN)], names=[*batch.schema.names, "spans"])

    return kept.mapInArrow(search, schema)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of find_spans() with each span replaced by its kind in brackets; of overlapping spans the first by start, then the longest, names the whole.
    Null, empty and clean texts stay as they are; rows map one to one, and other columns are kept whatever their names."""
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))
    # overlapping spans become one: fold in order, widening the last
    first = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def widen(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        entry = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(entry(last["start"], F.greatest(last["end"], -s["neg_end"]), last["kind"])))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), joined).otherwise(F.concat(done, F.array(entry(s["start"], -s["neg_end"], s["kind"]))))

    def clean(merged: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda s: s["end"]))
        starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.char_length(text).cast("bigint")))
        marks = F.concat(F.transform(merged, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
        kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
        return F.array_join(F.zip_with(kept, marks, lambda t, m: F.concat(t, m)), "")

    return found.withColumn(text, F.when(F.size("spans") > 0, let(F.aggregate(by_place, first, widen), clean)).otherwise(F.col(text)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, learn(docs)).select("doc_id", "spans")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
