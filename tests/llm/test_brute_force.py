"""What SQL cannot say, against plain reimplementations, exhaustive searches and held-out rows."""

import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, mixing, near_duplicates, quality_classifier, toxicity
from test_llm import brute_components, sentence, words

FOLDER = "/root/testdata/sf0.01"


# near duplicates


def crowd(rng, members, edits):
    """Texts that keep most of one text, so that many pairs lie around the threshold."""
    base = sentence(rng, 90).split()
    out = []
    for _ in range(members):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = sentence(rng, 1)
        out.append(" ".join(own))
    return out


def test_every_depth_reaches_the_recall():
    for classes in (1, 1000, 10**6, 10**9, 4 * 10**10):
        depth, trees = near_duplicates.planned(classes)
        assert near_duplicates.missed(depth, trees) <= near_duplicates.MISSED and near_duplicates.FANOUT**depth >= min(classes, near_duplicates.FANOUT**3)
    # the chance that a pair meets in a tree, by drawing trees
    rng = random.Random(1)

    def meets(s, depth):
        if not depth:
            return True
        return any(rng.random() < s and meets(s, depth - 1) for _ in range(1 + (rng.random() < 1 / 3)))

    drawn = sum(not meets(0.75, 3) for _ in range(20_000)) / 20_000
    assert abs(drawn - near_duplicates.lost(0.75, 3)) < 0.015


@pytest.mark.parametrize(("tile", "large"), [(1024, 8192), (64, 200)])
def test_crowds_around_the_threshold(spark, monkeypatch, tile, large):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "LARGE", large)
    rng = random.Random(7)
    texts = crowd(rng, 700, 7) + crowd(rng, 60, 9) + [sentence(rng, 50) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 100  # many that lie just outside
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert sum(a != b for a, b in zip(found, want, strict=True)) <= 1


def test_many_languages_are_joined_with_the_same_result(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(150)
    profiles = language.learn(docs)
    asked = docs.unionByName(spark.createDataFrame([(-1, None, None), (-2, "123 ...", None), (-3, "\u4e00\u4e01", None), (-3, "\u4e00\u4e01", None)], "doc_id long, text string, lang string")).withColumn("at", F.lit(3)).withColumn("gram", F.lit("x"))
    rows = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 12), r["at"], r["gram"]) for r in df.collect())
    assert rows(language.predict(asked, profiles, most_held=0)) == rows(language.predict(asked, profiles))
    assert language.predict(asked.limit(0), profiles, most_held=0).count() == 0


def test_large_nodes_lose_no_link(spark, monkeypatch):
    """A crowd in nodes that branch on, with pairs between 0.75 and 0.80 that nothing else links: none is lost."""
    monkeypatch.setattr(near_duplicates, "TILE", 64)
    monkeypatch.setattr(near_duplicates, "LARGE", 100)
    allowed = near_duplicates.missed(*near_duplicates.planned(400)) + near_duplicates.ROUNDS * near_duplicates.missed(near_duplicates.STEPS, near_duplicates.REPEATS)
    assert allowed <= near_duplicates.MISSED
    rng = random.Random(12)
    # all share half of a text, so large nodes hold them; only the partners of a pair share more
    shared, rows, near = sentence(rng, 120).split(), [], 0
    while len(rows) < 400:
        base = shared + sentence(rng, 60).split()
        own = list(base)
        for _ in range(rng.randint(2, 5)):
            own[rng.randrange(len(own))] = sentence(rng, 1)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, own))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            near += 1
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert near == 200 and sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_pairs_just_over_the_threshold_are_found(spark):
    rng = random.Random(9)
    rows, pairs = [], 0
    while pairs < 250:
        base = sentence(rng, rng.randint(60, 160)).split()
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = sentence(rng, 1)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, own))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(own))]
            pairs += 1
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = doc_id - doc_id % 2").count() >= 2 * pairs - 1


def test_sets_are_not_exchanged_before_they_are_compared(spark, monkeypatch):
    """A repeated row's sets are made one where they are joined, with the same result; the table of sets takes no exchange."""
    written, plans = near_duplicates.Scratch.written, []

    def noted(self, df):
        if df.columns == ["class", "shingles"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(self, df)

    monkeypatch.setattr(near_duplicates.Scratch, "written", noted)
    rng = random.Random(21)
    rows = list(enumerate(crowd(rng, 40, 12)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows + rows[:5] * 3, "doc_id long, text string").repartition(7))
    assert sorted({(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()}) == brute_components(rows) and got.count() == 55
    assert plans and not any("Exchange hashpartitioning" in p or "Exchange(hashpartitioning" in p for p in plans)


def test_a_tile_of_long_texts_takes_little_more_than_its_sets(monkeypatch):
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 64, 60_000, np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(1, 30_000)), replace=False)) for _ in range(60)] + [np.empty(0, np.uint64)]
    left, right = np.arange(0, 40), np.arange(20, 61)
    tracemalloc.start()
    got = near_duplicates._in_common(sets, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in right[:6].tolist()] for i in left[:6].tolist()] == got[:6, :6].tolist()
    assert peak < 3 * sum(s.nbytes for s in sets)
    monkeypatch.setattr(near_duplicates, "SORTED", 1 << 40)
    assert np.array_equal(got, near_duplicates._in_common(sets, left, right))


# quality: the risk and the prior in plain Python


def plain_fit(positive, unlabelled, prior, steps, rate=0.05, decay=1e-2):
    k = len(unlabelled[0])
    mean = [sum(r[i] for r in unlabelled) / len(unlabelled) for i in range(k)]
    scale = [math.sqrt(sum((r[i] - mean[i]) ** 2 for r in unlabelled) / len(unlabelled)) + 1e-3 for i in range(k)]

    def design(r):
        z = [max(-4.0, min(4.0, (r[i] - mean[i]) / scale[i])) for i in range(k)]
        return [1.0, *z, *(v * v for v in z)]

    p, u = [design(r) for r in positive], [design(r) for r in unlabelled]
    w, m, v = ([0.0] * (2 * k + 1) for _ in range(3))
    prob = lambda r: 1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w, strict=True))))
    for t in range(1, steps + 1):
        negative = sum(-math.log(1 - prob(r)) for r in u) / len(u) - prior * sum(-math.log(1 - prob(r)) for r in p) / len(p)
        of_negative = [sum(r[i] * prob(r) for r in u) / len(u) - prior * sum(r[i] * prob(r) for r in p) / len(p) for i in range(len(w))]
        gradient = [g - prior * sum(r[i] * (1 - prob(r)) for r in p) / len(p) for i, g in enumerate(of_negative)] if negative >= 0 else [-g for g in of_negative]
        for i, g in enumerate(gradient):
            g += decay * w[i] * (i > 0)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
        w = [x - rate * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_risk_is_minimised_as_by_the_formula(prior):
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(1, 1, (12, 3)), rng.normal(0, 1.5, (30, 3))
    got = quality_classifier.fit(positive, unlabelled, prior, steps=60).weights
    assert got == pytest.approx(plain_fit(positive.tolist(), unlabelled.tolist(), prior, 60), rel=1e-6, abs=1e-8)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(3, 1, 8000)
        unlabelled = np.concatenate([rng.normal(3, 1, int(20_000 * share)), rng.normal(-2, 1, int(20_000 * (1 - share)))])
        assert quality_classifier.estimate_prior(positive, unlabelled) == pytest.approx(share, abs=0.05)


# toxicity: every reading of a token


def readings(token, fold):
    """Alternatives of each run of equal characters, as the module's docstring and constants say."""
    steps = []
    for c, run in ((k, len(list(g))) for k, g in itertools.groupby(token)):
        if c in toxicity.READINGS:
            steps.append((c, list(toxicity.READINGS[c]), run))
        elif run >= 3:
            steps.append((c, [(c, -0.3), (c + c, -1.5)], 1))
        elif run == 2:
            steps.append((c, [(c + c, 0.0)] + ([(c, toxicity.DOUBLED)] if fold else []), 1))
        else:
            steps.append((c, [(c, 0.0)], 1))
    out, at = [], 0
    for (c, options, run), (_, group) in zip(steps, itertools.groupby(token), strict=True):
        length = len(list(group))
        before, after = token[at - 1 : at] if at else "", token[at + length : at + length + 1]
        if fold and c in toxicity.READINGS and c not in toxicity.SEPARATORS and not c.isdigit() and c != " " and (before in ("", " ")) != (after in ("", " ")):
            options = [*options, toxicity.AT_EDGE]
        out.append(options)
        if run > 1 and c != " ":
            out.append([*options, ("", toxicity.DOUBLED)] if fold else options)
        at += length
    return out


def best_reading(model, token, fold):
    n = toxicity.SYMBOLS
    best = {}
    for path in itertools.product(*readings(token, fold)):
        score, state = 0.0, (0, 0)
        for letters, cost in path:
            score += cost
            for c in letters:
                if c != " ":
                    x = ord(c) - 96
                    score += model.log[(state[0] * n + state[1]) * n + x]
                    state = state[1], x
                elif state != (0, 0):
                    score += model.log[(state[0] * n + state[1]) * n]
                    state = 0, 0
        if state != (0, 0):
            score += model.log[(state[0] * n + state[1]) * n]
        text = "".join(letters for letters, _ in path)
        best[text] = max(best.get(text, -1e9), score)
    return best


def test_viterbi_finds_the_best_of_all_readings():
    rng = np.random.default_rng(5)
    model = toxicity.CharacterModel(rng.integers(0, 40, toxicity.SYMBOLS**3) * (rng.random(toxicity.SYMBOLS**3) < 0.2))
    draw = random.Random(6)
    for _ in range(400):
        token = "".join(draw.choice("abct01!$@*.- ") * draw.choice((1, 1, 1, 2)) for _ in range(draw.randint(1, 5))).strip()
        for fold in (True, False):
            if token and math.prod(len(s) for s in readings(token, fold)) < 20_000:
                best = best_reading(model, token, fold)
                got = model.restore(token, fold)
                assert best.get(got, -1e9) == pytest.approx(max(best.values())), (token, fold, got)


# language: distances by dicts


def plain_profile(texts, size=language.PROFILE):
    counts = Counter()
    for text in texts:
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        padded = " " + " ".join(low.split()) + " " if low.split() else ""
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if (n == 1 and gram != " ") or (n > 1 and " " not in gram[1:-1] and gram != "  "):
                    counts[gram] += 1
    ranked = sorted(counts, key=lambda g: (-counts[g], len(g), [ord(c) for c in g]))[:size]
    return {g: k for k, g in enumerate(ranked)}


def test_distances_as_by_dicts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.where("doc_id < 150").collect() if r["text"]]
    profiles = {lang: plain_profile([r["text"] for r in rows if r["lang"] == lang]) for lang in {r["lang"] for r in rows if r["lang"]}}
    learned = defaultdict(dict)
    found = language.learn(docs.where("doc_id < 150"))
    for r in found.collect():
        gram = "".join(chr((r["gram"] >> shift & 0x1FFFFF) - 1) for shift in (42, 21, 0) if r["gram"] >> shift & 0x1FFFFF)
        learned[r["lang"]][gram] = r["place"]
    assert {k: dict(v) for k, v in learned.items()} == profiles
    size = language.PROFILE
    for r in language.predict(docs.where("doc_id BETWEEN 150 AND 260"), found).collect():
        own = plain_profile([r["text"] or ""])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        away = {lang: sum(min(size, abs(p[g] - k)) if g in p else size for g, k in own.items()) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - away[best] / (len(own) * size))


# mixing: the schedule slot by slot


@pytest.mark.parametrize("spread", [("a", "b", None), ("a", "a", "a", "a", "a", "a", "tiny")])
def test_taken_words_slot_by_slot(spark, monkeypatch, spread):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 300)
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.choice((0, 3, 40, 900))), rng.choice(spread)) for i in range(400)] + [(900, sentence(rng, 40), "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", F.xxhash64(F.lit(1), "doc_id", F.size(mixing.words(F.col("text"))).cast("long")).alias("key")).collect()}
    got = {r["doc_id"]: r for r in mixing.mix(docs)[0].collect()}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted(((keys[d] % 2**64, d, len(words(t))) for d, t, x in rows if x == s)) for s in sources}
    total = {s: sum(n for _, _, n in own[s]) for s in sources}
    target = {s: next(got[d]["target"] for _, d, _ in own[s]) for s in sources}
    block = max(1, min(mixing.BLOCK_TOKENS, int(sum(target.values())) // 300))
    blocks = {s: max(-(-total[s] // block), min(total[s], mixing.LEAST_BLOCKS)) for s in sources}
    slots = {s: target[s] * blocks[s] / total[s] if total[s] else 0.0 for s in sources}
    high, reach = {}, 0.0
    for s in sources:
        reach += slots[s]
        high[s] = round(reach / sum(slots.values()) * mixing.UNIT)
    times, rank = Counter(), Counter()
    for k in range(math.ceil(sum(slots.values()))):
        point = k * mixing.PHI % mixing.UNIT
        s = next(x for x in sources if point < high[x])
        if rank[s] < 3 * blocks[s]:
            times[s, rank[s] % blocks[s]] += 1
        rank[s] += 1
    for s in sources:
        edges = [b * (total[s] // blocks[s]) + min(b, total[s] % blocks[s]) for b in range(blocks[s] + 1)] if blocks[s] else [0]
        start = 0
        for _, d, n in own[s]:
            want = sum(times[s, b] * max(0, min(edges[b + 1], start + n) - max(edges[b], start)) for b in range(blocks[s]))
            assert got[d]["taken"] == want, (s, d)
            start += n
        taken = sum(got[d]["taken"] for _, d, _ in own[s])
        assert abs(taken - target[s]) <= 0.02 * target[s] + 4 * max(1, total[s] / max(1, blocks[s])), s


# held-out accuracy


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(quality_classifier.op4_quality_classifier, "quality", 0.95), (toxicity.op6_toxicity, "toxic", 0.85)])
def test_held_out_labels_are_ranked(spark, query, label, least):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"{label} IS NOT NULL").select("doc_id", label)
    rows = query(spark, FOLDER).where("held_out").join(labels, "doc_id").toPandas()
    assert len(rows) > 50 and rows["score"].between(0, 1).all()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) >= least


def test_held_out_languages_are_told(spark):
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    rows = language.op7_language(spark, FOLDER).where("held_out AND lang_pred != 'und'").join(lang, "doc_id").toPandas()
    assert len(rows) > 100 and (rows["lang"] == rows["lang_pred"]).mean() >= 0.98
