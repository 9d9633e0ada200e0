"""Phrases, nearest neighbours and conversation repair against plain Python, with odd and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_repair, neighbours, phrases

FOLDER = "/root/testdata/sf0.01"


# phrases


def brute_phrases(rows, least, longest, best):
    n, f = Counter(), defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rank = []
        for p, a in found.items():
            if 100 * longer[p] < 50 * a:
                cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rank.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rank)[:best], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("longest", "per_trie"), [(3, 1 << 19), (4, 40)])
def test_phrases_against_counting(spark, longest, per_trie):
    rng = random.Random(4)
    word = lambda: rng.choice("ab Ab é éb a c Q1 the of x-y".split(" ")) if rng.random() < 0.9 else str(rng.randrange(300))
    texts = ["".join(word() + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", "fr"), ("lone", "fr"), (" . ", None)]
    rows += [("again and again " * 3000, "de"), ("w" * 70000 + " end ", "en")] + [("same row twice", "en")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumn("d", F.lit(1)).withColumn("n", F.lit("x"))
    got = phrases.collocations(docs, least=5, longest=longest, best=50, per_trie=per_trie)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute_phrases(rows, 5, longest, 50)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


def test_trie_accepts_its_phrases_only():
    rng = np.random.default_rng(2)
    vocabulary = np.unique(rng.integers(0, 2**63, 700)).astype(np.uint64)
    # one word that very many go on from, so that a state has every symbol
    wanted = {(0, i) for i in range(1, 600)} | {tuple(rng.integers(0, 700, rng.integers(2, 5)).tolist()) for _ in range(3000)}
    trie = phrases.build_trie(np.concatenate([vocabulary[list(p)] for p in wanted]), np.array([len(p) for p in wanted]))
    numbers = np.searchsorted(trie.words, vocabulary)
    asked = list(wanted) + [tuple(rng.integers(0, 700, rng.integers(1, 5)).tolist()) for _ in range(3000)]
    for p in asked:
        state = np.array([trie.root], np.int32)
        for w in p:
            state = trie.step(state, np.array([numbers[w]]))[1] if numbers[w] < len(trie.words) and trie.words[numbers[w]] == vocabulary[w] else state[:0]
        assert bool(len(state) and trie.accepts[state[0]] >= 0) == (p in wanted)


# nearest neighbours


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute_neighbours(rows, k=10):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known[i] = min(known.get(i, v), v)
    sizes = Counter(len(v) for v in known.values())
    usual = min(sizes, key=lambda s: (-sizes[s], s), default=0)
    known = {i: v for i, v in known.items() if len(v) == usual}
    out = []
    for q in (i for i in known if i % 100 == 0):
        best = sorted((distance(known[q], v), i) for i, v in known.items() if i != q)
        out += [(q, n, i, d) for n, (d, i) in enumerate(best[:k], 1)]
    return out


def found_rows(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


def test_neighbours_reach_the_recall(spark):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in given.collect()])
    index = neighbours.build_index(given, list_size=16)
    got = found_rows(neighbours.search(index, index.vectors.where("vec_id % 100 = 0")))
    exact = {(q, i): d for q, _, i, d in want}
    assert sum((q, i) in exact for q, _, i, _ in got) >= 0.9 * len(want) and len(got) == len(want)
    assert index.recall >= neighbours.TARGET
    assert all(exact[q, i] == d for q, _, i, d in got if (q, i) in exact)
    assert sorted(got) == sorted(got, key=lambda g: (g[0], g[3], g[2]))
    assert sorted(found_rows(neighbours.exact_neighbours(index.vectors.where("vec_id % 100 = 0"), index.vectors))) == sorted(want)


def test_clustered_vectors_are_searched_in_few_lists(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24)) * 4
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.5
    rows = list(enumerate(x.tolist()))
    index = neighbours.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_size=64)
    want = {(q, i) for q, _, i, _ in brute_neighbours(rows)}
    got = found_rows(neighbours.search(index, index.vectors.where("vec_id % 100 = 0")))
    assert sum((q, i) in want for q, _, i, _ in got) >= 0.9 * len(want)
    taken = index.graph.lists_for(x[::100], index.ratio, 44)
    assert np.mean([index.graph.sizes[c].sum() for c in taken]) < 0.2 * len(x)
    assert index.graph.sizes.max() < 10 * 64 * neighbours.REPLICAS


def test_odd_vectors_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(4)]
    copy = [1.0, 1.0, 0.5, -1.0]
    rows = [(i, vector()) for i in range(400)] + [(i, copy) for i in range(400, 1100)]
    rows += [(1100, None), (1200, [0.0] * 4), (1300, [1.0, None, 1.0, 1.0]), (1400, [1.0, float("nan"), 0.0, 0.0]), (1500, [float("inf")] * 4), (1600, [1.0, 2.0]), (1700, []), (None, copy)]
    rows += [(200, copy), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("list", F.lit("x"))
    index = neighbours.build_index(df, list_size=32)
    got = found_rows(neighbours.search(index, index.vectors.where("vec_id % 100 = 0")))
    want = brute_neighbours(rows)
    assert {q for q, *_ in got} == {q for q, *_ in want} and len(got) == len(want)
    near = {(q, n): d for q, n, _, d in want}
    assert sum(near[q, n] == d for q, n, _, d in got) >= 0.9 * len(want)
    for few in (rows[:1], rows[:7], [(100, copy), (200, copy)], [(100, copy)], rows[-8:-3]):
        index = neighbours.build_index(spark.createDataFrame(few, "vec_id long, embedding array<double>"))
        assert sorted(found_rows(neighbours.search(index, index.vectors.where("vec_id % 100 = 0")))) == sorted(brute_neighbours(few))
    index = neighbours.build_index(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert neighbours.search(index, index.vectors).count() == 0


# conversation repair


def brute_repair(rows):
    """(cost, audit, repaired) by trying edits in order of cost and audit; rows (role, text, fault)."""
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    # all audits of each place by cost: plain dynamic programming that keeps every cheapest audit
    table = {(0, ""): (0, {"": ()})}
    todo = [(0, 0, "")]
    done = set()
    import heapq

    while todo:
        cost, at, state = heapq.heappop(todo)
        if (at, state) in done or table[at, state][0] != cost:
            continue
        done.add((at, state))
        steps = [(3, "I", at, nexts[state, t], (t, "")) for t in "ua" if (state, t) in nexts]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append((4, "D", at + 1, state, None))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in nexts:
                    steps.append((extra, "K", at + 1, nexts[state, role[:1]], (role, text)))
                steps += [(3 + extra, "R", at + 1, nexts[state, t], (t, text)) for t in "ua" if (state, t) in nexts]
        for more, edit, to, into, said in steps:
            old = table.get((to, into), (math.inf, {}))
            if cost + more < old[0]:
                old = table[to, into] = (cost + more, {})
            if cost + more == old[0]:
                for audit, way in table[at, state][1].items():
                    old[1][audit + edit] = (*way, said) if said else way
                heapq.heappush(todo, (cost + more, to, into))
    ends = [table[len(rows), s] for s in ("", "a") if (len(rows), s) in table]
    best = min(c for c, _ in ends)
    audit, way = min((a, w) for c, audits in ends if c == best for a, w in audits.items())
    full = {"u": "user", "a": "assistant"}
    return best, audit, "\n".join(f"{full.get(r, r)}:{t}" for r, t in way)


def brute_conversation(rows):
    """rows (turn, role, text) after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = Counter(f for *_, f in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *brute_repair(marked))


def test_repairs_against_all_cheapest_edits(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 11)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            text = rng.choice(["Yes.", "No!", "cut off", "A.", "", " \n", None, "B? \t", "é.", "C."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None]), role, text, conv == 7))
    got = chat_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").withColumn("place", F.lit(1)))
    groups = defaultdict(list)
    for conv, turn, role, text, gone in rows:
        groups[conv] += [] if gone else [(turn, role, text)]
    found = {r["conv_id"]: tuple(r)[1:] for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired").collect()}
    assert found == {c: brute_conversation(g) for c, g in groups.items()}
    assert found[7] == (0, 0, 0, 0, 0, 0, "", "")


def brute_damage(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return groups


def test_query_of_damaged_conversations(spark):
    from quarry.llm.registry import queries

    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv, group in brute_damage(given).items():
        *counts, cost, audit, repaired = brute_conversation(group)
        want[conv] = (*counts, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    got = queries()["op13_conversation_repair"](spark, FOLDER)
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got.collect()} == want
    odd = [(1, None, "user", "a."), (None, 3, None, None), (None, None, "user", "b."), (2, 2, "user", "x."), (2, 2, "user", "x."), (3, -5, "system", "é" * 100000)] + [(4, i, "user", "Hi.") for i in range(60)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired"]) for r in chat_repair.repair_conversations(chat_repair.damage(df)).collect()}
    assert found == {c: brute_conversation(g) for c, g in brute_damage(odd).items()}
    assert chat_repair.repair_conversations(chat_repair.damage(df.limit(0))).count() == 0


def test_long_conversations_are_searched_in_time():
    rng = random.Random(1)
    rows = "".join(rng.choice(["u-", "a-", "u-", "a-", "ut", "ab", "s-", "o-"]) for _ in range(20000))
    cost, edits = chat_repair.repair(rows)
    assert sum(e != "I" for e, *_ in edits) == 20000 and cost > 0
