"""Queries over similarity-matrix features, mention scores and rescoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dense, late, lexical
from quarry.operators import interaction as op
from quarry.plans.dense import _COS, _MAXSIM, _RUN, _SIM, _candidates, _rescored, _run
from quarry.plans.prelude import sql, topk
from quarry.plans.tables import Tables


def _first(t: Tables) -> DataFrame:
    return late.maxsim(t.qtok, t.tokvec)


def _scored(t: Tables) -> DataFrame:
    """A supplied scorer of (query, text) pairs, a batch at a time: the cosine of the counts of their letters a to z, as a
    model would take two texts and give a number."""

    def letters(texts: pd.Series) -> np.ndarray:
        counts = np.zeros((len(texts), 26))
        for i, text in enumerate(texts):
            seen = np.frombuffer((text or "").lower().encode(), np.uint8)
            counts[i] = np.bincount(seen, minlength=256)[97:123]
        return counts

    @F.pandas_udf("double")
    def overlap(query: pd.Series, text: pd.Series) -> pd.Series:
        a, b = letters(query), letters(text)
        return pd.Series(np.round((a * b).sum(1) / np.maximum(np.sqrt((a * a).sum(1) * (b * b).sum(1)), 1e-9), 6))

    top = t.run_a.where("rank <= 10").select("qid", "docid").join(t.queries, "qid").join(t.docs, "docid")
    return top.select("qid", "docid", overlap("query", "text").alias("score"))


#: Weights that are supplied to nprf_score, by a rule.
WEIGHTS = {
    "w1": [[((3 * k + 5 * j) % 7 - 3) / 10 for k in range(11)] for j in range(5)], "b1": [0.05 * j for j in range(5)],
    "w2": [((2 * j) % 5 - 2) / 4 for j in range(5)], "b2": 0.1, "gate": 0.5, "out": [1.0, 0.5, 0.25], "bias": 0.2,
}

QUERIES = {
    "histogram_features": lambda t: op.histogram_features(t.qtok, t.tokvec, _candidates(t)),
    "kernel_features": lambda t: op.kernel_features(t.qtok, t.tokvec, _candidates(t)),
    "ceqe_centroid": lambda t: op.mention_scores(t.qtok, t.tokvec, _first(t)),
    "ceqe_term_max": lambda t: op.mention_scores(t.qtok, t.tokvec, _first(t), "max"),
    "ceqe_term_mul": lambda t: op.mention_scores(t.qtok, t.tokvec, _first(t), "mul"),
    "nprf_score": lambda t: op.nprf_score(_first(t), t.tokvec, WEIGHTS),
    "unique_expansion_terms": lambda t: op.new_terms(t.rm3_terms, lexical.query_terms(t.queries)),
    "max_passage_rescore": lambda t: op.max_passage(t.run_a.where("rank <= 10"), t.queries, t.docs),
    "pair_rescore": lambda t: dense.rescore(_run(t), t.dq, t.dd, 100, "dot"),
    "scorer_udf": _scored,
}

_MENTION = {
    **_SIM,
    "firsts": f"SELECT qid, docid, rank, exp(score - max(score) OVER (PARTITION BY qid)) AS r FROM ({_MAXSIM.format(s='sims')}) WHERE rank <= 3",
    "fed": "SELECT qid, docid, r / sum(r) OVER (PARTITION BY qid) AS post FROM firsts",
}


def _mentions(q: str, pooled: str = "max") -> str:
    return f"""SELECT qid, tokid, round({pooled}(s), 6) AS score FROM (SELECT qid, qpos, tokid, sum(post * CASE WHEN total > 0 THEN mass / total ELSE 0 END) AS s FROM (
      SELECT *, sum(mass) OVER (PARTITION BY qid, qpos, docid) AS total FROM (SELECT f.qid AS qid, qpos, f.docid AS docid, post, d.tokid AS tokid, sum(greatest(0, {_COS.format(a='q', b='d.v')})) AS mass
      FROM fed f JOIN tokvec d ON d.docid = f.docid JOIN ({q}) USING (qid) GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL"""


_CENTRE = "SELECT qid, 0 AS qpos, list(x ORDER BY dim) AS q FROM (SELECT qid, dim, avg(x) AS x FROM (SELECT qid, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM qtok) GROUP BY ALL) GROUP BY qid"
_KERNELS = ", ".join(f"({k}, {m}e0, {'1e-5' if k == 0 else '0.1e0'})" for k, (m, _) in enumerate(op.KERNELS))
_LETTERS = "list_transform(range(97, 123), lambda c: (length(lower(coalesce({x}, ''))) - length(replace(lower(coalesce({x}, '')), chr(c::INT), '')))::DOUBLE)"
_TOKS = r"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_matches(t, '^[a-z]{{2,}}$'))"
SQL = {
    "histogram_features": sql("qtok", "SELECT qid, docid, qpos, bin, round(ln(1 + count(*)), 6) AS value FROM (SELECT qid, docid, qpos, greatest(0, least(29, floor((round(sim, 9) + 1) / 2 * 29)))::BIGINT AS bin FROM csims) GROUP BY ALL", **_SIM),
    "kernel_features": sql("qtok", f"SELECT qid, docid, kernel, round(sum(0.01e0 * ln(greatest(soft, 1e-10))), 6) AS value FROM (SELECT qid, docid, qpos, kernel, sum(exp(-(sim - mu) * (sim - mu) / (2 * sigma * sigma))) AS soft FROM csims, (VALUES {_KERNELS}) k(kernel, mu, sigma) GROUP BY ALL) GROUP BY ALL", **_SIM),
    "ceqe_centroid": sql("qtok", _mentions(_CENTRE), **_MENTION),
    "ceqe_term_max": sql("qtok", _mentions("SELECT qid, qpos, v AS q FROM qtok WHERE tokid NOT IN (101, 102, 103, 1, 2)"), **_MENTION),
    "ceqe_term_mul": sql("qtok", _mentions("SELECT qid, qpos, v AS q FROM qtok WHERE tokid NOT IN (101, 102, 103, 1, 2)", "product"), **_MENTION),
    "nprf_score": sql(
        "qtok", topk("SELECT qid, docid, round(0.2e0 + sum(out * 0.5e0 * scaled * s), 6) AS score FROM nfb JOIN nrun USING (qid) JOIN ns USING (fb, docid) GROUP BY qid, docid", "qid", "score", "docid", None), **_SIM,
        nrun=f"SELECT qid, docid, rank, score FROM ({_MAXSIM.format(s='sims')}) WHERE rank <= 20",
        nfb="SELECT qid, docid AS fb, [1.0e0, 0.5e0, 0.25e0][rank] AS out, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.75e0 ELSE 0.5e0 + 0.5e0 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled FROM nrun WHERE rank <= 3 WINDOW w AS (PARTITION BY qid)",
        nsims="SELECT fb, a.pos AS apos, p.docid AS docid, list_dot_product(a.v, b.v) AS sim FROM (SELECT DISTINCT fb, nrun.docid AS docid FROM nfb JOIN nrun USING (qid)) p JOIN tokvec a ON a.docid = p.fb JOIN tokvec b ON b.docid = p.docid",
        nk=f"SELECT fb, docid, kernel, round(sum(0.01e0 * ln(greatest(soft, 1e-10))), 6) AS value FROM (SELECT fb, docid, apos, kernel, sum(exp(-(sim - mu) * (sim - mu) / (2 * sigma * sigma))) AS soft FROM nsims, (VALUES {_KERNELS}) k(kernel, mu, sigma) GROUP BY ALL) GROUP BY ALL",
        nh="SELECT fb, docid, j, tanh(sum(value * ((3 * kernel + 5 * j) % 7 - 3) / 10e0) + 0.05e0 * j) AS h FROM nk, (SELECT unnest(range(5)) AS j) GROUP BY fb, docid, j",
        ns="SELECT fb, docid, sum(h * ((2 * j) % 5 - 2) / 4e0) + 0.1e0 AS s FROM nh GROUP BY fb, docid",
    ),
    "scorer_udf": sql(
        "run_a", "SELECT qid, docid, round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 1e-9), 6) AS score FROM run_a JOIN lq USING (qid) JOIN ld USING (docid) WHERE rank <= 10",
        lq=f"SELECT qid, {_LETTERS.format(x='query')} AS a FROM q", ld=f"SELECT docid, {_LETTERS.format(x='text')} AS b FROM d WHERE docid IN (SELECT docid FROM run_a WHERE rank <= 10)",
    ),
    "unique_expansion_terms": sql("rm3t", topk("SELECT qid, term, weight FROM rm3t WHERE length(term) > 1 AND (qid, term) NOT IN (SELECT (qid, term) FROM qbag)", "qid", "weight", "term", 10, "place")),
    "pair_rescore": sql("dq dd", _rescored("run", "dq", "list_dot_product({a}, {b})", 100), **_RUN),
    "max_passage_rescore": sql(
        "run_a", topk("SELECT qid, docid, coalesce(best, score) AS score FROM top10 LEFT JOIN best USING (qid, docid)", "qid", "score", "docid", None),
        top10="SELECT qid, docid, score FROM run_a WHERE rank <= 10",
        u=r"SELECT docid, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\.[\s]+|\n'), lambda s: trim(s)), lambda s: s != '') AS units FROM d WHERE docid IN (SELECT docid FROM top10)",
        p="SELECT docid, array_to_string(units[i * 5 + 1 : i * 5 + 10], '. ') AS passage FROM (SELECT docid, units, unnest(range(0, greatest(0, ceil((len(units) - 10) / 5))::BIGINT + 1)) AS i FROM u WHERE len(units) > 0)",
        best=f"SELECT qid, docid, max(len(list_intersect(list_distinct({_TOKS.format(x='query')}), list_distinct({_TOKS.format(x='passage')}))))::DOUBLE AS best FROM top10 JOIN p USING (docid) JOIN q USING (qid) GROUP BY qid, docid",
    ),
}
