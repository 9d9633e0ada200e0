"""Shared parts of the oracle SQL, written independently of the operators. sql() puts a statement after the parts it names.

The fixed word lists and tables (stop words, categories, kernels, letters with marks) are shared with the operators, so the
SQL cannot find an error in those.
"""

from __future__ import annotations

from quarry.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def analyzed(source: str, key: str, text: str) -> str:
    return rf"""SELECT {key}, pos, form, stem FROM (
      SELECT {key}, pos, form, CASE WHEN ends_with(form, 'ing') THEN left(form, length(form) - 3) WHEN ends_with(form, 'ed') THEN left(form, length(form) - 2)
             WHEN ends_with(form, 's') THEN left(form, length(form) - 1) ELSE form END AS stem
      FROM (SELECT {key}, unnest(range(0, len(toks)))::INT AS pos, unnest(toks) AS form FROM (
        SELECT {key}, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_matches(t, '^[a-z]{{2,}}$')) AS toks FROM {source}))
      WHERE form NOT IN ({_STOP})) WHERE stem <> ''"""


def topk(source: str, keys: str, score: str, tie: str, k: int | None, rank: str = "rank") -> str:
    cut = "" if k is None else f" WHERE {rank} <= {k}"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, {tie}) AS {rank} FROM ({source})){cut}"


def retrieve(terms: str, k: int, keys: str = "qid") -> str:
    return topk(
        f"""SELECT {keys}, docid, round(sum(weight * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 6) AS score
        FROM {terms} JOIN freq USING (term) JOIN postings USING (term) JOIN doclen USING (docid), stats GROUP BY {keys}, docid""",
        keys, "score", "docid", k,
    )


def feedback(run: str, n: int) -> str:
    return f"""SELECT qid, docid, rank, score, CASE WHEN min(score) OVER (PARTITION BY qid) < 0 THEN exp(score - max(score) OVER (PARTITION BY qid)) / sum(exp(score - m)) OVER (PARTITION BY qid)
      WHEN sum(score) OVER (PARTITION BY qid) = 0 THEN 0 ELSE score / sum(score) OVER (PARTITION BY qid) END AS weight
      FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM {run} WHERE rank <= {n})"""


def rm3(run: str, fb_docs: int = 10, fb_terms: int = 15, alpha: str = "0.5e0") -> str:
    return topk(
        f"""SELECT qid, term, round(sum(part), 6) AS weight FROM (
          SELECT qid, stem AS term, {alpha} / count(*) OVER (PARTITION BY qid) AS part FROM qterms
          UNION ALL
          SELECT qid, term, (1 - {alpha}) * sum(f.weight * tf / dl) AS part FROM ({feedback(run, fb_docs)}) f JOIN postings USING (docid) JOIN doclen USING (docid) GROUP BY qid, term
        ) GROUP BY qid, term""",
        "qid", "weight", "term", fb_terms, "place",
    )


def hashed(source: str, key: str, text: str, dim: int = 64) -> str:
    """(key, v): texts as hashed bags of tokens at length 1."""
    return rf"""SELECT {key}, list_transform(range({dim}), lambda i: CASE WHEN len0 = 0 THEN 0 ELSE coalesce(cells[i], 0) / len0 END) AS v FROM (
      SELECT {key}, map_from_entries(list({{'k': dim, 'v': x}}) FILTER (dim IS NOT NULL)) AS cells, coalesce(sqrt(sum(x * x)), 0) AS len0 FROM (
        SELECT {key}, dim, sum(s)::DOUBLE AS x FROM (
          SELECT {key}, ('0x' || left(md5(tok), 4))::BIGINT % {dim} AS dim, 1 - 2 * (('0x' || substr(md5(tok), 5, 1))::BIGINT % 2) AS s FROM (
            SELECT {key}, unnest(CASE WHEN len(toks) = 0 THEN [NULL] ELSE toks END) AS tok FROM (
              SELECT {key}, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_matches(t, '^[a-z]{{2,}}$')) AS toks FROM {source}))) GROUP BY {key}, dim) GROUP BY {key})"""


PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "q": ((), "SELECT item_id AS qid, text AS query FROM benchmark"),
    "d": ((), "SELECT doc_id AS docid, text FROM documents"),
    "qterms": (("q",), analyzed("q", "qid", "query")),
    "dterms": (("d",), analyzed("d", "docid", "text")),
    "postings": (("dterms",), "SELECT stem AS term, docid, count(*) AS tf FROM dterms GROUP BY ALL"),
    "freq": (("postings",), "SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM postings GROUP BY term"),
    "doclen": (("postings",), "SELECT docid, sum(tf)::BIGINT AS dl FROM postings GROUP BY docid"),
    "stats": (("doclen",), "SELECT count(*) AS n, avg(dl) AS avgdl, sum(dl)::BIGINT AS total FROM doclen"),
    "qbag": (("qterms",), "SELECT qid, stem AS term, count(*)::DOUBLE AS weight FROM qterms GROUP BY ALL"),
    "run_a": (("qbag", "freq", "stats"), retrieve("qbag", 100)),
    "rm3t": (("run_a",), rm3("run_a")),
    "run_b": (("rm3t",), retrieve("rm3t", 100)),
    "qrels": (
        ("run_a",),
        """SELECT * FROM (SELECT qid, docid, CASE WHEN contains(lower(d.text), lower(left(query, 40))) THEN 2 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END AS grade
        FROM run_a JOIN q USING (qid) JOIN d USING (docid) LEFT JOIN labels ON labels.doc_id = docid) WHERE grade IS NOT NULL""",
    ),
    "vecs": ((), "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "dq": (("vecs",), "SELECT vec_id AS qid, v, label FROM vecs WHERE vec_id % 100 = 0"),
    "dd": (("vecs",), "SELECT vec_id AS docid, v, label FROM vecs"),
    "dqrels": (("dq", "dd"), "SELECT qid, docid, CASE WHEN dd.label = dq.label THEN 2 ELSE 1 END AS grade FROM dq JOIN dd ON abs(dd.label - dq.label) <= 1"),
    "tokvec": (("vecs",), "SELECT vec_id // 4 AS docid, (vec_id % 4)::INT AS pos, label AS tokid, v FROM vecs"),
    "qtok": (("tokvec",), "SELECT docid AS qid, pos AS qpos, tokid, 1e0 AS weight, v FROM tokvec WHERE docid % 25 = 0"),
    "history": ((), "SELECT event_type AS run, dayofyear(ts)::INT AS epoch, round(avg(value), 6) AS score FROM events GROUP BY ALL"),
}


def sql(needs: str, body: str, **more: str) -> str:
    """WITH the named parts and what they need, then `more` in order, then body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in PARTS[name][0]:
                need(other)
            order.append(name)

    for name in needs.split():
        need(name)
    parts = [f"{n} AS ({PARTS[n][1]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
