"""Approximate nearest neighbours: balanced posting lists whose centroids are searched through an in-memory graph.

Vectors near a boundary stand in several lists. A query takes the lists whose centroids are not much farther than its
nearest one; how much, is measured against the exact neighbours of a sample of queries when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, table

#: Vectors a list, about, and lists at most; beyond, lists are longer. The graph and the centroids are held by every task.
LIST, MOST_LISTS, CENTROID_BYTES = 256, 16_384, 64 << 20
#: Vectors from which centroids are fitted, at most, for each list and in bytes.
SAMPLE_A_LIST, SAMPLE_BYTES = 64, 64 << 20
#: A vector stands in at most REPLICAS lists, those whose centroids are at most 1 + BOUNDARY times as far as the nearest.
REPLICAS, BOUNDARY = 4, 0.1
#: Neighbours of a centroid in the graph, and random links beside them.
LINKS, SHORTCUTS = 20, 4
#: Width of the graph search by which a vector finds its lists.
WIDTH = 16
#: Queries by which the distance ratio is set, and the share of their exact neighbours that it has to reach.
CALIBRATED, TARGET = 64, 0.97
#: Vectors of a list, and queries, that one comparison holds.
BLOCK, ASKED = 1024, 256


@dataclass
class Graph:
    """Centroids, the links of each, and the rows of each list (none before vectors are assigned)."""

    centroids: np.ndarray
    links: np.ndarray
    sizes: np.ndarray | None = None

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroids) of about the `width` nearest to each row of x, nearest first; fewer are padded with
        infinity. Beams of all rows go on together: each takes its nearest place not yet taken and looks at its links."""
        n, lists = len(x), len(self.centroids)
        width = min(width, lists)
        seen = np.zeros((n, lists), bool)
        begin = np.arange(0, lists, max(1, lists // 4))[:8]
        seen[:, begin] = True
        far = self._distance(x, np.repeat(np.arange(n), len(begin)), np.tile(begin, n)).reshape(n, -1)
        at, taken = np.tile(begin, (n, 1)), np.zeros((n, len(begin)), bool)
        live = np.arange(n)
        beams = np.full((n, width), np.inf), np.zeros((n, width), np.int64)
        while len(live):
            order = np.argsort(far, 1, kind="stable")[:, :width]
            far, at, taken = (np.take_along_axis(m, order, 1) for m in (far, at, taken))
            waiting = ~taken & np.isfinite(far)
            on = waiting.any(1)
            for beam, now in zip(beams, (far, at), strict=True):
                beam[live[~on], : now.shape[1]] = now[~on]
            live, far, at, taken, waiting = live[on], far[on], at[on], taken[on], waiting[on]
            if not len(live):
                break
            first = waiting.argmax(1)
            taken[np.arange(len(live)), first] = True
            to = self.links[at[np.arange(len(live)), first]]
            fresh = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            row, link = np.nonzero(fresh)
            more = np.full(to.shape, np.inf)
            more[row, link] = self._distance(x, live[row], to[row, link])
            far, at, taken = np.hstack((far, more)), np.hstack((at, to)), np.hstack((taken, np.zeros(to.shape, bool)))
        return beams

    def _distance(self, x: np.ndarray, row: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[row] - self.centroids[centroid]) ** 2).sum(1))

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each row of x stands in: the nearest, and others within the boundary that no list already chosen
        is nearer to than the row itself, so that replicas lie in different directions."""
        far, at = self.search(x, WIDTH)
        out = []
        for distance, near in zip(far, at, strict=True):
            chosen = [near[0]]
            for d, c in zip(distance[1:], near[1:], strict=True):
                if len(chosen) == REPLICAS or not d <= (1 + BOUNDARY) * distance[0]:
                    break
                if ((self.centroids[chosen] - self.centroids[c]) ** 2).sum(1).min() >= d * d:
                    chosen.append(c)
            out.append(np.array(chosen))
        return out

    def lists_for(self, x: np.ndarray, ratio: float, least: int) -> list[np.ndarray]:
        """The lists that each query takes: all with a centroid within `ratio` times the distance of the nearest, and more
        until they hold `least` rows. The beam is widened until it reaches beyond both."""
        out: list = [None] * len(x)
        todo, width = np.arange(len(x)), 2 * WIDTH
        while len(todo):
            far, at = self.search(x[todo], width)
            rows = np.cumsum(np.where(np.isfinite(far), self.sizes[at], 0), 1)
            wanted = np.isfinite(far) & ((far <= ratio * far[:, :1]) | (rows - self.sizes[at] < least))
            ready = ~wanted.all(1) | (width >= len(self.centroids))
            for i in np.flatnonzero(ready):
                out[todo[i]] = at[i][wanted[i]]
            todo, width = todo[~ready], 2 * width
        return out


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of `lists` parts of x of equal size, by halving: each part is cut at the median between its two means."""
    draw, parts = np.random.default_rng(3), [(np.arange(len(x)), min(lists, len(x)))]
    out = []
    while parts:
        rows, n = parts.pop()
        if n <= 1:
            out.append(x[rows].mean(0))
            continue
        y = x[rows]
        two = y[draw.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = ((y - two[1]) ** 2).sum(1) < ((y - two[0]) ** 2).sum(1)
            if side.all() or not side.any():
                break
            two = np.stack((y[~side].mean(0), y[side].mean(0)))
        left = n // 2
        order, cut = np.argsort(y @ (two[1] - two[0]), kind="stable"), len(y) * left // n
        parts += [(rows[order[:cut]], left), (rows[order[cut:]], n - left)]
    return np.unique(np.array(out), axis=0)


def linked(centroids: np.ndarray) -> Graph:
    """The graph of centroids: each one's nearest, a ring so that all can be reached, and random shortcuts."""
    n, draw = len(centroids), np.random.default_rng(5)
    near, half = min(LINKS, n - 1), (centroids**2).sum(1) / 2
    links = np.zeros((n, near + 1 + SHORTCUTS), np.int64)
    for i in range(0, n, 1024):
        d = half[None] - centroids[i : i + 1024] @ centroids.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        if near:
            links[i : i + 1024, :near] = np.argpartition(d, near - 1, 1)[:, :near]
    links[:, near] = (np.arange(n) + 1) % n
    links[:, near + 1 :] = draw.integers(0, n, (n, SHORTCUTS))
    # a link that stands twice counts once
    links.sort(1)
    repeats = np.zeros(links.shape, bool)
    repeats[:, 1:] = links[:, 1:] == links[:, :-1]
    return Graph(centroids, np.where(repeats, np.arange(n)[:, None], links))


@dataclass
class Index:
    """vectors (vec_id, v), postings (list, vec_id, v), the graph, the ratio of distances within which lists are taken, and
    the share of the calibrating queries' exact neighbours that this ratio reaches (null without queries)."""

    vectors: DataFrame
    postings: DataFrame
    graph: Graph
    ratio: float
    recall: float | None


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part. See build_index for the others."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares summed in the order of the components as a plain loop does."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def _best(distance: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, distance) of each row's k nearest but its own, ties to the smaller id."""
    distance = np.where(ids[None] == own[:, None], np.inf, distance)
    if distance.shape[1] > k:
        limit = np.partition(distance, k - 1, 1)[:, k - 1 : k]
        row, col = np.nonzero((distance <= limit) & np.isfinite(distance))
    else:
        row, col = np.nonzero(np.isfinite(distance))
    order = np.lexsort((ids[col], distance[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[col[keep]], distance[row[keep], col[keep]]


_FOUND = "query_id long, vec_id long, score double"


def _found(query_ids: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; a replica counts once."""
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) by comparing a set of queries (vec_id, v) of bounded size with all vectors."""
    held = queries.toArrow()
    if not len(held):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(held["v"][0])
    asked = queries.sparkSession.sparkContext.broadcast((held["vec_id"].to_numpy(), _matrix(held["v"].combine_chunks(), dim)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                own = part["vec_id"].to_numpy()
                yield _found(ids, *_best(_distances(q, _matrix(part["v"], dim)), own, ids, k))

    return _ranked(vectors.select("vec_id", "v").mapInArrow(compare, _FOUND), k)


def _sampled(vectors: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    """About `most` of n vectors, by a hash of their ids; all, if there are no more."""
    order = F.xxhash64(F.lit(seed), "vec_id")
    share = min(1.0, most / max(1, n))
    return vectors if share == 1 else vectors.where(order < F.lit(int(-(2**63) + share * (2**64 - 1024))))


def build_index(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", list_size: int = LIST) -> Index:
    """The index of a table of vectors; `queries` says which of them are queries, and a sample of these sets the ratio.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id and those of
    another length than most (of equally frequent lengths the smaller). Repeated rows count once; of different vectors with
    one id the least in array order. Extra columns are left out; an empty table gives an index without rows.

    Centroids are fitted on a bounded sample in one task, by halving at medians, so lists are balanced; every vector is then
    assigned through the graph. A list that copies make long is compared in blocks like any other.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    usual = usable(vectors, vec_id, vector)
    rows = scratch.written(usual)
    by_length = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = Graph(np.zeros((0, 1)), np.zeros((0, 1), np.int64), np.zeros(0, np.int64))
    if by_length is None:
        return Index(rows, rows.select(F.lit(0).alias("list"), "vec_id", "v"), empty, 1.0, None)
    dim, n = by_length["dim"], by_length["count"]
    rows = rows.where(F.size("v") == dim)
    lists = int(max(1, min(-(-n // list_size), MOST_LISTS, CENTROID_BYTES // (8 * dim))))
    sample = _sampled(rows, min(lists * SAMPLE_A_LIST, SAMPLE_BYTES // (8 * dim)), n, 11)

    def fit(part: pa.Table) -> pa.Table:
        x = np.unique(_matrix(part["v"].combine_chunks(), dim), axis=0)
        x = x[np.argsort(np.random.default_rng(7).random(len(x)), kind="stable")]
        return pa.table({"v": balanced_centroids(x, lists).tolist()}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    centroids = sample.select("v", F.lit(0).alias("all")).groupBy("all").applyInArrow(fit, "v array<double>").toArrow()
    if not len(centroids):  # the hash left out all of very few vectors
        centroids = rows.orderBy("vec_id").limit(lists).select("v").toArrow()
    graph = linked(_matrix(centroids["v"].combine_chunks(), dim))
    shared = spark.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                chosen = shared.value.lists_of(_matrix(part["v"], dim))
                own = pa.array(np.repeat(np.arange(len(part)), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).astype(np.int32)), part["vec_id"].take(own), part["v"].take(own)], names=["list", "vec_id", "v"])

    postings = scratch.written(rows.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>"))
    sizes = postings.groupBy("list").count().toArrow()
    graph.sizes = np.zeros(len(graph.centroids), np.int64)
    graph.sizes[sizes["list"].to_numpy()] = sizes["count"].to_numpy()
    asking = rows.where(queries)
    ratio, reached = _calibrated(asking.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(CALIBRATED), rows, postings, graph, k)
    return Index(rows, postings, graph, ratio, reached)


def _calibrated(sample: DataFrame, rows: DataFrame, postings: DataFrame, graph: Graph, k: int) -> tuple[float, float | None]:
    """The ratio at which TARGET of the sample's exact neighbours stand in a list that is taken, and the share that do."""
    held = sample.toArrow()
    if not len(held):
        return 1.0, None
    x = _matrix(held["v"].combine_chunks(), len(held["v"][0]))
    far = np.sqrt(((x[:, None] - graph.centroids[None]) ** 2).sum(2)) if len(graph.centroids) * x.size < 1 << 22 else np.stack([np.sqrt(((graph.centroids - q) ** 2).sum(1)) for q in x])
    far /= np.maximum(far.min(1, keepdims=True), np.finfo(float).tiny)
    place = dict(zip(held["vec_id"].to_pylist(), range(len(x)), strict=True))
    met = exact_neighbours(sample, rows, k).join(postings.select("vec_id", "list"), "vec_id").select("query_id", "vec_id", "list").toArrow().to_pylist()
    needed: dict = {}
    for m in met:
        pair = m["query_id"], m["vec_id"]
        needed[pair] = min(needed.get(pair, np.inf), far[place[pair[0]], m["list"]])
    if not needed:
        return 1.0, None
    values = np.array(list(needed.values()))
    ratio = float(np.quantile(values, TARGET, method="higher")) * (1 + 1e-9)
    return ratio, float((values <= ratio).mean())


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, v), its own row left out, ties to the
    smaller id; fewer only if there are no more.

    A query is sent to the blocks of the lists it takes, and compared there with their vectors: a task holds at most about
    BLOCK vectors and ASKED queries of a list at once, however long the list or many the queries.
    """
    spark = queries.sparkSession
    if not len(index.graph.centroids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, shared, ratio = index.graph.centroids.shape[1], spark.sparkContext.broadcast(index.graph), index.ratio
    least = (k + 1) * REPLICAS  # k others, wherever their replicas stand

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ASKED):
                part = batch.slice(i, ASKED)
                chosen = shared.value.lists_for(_matrix(part["v"], dim), ratio, least)
                own = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).astype(np.int32)), part["vec_id"].take(pa.array(own))], names=["list", "query_id"])

    asked = Scratch(spark).written(queries.select("vec_id", "v").mapInArrow(choose, "list int, query_id long"))
    sizes = np.maximum(1, -(-index.graph.sizes // BLOCK))
    counts = asked.groupBy("list").count().toArrow()
    chunks = np.ones(len(sizes), np.int64)
    chunks[counts["list"].to_numpy()] = -(-counts["count"].to_numpy() // ASKED)
    # one row a list, of which there are at most MOST_LISTS
    plan = F.broadcast(spark.createDataFrame(pa.table({"list": np.arange(len(sizes), dtype=np.int32), "blocks": sizes, "chunks": chunks})))
    held = index.postings.join(F.broadcast(asked.select("list").distinct().limit(MOST_LISTS)), "list").join(plan, "list")
    held = held.select("list", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v")
    sent = asked.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").alias("chunk"), "query_id")
    sent = sent.join(queries.select(F.col("vec_id").alias("query_id"), "v"), "query_id")

    def compare(asking: pa.Table, near: pa.Table) -> pa.Table:
        out = []
        if len(asking) and len(near):
            ids, x = near["vec_id"].to_numpy(), _matrix(near["v"].combine_chunks(), dim)
            for i in range(0, len(asking), ASKED):
                part = asking.slice(i, ASKED)
                own = part["query_id"].to_numpy()
                out.append(_found(own, *_best(_distances(_matrix(part["v"].combine_chunks(), dim), x), ids, own, k)))
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    keys = ["list", "block", "chunk"]
    return _ranked(sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compare, _FOUND), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that were found."""
    pairs = exact.select("query_id", "vec_id")
    return pairs.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / max(1, pairs.count())


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, among all others."""
    index = build_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(index, index.vectors.where("vec_id % 100 = 0"))
