"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Exact copies of a shingle set form a class first, by a 128-bit digest; only classes are searched. In each of a number of
independent trees a class follows paths of minwise tokens: a node picks one or two coordinates of the minwise signature,
as many as keep a link at the threshold alive (1 / threshold on average), and its members part by their values there. All
levels of a path are followed in one step, so only leaves are exchanged; nodes with the same members are kept once.

The members of a leaf are first compared with its least member. That joins most of what belongs together in linear work,
and leaves that are one component by then are settled. In the others every member is compared with all members outside
its own component: by signatures first, then by full shingle sets. Comparison is cut into tiles of bounded size, and a
tile returns a spanning forest of the links it finds, so no step makes all pairs of a group as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, runs, small, small_batches, table, text_bytes
from quarry.llm.components import components
from quarry.llm.hashing import constants, mix, shingle_lists, split_words

#: Words of a shingle; links need SIMILAR of DIFFERENT of the union in common.
SHINGLE, SIMILAR, DIFFERENT = 5, 75, 100
#: Minwise coordinates; share of pairs at exactly the threshold that may meet in no tree.
COORDINATES, MISSED = 64, 1e-4
#: Paths are as long as parts a corpus into FANOUT ** depth, and LEAST_DEPTH at least.
FANOUT, LEAST_DEPTH = 64, 3
#: Members of a side of a tile; members of a node beyond which it branches on, REPEATS times STEPS levels, ROUNDS times at
#: most. What is still larger is compared in tiles as well. A round of branching parts a pair with a chance of its own (0.00001
#: for one at the threshold), which planned() takes off what the trees may miss.
TILE, LARGE, STEPS, REPEATS, ROUNDS = 1024, 8192, 2, 12, 3
#: Pairs whose signatures agree in fewer coordinates are not compared as sets: 4.3 standard deviations below the threshold.
LEAST_AGREEING = 33
#: Bytes of text that are hashed at once; shingles of a tile that are sorted at once, about, and shared ones that are counted
#: at once: so a tile of long texts takes little more memory than its sets.
AT_ONCE, SORTED, COLUMNS = 1 << 18, 1 << 18, 1024

_SEEDS = constants(COORDINATES, 11)


def lost(similarity: float, depth: int) -> float:
    """Chance that two sets share no leaf of one tree, if each coordinate agrees with that probability."""
    dead = 0.0
    for _ in range(depth):
        parted = 1 - similarity * (1 - dead)
        dead = (2 * parted + parted * parted) / 3
    return dead


def missed(depth: int, trees: int, similarity: float = SIMILAR / DIFFERENT) -> float:
    """Chance that two sets share no leaf of any tree. Trees share the coordinates, of which a binomial number agree."""
    agree = (math.comb(COORDINATES, a) * similarity**a * (1 - similarity) ** (COORDINATES - a) for a in range(COORDINATES + 1))
    return sum(p * lost(a / COORDINATES, depth) ** trees for a, p in enumerate(agree))


def planned(classes: int) -> tuple[int, int]:
    """Depth and number of trees for so many classes: so many that trees and branching together miss no more than MISSED."""
    depth = max(LEAST_DEPTH, math.ceil(math.log(max(classes, 1), FANOUT)))
    allowed = MISSED - ROUNDS * missed(STEPS, REPEATS)
    return depth, next(t for t in range(1, 1000) if missed(depth, t) <= allowed)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row of the first, and the distinct shingles of each document, by runs of documents."""
    data, at = text_bytes(batch.column(0))
    for i, j in runs(at, AT_ONCE):
        words = split_words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower=True)
        yield i, [np.unique(s) for s in shingle_lists(words, SHINGLE)]


def _digest(found: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a set in two halves; None for the empty one."""
    if not len(found):
        return None, None
    halves = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return tuple(halves.view(np.int64).tolist())


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values of non-empty sets, a row for each."""
    joined = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((joined ^ (_SEEDS[k] >> np.uint64(1))) * _SEEDS[k], first) >> np.uint64(32)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves, counts, rows = [], [], []
        for _, sets in _sets(batch):
            full = [s for s in sets if len(s)]
            signed = iter(_signatures(full)) if full else iter(())
            for s in sets:
                halves.append(_digest(s))
                counts.append(len(s))
                rows.append(next(signed).tobytes() if len(s) else None)
        high, low = (pa.array([h[k] for h in halves], pa.int64()) for k in range(2))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(counts, pa.int64()), high, low, pa.array(rows, pa.binary())], names=["id", "body", "n_shingles", "high", "low", "signature"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each class, once for each task."""
    seen: set[int] = set()
    for batch in batches:
        classes, sets = [], []
        for i, found in _sets(batch):
            for c, s in zip(batch.column(1).slice(i, len(found)).to_pylist(), found, strict=True):
                if c not in seen:
                    seen.add(c)
                    classes.append(c)
                    sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "shingles"])


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def _signed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures of a binary column, a row for each."""
    data, at = text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint32).reshape(-1, COORDINATES)


def _follow(depth: int, repeats: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From members (key, class, signature) of nodes to members (key, class) of the nodes that lie depth levels below, in
    each of a number of independent trees below each node."""

    def chosen(key: np.ndarray, which: int) -> np.ndarray:
        return (mix(key + _SEEDS[which]) % np.uint64(COORDINATES)).astype(np.int64)

    trees = constants(repeats, 31)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed, classes = _signed(batch.column(2)).astype(np.uint64), np.asarray(batch.column(1))
            key = mix(_unsigned(batch.column(0))[None, :] + trees[:, None]).ravel()
            row = np.tile(np.arange(len(classes)), repeats)
            for _ in range(depth):
                # one coordinate always and a second at one node of three: 4 / 3 = 1 / 0.75 on average
                second = mix(key ^ _SEEDS[3]) % np.uint64(3) == 0
                parts = [(mix(key + signed[row, chosen(key, 0)] * _SEEDS[4]), row)]
                k, r = key[second], row[second]
                parts.append((mix((k ^ _SEEDS[5]) + signed[r, chosen(k, 1)] * _SEEDS[6]), r))
                key, row = (np.concatenate([p[x] for p in parts]) for x in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(classes[row])], names=["key", "class"])

    return followed


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one tile after another; they come sorted by tile, and a tile may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = np.asarray(rows.column("tile"))
            bounds = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist()]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                yield rows.slice(i, j - i)
            held = rows.slice(bounds[-1])
    if held is not None:
        yield held


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows on the left and on the right of a tile, and which pairs of them are of different components."""
    side, part = np.asarray(t.column("side")), np.asarray(t.column("component"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    return left, right, part[left][:, None] != part[right][None, :]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each tile that have a likely partner of another component on the other side. What was compared with
    a node's least member before is not likely any more. The tile is named by who is left, so equal tiles become one."""
    for t in _by_tile(batches):
        left, right, apart = _sides(t)
        tried = np.asarray(t.column("tried").cast(pa.uint8())).astype(bool)
        apart &= ~(tried[left][:, None] | tried[right][None, :])
        signed = _signed(t.column("signature"))
        x, y = signed[left], np.ascontiguousarray(signed[right].T)
        agree = np.zeros(apart.shape, np.uint8)
        for k in range(COORDINATES):
            agree += x[:, k][:, None] == y[k][None, :]
        apart &= agree >= LEAST_AGREEING
        keep = np.zeros(len(t), bool)
        keep[left[apart.any(1)]] = True
        keep[right[apart.any(0)]] = True
        if keep.any():
            rows = t.select(["class", "component", "side"]).filter(pa.array(keep)).combine_chunks()
            name = mix(mix(_unsigned(rows.column("class"))) + np.asarray(rows.column("side")).astype(np.uint64)).sum(dtype=np.uint64)
            tile = pa.array(np.full(len(rows), name, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([tile, *(rows.column(c).combine_chunks() for c in ("class", "component", "side"))], names=["tile", "class", "component", "side"])


def _in_common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shingles in common of each set on the left with each on the right; sets are sorted, and read range by range of values."""
    total = np.zeros((len(left), len(right)), np.int64)
    ranges = max(1, -(-sum(len(s) for s in sets) // SORTED))
    inner = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, inner).tolist(), len(s)] for s in sets]
    for r in range(ranges):
        part = [s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)]
        joined, owner = np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part])
        _, which, count = np.unique(joined, return_inverse=True, return_counts=True)
        shared = count > 1
        column, owner = (np.cumsum(shared) - 1)[which][shared[which]], owner[shared[which]]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for begin in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [begin, begin + COLUMNS])
            has = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - begin)), np.float32)
            has[owner[a:b], column[a:b] - begin] = 1
            total += (has[left] @ has[right].T).astype(np.int64)
    return total


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between the two sides of each tile."""
    for t in _by_tile(batches):
        left, right, apart = _sides(t)
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        common = _in_common(sets, left, right)
        found = apart & (DIFFERENT * common >= SIMILAR * (n[left][:, None] + n[right][None, :] - common))
        ids, parent = np.asarray(t.column("class")).tolist(), {p: p for p in np.asarray(t.column("component")).tolist()}
        part = np.asarray(t.column("component")).tolist()

        def root(p: int, parent: dict[int, int] = parent) -> int:
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        a, b = [], []
        for i, row in zip(left.tolist(), found, strict=True):
            for j in right[row].tolist():
                p, q = root(part[i]), root(part[j])
                if p != q:
                    parent[q] = p
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _split(n: str, hashed: str) -> F.Column:
    """Which of the parts of at most about TILE members a class falls into."""
    return F.pmod(F.xxhash64(F.lit(hashed), "class"), F.ceil(F.col(n) / TILE))


def _parts(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / TILE) - 1))


class _Search:
    """The classes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, scratch: Scratch) -> None:
        self.docs, self.scratch = docs, scratch
        grouped = sketches.where("high IS NOT NULL").groupBy("high", "low").agg(
            F.min("row").alias("class"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("first"), F.any_value("signature").alias("signature"), F.count("*").alias("copies")
        )
        self.classes = scratch.written(grouped.select("high", "low", "class", F.col("first.id").alias("least_id"), F.col("first.body").alias("body"), "signature", "copies"))
        self.searched = self.classes
        self.sets: DataFrame | None = None

    def nodes(self, members: DataFrame) -> DataFrame:
        """Members of the nodes that hold two classes or more, with the node's size and least member; of nodes with the same
        members one is left. Members are counted before they are exchanged, so a node of very many is not one task's work."""
        members = self.scratch.written(members)  # read twice, and made by long paths
        counted = members.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("least"), F.bit_xor(F.xxhash64("class")).alias("mark"))
        # 64 bits do: they are compared only among nodes of one size and least member, and a class is in few nodes
        unlike = counted.where("size > 1").groupBy("size", "least", "mark").agg(F.min("key").alias("key"))
        return members.join(unlike.select("key", "size", "least"), "key")

    def below(self, members: DataFrame, depth: int, repeats: int) -> DataFrame:
        return members.select("key", "class", "signature").mapInArrow(_follow(depth, repeats), "key long, class long")

    def likely(self, tiles: DataFrame) -> DataFrame:
        """The rows of tiles (tile, class, component, side, tried) that have a likely partner."""
        signed = tiles.join(self.searched.select("class", "signature"), "class").repartition("tile").sortWithinPartitions("tile")
        found = signed.select("tile", "class", "component", "side", "tried", "signature").mapInArrow(_likely, "tile long, class long, component long, side int")
        return self.scratch.written(found.distinct())

    def linked(self, tiles: DataFrame) -> DataFrame:
        """Links between the two sides of tiles (tile, class, component, side), by full sets."""
        # a class has several sets only where one row of the table is repeated. They are made one in the exchange that the join
        # needs, so that sets are exchanged once here and not once more before
        sets = self.sets.groupBy("class").agg(F.any_value("shingles").alias("shingles"))
        full = tiles.join(sets, "class").repartition("tile").sortWithinPartitions("tile")
        return self.scratch.written(full.select("tile", "class", "component", "side", "shingles").mapInArrow(_linked, "a long, b long"))

    def stars(self, nodes: DataFrame) -> DataFrame:
        """Tiles that compare the least member of each node, on the left, with its other members."""
        spokes = self.scratch.written(nodes.where("`class` != least").select("least", "class").distinct())
        counted = spokes.groupBy("least").agg(F.count("*").alias("n"))
        right = spokes.join(counted, "least").select(F.xxhash64("least", _split("n", "star")).alias("tile"), "class", F.lit(1).alias("side"))
        left = counted.select(_parts("n").alias("part"), F.col("least").alias("class")).select(F.xxhash64("class", "part").alias("tile"), "class", F.lit(0).alias("side"))
        return left.union(right).select("tile", "class", F.col("class").alias("component"), "side", F.lit(False).alias("tried"))

    def tiles(self, mixed: DataFrame) -> DataFrame:
        """Tiles that compare what lies outside the largest component of each node, on the left, with all its members."""
        parts = mixed.groupBy("key", "component").agg(F.count("*").alias("n"))
        main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
        rows = mixed.join(main, "key").withColumn("other", F.col("component") != F.col("main"))
        shown = ("class", "component", F.col("side").cast("int").alias("side"), (F.col("class") == F.col("least")).alias("tried"))
        # a node of one tile holds each member once: on both sides, or on the right only
        few = rows.where(f"size <= {TILE}").withColumn("side", F.when(F.col("other"), 2).otherwise(1)).select(F.col("key").alias("tile"), *shown)
        many = rows.where(f"size > {TILE}").withColumns({"of_left": _split("others", "left"), "of_right": _split("size", "right")})
        left = many.where("other").withColumn("of_right", _parts("size"))
        right = many.withColumn("of_left", _parts("others"))
        large = left.withColumn("side", F.lit(0)).union(right.withColumn("side", F.lit(1)).select(*left.columns, "side"))
        return few.union(large.select(F.xxhash64("key", "of_left", "of_right").alias("tile"), *shown))

    def mixed(self, nodes: DataFrame, known: DataFrame) -> DataFrame:
        """Members, with their components so far, of the nodes that hold two or more of them."""
        labelled = nodes.join(known, nodes["class"] == known["node"], "left").select("key", "class", "size", "least", F.coalesce("component", "class").alias("component"))
        spread = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
        return self.scratch.written(labelled.join(spread, "key"))

    def run(self) -> DataFrame:
        """(node, component) of the classes that have links."""
        depth, trees = planned(self.classes.count())
        nodes = self.scratch.written(self.nodes(self.below(self.classes.withColumn("key", F.lit(0).cast("long")), depth, trees)))
        # from here on only classes that are not alone in every node; there are far fewer of them
        met = small(self.scratch.written(nodes.select("class").distinct()))
        self.searched = self.scratch.written(self.classes.join(met, "class", "left_semi").select("class", "least_id", "body", "signature"))
        chosen = small(self.searched.select(F.col("least_id").alias("_id"), F.col("body").alias("_body"), "class"))
        texts = self.docs.join(chosen, (F.col("body") == F.col("_body")) & F.col("id").eqNullSafe(F.col("_id")))
        self.sets = self.scratch.written(texts.select("text", "class").mapInArrow(_full_sets, "class long, shingles binary"))

        links = self.linked(self.likely(self.stars(nodes)))
        known = self.scratch.written(components(links))
        unsettled = self.mixed(nodes, known)
        few, large = [unsettled.where(f"size <= {LARGE}")], unsettled.where(f"size > {LARGE}")
        for _ in range(ROUNDS):
            if large.isEmpty():
                break
            # the members of large nodes meet again in smaller ones
            signed = large.select("key", "class").join(self.searched.select("class", "signature"), "class")
            unsettled = self.mixed(self.nodes(self.below(signed, STEPS, REPEATS)), known)
            few.append(unsettled.where(f"size <= {LARGE}"))
            large = unsettled.where(f"size > {LARGE}")
        more = self.linked(self.likely(self.tiles(reduce(DataFrame.union, [*few, large]))))
        # links between components, and each class to its component
        return components(more.union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are parted by ASCII space and line controls, A to Z in lower case. Null texts and texts without words have no
    shingles, are linked with nothing and are kept; a text of fewer than five words is one shingle. component_id is the
    least doc_id that links reach, kept marks the row that has it. Rows with a null doc_id take part; component_id is null
    and kept true for them if no row with an id is reached. Repeated rows of one doc_id are each returned and share its
    fate. Extra columns are left out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("id")).withColumn("body", F.xxhash64("text"))
    sketched = rows.select("text", "id", "body").mapInArrow(_sketched, "id long, body long, n_shingles long, high long, low long, signature binary")
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sketches = kept.written(sketched.withColumn("row", F.monotonically_increasing_id()))
    search = _Search(rows, sketches, scratch)
    linked = search.run()
    classes = search.classes.select("high", "low", "class", "least_id", "copies")
    joined = classes.join(linked, classes["class"] == linked["node"], "left")
    # a class that nothing links is settled by its own least id, and needs no row here if it has no copies
    least = joined.where("node IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("component_id"))
    settled = joined.where("node IS NOT NULL").join(least, "component").select("high", "low", "component_id").union(joined.where("node IS NULL AND copies > 1").select("high", "low", "least_id"))
    settled = kept.written(settled)
    scratch.drop()
    found = sketches.select(F.col("id").alias(doc_id), "n_shingles", "high", "low").join(settled, ["high", "low"], "left")
    found = found.withColumn("component_id", F.coalesce("component_id", doc_id))
    return found.select(doc_id, "n_shingles", "component_id", F.col(doc_id).eqNullSafe(F.col("component_id")).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
