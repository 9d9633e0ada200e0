"""Repair of damaged conversations by the cheapest edits, found by a bidirectional Dijkstra search over the edit lattice."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import table

RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: What the roles so far lead to: nothing yet, after a system row, after a user row, after an assistant row.
_NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
_ENDS = ("-", "a")


def _forward(rows: str, at: int, state: str) -> Iterator[tuple[int, str, int, str, str]]:
    """Edges (cost, edit, next row, next state, role) from a place of the lattice. A row is two letters: the initial of its
    role (o for others), and b for a row that must go, t for one that is cut off, - for a sound one."""
    if 2 * at < len(rows):
        role, fault = rows[2 * at], rows[2 * at + 1]
        yield DELETE, "D", at + 1, state, ""
        if fault != "b":
            extra = UNFINISHED if fault == "t" else 0
            if (state, role) in _NEXT:
                yield extra, "K", at + 1, _NEXT[state, role], ""
            for to in "ua":
                if (state, to) in _NEXT:
                    yield RENAME + extra, "R", at + 1, _NEXT[state, to], to
    for to in "ua":
        if (state, to) in _NEXT:
            yield INSERT, "I", at, _NEXT[state, to], to


def _backward(rows: str, at: int, state: str) -> Iterator[tuple[int, str, int, str, str]]:
    """The edges that lead to a place: (cost, edit, row before, state before, role)."""
    for before in (at - 1, at):
        if before >= 0:
            for was in "-sua":
                for cost, edit, to, into, role in _forward(rows, before, was):
                    if to == at and into == state:
                        yield cost, edit, before, was, role


def repair(rows: str) -> tuple[int, list[tuple[str, int, str]]]:
    """The least cost and the edits (edit, row or -1, role or ""), of all cheapest ones those with the least audit.

    Both searches settle the nearer of their next places until their radii together exceed the best crossing, so every edge
    on a cheapest path has an end settled from the front and one settled from the back. The places of cheapest paths are then
    followed from the front, all that share the least audit so far at once.
    """
    last = len(rows) // 2
    near = [{}, {}]  # settled distances, from the front and from the back
    open_ = [{(0, "-"): 0}, {(last, s): 0 for s in _ENDS}]
    heaps = [[(0, 0, "-")], [(0, last, s) for s in _ENDS]]
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heapq.heappop(heaps[side])
        if (at, state) in near[side]:
            continue
        near[side][at, state] = cost
        best = min(best, cost + open_[1 - side].get((at, state), best))
        for more, _, to, into, _ in (_backward if side else _forward)(rows, at, state):
            if cost + more < open_[side].get((to, into), float("inf")):
                open_[side][to, into] = cost + more
                heapq.heappush(heaps[side], (cost + more, to, into))
                best = min(best, cost + more + open_[1 - side].get((to, into), best))
    # from the crossings back to the front: the settled places from which a cheapest path crosses over
    fore, back = near[0], open_[1]
    crossing, todo = set(), []
    for place, cost in fore.items():
        for more, _, to, into, _ in _forward(rows, *place):
            if cost + more + back.get((to, into), float("inf")) == best:
                todo.append(place)
        if back.get(place) == best - cost:
            todo.append(place)
    while todo:
        place = todo.pop()
        if place not in crossing:
            crossing.add(place)
            todo += [(b, s) for more, _, b, s, _ in _backward(rows, *place) if fore.get((b, s), float("inf")) + more == fore[place]]

    def on_path(cost: int, place: tuple[int, str]) -> bool:
        return cost + back.get(place, float("inf")) == best or (place in crossing and fore[place] == cost)

    # cost so far and the edits that led there, for each place that the least audit so far can be at
    here, edits = {(0, "-"): (0, None)}, None
    while True:
        done = [way for (at, state), (cost, way) in here.items() if at == last and state in _ENDS and cost == best]
        if done:
            edits = done[0]
            break
        steps = {}
        for (at, state), (cost, way) in here.items():
            for more, edit, to, into, role in _forward(rows, at, state):
                if on_path(cost + more, (to, into)):
                    steps.setdefault(edit, {}).setdefault((to, into), (cost + more, (way, (edit, at if edit != "I" else -1, role))))
        here = steps[min(steps)]
    out = []
    while edits:
        edits, step = edits
        out.append(step)
    return best, out[::-1]


def _repaired(rows: pd.Series) -> pd.DataFrame:
    known = {}  # conversations of one shape have one repair
    for r in rows:
        if r not in known:
            cost, edits = repair(r)
            known[r] = cost, [{"edit": e, "row": i, "role": {"u": "user", "a": "assistant", "": None}[to]} for e, i, to in edits]
    return pd.DataFrame([known[r] for r in rows], columns=["cost", "edits"])


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of rows (conv_id, turn, role, text, gone):
    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    A row that is gone counts for nothing but that its conversation is returned. Rows go by turn, nulls first, then by role and
    text, so ties and repeated rows have one order. Null roles and texts are one space; an empty role has no initial. Each
    row's first fault counts: blank, duplicate of an earlier row's role and text, truncated (not ended by . ! or ?). Gaps are the turns that lack between the
    first and the last; illegal counts neighbours whose initials are not su, ua or au. A conversation without rows has zeros,
    an empty audit and an empty text; a null conv_id is a conversation of its own; an empty table gives an empty result.
    Other columns are left out.

    One exchange, by conversation. Two letters a row go to the search, texts stay in the JVM; a conversation's repaired text is
    one value by contract, so a conversation must fit into a row.
    """
    kept = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    order = W.partitionBy("conv_id").orderBy("gone", "turn", "role", "text")
    kept = kept.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag(_initial(F.col("role"))).over(order))
    nth = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy("place"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    kept = kept.withColumn("nth", nth).withColumn("fault", fault)
    there, pair = ~F.col("gone"), F.concat(F.col("before"), _initial(F.col("role")))
    role = F.when(_initial(F.col("role")).isin("s", "u", "a"), _initial(F.col("role"))).otherwise("o")
    letters = F.concat(role, F.when(F.col("fault").isin("blank", "duplicate"), "b").when(F.col("fault") == "truncated", "t").otherwise("-"))
    count = lambda condition: F.count(F.when(there & condition, 1))
    turns = F.max(F.when(there, F.col("turn"))) - F.min(F.when(there, F.col("turn"))) + 1 - F.count_distinct(F.when(there, F.col("turn")))
    whole = kept.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(there, F.struct("place", letters.alias("letters"), "role", "text")))).alias("rows"),
    )
    search = F.pandas_udf(_repaired, "cost long, edits array<struct<edit: string, row: int, role: string>>")
    found = whole.withColumn("found", search(F.array_join(F.transform("rows", lambda r: r["letters"]), "")))
    shown = F.transform(F.filter("found.edits", lambda e: e["edit"] != "D"), lambda e: F.concat(F.coalesce(e["role"], F.get("rows", e["row"])["role"]), F.lit(":"), F.coalesce(F.get("rows", e["row"])["text"], F.lit(""))))
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("found.cost").alias("cost"),
        F.array_join(F.transform("found.edits", lambda e: e["edit"]), "").alias("audit"), F.array_join(shown, "\n").alias("repaired"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """conversations damaged row by row, by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops the row (gone), 1
    empties its text, 2 takes . ! and ? out of it, 3 repeats it, 4 makes it a user's."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"), "kind",
    )
    return changed.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy", "kind")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, described and repaired."""
    repaired = repair_conversations(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return repaired.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
