"""Problem 8: filling containers of fixed capacity with texts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.tokens import VOCABULARY, token_counts
from qaloom.operators.rows import rank_within
from qaloom.plans.staging import staged
from qaloom.sources.tables import table

Pattern = tuple[tuple[int, int], ...]  # (size, how often) of one container


class _Sizes:
    """A histogram of sizes with the sizes at hand in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: k for s, k in counts.items() if k > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest_to(self, limit: int, besides: int = 0) -> int | None:
        """The largest size within `limit`; of the size `besides` one item is spoken for."""
        at = bisect_left(self.order, limit + 1) - 1
        while at >= 0 and self.order[at] == besides and self.n[besides] < 2:
            at -= 1
        return self.order[at] if at >= 0 else None

    def smallest_two(self, besides: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(2, self.n[s] - (s == besides))
            if len(out) >= 2:
                break
        return out[:2]


def _best_two(sizes: _Sizes, limit: int, besides: int) -> int:
    """The greatest total within `limit` of two items, 0 if no two fit."""
    order, best = sizes.order, 0
    low, high = 0, bisect_left(order, limit) - 1
    while low <= high:
        a, b = order[low], order[high]
        enough = sizes.n[a] - (a == besides) >= (2 if a == b else 1) and sizes.n[b] - (b == besides) >= 1
        if a + b > limit:
            high -= 1
        else:
            if enough:
                best = max(best, a + b)
            low += 1
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Containers that some best filling has, with how often, and the sizes that are left.

    Martello and Toth: a set dominates another if each item of the other can be put, alone or with others, in the place
    of an item of it that is as large. For a size j from the largest on: {j} dominates if nothing fits beside it;
    {j, k}, with k the largest that fits beside j, dominates if k fills the container, if no two items fit beside j, or
    if no two items that fit are together larger than k and no three fit. Each is fixed as often as its sizes allow, and
    the smaller instance is looked at again until no set dominates.
    """
    sizes, fixed = _Sizes(counts), []
    changed = True
    while changed:
        changed = False
        for j in reversed(list(sizes.order)):
            while sizes.n.get(j):
                room = capacity - j
                k = sizes.largest_to(room, besides=j)
                if k is None:
                    times = sizes.n[j]
                    fixed.append((((j, 1),), times))
                    sizes.take(j, times)
                    changed = True
                    break
                two = sizes.smallest_two(besides=j)
                pair = k == room or len(two) < 2 or sum(two) > room or (3 * two[0] > room and _best_two(sizes, room, j) <= k)
                if not pair:
                    break
                times = sizes.n[j] // 2 if j == k else min(sizes.n[j], sizes.n[k])
                if k != room:
                    times = 1 if len(sizes.order) < 3 else times
                fixed.append((((j, 2),) if j == k else ((j, 1), (k, 1)), times))
                sizes.take(j, 2 * times if j == k else times)
                if j != k:
                    sizes.take(k, times)
                changed = True
    return fixed, dict(sizes.n)


@dataclass
class _Open:
    """Containers alike, by what is in them and by the room they have."""

    groups: dict[int, list[tuple[dict[int, int], int]]] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)

    def add(self, room: int, inside: dict[int, int], times: int) -> None:
        if room not in self.groups:
            self.groups[room] = []
            insort(self.rooms, room)
        self.groups[room].append((inside, times))

    def pop(self, size: int) -> tuple[int, dict[int, int], int] | None:
        """A group of the fullest containers that hold one more of `size`."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        inside, times = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room]
            self.rooms.pop(at)
        return room, inside, times


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the histogram: items of a size go at once into the fullest containers that hold them.

    A step uses up the items of the size or a whole group of like containers, so the groups stay under three times the
    number of sizes, whatever the number of items.
    """
    state = _Open()
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        n = counts[size]
        while n:
            got = state.pop(size)
            if got is None:
                per = capacity // size
                if n >= per:
                    state.add(capacity - per * size, {size: per}, n // per)
                if n % per:
                    state.add(capacity - (n % per) * size, {size: n % per}, 1)
                break
            room, inside, times = got
            used = min(n, times)
            if used < times:
                state.add(room, inside, times - used)
            state.add(room - size, {**inside, size: inside.get(size, 0) + 1}, used)
            n -= used
    return [(tuple(sorted(inside.items(), reverse=True)), times) for groups in state.groups.values() for inside, times in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of containers with how often, for the histogram of sizes from 1 to the capacity."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: first rank of each stretch, first container of it, items of the size in a container."""
    out: dict[int, tuple[list, list, list, int]] = {}
    base = 0
    for pattern, times in patterns:
        for size, per in pattern:
            starts, bases, pers, at = out.get(size, ([], [], [], 0))
            starts.append(at)
            bases.append(base)
            pers.append(per)
            out[size] = (starts, bases, pers, at + per * times)
        base += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in v[:3]) for s, v in out.items()}


def pack(documents: DataFrame, capacity: int) -> DataFrame:
    """`container`, `doc_id`, `piece`, `first_token`, `tokens`: every text of `documents` (`doc_id`, `tokens`) in a container.

    A text beyond the capacity is cut into pieces of the capacity and a rest; no other is divided. Texts of no tokens,
    and null counts, are in no container; an empty table gives an empty one; repeated ids are packed each.

    Only the histogram of sizes, at most `capacity` rows, goes to the driver. There dominance fixes what it can and
    best-fit the rest, as patterns with multiplicities: their number is bounded by the sizes, not by the texts. A
    text's rank among those of its size, counted without gathering a frequent size, then gives its container.
    """
    c = F.lit(capacity)
    cut = documents.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / c).cast("int"))).alias("piece"))
    items = staged(cut.select("doc_id", "piece", (F.col("piece") * c).cast("bigint").alias("first_token"), F.least(c, F.col("tokens") - F.col("piece") * c).cast("bigint").alias("tokens")))
    counts = {int(r["tokens"]): int(r["n"]) for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = items.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))  # bounded by the capacity
    ranked = rank_within(items, "tokens", [F.col("doc_id"), F.col("piece")], F.col("doc_id"), "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = places.value
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            sizes, ranks = pdf["tokens"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                starts, bases, pers = at[int(size)]
                k = np.searchsorted(starts, ranks[rows], "right") - 1
                container[rows] = bases[k] + (ranks[rows] - starts[k]) // pers[k]
            yield pdf.drop(columns="rank").assign(container=container)[["container", "doc_id", "piece", "first_token", "tokens"]]

    return ranked.select("doc_id", "piece", "first_token", "tokens", "rank").mapInPandas(run, "container bigint, doc_id bigint, piece int, first_token bigint, tokens bigint")


def p8_containers(spark: SparkSession, sf_dir: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """The texts of documents in containers of 2,048 tokens."""
    counted = token_counts(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), vocabulary)
    return pack(counted, capacity)


def p8_fill(spark: SparkSession, sf_dir: str, capacity: int = 2048) -> DataFrame:
    """Containers, tokens, the share of the capacity used, and the least number of containers there could be."""
    by = p8_containers(spark, sf_dir, capacity).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    total = F.sum("tokens")
    return by.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), F.max("tokens").alias("fullest"), (total / (F.count(F.lit(1)) * capacity)).alias("used"), F.ceil(total / capacity).alias("least_containers"))
