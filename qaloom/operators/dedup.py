"""Removal of repeated records: exact, near by shingles, fuzzy by edit distance; the first record wins."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import squeeze
from qaloom.operators.graph import link_components
from qaloom.plans.staging import settled, staged


def question_hash(question: Column) -> Column:
    """md5 of the question in lower case with single blanks; punctuation counts."""
    return F.md5(squeeze(F.lower(question)))


def exact_dedup(records: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay. Of a hot key each task sends on its first row alone."""
    keyed = records.withColumn("_key", key)
    first = keyed.where(F.col("_key").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return first.where("_r = 1").drop("_key", "_r").unionByName(keyed.where(F.col("_key").isNull()).drop("_key"))


def first_wins(nodes: DataFrame, links: DataFrame, grouped: int = 5_000) -> DataFrame:
    """`node` and `kept`: a node falls if an earlier node that is kept is linked to it.

    `nodes` has `node`, an orderable position; `links` has `a` < `b`. Components of up to `grouped` links are each gone
    through in order inside one task, so chains cost no rounds. Links of larger ones are decided in rounds to a fixpoint:
    a node without undecided or kept earlier neighbours is kept, one with a kept neighbour falls.
    """
    links = staged(links.where("a < b").select("a", "b").distinct())
    kind = nodes.schema["node"].dataType.simpleString()
    roots = staged(link_components(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), links))
    rooted = staged(links.join(roots.withColumnRenamed("node", "a"), "a"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    small, large = (rooted.join(sizes.where(c), "root", "left_semi") for c in (F.col("n") <= grouped, F.col("n") > grouped))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        here = None
        for pdf in batches:  # links of a component in the order of their later end
            out = []
            for root, b, earlier in zip(pdf["root"], pdf["b"], pdf["earlier"], strict=True):
                if root != here:
                    here, kept = root, {}
                for a in earlier:
                    if a not in kept:
                        kept[a] = True
                        out.append((a, True))
                kept[b] = not any(kept[a] for a in earlier)
                out.append((b, kept[b]))
            yield pd.DataFrame(out, columns=["node", "new"])

    per = small.groupBy("root", "b").agg(F.sort_array(F.collect_list("a")).alias("earlier")).repartition("root").sortWithinPartitions("root", "b")
    decided = staged(per.mapInPandas(walk, f"node {kind}, new boolean"))
    links = staged(large.select("a", "b"))
    touched = links.select(F.col("b").alias("node")).distinct()
    state = nodes.select("node").distinct().join(decided, "node", "left").join(touched.withColumn("_t", F.lit(True)), "node", "left")
    links, state = settled(links), settled(state.select("node", F.coalesce("new", F.when(F.col("_t").isNull(), True)).alias("kept")))
    while not state.where("kept IS NULL").isEmpty():
        known = state.select(F.col("node").alias("a"), F.col("kept").alias("ka"))
        undecided = state.where("kept IS NULL").select(F.col("node").alias("b"))
        seen = links.join(undecided, "b").join(known, "a").groupBy("b").agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("falls"), F.bool_or(F.col("ka").isNull()).alias("waits"))
        new = seen.where("falls OR NOT waits").select(F.col("b").alias("node"), (~F.col("falls")).alias("new"))
        state = settled(state.join(new, "node", "left").select("node", F.coalesce("kept", "new").alias("kept")))
    return state


class _WordHashes(dict):
    """64-bit hashes of words, kept while a task runs."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def _shingle_hashes(text: str, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words in lower case: a polynomial in the hashes of the words."""
    w = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(32)
    return np.unique((out * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64))


#: Length of the table in which pieces of text are counted: its size is fixed, whatever the data.
COUNTERS = 1 << 20


def piece_counts(pieces: DataFrame) -> np.ndarray:
    """How often hashes `h` (an array a row) fall on each of COUNTERS places: an order of pieces, rare ones first."""
    slot = F.pmod(F.col("k"), F.lit(COUNTERS))
    counts = np.zeros(COUNTERS, dtype=np.int64)
    found = pieces.select(F.explode("h").alias("k")).groupBy(slot.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # COUNTERS rows at most
    counts[found["b"].to_numpy()] = found["n"].to_numpy()
    return counts


def rare_first(h: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The `keep` rarest of the hashes."""
    return h[np.lexsort((h, counts[h % COUNTERS]))[:keep]]


#: Bands and rows of 128 minima that serve a threshold of .8.
BANDS, BAND_ROWS, PERMUTATIONS = 9, 13, 128


def minhash(texts: DataFrame, size: int = 3, permutations: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """`node`, `signature` (`permutations` minima over the `size`-word shingles) of `texts` (`node`, `text`).

    Texts of fewer words than a shingle, null ones too, have an empty signature.
    """
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 62, permutations, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 62, permutations, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                h = _shingle_hashes(text or "", size, known).view(np.uint64)
                least = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(h), 4096):
                    x = h[at : at + 4096, None] * mul + add
                    x ^= x >> np.uint64(31)
                    least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
                out.append(least.view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pdf[["node"]].assign(signature=out)

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInPandas(run, f"node {kind}, signature array<bigint>")


def lsh_links(signatures: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """`a` < `b` of nodes that share a band with the first node of its bucket, for each band: a star, not all pairs.

    Candidates, not verified: a bucket's nodes are all candidates of each other, and the star keeps them connected with
    one row a node and band, however many copies a bucket holds.
    """
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("h"))))
    keyed = signatures.where(F.size("signature") > 0).select("node", band.alias("k")).select("node", "k.i", "k.h")
    first = keyed.groupBy("i", "h").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(first, ["i", "h"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def lsh_dedup(texts: DataFrame, verified: bool = True, size: int = 3, threshold: float = 0.8) -> DataFrame:
    """`node` and `kept`, first wins, by LSH over MinHash signatures of `size`-word shingles.

    With `verified` a link counts if the exact Jaccard similarity is `threshold` or more; else every candidate counts.
    """
    rows = texts.select("node", "text")
    links = lsh_links(staged(minhash(rows, size)))
    if verified:
        links, sets = staged(links), _shingled(rows, size)
        sa, sb = sets.select(F.col("node").alias("a"), F.col("h").alias("sa")), sets.select(F.col("node").alias("b"), F.col("h").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        links = links.join(sa, "a").join(sb, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")
    return first_wins(rows.select("node"), links)


def _shingled(texts: DataFrame, size: int) -> DataFrame:
    """`node`, `h` (sorted hashes of the distinct shingles), `n`, of the texts that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for pdf in batches:
            hashes = [_shingle_hashes(t or "", size, known) for t in pdf["text"]]
            out = pdf[["node"]].assign(h=hashes, n=[len(h) for h in hashes])
            yield out[out["n"] > 0]

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInPandas(run, f"node {kind}, h array<bigint>, n int")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """`node`, `n`, `k`: the n - ceil(threshold * n) + 1 rarest hashes of each set."""
    shared = sets.sparkSession.sparkContext.broadcast(piece_counts(sets))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for pdf in batches:
            keys = [rare_first(np.asarray(h, dtype=np.int64), counts, len(h) - math.ceil(threshold * len(h) - 1e-9) + 1) for h in pdf["h"]]
            yield pdf[["node", "n"]].assign(k=keys).explode("k").astype({"k": "int64"})

    kind = sets.schema["node"].dataType.simpleString()
    return sets.select("node", "n", "h").mapInPandas(run, f"node {kind}, n int, k bigint")


def near_duplicates(texts: DataFrame, size: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs `a` < `b` of class representatives of `texts` (`node`, `text`) with a Jaccard similarity of `threshold` or more, and `node`, `class`.

    Similarity is that of the sets of `size`-word shingles. Texts with equal sets are a class, named by its least node;
    pairs are between different sets, so copies are not expanded. Candidates share a shingle among the rarest of both,
    which no similar pair can avoid in any one order; each is counted exactly. Texts of fewer words than a shingle are in a
    class of their own, as are null texts.
    """
    prints = staged(_shingled(texts, size).withColumn("key", F.xxhash64("h")))
    classes = prints.groupBy("key", "n").agg(F.min("node").alias("class"))
    known = prints.join(classes, ["key", "n"])
    members = known.select("node", "class")
    alone = texts.select("node").join(members.select("node"), "node", "left_anti").select("node", F.col("node").alias("class"))
    heads = staged(known.where(F.col("node") == F.col("class")).select("node", "n", "h"))
    keys = _prefixes(heads, threshold)
    left, right = keys.select("k", F.col("node").alias("a"), F.col("n").alias("na")), keys.select("k", F.col("node").alias("b"), F.col("n").alias("nb"))
    maybe = left.join(right, "k").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sa, sb = heads.select(F.col("node").alias("a"), F.col("h").alias("sa")), heads.select(F.col("node").alias("b"), F.col("h").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    exact = maybe.join(sa, "a").join(sb, "b").withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both))
    return exact.where(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "jaccard"), members.union(alone)


def near_dedup(texts: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """`node` and `kept`: the first of near-equal texts stays. Of a class only the first node is a candidate."""
    pairs, classes = near_duplicates(texts, size, threshold)
    classes = staged(classes)
    heads = first_wins(classes.select(F.col("class").alias("node")).distinct(), pairs.select("a", "b"))
    return classes.join(heads.select(F.col("node").alias("class"), "kept"), "class").select("node", (F.col("kept") & (F.col("node") == F.col("class"))).alias("kept"))


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of both texts' characters in their longest common subsequence."""
    if not a and not b:
        return 100.0
    row, ones = (1 << len(b)) - 1, (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    for c in a:  # bit-parallel longest common subsequence
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & ones
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


BITS = ("b0", "b1", "b2", "b3")


@lru_cache(maxsize=200_000)
def hash_bit(char: str, nth: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{char}{nth}".encode(), digest_size=1).digest(), "little")


def bitmap(text: str) -> list[int]:
    """Four 64-bit words with the parity of the characters, each occurrence an element of its own: an edit changes one bit at most."""
    bits = 0
    for c, n in Counter(text).items():
        for nth in range(n):
            bits ^= 1 << hash_bit(c, nth)
    return [((bits >> (64 * i) & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for i in range(4)]


def packed(text: str) -> np.ndarray:
    return np.array(bitmap(text), dtype=np.int64).view(np.uint64)


def near_any(text: str, bits: np.ndarray, heads: list[str], maps: np.ndarray, sizes: np.ndarray, ratio: float) -> bool:
    """Whether the indel ratio of `text`, of bitmap `bits`, and one of `heads`, whose bitmaps and lengths are given, is `ratio` or more."""
    total = sizes + len(text)
    fits = np.minimum(sizes, len(text)) * 2.0 >= ratio / 100.0 * total - 1e-9
    apart = np.bitwise_count(maps ^ bits[:, None]).sum(axis=0, dtype=np.int64)
    maybe = np.flatnonzero(fits & (apart <= (1 - ratio / 100.0) * total + 1e-9))
    return any(indel_ratio(heads[i], text) >= ratio - 1e-9 for i in maybe[np.argsort(apart[maybe], kind="stable")])


def fuzzy_leaders(heads: DataFrame, ratio: float, block: int = 4_096, least_share: float = 0.1, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """`kept` (`node`) and `rest` (`node`, `text`): what the first of `heads` decide of a removal in which the first wins.

    The first `block` texts in the order of nodes are gone through one by one; those kept are compared with all later
    texts where these are, without a row per pair, and what is near one falls. This goes on while a block fells
    `least_share` of the later texts, `rounds` times at most. What is in neither `kept` nor `rest` has fallen; `rest` is
    near to nothing in `kept`, so it can be decided by itself. Nothing is left out, and templates that most texts
    follow are felled by a few leaders instead of by all their pairs.
    """
    spark, kind = heads.sparkSession, heads.schema["node"].dataType.simpleString()
    rest, kept, left = heads.select("node", "text"), [], heads.count()
    for _ in range(rounds):
        if left <= block:
            break
        first = rest.orderBy("node").limit(block).collect()  # `block` rows, whatever the data
        last, leaders, nodes = first[-1]["node"], [], []
        maps, sizes = np.zeros((4, block), dtype=np.uint64), np.zeros(block, dtype=np.int64)
        for node, text in first:
            n, bits = len(leaders), packed(text)
            if not near_any(text, bits, leaders, maps[:, :n], sizes[:n], ratio):
                leaders.append(text)
                nodes.append((node,))
                maps[:, n], sizes[n] = bits, len(text)
        kept.append(spark.createDataFrame(nodes, f"node {kind}"))
        shared = spark.sparkContext.broadcast((leaders, maps[:, : len(leaders)].copy(), sizes[: len(leaders)]))

        def alive(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = shared.value
            for pdf in batches:
                yield pdf[[not near_any(text, packed(text), *held, ratio) for text in pdf["text"]]]

        rest = staged(rest.where(F.col("node") > F.lit(last)).mapInPandas(alive, f"node {kind}, text string"))
        before, left = left - len(first), rest.count()
        if before - left < least_share * before:
            break
    none = heads.select("node").limit(0)
    for x in kept:
        none = none.union(x)
    return none, rest


def fuzzy_scan(heads: DataFrame, ratio: float, window: int) -> DataFrame:
    """`node` and `kept` of `heads` (`node`, `text`): a text falls if a kept one of the `window` texts before it is near.

    What falls depends on what was kept before, all along the order, so one task goes through it; it holds no more than the
    kept texts of a window, and there is no row for a pair. Bitmaps are made before, in parallel.
    """
    kind = heads.schema["node"].dataType.simpleString()

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = [bitmap(text) for text in pdf["text"]]
            yield pdf[["node", "text"]].assign(**{c: [m[i] for m in maps] for i, c in enumerate(BITS)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = 2 * window + 2
        maps, sizes, at = np.zeros((4, room), dtype=np.uint64), np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        texts: list[str] = []
        start, here = 0, 0
        for pdf in batches:
            kept = []
            for text, bits in zip(pdf["text"], np.ascontiguousarray(pdf[list(BITS)].to_numpy(dtype=np.int64)).view(np.uint64), strict=True):
                end = len(texts)
                while start < end and at[start] < here - window:
                    start += 1
                if end == room:  # those behind the window go
                    n = end - start
                    maps[:, :n], sizes[:n], at[:n] = maps[:, start:end].copy(), sizes[start:end].copy(), at[start:end].copy()
                    texts, start, end = texts[start:], 0, n
                new = not near_any(text, bits, texts[start:], maps[:, start:end], sizes[start:end], ratio)
                if new:
                    texts.append(text)
                    maps[:, end], sizes[end], at[end] = bits, len(text), here
                kept.append(new)
                here += 1
            yield pdf[["node"]].assign(kept=kept)

    rows = heads.select("node", "text").mapInPandas(mapped, f"node {kind}, text string, " + ", ".join(f"{c} bigint" for c in BITS))
    return rows.repartition(1).sortWithinPartitions("node").mapInPandas(scan, f"node {kind}, kept boolean")


def fuzzy_pairs(texts: DataFrame, ratio: float = 90.0, gram: int = 3) -> DataFrame:
    """Pairs `a` < `b` of distinct `texts` (`node`, `text`) whose indel ratio is `ratio` or more.

    Texts that near share most of their `gram`-character pieces: with at most d = (1 - ratio) * (la + lb) edits at most
    gram * d pieces of either differ. Candidates share one of the gram * d + 1 rarest pieces of both, are of fitting length,
    differ in no more than d places of a bitmap (the parity of the characters, each occurrence an element of its own: an
    edit changes one of them) and are of a Levenshtein distance within d; then they are measured. No filter loses a pair.
    """
    far = 1 - ratio / 100.0

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, keep, maps = [], [], []
            for text in pdf["text"]:
                maps.append(bitmap(text))
                edits = int(far * len(text) * (1 + (2 - ratio / 100) / (ratio / 100)))  # the other text is at most (2 - r) / r as long
                padded = text + "\0" * gram
                seen: dict[str, int] = {}
                grams = []
                for i in range(len(text)):
                    g = padded[i : i + gram]
                    seen[g] = seen.get(g, 0) + 1
                    grams.append(int.from_bytes(hashlib.blake2b(f"{g}{seen[g]}".encode(), digest_size=8).digest(), "little", signed=True))
                out.append(sorted(grams))
                keep.append(gram * edits + 1)
            columns = {f"b{i}": [m[i] for m in maps] for i in range(4)}
            yield pdf[["node"]].assign(n=pdf["text"].str.len(), h=out, keep=keep, **columns)

    kind = texts.schema["node"].dataType.simpleString()
    some = staged(texts.where("text <> ''").select("node", "text"))
    cut = staged(some.mapInPandas(pieces, f"node {kind}, n int, h array<bigint>, keep int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"))
    shared = cut.sparkSession.sparkContext.broadcast(piece_counts(cut))  # of fixed size

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for pdf in batches:
            keys = [rare_first(np.asarray(h, dtype=np.int64), counts, k) for h, k in zip(pdf["h"], pdf["keep"], strict=True)]
            yield pdf[["node", "n", *BITS]].assign(k=keys).explode("k").astype({"k": "int64"})

    keys = cut.mapInPandas(rarest, f"node {kind}, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, k bigint")
    left, right = (keys.select("k", F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in BITS]) for x in ("a", "b"))
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in BITS), F.lit(0))
    fits = (F.least("na", "nb") * 2.0 >= (ratio / 100.0) * (F.col("na") + F.col("nb")) - 1e-9) & (apart <= far * (F.col("na") + F.col("nb")) + 1e-9)
    maybe = left.join(right, "k").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    ta, tb = some.select(F.col("node").alias("a"), F.col("text").alias("ta")), some.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    near = maybe.join(ta, "a").join(tb, "b").where(F.levenshtein("ta", "tb") <= far * (F.length("ta") + F.length("tb")) + 1e-9)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = [indel_ratio(x, y) for x, y in zip(pdf["ta"], pdf["tb"], strict=True)]
            out = pdf[["a", "b"]].assign(ratio=r)
            yield out[out["ratio"] >= ratio - 1e-9]

    return near.mapInPandas(measure, f"a {kind}, b {kind}, ratio double")


def fuzzy_dedup(records: DataFrame, record: str = "id", question: str = "question", ratio: float = 90.0, window: int | None = None, block: int = 4_096) -> DataFrame:
    """`node` (the record's id) and `kept` after exact and fuzzy removal of repeated questions, in the order of ids.

    Equal questions, in lower case with single blanks, count once; only distinct ones are compared. Null questions stay.
    The first questions, `block` at a time, fell what is near them before the rest is compared in pairs.
    With `window` a question is compared with that many distinct questions before it only, as a scan with a bounded
    memory does (`fuzzy_scan`).
    """
    text = F.trim(squeeze(F.lower(F.col(question))))
    rows = staged(records.select(F.col(record).alias("node"), text.alias("text")))
    heads = staged(rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("node").alias("node")))
    if window is not None:
        kept = fuzzy_scan(heads, ratio, window)
    else:
        sure, rest = fuzzy_leaders(heads, ratio, block)
        kept = first_wins(rest.select("node"), fuzzy_pairs(rest, ratio).select("a", "b"))
        kept = heads.select("node").join(kept.union(sure.select("node", F.lit(True).alias("kept"))), "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))
    return rows.select("node", F.col("text").isNull().alias("_null")).join(kept, "node", "left").select("node", F.coalesce("kept", F.col("_null")).alias("kept"))
