"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.subset_sum import closest_subset
from qaloom.llm.tokens import VOCABULARY, token_counts
from qaloom.operators.rows import rank_within
from qaloom.plans.staging import staged
from qaloom.sources.tables import table


def feasible_total(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which no source needs more than its repeats; sources without tokens are left aside."""
    limits = [tokens[s] * repeats / share for s, (share, repeats) in targets.items() if share > 0 and tokens.get(s)]
    return int(min(limits, default=0))


def mixture_plan(histograms: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, dict[int, int]]]:
    """By source: how often all its texts come, and of each length how many come once more.

    A source's budget is its share of the total. Whole passes over it are taken first; what is left of the budget is
    filled by a bounded knapsack over the numbers of texts of each exact length, never beyond the budget.
    """
    sums = {s: sum(n * k for n, k in h.items()) for s, h in histograms.items()}
    wanted = feasible_total(sums, targets) if total is None else total
    out = {}
    for source, (share, repeats) in targets.items():
        if not sums.get(source):
            out[source] = (0, {})
            continue
        budget = min(round(share * wanted), sums[source] * repeats)
        passes = budget // sums[source]
        rest = budget - passes * sums[source]
        out[source] = (passes, closest_subset(histograms[source], rest, at_most=True) if rest else {})
    return out


def mix(documents: DataFrame, targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 42) -> DataFrame:
    """`doc_id`, `source`, `tokens`, `repeats` of the texts of a mixture of `documents` (`doc_id`, `source`, `tokens`).

    `targets` has the share of each source and how often it may be repeated at most. Without `total` the mixture is as
    large as the repeats allow. Sources without a target, null sources and texts without tokens are left out. Only
    numbers of texts by source and length go to the driver, as many rows as there are lengths. Which texts of a length
    come once more is drawn by a seeded hash of the id, ranked without gathering a frequent length or source.
    """
    known = staged(documents.where(F.col("source").isin(*targets) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens"))
    histograms: dict[str, dict[int, int]] = {}
    for r in known.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        histograms.setdefault(r["source"], {})[int(r["tokens"])] = int(r["n"])
    chosen = mixture_plan(histograms, targets, total)
    rows = [(s, n, passes, extra.get(n, 0)) for s, (passes, extra) in chosen.items() for n in histograms.get(s, {})]
    quotas = known.sparkSession.createDataFrame(rows, "source string, tokens bigint, passes int, extra bigint")
    drawn = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = known.withColumn("_length", F.concat_ws(":", "source", F.col("tokens").cast("string")))
    ranked = rank_within(keyed, "_length", [drawn, F.col("doc_id")], drawn, "_rank")
    got = ranked.join(quotas, ["source", "tokens"])
    repeats = F.col("passes") + F.when(F.col("_rank") < F.col("extra"), 1).otherwise(0)
    return got.select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def _inputs(spark: SparkSession, sf_dir: str, vocabulary: str) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    rows = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL AND target_share > 0").collect()  # eight rows, fixed
    targets = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] or 1)) for r in rows}
    documents = table(spark, sf_dir, "documents").where(F.col("source").isin(*targets))
    return token_counts(documents, ["doc_id", "source"], F.col("text"), vocabulary), targets


def p9_mixture(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The texts of the mixture by mix_targets, with how often each comes."""
    return mix(*_inputs(spark, sf_dir, vocabulary))


def p9_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source the target and the real share of the mixture, its tokens and its most repeated text."""
    documents, targets = _inputs(spark, sf_dir, vocabulary)
    mixed = mix(documents, targets)
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("documents"))
    wanted = spark.createDataFrame([(s, share, k) for s, (share, k) in targets.items()], "source string, target_share double, max_repeats int")
    total = by.agg(F.sum("mixed_tokens").alias("total"))
    joined = wanted.join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
    tokens = F.coalesce("mixed_tokens", F.lit(0))
    return joined.select("source", "target_share", "max_repeats", tokens.alias("mixed_tokens"), (tokens / F.col("total")).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"))
