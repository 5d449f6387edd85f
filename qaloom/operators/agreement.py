"""Agreement between annotators, adjudication and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """`key`, `a`, `b` where both annotators gave a label that isn't blank; of repeated keys in `b` the last row counts.

    `b` needs a column `position` if its keys repeat.
    """
    pick = F.max_by(F.col(label), F.col("position")) if "position" in b.columns else F.max(label)
    one = b.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("b"))
    return a.select(key, F.trim(F.col(label)).alias("a")).join(one.select(key, F.trim("b").alias("b")), key).where("a <> '' AND b <> ''")


def adjudicated(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Every row of `a` with both labels and the final one: the label if both agree, else empty."""
    one = b.groupBy(key).agg(F.max(label).alias("b"))
    x = a.select(key, F.trim(F.coalesce(label, F.lit(""))).alias("a")).join(one.select(key, F.trim(F.coalesce("b", F.lit(""))).alias("b")), key, "left")
    y = x.withColumn("b", F.coalesce("b", F.lit("")))
    return y.withColumn("final", F.when((F.col("a") == F.col("b")) & (F.col("a") != ""), F.col("a")).otherwise(F.lit("")))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """`n`, `agreement`, `expected`, `kappa` of label pairs `a`, `b`, for each value of `by`; no pairs, no row for that value.

    kappa is 1 where agreement by chance is certain.
    """
    keys = [by] if by else []
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = (cells.groupBy(*keys, F.col(c).alias("label")).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    both = rows.join(cols, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    x = total.join(both, keys, "left") if keys else total.crossJoin(F.broadcast(both))  # one row each
    n = F.col("n")
    expected = F.coalesce("products", F.lit(0.0)) / (n * n)
    agreement = F.col("same") / n
    kappa = F.when(expected >= 1.0, F.lit(1.0)).otherwise((agreement - expected) / F.nullif(F.lit(1.0) - expected, F.lit(0.0)))
    return x.where(n > 0).select(*keys, n, agreement.alias("agreement"), expected.alias("expected"), kappa.alias("kappa"))


def fleiss_kappa(labels: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """Fleiss' kappa of `labels`, a row per item and rater, over the items with exactly `raters` labels."""
    cells = labels.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    full = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq")).where(F.col("r") == raters)
    p_items = full.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("sq") - raters) / F.lit(float(raters * (raters - 1)))).alias("observed"))
    shares = cells.join(full.select(item), item).groupBy(label).agg(F.sum("n").alias("n"))
    total = shares.agg(F.sum("n").alias("all"))
    chance = shares.crossJoin(F.broadcast(total)).agg(F.sum((F.col("n") / F.col("all")) * (F.col("n") / F.col("all"))).alias("expected"))
    x = p_items.crossJoin(F.broadcast(chance))  # one row each
    kappa = F.when(F.col("expected") >= 1.0, F.lit(1.0)).otherwise((F.col("observed") - F.col("expected")) / F.nullif(F.lit(1.0) - F.col("expected"), F.lit(0.0)))
    return x.where("items > 0").select("items", "observed", "expected", kappa.alias("kappa"))


def bootstrap_kappa(pairs: DataFrame, key: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """`low`, `high`: the middle 95 % of Cohen's kappa over seeded resamples.

    Each pair enters each resample as often as a Poisson draw from its hash says, so a resample is a weighted
    aggregate: no rows are copied, only label cells are summed.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("round")), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += term
        term /= k
        weight = weight + (u > total).cast("int")
    drawn = pairs.select(key, "a", "b", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    cells = drawn.groupBy("round", "a", "b").agg(F.sum("w").alias("n"))
    t = cells.groupBy("round").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra, rb = (cells.groupBy("round", F.col(c).alias("label")).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    e = ra.join(rb, ["round", "label"]).groupBy("round").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("p"))
    x = t.join(e, "round").where("n > 0").withColumn("pe", F.col("p") / (F.col("n") * F.col("n")))
    kappa = x.select(F.when(F.col("pe") >= 1.0, 1.0).otherwise((F.col("same") / F.col("n") - F.col("pe")) / F.nullif(1.0 - F.col("pe"), F.lit(0.0))).alias("kappa"))
    return kappa.agg(F.percentile("kappa", F.lit(0.025)).alias("low"), F.percentile("kappa", F.lit(0.975)).alias("high"))


def label_kind(label: Column) -> Column:
    """yes, partial or no by what a free label contains, looked for in that order; null for none."""
    low = F.lower(F.trim(label))
    return F.when(F.contains(low, F.lit("yes")), "yes").when(F.contains(low, F.lit("partial")), "partial").when(F.contains(low, F.lit("no")), "no")


def summary(annotations: DataFrame, label: str) -> DataFrame:
    """Counts of the kinds of a label and accuracy, partial answers counting half."""
    k = annotations.select(label_kind(F.col(label)).alias("k"))
    x = k.agg(F.count("k").alias("n"), F.count_if(F.col("k") == "yes").alias("yes"), F.count_if(F.col("k") == "partial").alias("partial"), F.count_if(F.col("k") == "no").alias("no"))
    return x.withColumn("accuracy", (F.col("yes") + 0.5 * F.col("partial")) / F.nullif(F.col("n"), F.lit(0)))


#: What labels of each rubric are looked for, in this order.
RUBRICS = {"answer_correct": ("yes", "partial", "no"), "evidence_support": ("yes", "partial", "no"), "evidence_quality": ("good", "weak", "missing"), "question_clarity": ("good", "ambiguous", "bad")}


def rubric_summary(annotations: DataFrame, by: str | None = None) -> DataFrame:
    """`rubric`, `kind`, `n` of the four rubrics in `annotations`, for each value of `by` if given; blank labels count nowhere."""
    keys = [by] if by else []
    pairs = []
    for rubric, kinds in RUBRICS.items():
        low, found = F.lower(F.col(rubric)), F.lit(None).cast("string")
        for kind in reversed(kinds):
            found = F.when(F.contains(low, F.lit(kind)), kind).otherwise(found)
        pairs.append(F.struct(F.lit(rubric).alias("rubric"), found.alias("kind")))
    long = annotations.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.rubric", "x.kind").where("kind IS NOT NULL")
    return long.groupBy(*keys, "rubric", "kind").agg(F.count(F.lit(1)).alias("n"))


def mean_kappa(a: DataFrame, b: DataFrame, key: str, rubrics: tuple[str, ...] = tuple(RUBRICS)) -> DataFrame:
    """`rows_aligned`, the keys both annotators have, and `mean_kappa` over the rubrics; one without pairs counts 0."""
    def long(x: DataFrame) -> DataFrame:
        return x.select(key, F.explode(F.array(*[F.struct(F.lit(r).alias("rubric"), F.trim(F.col(r)).alias("label")) for r in rubrics])).alias("x")).select(key, "x.rubric", "x.label").where("label <> ''")

    pairs = long(a).withColumnRenamed("label", "a").join(long(b).withColumnRenamed("label", "b"), [key, "rubric"])
    per = cohen_kappa(pairs, "rubric").agg((F.coalesce(F.sum("kappa"), F.lit(0.0)) / len(rubrics)).alias("mean_kappa"))
    common = a.select(key).distinct().join(b.select(key).distinct(), key).agg(F.count(F.lit(1)).alias("rows_aligned"))
    return common.crossJoin(F.broadcast(per))  # one row each


def matched_agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """`n`, `agreement`, `kappa` over the common keys: agreement is a share of all of them, also of those without a label.

    Labels are compared in lower case without blanks at the ends; kappa is over the pairs that have both, 0 without any.
    """
    x = a.select(key, F.lower(F.trim(F.col(label))).alias("a")).join(b.select(key, F.lower(F.trim(F.col(label))).alias("b")), key)
    total = x.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == F.col("b")) & (F.col("a") != "")).alias("same"))
    kappa = cohen_kappa(x.where("a <> '' AND b <> ''")).agg(F.coalesce(F.max("kappa"), F.lit(0.0)).alias("kappa"))
    return total.crossJoin(F.broadcast(kappa)).select("n", F.when(F.col("n") > 0, F.col("same") / F.col("n")).otherwise(F.lit(0.0)).alias("agreement"), "kappa")  # one row each
