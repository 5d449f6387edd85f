"""Runs of pipelines and trainings: resuming, failing, losses, references, majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.operators.dedup import question_hash
from qaloom.plans.staging import staged


def new_questions(records: DataFrame, kept_before: DataFrame, question: str = "question") -> DataFrame:
    """Records whose question an earlier output doesn't hold; null questions stay. Only hashes of the output are shipped."""
    before = kept_before.select(question_hash(F.col(question)).alias("_h")).where("_h IS NOT NULL").distinct()
    return records.withColumn("_h", question_hash(F.col(question))).join(before, "_h", "left_anti").drop("_h")


def breaks_circuit(attempts: DataFrame, run: str, order: str, failed: Column, most: float = 0.4, least: int = 10) -> DataFrame:
    """`attempts` with the running share of failures of their run and whether it is over `most` after `least` attempts.

    A run is summed up in ranges of `order`: a range adds the sums of those before it, so that one long run, even one that
    has nearly all attempts, is spread over the tasks. Ties in `order` count in no stated order.
    """
    cut = attempts.withColumn("_fails", failed.cast("bigint")).repartitionByRange(run, order).withColumn("_part", F.spark_partition_id())
    cut = staged(cut)
    sums = cut.groupBy(F.col(run).alias("_run"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_fails").alias("_f"))
    w = Window.partitionBy("_run").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a run and range
    before = sums.select("_run", "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_f").over(w), F.lit(0)).alias("_f0"))
    inside = Window.partitionBy(run, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = cut.withColumns({"attempts": F.count(F.lit(1)).over(inside), "_done": F.sum("_fails").over(inside)})
    x = x.join(before, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_p")))
    x = x.withColumn("attempts", F.col("attempts") + F.col("_n0")).withColumn("failed_share", (F.col("_done") + F.col("_f0")) / F.col("attempts"))
    return x.withColumn("broken", (F.col("attempts") >= least) & (F.col("failed_share") > most)).drop("_fails", "_part", "_run", "_p", "_n0", "_f0", "_done")


def loss_statistics(metrics: DataFrame) -> DataFrame:
    """First, last and least loss of each model from `model`, `step`, `metric`, `value`."""
    x = metrics.where("metric = 'loss'").groupBy("model")
    return x.agg(F.min_by("value", "step").alias("first_loss"), F.max_by("value", "step").alias("last_loss"), F.min("value").alias("least_loss"), F.count(F.lit(1)).alias("n"))


def title_words(title: Column) -> Column:
    """The distinct words of a title, without punctuation and case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: w != ""))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two titles' words; 0 if either has none."""
    x, y = title_words(a), title_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def reference_status(found: Column, similarity: Column, passing: float = 0.8, doubtful: float = 0.5) -> Column:
    """PASS, WARN or FAIL of a looked-up reference."""
    return F.when(~F.coalesce(found, F.lit(False)) | (similarity < doubtful), "FAIL").when(similarity < passing, "WARN").otherwise("PASS")


def majority(labels: DataFrame, item: str, label: str) -> DataFrame:
    """`item`, its most frequent label (of equals the first) and whether all raters agree."""
    by = labels.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(item).agg(F.min(F.struct(-F.col("n"), F.col(label))).alias("x"), (F.count(F.lit(1)) == 1).alias("unanimous")).select(item, F.col(f"x.{label}").alias("label"), "unanimous")


def first_available(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key the row of the least priority."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(priority))).where("_r = 1").drop("_r")


def first_of_each(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each `key`; each task cuts its part of a hot key first (WindowGroupLimit)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def skip_take(rows: DataFrame, order: list[Column], skip: int, take: int) -> DataFrame:
    """`take` rows after the first `skip` in an order."""
    return rows.orderBy(*order).offset(skip).limit(take)


def extraction_statistics(results: DataFrame) -> DataFrame:
    """One row on `results` (`success`, `method`, `pages`, `seconds`): files, successes, skips, failures, pages, time.

    Skipped files are successful ones of the method "skipped"; pages, time and methods count for the others alone.
    """
    done = F.col("success") & (F.col("method") != "skipped")
    by = [F.count_if(done & (F.col("method") == m)).alias(m) for m in ("direct", "ocr", "mixed")]
    x = results.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(done).alias("successful"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), F.count_if(F.col("success") & (F.col("method") == "skipped")).alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(done, F.col("seconds"))), F.lit(0.0)).alias("seconds"), *by,
    )
    return x.withColumn("seconds_per_file", F.when(F.col("successful") > 0, F.col("seconds") / F.col("successful")).otherwise(F.lit(0.0)))


def line_validation(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row on JSON lines: those not blank, and of them those that are objects with a question and an answer."""
    x = lines.where(F.trim(line) != "")
    keys = F.json_object_keys(F.trim(line))
    valid = F.coalesce(F.array_contains(keys, "question") & F.array_contains(keys, "answer"), F.lit(False))
    return x.agg(F.count(F.lit(1)).alias("lines"), F.count_if(valid).alias("valid"))
