"""Summaries of a dataset, of its leaks and of its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import squeeze, words


def dataset_statistics(records: DataFrame) -> DataFrame:
    """One row: pairs, documents, of them by split, records with identifiers, mean lengths and score."""
    per = records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col("split") == s).alias(s) for s in ("train", "val", "test")], *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        F.count("doi").alias("doi"), F.count_if(F.col("answer_style") == "extractive").alias("extractive"),
        F.sum(F.length("question")).alias("q"), F.count("question").alias("nq"), F.sum(F.length("answer")).alias("a"), F.count("answer").alias("na"),
    )
    return per.agg(
        F.sum("n").alias("pairs"), F.count("doc_id").alias("documents"), *[F.count_if(F.col(s) & F.col("doc_id").isNotNull()).alias(f"{s}_documents") for s in ("train", "val", "test")], *[F.sum(f"n_{s}").alias(f"{s}_pairs") for s in ("train", "val", "test")],
        F.sum("doi").alias("with_doi"), F.sum("extractive").alias("extractive"), (F.sum("q") / F.sum("nq")).alias("mean_question"), (F.sum("a") / F.sum("na")).alias("mean_answer"),
    )


def consolidation_rollup(records: DataFrame, folder: Column, file: Column) -> DataFrame:
    """Records and distinct questions per file, per folder and in all, with the share repeated in percent."""
    x = records.select(folder.alias("folder"), file.alias("file"), F.md5(squeeze(F.lower("question"))).alias("q"))
    by = x.rollup("folder", "file").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("q").alias("questions"), F.grouping_id().cast("int").alias("level"))
    return by.withColumn("repeated_percent", F.round(F.lit(100.0) * (F.col("records") - F.col("questions")) / F.col("records"), 2))


def top_files(records: DataFrame, key: Column, k: int = 20) -> DataFrame:
    """The `k` most frequent values of `key`; equals in the order of the value."""
    return records.groupBy(key.alias("file")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "file").limit(k)


def first_per_document(records: DataFrame, doc: str, column: str, order: str) -> DataFrame:
    """`doc` and the `column` of its first record by `order`."""
    return records.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.min_by(column, order).alias(column))


def year_histogram(records: DataFrame) -> DataFrame:
    """Documents by year, 1990 to 2030; a document's year is that of its first record."""
    return first_per_document(records, "doc_id", "year", "id").where(F.col("year").between(1990, 2030)).groupBy("year").agg(F.count(F.lit(1)).alias("documents"))


def exact_leaks(records: DataFrame, field: str, least_words: int = 1) -> DataFrame:
    """Test records, and of them those whose `field` (lower case, single blanks) a training record has."""
    x = records.where(F.col(field).isNotNull()).select("split", squeeze(F.lower(field)).alias("t")).where(F.size(words(F.col("t"))) >= least_words)
    train = x.where("split = 'train'").select("t").distinct().withColumn("hit", F.lit(True))
    return x.where("split = 'test'").join(train, "t", "left").agg(F.count(F.lit(1)).alias("test_records"), F.count_if(F.coalesce("hit", F.lit(False))).alias("leaked"))


def ngram_leaks(records: DataFrame, field: str, n: int = 5) -> DataFrame:
    """`id` of each test record with its distinct word n-grams and how many of them training records have.

    Training n-grams are reduced to distinct hashes of those that occur in the test split before they meet the records.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, n))))
    x = records.where(F.col(field).isNotNull()).select("id", "split", words(F.lower(field)).alias("w")).where(F.size("w") >= n)
    test = x.where("split = 'test'").select("id", F.explode(grams).alias("g"))
    train = x.where("split = 'train'").select(F.explode(grams).alias("g")).join(test.select("g").distinct(), "g", "left_semi").distinct().withColumn("hit", F.lit(1))
    return test.join(train, "g", "left").groupBy("id").agg(F.count(F.lit(1)).alias("grams"), F.count("hit").alias("shared"))


def overlap_summary(per_record: DataFrame) -> DataFrame:
    """Mean, median and upper percentiles of the shares of `ngram_leaks`."""
    x = per_record.select((F.col("shared") / F.col("grams")).alias("share"))
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.avg("share").alias("mean"), F.percentile("share", F.lit(0.5)).alias("median"), F.percentile("share", F.lit(0.9)).alias("p90"), F.percentile("share", F.lit(0.95)).alias("p95"), F.avg((F.col("share") >= 0.5).cast("double")).alias("half_or_more")
    )


def calibration_buckets(records: DataFrame, score: str, label: Column) -> DataFrame:
    """Records and mean label by range of the score."""
    s = F.col(score)
    bucket = F.when(s < 0.5, "<0.5").when(s < 0.6, "0.5-0.6").when(s < 0.7, "0.6-0.7").when(s < 0.8, "0.7-0.8").when(s < 0.9, "0.8-0.9").otherwise(">=0.9")
    return records.where(s.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(label.cast("double")).alias("mean_label"))


def average_ranks(values: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """`column` and `rank`, the mean rank of equal values, of a numeric column.

    Ranks come from the counts of distinct values, within ranges between at most `parts` quantiles and on top of the
    counts of the ranges before, so that no task orders all values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    cuts = sorted(set(counts.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.01)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(column).cast("double") > c).cast("int")
    cut = counts.withColumn("_p", part)
    sums = cut.groupBy("_p").agg(F.sum("_c").alias("_s"))
    offsets = sums.select(F.col("_p").alias("_q"), (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_o"))  # `parts` rows
    before = F.sum("_c").over(Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.withColumn("_b", F.coalesce(before, F.lit(0))).join(offsets, F.col("_p") == F.col("_q"))
    return ranked.select(column, (F.col("_o") + F.col("_b") + (F.col("_c") + 1) / F.lit(2.0)).alias("rank"))


def spearman(records: DataFrame, a: str, b: str) -> DataFrame:
    """`n` and `rho`, the correlation of average ranks of two columns; rows with a null in either are left out."""
    x = records.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ra, rb = average_ranks(x, "a").withColumnRenamed("rank", "ra"), average_ranks(x, "b").withColumnRenamed("rank", "rb")
    return x.join(ra, "a").join(rb, "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def stratified_sample(records: DataFrame, stratum: str, size: int, seed: int = 42, record: str = "id") -> DataFrame:
    """`size` records in equal parts of the strata, what is left over to the first strata by name; ids `ann_00001` on.

    Which records is decided by the md5 of seed and id, and so is the order in which ids are given. Only each stratum's
    quota is ranked further.
    """
    rows = records.select(record, F.coalesce(stratum, F.lit("unknown")).alias("stratum")).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(record))))
    groups = rows.select("stratum").distinct().select("stratum", (F.row_number().over(Window.orderBy("stratum")) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("k"))
    quota = groups.select("stratum", (F.floor(F.lit(size) / F.col("k")) + F.when(F.col("at") < F.lit(size) % F.col("k"), 1).otherwise(0)).alias("quota"))
    # the first `size` of each part of a stratum by the hash: no stratum is sorted whole, and no quota is beyond `size`
    best = Window.partitionBy("stratum", "_part").orderBy("h", record)
    few = rows.withColumn("_part", F.spark_partition_id()).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= size)
    some = F.broadcast(quota.where("quota > 0"))  # `size` strata at most
    picked = few.join(some, "stratum").withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("h", record))).where("r <= quota").drop("_part", "_r")
    given = picked.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", record)))  # `size` rows
    return given.select(F.concat(F.lit("ann_"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("annotation_id"), F.col(record).alias("original_id"), "stratum")


def usage_statistics(records: DataFrame) -> DataFrame:
    """Records, runs and tokens by model."""
    return records.groupBy("model").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("run_id").alias("runs"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"), F.avg("usage.total_tokens").alias("mean_tokens"))


def last_known(rows: DataFrame, column: str, partition: str, order: str) -> DataFrame:
    """`rows` with `column` carried forward over nulls."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def extremes(scored: DataFrame, score: str, name: str, k: int = 5) -> DataFrame:
    """`end` (lowest or highest), `rank`, `name`, `score`: the `k` rows at both ends by score, equals by name."""
    rows = scored.where(F.col(score).isNotNull()).select(F.col(name).alias("name"), F.col(score).alias("score"))
    ends = []
    for end, order in (("lowest", [F.asc("score"), F.asc("name")]), ("highest", [F.desc("score"), F.asc("name")])):
        some = rows.orderBy(*order).limit(k)
        ends.append(some.select(F.lit(end).alias("end"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"), "name", "score"))  # `k` rows
    return ends[0].unionByName(ends[1])


#: The types of which a gold sample has equal numbers.
SAMPLED_TYPES = ("factual", "method", "definition", "comparison", "causal", "list", "numeric")


def fixed_type_sample(records: DataFrame, kind: str, size: int, types: tuple[str, ...] = SAMPLED_TYPES, context: str = "context", seed: int = 42, record: str = "id") -> DataFrame:
    """`record` and `kind`: of each of `types` max(1, size // number of types) records that have a context, by a seeded hash."""
    per = max(1, size // len(types))
    rows = records.where(F.col(kind).isin(*types) & (F.coalesce(context, F.lit("")) != "")).select(record, kind, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(record))).alias("_h"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy("_h", record)))  # WindowGroupLimit cuts each task's part first
    return ranked.where(F.col("_r") <= per).drop("_h", "_r")


def uniform_sample(records: DataFrame, size: int, record: str = "id", seed: int = 42) -> DataFrame:
    """`size` rows drawn by a seeded hash of `record`."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(record))), record).limit(size)
