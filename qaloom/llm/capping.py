"""Problem 2: at most so many records of a contributor, those of best quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.llm.common import doc_key, qa_release


def cap_of_share(sizes: DataFrame, share: float) -> DataFrame:
    """The greatest cap c (one row, `cap`) at which no contributor has over `share` of what remains.

    `sizes` has one row per contributor with its number of records in `n`. What remains under c is the sum of
    min(n, c), so c is found between two neighbouring sizes from the histogram of sizes alone: at most sqrt(2 N)
    distinct sizes for N records. No contributors: no row. If no cap meets the share, as with too few contributors,
    the cap is 1, so that each contributor keeps a record.
    """
    hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    below = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    steps = hist.select(
        "n",
        F.coalesce(F.lag("n").over(Window.orderBy("n")), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.col("n") * F.col("groups")).over(below), F.lit(0)).alias("small"),
        F.sum("groups").over(above).alias("large"),
    )
    # in (low, n]: c <= share * (small + c * large)
    rest = F.lit(1.0) - F.lit(share) * F.col("large")
    best = F.when(rest <= 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.lit(share) * F.col("small") / F.nullif(rest, F.lit(0.0)) + F.lit(1e-9))))
    return steps.select(F.when(best > F.col("low"), best).alias("c")).agg(F.greatest(F.max("c"), F.lit(1)).cast("bigint").alias("cap"))


def cap_contributors(
    records: DataFrame, contributor: Column, record_id: Column, score: Column, max_records: int | None = None, max_share: float | None = None, lowest: float = 0.0, highest: float = 1.0, salts: int = 32, steps: int = 1000
) -> DataFrame:
    """`id`, `contributor`, `score` and `kept` of each record: of each contributor the best `max_records` are kept.

    Best is the highest score; null, NaN and scores outside `lowest`..`highest` rank last and equals rank by id. With
    `max_share` the cap is the greatest under which no contributor has over that share of what is kept. Records without
    a contributor are kept: there's nobody to cap. Repeated ids count as records of their own; an empty table gives an
    empty table. Further columns are neither read nor returned, so their names can't clash.

    A dominant contributor is cut into `salts` parts by the hash of the id. A record beyond the cap in its part is
    beyond it overall; with `max_records` the others, at most salts * cap of a contributor, are ranked again. A cap by
    share may be large: there a contributor's records are counted in `steps` ranges of the score, ranges are kept or left
    out whole by these counts, and only the records of the one range in which the cap falls are ranked.
    """
    if (max_records is None) == (max_share is None):
        raise ValueError("give either max_records or max_share")
    valid = score.between(lowest, highest) & ~F.isnan(score.cast("double"))
    rows = records.select(record_id.alias("id"), contributor.alias("contributor"), score.cast("double").alias("score"), F.when(valid, score.cast("double")).alias("_good"))
    known = rows.where(F.col("contributor").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    best_first = [F.col("_good").desc_nulls_last(), F.col("id").asc()]
    out = [F.col(c) for c in ("id", "contributor", "score")]
    unknown = rows.where(F.col("contributor").isNull()).select(*out, F.lit(True).alias("kept"))
    if max_share is not None:
        cap = cap_of_share(known.groupBy("contributor").agg(F.count(F.lit(1)).alias("n")), max_share)
        width = (F.lit(highest) - F.lit(lowest)) / steps
        step = F.coalesce(F.floor((F.lit(highest) - F.col("_good")) / width).cast("int"), F.lit(steps + 1))  # best range first, null scores last
        ranked = known.withColumn("_step", step)
        sizes = ranked.groupBy(F.col("contributor").alias("_c"), F.col("_step").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_c").orderBy("_s")) - F.col("_n"))  # at most steps + 2 rows a contributor
        placed = ranked.join(before, (F.col("contributor") == F.col("_c")) & (F.col("_step") == F.col("_s"))).crossJoin(F.broadcast(cap))  # one row
        # whole ranges are in or out; only the range in which the cap falls is ranked, salted as above
        clear = placed.where((F.col("_before") + F.col("_n") <= F.col("cap")) | (F.col("_before") >= F.col("cap"))).select(*out, (F.col("_before") < F.col("cap")).alias("kept"))
        split = placed.where((F.col("_before") + F.col("_n") > F.col("cap")) & (F.col("_before") < F.col("cap"))).withColumn("_left", F.col("cap") - F.col("_before"))
        first = split.withColumn("_r", F.row_number().over(Window.partitionBy("contributor", "_salt").orderBy(*best_first)))
        again = first.where(F.col("_r") <= F.col("_left")).withColumn("_r", F.row_number().over(Window.partitionBy("contributor").orderBy(*best_first)))
        decided = again.select(*out, (F.col("_r") <= F.col("_left")).alias("kept"))
        beyond = first.where(F.col("_r") > F.col("_left")).select(*out, F.lit(False).alias("kept"))
        return clear.unionByName(decided).unionByName(beyond).unionByName(unknown)
    first = known.withColumn("_r", F.row_number().over(Window.partitionBy("contributor", "_salt").orderBy(*best_first))).withColumn("cap", F.lit(max_records))
    again = first.where(F.col("_r") <= F.col("cap")).withColumn("_r", F.row_number().over(Window.partitionBy("contributor").orderBy(*best_first)))
    decided = again.select(*out, (F.col("_r") <= F.col("cap")).alias("kept"))
    beyond = first.where(F.col("_r") > F.col("cap")).select(*out, F.lit(False).alias("kept"))
    return decided.unionByName(beyond).unionByName(unknown)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of qa_release left out at 20 of a document."""
    records = qa_release(spark, sf_dir, ["id", "doc_id", "file_name", "quality_score"])
    ranked = cap_contributors(records, doc_key(F.col("doc_id"), F.col("file_name")), F.col("id"), F.col("quality_score"), max_records=20)
    return ranked.where(~F.col("kept")).select("id")


def p2_share_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept and left out by document if none may have over 1 % of what remains."""
    records = qa_release(spark, sf_dir, ["id", "doc_id", "file_name", "quality_score"])
    ranked = cap_contributors(records, doc_key(F.col("doc_id"), F.col("file_name")), F.col("id"), F.col("quality_score"), max_share=0.01)
    return ranked.groupBy("contributor").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("left_out"))


P2_FOUND_SQL = r"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d FROM qa_release WHERE id IS NOT NULL
), keyed AS (
  SELECT id, coalesce(nullif(lower(trim(regexp_replace(trim(doc_id), '(?i)\.pdf$', ''))), ''),
                      nullif(lower(trim(regexp_replace(regexp_extract(trim(file_name), '([^/\\]*)$', 1), '(?i)\.(txt|pdf|json|jsonl|xml|html)$', ''))), '')) AS doc,
         CASE WHEN quality_score BETWEEN 0 AND 1 THEN quality_score END AS good
  FROM latest WHERE d = 1
), ranked AS (
  SELECT id, doc, row_number() OVER (PARTITION BY doc ORDER BY good DESC NULLS LAST, id) AS r FROM keyed WHERE doc IS NOT NULL
)
SELECT id FROM ranked WHERE r > 20
"""

P2_SHARE_CAPPED_SQL = r"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d FROM qa_release WHERE id IS NOT NULL
), keyed AS (
  SELECT coalesce(nullif(lower(trim(regexp_replace(trim(doc_id), '(?i)\.pdf$', ''))), ''),
                  nullif(lower(trim(regexp_replace(regexp_extract(trim(file_name), '([^/\\]*)$', 1), '(?i)\.(txt|pdf|json|jsonl|xml|html)$', ''))), '')) AS doc
  FROM latest WHERE d = 1
), sizes AS (SELECT doc, count(*) AS n FROM keyed GROUP BY doc
), tried AS (SELECT c, (SELECT sum(least(n, c)) FROM sizes WHERE doc IS NOT NULL) AS remains FROM (SELECT unnest(generate_series(1, (SELECT max(n) FROM sizes WHERE doc IS NOT NULL))) AS c)
), cap AS (SELECT coalesce(max(c) FILTER (WHERE c <= 0.01::DOUBLE * remains + 1e-9), 1) AS cap FROM tried)
SELECT doc AS contributor, CASE WHEN doc IS NULL THEN n ELSE least(n, cap) END AS kept, CASE WHEN doc IS NULL THEN 0 ELSE greatest(n - cap, 0) END AS left_out FROM sizes, cap
"""
