"""Splits by hash: documents, records, and checks for leaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.hashing import file_stem, md5_mod
from qaloom.operators.rows import positions


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.85
    val: float = 0.10
    test: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        if abs(self.train + self.val + self.test - 1.0) > 0.001:
            raise ValueError("the ratios must add up to 1")

    @property
    def cuts(self) -> tuple[int, int]:
        return int(self.train * 100), int(self.train * 100) + int(self.val * 100)


def by_bucket(bucket: Column, cfg: SplitConfig) -> Column:
    low, high = cfg.cuts
    return F.when(bucket < low, "train").when(bucket < high, "val").otherwise("test")


def document_split(doc_id: Column, cfg: SplitConfig = SplitConfig()) -> Column:
    """The split of a document: all its records share it."""
    return by_bucket(md5_mod(F.concat_ws(":", doc_id, F.lit(str(cfg.seed))), 100), cfg)


def record_split(record_id: Column, cfg: SplitConfig = SplitConfig()) -> Column:
    """The split of a record by its bare id, without a seed."""
    return by_bucket(md5_mod(record_id, 100), cfg)


def drops_context(record_id: Column, share_of_thousand: int = 300) -> Column:
    """Whether a record is trained on without its context."""
    return md5_mod(F.concat(F.lit("ctx_"), record_id), 1000) < share_of_thousand


def assign_splits(records: DataFrame, cfg: SplitConfig = SplitConfig(), doc: str = "doc_id", file: str = "file_name", record: str = "id") -> DataFrame:
    """`records` with `split`. The document is `doc`, else the stem of `file`, else the record itself."""
    key = F.coalesce(*[F.col(c) if c != file else file_stem(F.col(c)) for c in (doc, file, record) if c in records.columns])
    return records.withColumn("split", document_split(key, cfg))


def split_statistics(records: DataFrame, split: str = "split", doc: str = "doc_id") -> DataFrame:
    """Documents and pairs per split with their shares in percent, and a row `total`."""
    per = records.groupBy(split, doc).agg(F.count(F.lit(1)).alias("n"))  # partial sums before counting documents
    by = per.rollup(split).agg(F.count(doc).alias("documents"), F.sum("n").alias("pairs"))
    total = by.where(F.col(split).isNull()).select(F.col("documents").alias("_d"), F.col("pairs").alias("_p"))
    return by.crossJoin(F.broadcast(total)).select(  # one row
        F.coalesce(split, F.lit("total")).alias("split"), "documents", "pairs", (F.lit(100.0) * F.col("documents") / F.col("_d")).alias("document_percent"), (F.lit(100.0) * F.col("pairs") / F.col("_p")).alias("pair_percent")
    )


def leaking_documents(records: DataFrame, split: str = "split", doc: str = "doc_id") -> DataFrame:
    """Documents with records in more than one split, with the splits in order."""
    by = records.where(F.col(split).isNotNull() & F.col(doc).isNotNull()).select(doc, split).distinct().groupBy(doc)
    return by.agg(F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"), F.count(F.lit(1)).alias("n")).where("n > 1").select(doc, "splits")


def positional_split(records: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """`records` with `split`: the first int(share * n) by `order` train, the rest val."""
    at = positions(records, order, "_position")
    cut = int(records.count() * share)
    return at.withColumn("split", F.when(F.col("_position") < cut, "train").otherwise("val")).drop("_position")
