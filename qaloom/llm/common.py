"""Columns and helpers that several of the problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.rows import latest_once, latest_rows
from qaloom.sources.tables import table

#: White space and zero-width characters.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def strip(text: Column) -> Column:
    """`text` without white space (of any script, zero-width marks too) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def doc_key(doc_id: Column, file_name: Column | None = None) -> Column:
    """A doc_id in its one spelling: no blank at the ends, no `.pdf` ending, lower case; else the stem of the file name."""
    def fold(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)\.pdf$", "")))

    key = F.nullif(fold(doc_id), F.lit(""))
    if file_name is None:
        return key
    stem = F.regexp_replace(F.regexp_extract(F.trim(file_name), r"([^/\\]*)$", 1), r"(?i)\.(?:txt|pdf|json|jsonl|xml|html)$", "")
    return F.coalesce(key, F.nullif(fold(stem), F.lit("")))


def split_name(split: Column) -> Column:
    """train, val or test; null for anything else."""
    s = F.lower(F.trim(split))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "validation", "dev"), "val").when(s == "test", "test")


def source_of(source_pdf: Column) -> Column:
    """The source of a record, its directory below /corpus; null if the path has another form."""
    return F.nullif(F.regexp_extract(source_pdf, r"^/corpus/([^/]+)/", 1), F.lit(""))


def qa_raw(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """qa_raw, each record once (its latest delivery); only texts of records delivered again are shuffled."""
    return latest_once(table(spark, sf_dir, "qa_raw"), "id", "loaded_at", columns)


def qa_release(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """qa_release, each record once (its latest delivery)."""
    return latest_rows(table(spark, sf_dir, "qa_release"), "id", "loaded_at", columns)
