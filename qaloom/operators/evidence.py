"""Evidence for an answer in its context, and the style of the answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions.hashing import file_stem
from qaloom.functions.metadata import metadata_columns
from qaloom.functions.text import squeeze
from qaloom.operators.quality import word_overlap

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def spans_of(context: str | None, answer: str | None, longest: int = 10, shortest: int = 3, least_chars: int = 20, apart: int = 20, most: int = 3) -> list[tuple[int, int, str]]:
    """Sentences of the context that hold word sequences of the answer, longer sequences first.

    Offsets count from 0 and run from behind a full stop to behind the next; the text is stripped. A sequence of at
    most `least_chars` characters says nothing, and a span that starts within `apart` of another is the same.
    """
    found: list[tuple[int, int, str]] = []
    if not context or not answer:
        return found
    low, parts = context.lower(), answer.lower().split()
    for n in range(min(len(parts), longest), shortest - 1, -1):
        for phrase in (" ".join(parts[k : k + n]) for k in range(len(parts) - n + 1)):
            at = low.find(phrase) if len(phrase) > least_chars else -1
            if at < 0:
                continue
            begin = context.rfind(".", 0, at) + 1
            stop = context.find(".", at + len(phrase)) + 1 or len(context)
            if all(abs(begin - s) >= apart for s, _, _ in found):
                found.append((begin, stop, context[begin:stop].strip()))
                if len(found) == most:
                    return found
    return found


@F.pandas_udf(SPANS)
def evidence_spans(context: pd.Series, answer: pd.Series) -> pd.Series:
    """`start`, `end` and `text` of at most three places in `context`."""
    return pd.Series([[{"start": s, "end": e, "text": t} for s, e, t in spans_of(c, a)] for c, a in zip(context, answer, strict=True)])


def answer_style(context: Column, answer: Column, spans: Column | None = None) -> Column:
    """extractive if the answer is in the context or shares over .8 of its words, abstractive under .5; between, by evidence."""
    c, a = F.coalesce(context, F.lit("")), F.coalesce(answer, F.lit(""))
    overlap = word_overlap(a, c)
    length = F.lit(0) if spans is None else F.aggregate(spans, F.lit(0), lambda s, x: s + F.length(x["text"]))
    return (
        F.when((c == "") | (squeeze(a) == ""), "unknown")
        .when(F.contains(squeeze(F.lower(c)), squeeze(F.lower(a))) | (overlap > 0.8), "extractive")
        .when(overlap < 0.5, "abstractive")
        .when(length > F.length(a) * 0.8, "extractive")
        .otherwise("abstractive")
    )


def context_id(doc_id: Column, paragraph: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", doc_id, paragraph.cast("string"))), F.lit(16))


def enrich(records: DataFrame, metadata: DataFrame, version: str = "1.0") -> DataFrame:
    """Records with their document's metadata, evidence, style and keys; every record of a document gets the same.

    The document is the stem of `file_name`, else the first 40 characters of the id. `metadata` has one row per
    `doc_id`; its join is left to the planner. Fields outside the target schema are dropped.
    """
    doc = F.coalesce(F.nullif(file_stem(F.col("file_name")), F.lit("")), F.left("id", F.lit(40)))
    kept = [c for c in ("quality_score", "question_type") if c in records.columns]
    facts = metadata.select(F.col("doc_id").alias("_doc"), "doi", "pmid", "arxiv_id", "title", "year", "venue", "license")
    base = records.withColumn("doc_id", doc).withColumn("evidence_spans", evidence_spans("context", "answer"))
    joined = base.join(facts, F.col("doc_id") == F.col("_doc"), "left")
    return joined.select(
        "id", "question", "answer", "context", "file_name", "source_pdf", "paragraph_index", "line_number", "doc_id", "doi", "pmid", "arxiv_id", "title", "year", "venue",
        F.coalesce("license", F.lit("unknown")).alias("license"), "evidence_spans", answer_style(F.col("context"), F.col("answer"), F.col("evidence_spans")).alias("answer_style"),
        *kept, F.lit("train").alias("split"), context_id(F.col("doc_id"), F.coalesce("paragraph_index", F.lit(0))).alias("context_id"), "model", "run_id", "created_at", F.lit(version).alias("enrichment_version"),
    )


def resolved_metadata(records: DataFrame, texts: DataFrame, order: str = "id") -> DataFrame:
    """`doc_id`, `origin` (text or context) and the bibliographic fields of every document of `records`.

    They come from the document's full text in `texts` (`doc_id`, `text`, one row each) if there is one, else from the
    context of its first record by `order`; a document's records all get the same. `records` has `doc_id`, `context`.
    """
    first = records.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(F.coalesce("context", F.lit("")), order).alias("context"))
    known = first.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    x = known.select("doc_id", F.when(F.col("_text").isNotNull(), "text").otherwise("context").alias("origin"), F.coalesce("_text", "context").alias("_t"))
    return x.select("doc_id", "origin", *[c.alias(n) for n, c in metadata_columns(F.col("_t")).items()])
