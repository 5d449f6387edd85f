"""Views for release by licence, with secrets and doubtful titles taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRET, MASK = r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED_OPENAI_API_KEY]"
#: What a restricted record keeps.
RESTRICTED = (
    "id", "doc_id", "doi", "pmid", "arxiv_id", "title", "year", "venue", "license", "paragraph_index", "line_number", "context_id",
    "quality_score", "question_type", "answer_style", "split", "model", "run_id", "created_at", "enriched_at", "enrichment_version",
)
#: Signs of a line that is no title, and what follows a title on its line.
SUSPICIOUS = (
    r"(?i)^\s*\d+\s*(?:department|division|faculty|institute|laboratory|school|state key)",
    r"(?i)^\s*(?:abstract|background:|citation:|received:|the author\(s\)|open access|this item was submitted)",
    r"(?i)^\s*(?:archive for|skip to|match commun\.|journal of .*submitted)",
    r"(?i)\b(?:creative commons|licensed under|university|department of|laboratory of|academy of sciences)\b",
    r"^(?:[A-Z][A-Za-z'’-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][A-Za-z'’-]+)?\s*,\s*){2,}",
)
STOPS = (
    r"(?is)\s+(?:PLOS ONE|Scientific Reports|Nature Communications|BMC [A-Za-z ]+|Frontiers in [A-Za-z \n]+)\s*\|.*$",
    r"(?is)\s+www\.[^\s]+.*$",
    r"(?is)\s+\|\s+www\..*$",
    r"(?is)\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}.*$",
    r"(?is)\s+\d{4}\s*\|\s*Volume.*$",
)
EDGE = " .;,:|-"


def redact(column: Column, kind: T.DataType) -> Column:
    """`column` with secrets masked in every string of it, however deep in arrays, structs and maps."""
    if isinstance(kind, T.StringType):
        return F.regexp_replace(column, SECRET, MASK.replace("$", r"\$"))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[redact(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: redact(v, kind.valueType))
    return column


def redact_all(df: DataFrame) -> DataFrame:
    return df.select(*[redact(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def normalize_title(title: Column) -> Column:
    t = F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), F.lit(EDGE))
    for stop in STOPS:
        t = F.btrim(F.regexp_replace(t, stop, ""), F.lit(EDGE))
    return t


def suspicious_title(title: Column) -> Column:
    t = normalize_title(title)
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    bad = (F.length(t) < 8) | (F.length(t) > 180) | ((commas >= 3) & ~t.rlike("[:?]"))
    for p in SUSPICIOUS:
        bad = bad | t.rlike(p)
    return title.isNull() | (F.trim(title) == "") | bad


def title_from_context(context: Column, doi: Column) -> Column:
    """The last acceptable text behind a DOI in the context."""
    found = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(r"(?is)doi:\s*\S+\s+(.{8,260})"), 1)
    clean = F.transform(found, lambda x: F.trim(F.replace(normalize_title(x), F.coalesce(F.nullif(doi, F.lit("")), F.lit("\0")), F.lit(""))))
    good = F.filter(clean, lambda x: (F.length(x).between(8, 180)) & ~x.rlike(r"(?i)^(?:figure|table)\s+\d+") & ~x.rlike(r"(?i)\b(?:doi|copyright|creative commons|downloaded from)\b") & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > F.length(x) * 0.45))
    return F.try_element_at(good, F.lit(-1))


def repair_titles(records: DataFrame) -> DataFrame:
    """`records` with a clean `title` and its `title_source`: extracted, context_footer or unavailable_after_cleanup."""
    bad, other = suspicious_title(F.col("title")), title_from_context(F.col("context"), F.col("doi"))
    had = F.coalesce(F.col("title"), F.lit("")) != ""
    return records.withColumns({"_bad": bad, "_other": other}).withColumns({
        "title_source": F.when(~F.col("_bad"), "extracted").when(F.col("_other").isNotNull(), "context_footer").when(had, "unavailable_after_cleanup"),
        "title": F.when(~F.col("_bad"), normalize_title(F.col("title"))).when(F.col("_other").isNotNull(), F.col("_other")).when(had, F.lit(None)).otherwise(F.col("title")),
    }).drop("_bad", "_other")


def is_redistributable(license: Column, allowed: tuple[str, ...] = ("open_access",)) -> Column:
    return F.coalesce(F.lower(license).isin(*{"open_access", *allowed}), F.lit(False))


def released(records: DataFrame) -> DataFrame:
    """Records that may be given out with their text."""
    x = redact_all(repair_titles(records.where(is_redistributable(F.col("license"))))).drop("source_pdf")
    return x.withColumns({"document_hash": F.col("doc_id"), "redistribution_status": F.lit("text_released"), "release_license": F.lit("CC-BY-4.0")})


def restricted(records: DataFrame, keep_abstractive: bool = True) -> DataFrame:
    """The others: metadata only, and the answer where it is no extract."""
    x = repair_titles(records.where(~is_redistributable(F.col("license"))))
    keep = (F.lower(F.coalesce("answer_style", F.lit(""))) != "extractive") & (F.coalesce("answer", F.lit("")) != "") & F.lit(keep_abstractive)
    kept = [c for c in RESTRICTED if c in x.columns]
    out = x.withColumns({"_a": F.when(keep, F.col("answer")), "_r": keep}).select(*[redact(F.col(c), x.schema[c].dataType).alias(c) for c in kept], redact(F.col("title_source"), T.StringType()).alias("title_source"), F.col("_a").alias("answer"), F.col("_r").alias("answer_released"))
    return out.withColumns({"document_hash": F.col("doc_id"), "redistribution_status": F.lit("metadata_only"), "release_license": F.lit("source_terms_apply")})


def public_view(records: DataFrame) -> DataFrame:
    """The fields for everybody: no text of the paper, evidence by its place alone."""
    spans = F.transform("evidence_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    names = ("id", "question", "answer", "doc_id", "doi", "pmid", "arxiv_id", "title", "year", "venue", "license", "context_id", "question_type", "answer_style", "quality_score", "split", "context_offsets")
    return records.select(*[c for c in names if c in records.columns], spans.alias("evidence_spans"))


def audit_rows(records: DataFrame) -> DataFrame:
    """What is released of each record, and how."""
    x = repair_titles(records)
    open_text = is_redistributable(F.col("license"))
    released_answer = open_text | (F.lower(F.coalesce("answer_style", F.lit(""))) != "extractive") & (F.coalesce("answer", F.lit("")) != "")
    return x.select(
        F.col("id").alias("record_id"), F.col("doc_id").alias("document_hash"), "doi", "title", "title_source", "year", "venue", F.coalesce("license", F.lit("unknown")).alias("license"), "split", "question_type", "answer_style",
        F.when(open_text, "text_released").otherwise("metadata_only").alias("redistribution_status"), released_answer.alias("answer_released"), (F.coalesce("source_pdf", F.lit("")) != "").alias("source_pdf_present"),
    )


def tier_counts(records: DataFrame) -> DataFrame:
    """Records and documents per split, licence and tier."""
    tier = F.when(is_redistributable(F.col("license")), "released").otherwise("restricted")
    return records.groupBy("split", F.coalesce("license", F.lit("unknown")).alias("license"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("doc_id").alias("documents"))


def reconstruct(restricted_records: DataFrame, texts: DataFrame) -> DataFrame:
    """Restricted records with the paragraph of their text: `texts` has `doc_id` and `paragraphs`, an array from 0.

    The text is looked up by `document_hash`, else `doc_id`; `status` says found, no_document or no_paragraph.
    """
    known = texts.select(F.col("doc_id").alias("_d"), F.lit(True).alias("_known")).distinct()
    # a paragraph is joined by its document and its place: a document with very many records is spread over the tasks, and
    # its paragraphs aren't copied to each of them
    parts = texts.select(F.col("doc_id").alias("_d"), F.posexplode("paragraphs").alias("_at", "_text"))
    x = restricted_records.withColumn("_key", F.coalesce("document_hash", "doc_id"))
    x = x.join(parts, (F.col("_key") == F.col("_d")) & (F.col("paragraph_index") == F.col("_at")), "left").drop("_d", "_at")
    x = x.join(known, F.col("_key") == F.col("_d"), "left")
    status = F.when(F.col("_known").isNull(), "no_document").when(F.col("_text").isNull(), "no_paragraph").otherwise("found")
    return x.withColumns({"context": F.col("_text"), "status": status}).drop("_key", "_d", "_known", "_text")
