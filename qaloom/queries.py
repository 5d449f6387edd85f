"""The queries of the core operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaloom.functions import metadata as md
from qaloom.functions import text as tx
from qaloom.functions.hashing import file_stem
from qaloom.operators import agreement, annotate, classify, dedup, evidence, generation, quality, release, retrieval, splitting, statistics
from qaloom.operators.rows import latest_rows
from qaloom.plans.staging import staged
from qaloom.sources import readers, writers
from qaloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RAW = "id run_id created_at model file_name source_pdf line_number paragraph_index context question answer usage".split()
RELEASE = (
    "id question answer context file_name source_pdf paragraph_index line_number doc_id doi pmid arxiv_id title year venue license context_offsets evidence_spans "
    "question_type answer_style quality_score split context_id model run_id created_at enriched_at enrichment_version"
).split()

#: Parts of the SQL: white space, the latest delivery of records, the words of a text.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
QA = "qa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d_ FROM qa_raw WHERE id IS NOT NULL) WHERE d_ = 1)"
REL = "rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d_ FROM qa_release WHERE id IS NOT NULL) WHERE d_ = 1)"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_md5_mod(x: str, m: int) -> str:
    return f"(((('0x' || substr(md5({x}), 1, 16))::UBIGINT % {m}) * {pow(2, 64, m)} + ('0x' || substr(md5({x}), 17, 16))::UBIGINT % {m}) % {m})"


def sql_split(bucket: str) -> str:
    return f"CASE WHEN {bucket} < 85 THEN 'train' WHEN {bucket} < 95 THEN 'val' ELSE 'test' END"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def qa(spark: SparkSession, d: str, columns: list[str] = RAW) -> DataFrame:
    return latest_rows(table(spark, d, "qa_raw"), "id", "loaded_at", ["id", *[c for c in columns if c != "id"]])


def rel(spark: SparkSession, d: str, columns: list[str] = RELEASE) -> DataFrame:
    return latest_rows(table(spark, d, "qa_release"), "id", "loaded_at", ["id", *[c for c in columns if c != "id"]])


# --- splits ---------------------------------------------------------------------------------------------------------

STEM = r"regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@query("split_assign", f"WITH {QA} SELECT id, {STEM} AS doc_id, {sql_split(sql_md5_mod(STEM + ' || ' + chr(39) + ':42' + chr(39), 100))} AS split FROM qa WHERE file_name IS NOT NULL")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d, ["id", "file_name"]).where("file_name IS NOT NULL")
    return splitting.assign_splits(rows).select("id", file_stem(F.col("file_name")).alias("doc_id"), "split")


@query("split_stats", f"""WITH {QA}, s AS (SELECT {STEM} AS doc_id, {sql_split(sql_md5_mod(STEM + " || ':42'", 100))} AS split FROM qa WHERE file_name IS NOT NULL),
g AS (SELECT coalesce(split, 'total') AS split, count(DISTINCT doc_id) AS documents, count(*) AS pairs FROM s GROUP BY ROLLUP (split))
SELECT split, documents, pairs, 100.0::DOUBLE * documents / max(documents) OVER () AS document_percent, 100.0::DOUBLE * pairs / max(pairs) OVER () AS pair_percent FROM g""")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_statistics(split_assign(spark, d)).withColumn("pairs", F.col("pairs").cast("bigint"))


@query("record_split", f"WITH {QA} SELECT id, {sql_split(sql_md5_mod('id', 100))} AS split FROM qa")
def record_split(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id"]).select("id", splitting.record_split(F.col("id")).alias("split"))


@query("context_drop", f"WITH {QA} SELECT id, {sql_md5_mod(chr(39) + 'ctx_' + chr(39) + ' || id', 1000)} < 300 AS drops FROM qa")
def context_drop(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id"]).select("id", splitting.drops_context(F.col("id")).alias("drops"))


@query("leakage_check", f"WITH {REL}, k AS (SELECT DISTINCT doc_id, split FROM rel WHERE doc_id IS NOT NULL AND split IS NOT NULL) SELECT doc_id, string_agg(split, ',' ORDER BY split) AS splits FROM k GROUP BY doc_id HAVING count(*) > 1")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return splitting.leaking_documents(rel(spark, d, ["id", "doc_id", "split"]))


# --- filters and quality --------------------------------------------------------------------------------------------

_GENERIC = ", ".join(f"'{g}'" for g in quality.GENERIC)
_GENERIC_SHORT = ", ".join(f"'{g}'" for g in quality.GENERIC_SHORT)


@query("quality_filter_f1", f"WITH {QA} SELECT id FROM qa WHERE length(trim(question)) >= 15 AND length(trim(answer)) >= 20 AND lower(trim(question)) NOT IN ({_GENERIC})")
def quality_filter_f1(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "question", "answer"]).where(quality.is_quality_record(F.col("question"), F.col("answer"))).select("id")


@query("valid_pairs", f"""WITH {QA} SELECT id FROM qa WHERE length(trim(question)) >= 15 AND length(trim(answer)) >= 20 AND lower(trim(question)) NOT IN ({_GENERIC_SHORT})
AND NOT (contains(lower(trim(answer)), lower(trim(question))) AND length(trim(answer)) < length(trim(question)) * 1.5)""")
def valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "question", "answer"]).where(quality.is_valid_pair(F.col("question"), F.col("answer"))).select("id")


@query("trainer_filter", f"WITH {QA} SELECT id, length(question) BETWEEN 10 AND 256 AND length(answer) BETWEEN 20 AND 512 AS embedding, length(question) BETWEEN 10 AND 512 AND length(answer) BETWEEN 20 AND 2048 AS generation FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL")
def trainer_filter(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    rows = qa(spark, d, ["id", "question", "answer"]).where(q.isNotNull() & a.isNotNull())
    return rows.select("id", quality.fits_trainer(q, a).alias("embedding"), quality.fits_trainer(q, a, (10, 512), (20, 2048)).alias("generation"))


def _count(x: str, k: str) -> str:
    return f"((length({x}) - length(replace({x}, '{k}', ''))) / {len(k)})"


@query("valid_paragraphs", f"""WITH {QA}, c AS (SELECT id, coalesce(context, '') AS t, lower(coalesce(context, '')) AS l FROM qa) SELECT id FROM c WHERE length(t) BETWEEN 50 AND 4000
AND NOT ({" OR ".join(f"starts_with(lower(trim(split_part(t, chr(10), 1))), '{p}')" for p in quality.EXCLUDED)})
AND {_count("l", "doi:")} <= 2 AND {_count("l", "http")} <= 3 AND {_count("t", "|")} <= 10 AND length(t) - length(replace(t, chr(9), '')) <= 20 AND {_count("t", ".")} >= 2""")
def valid_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "context"]).where(quality.is_valid_paragraph(F.col("context"))).select("id")


_STARTS = " OR ".join(f"starts_with(lower(q), '{s}')" for s in quality.STARTERS)
_TRIVIAL = " OR ".join(f"regexp_matches(lower(trim(q)), '{p}')" for p in quality.TRIVIAL)
_UNFINISHED = "".join(f" + CASE WHEN ends_with(lower(a), '{e}') THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END" for e in quality.UNFINISHED)
METRICS = f"""{QA}, t AS (SELECT id, coalesce(question, '') AS q, coalesce(answer, '') AS a, coalesce(context, '') AS c FROM qa),
w AS (SELECT *, list_distinct({sql_words("lower(a)")}) AS aw, list_distinct({sql_words("lower(c)")}) AS cw FROM t),
f AS (SELECT id, q, a, c, CASE WHEN len(aw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aw, cw))::DOUBLE / len(aw) END AS ov,
 {sql_squeeze("lower(a)")} <> '' AND contains({sql_squeeze("lower(c)")}, {sql_squeeze("lower(a)")}) AS sub,
 CASE WHEN q = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (0.0::DOUBLE + CASE WHEN length(q) > 50 THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN length(q) > 100 THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN regexp_matches(q, '[0-9]') THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN regexp_matches(q, '["''].*?["'']') THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN {_STARTS} THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN length(q) < 20 THEN -0.2::DOUBLE ELSE 0.0 END))) END AS sp,
 CASE WHEN a = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE + (0.0::DOUBLE{_UNFINISHED} + CASE WHEN right(a, 1) NOT IN ('.', '!', '?', ')', '"', '''') THEN -0.2::DOUBLE ELSE 0.0 END)) END AS co,
 length(trim(q)) < 10 OR {_TRIVIAL} AS tr FROM w),
m AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ov BETWEEN 0.2 AND 0.8 THEN 0.3::DOUBLE WHEN ov > 0.1 THEN 0.15::DOUBLE ELSE 0.0 END + sp * 0.25::DOUBLE + co * 0.2::DOUBLE
 + (0.0::DOUBLE + CASE WHEN length(q) BETWEEN 20 AND 200 THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN length(a) BETWEEN 30 AND 500 THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN tr THEN -0.3::DOUBLE ELSE 0.0 END))) AS score FROM f),
r AS (SELECT *, list_filter([CASE WHEN length(q) < 15 THEN 'question_too_short' END, CASE WHEN length(q) > 500 THEN 'question_too_long' END, CASE WHEN length(a) < 20 THEN 'answer_too_short' END,
 CASE WHEN length(a) > 2000 THEN 'answer_too_long' END, CASE WHEN length(c) < 50 THEN 'context_too_short' END, CASE WHEN ov < 0.1 THEN 'low_answer_context_overlap' END,
 CASE WHEN ov > 0.95 THEN 'excessive_answer_context_overlap' END, CASE WHEN sp < 0.3 THEN 'low_question_specificity' END, CASE WHEN tr THEN 'trivial_question' END, CASE WHEN score < 0.4 THEN 'low_quality_score' END], lambda x: x IS NOT NULL) AS reasons,
 NOT (length(q) < 15 OR length(q) > 500 OR length(a) < 20 OR length(a) > 2000 OR length(c) < 50 OR tr OR score < 0.4) AS keep FROM m)"""


@query("quality_metrics", f"WITH {METRICS} SELECT id, round(ov, 6) AS overlap, sub AS substring, round(sp, 6) AS specificity, round(co, 6) AS completeness, tr AS trivial, round(score, 6) AS quality_score, array_to_string(reasons, ',') AS reasons, keep FROM r")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = quality.quality_metrics(qa(spark, d, ["id", "question", "answer", "context"]))
    return m.select("id", F.round("answer_context_overlap", 6).alias("overlap"), F.col("answer_is_substring").alias("substring"), F.round("question_specificity", 6).alias("specificity"), F.round("answer_completeness", 6).alias("completeness"), F.col("is_trivial_question").alias("trivial"), F.round("quality_score", 6).alias("quality_score"), F.array_join("filter_reasons", ",").alias("reasons"), F.col("should_keep").alias("keep"))


@query("quality_histogram", f"WITH {METRICS} SELECT printf('%.1f', floor(round(score, 9) * 10.0::DOUBLE) / 10.0::DOUBLE) AS bucket, count(*) AS n FROM r GROUP BY 1")
def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    m = quality.quality_metrics(qa(spark, d, ["id", "question", "answer", "context"]))
    return m.groupBy(quality.score_bucket(F.round("quality_score", 9)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_reasons", f"WITH {METRICS}, u AS (SELECT unnest(reasons) AS reason FROM r WHERE NOT keep) SELECT reason, count(*) AS n FROM u GROUP BY reason")
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.reason_histogram(quality.quality_metrics(qa(spark, d, ["id", "question", "answer", "context"])))


@query("garbled", f"""WITH {QA}, t AS (SELECT id, coalesce(context, '') AS c FROM qa), s AS (SELECT id, c, length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) / nullif(length(c), 0)::DOUBLE AS al, length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / nullif(length(c), 0)::DOUBLE AS an FROM t)
SELECT id, CASE WHEN length(c) < 20 THEN true WHEN al < 0.15 THEN true WHEN an > 0.45 THEN false ELSE al < 0.20 END AS garbled FROM s""")
def garbled(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "context"]).select("id", quality.is_garbled(F.col("context")).alias("garbled"))


@query("extraction_quality", f"""WITH t AS (SELECT doc_id, page, block_no, coalesce(text, '') AS t, {sql_words("lower(text)")} AS w FROM pdf_blocks), s AS (SELECT *, list_distinct(w) AS u FROM t),
m AS (SELECT *, list_max(list_transform(u, lambda x: len(list_filter(w, lambda y: y = x)))) AS most, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]', '', 'g')) / nullif(length(t), 0)::DOUBLE AS sg FROM s)
SELECT doc_id, page, block_no, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN length(t) < 50 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN length(t) >= 50 AND len(w) >= 10 AND most / len(w)::DOUBLE > 0.3 THEN 0.5::DOUBLE ELSE 0 END
 - CASE WHEN len(w) > 10 AND len(u) / len(w)::DOUBLE < 0.3 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN sg > 0.3 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN {" OR ".join(f"contains(lower(t), '{f}')" for f in quality.FAILURES)} THEN 0.4::DOUBLE ELSE 0 END), 6) END AS score FROM m""")
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").select("doc_id", "page", "block_no", F.round(quality.extraction_quality(F.col("text")), 6).alias("score"))


@query("retry_decision")
def retry_decision(spark: SparkSession, d: str) -> DataFrame:
    scored = extraction_quality(spark, d)
    return scored.select("doc_id", "page", "block_no", quality.retry_decision(F.col("score"), F.col("page")).alias("decision"))


# --- text -----------------------------------------------------------------------------------------------------------


def _sql_cut(x: str, n: int) -> str:
    return f"CASE WHEN contains(left({x}, {n}), ' ') THEN regexp_extract(left({x}, {n}), '(?s)^(.*) [^ ]*$', 1) ELSE left({x}, {n}) END"


def _sql_clean_answer(x: str) -> str:
    out = f"coalesce({x}, '')"
    for p in tx.ANSWER_NOISE:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return sql_squeeze(out)


@query("clean_answer", f"WITH {QA}, c AS (SELECT id, {_sql_clean_answer('answer')} AS x FROM qa) SELECT id, CASE WHEN length(x) > 512 THEN trim({_sql_cut('x', 512)}) ELSE x END AS answer FROM c")
def clean_answer(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "answer"]).select("id", tx.clean_answer(F.col("answer")).alias("answer"))


@query("clean_question", f"WITH {QA}, c AS (SELECT id, {sql_squeeze('coalesce(question, chr(32))')} AS x FROM qa), k AS (SELECT id, x, {_sql_cut('x', 256)} AS y FROM c) SELECT id, CASE WHEN length(x) <= 256 THEN x WHEN ends_with(y, '?') THEN y ELSE y || '?' END AS question FROM k")
def clean_question(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "question"]).select("id", tx.clean_question(F.col("question")).alias("question"))


@query("truncate_context", f"""WITH {QA}, h AS (SELECT id, context AS t, left(context, 1536) AS h FROM qa WHERE context IS NOT NULL), p AS (SELECT *, CASE WHEN contains(h, '. ') THEN length(h) - strpos(reverse(h), ' .') - 1 ELSE -1 END AS pos FROM h)
SELECT id, CASE WHEN length(t) <= 1536 THEN t WHEN pos > 768 THEN left(h, pos + 1) ELSE {_sql_cut('t', 1536)} END AS context FROM p""")
def truncate_context(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "context"]).where("context IS NOT NULL").select("id", tx.truncate_context(F.col("context")).alias("context"))


@query("paragraphs")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return readers.explode_paragraphs(table(spark, d, "documents").select("doc_id", "text"))


@query("body_text", "WITH t AS (SELECT doc_id, text, least(nullif(strpos(lower(text), 'abstract'), 0), nullif(strpos(lower(text), 'introduction'), 0)) AS s, nullif(strpos(lower(text), 'references'), 0) AS e FROM documents) SELECT doc_id, CASE WHEN s < e THEN substr(text, s, e - s) ELSE text END AS text FROM t")
def body_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.body_text(F.col("text")).alias("text"))


@query("page_texts", "SELECT doc_id, page, string_agg(text, '' ORDER BY block_no) AS text FROM pdf_blocks WHERE block_type = 0 GROUP BY doc_id, page")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_blocks(table(spark, d, "pdf_blocks"))


@query("clean_pages")
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_texts(spark, d).select("doc_id", "page", readers.clean_page(F.col("text")).alias("text"))


@query("markdown_documents")
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = page_texts(spark, d).withColumn("quality", quality.extraction_quality(F.col("text")))
    total = table(spark, d, "pdf_blocks").groupBy("doc_id").agg(F.max("page").alias("pages"))
    return writers.markdown_pages(pages, total)


@query("chat_messages")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d, ["id", "question", "answer", "context"]).where("question IS NOT NULL AND answer IS NOT NULL")
    context = F.when(splitting.drops_context(F.col("id")), F.lit("")).otherwise(tx.truncate_context(F.coalesce("context", F.lit(""))))
    return rows.select("id", writers.chat_text(writers.chat_messages(F.col("question"), F.col("answer"), context)).alias("text"))


# --- question types, evidence, enrichment ---------------------------------------------------------------------------


def _sql_types() -> str:
    parts = []
    for order, (name, patterns) in enumerate(classify.PATTERNS.items()):
        hits = [f"regexp_matches(q, '{p}')" for p in patterns]
        score = " + ".join(f"CASE WHEN {h} THEN {1.0 / (i + 1)!r}::DOUBLE ELSE 0.0::DOUBLE END" for i, h in enumerate(hits))
        score += "".join(f" + CASE WHEN contains(q, '{w}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" for w in classify.INDICATORS.get(name, ()))
        parts.append(f"CASE WHEN {' OR '.join(hits)} THEN {{'score': 0.0::DOUBLE + {score}, 'ord': {-order}, 'type': '{name}'}} END")
    return f"list_reverse_sort(list_filter([{', '.join(parts)}], lambda r: r IS NOT NULL))"


TYPES = f"""{QA}, t AS (SELECT id, lower(trim(coalesce(question, ''))) AS q FROM qa), s AS (SELECT id, q, {_sql_types()} AS s FROM t), c AS (SELECT id, CASE WHEN q = '' THEN 'unknown' WHEN len(s) > 0 THEN s[1].type
 WHEN starts_with(q, 'how') THEN CASE WHEN contains(q, 'how many') OR contains(q, 'how much') OR contains(q, 'how often') THEN 'numeric' ELSE 'method' END WHEN starts_with(q, 'why') THEN 'causal'
 WHEN starts_with(q, 'what is') OR starts_with(q, 'what are') THEN 'definition' WHEN regexp_matches(q, '^(?:what|which|who|when|where)') THEN 'factual' ELSE 'unknown' END AS question_type,
 CASE WHEN q = '' THEN 0.0::DOUBLE WHEN len(s) = 0 THEN 0.5::DOUBLE WHEN len(s) = 1 THEN 0.8::DOUBLE ELSE round(least(0.95::DOUBLE, 0.6::DOUBLE + (s[1].score - s[2].score) * 0.2::DOUBLE), 3) END AS confidence, CASE WHEN s[2].score > 0.5 THEN s[2].type END AS secondary FROM s)"""


@query("question_types", f"WITH {TYPES} SELECT * FROM c")
def question_types(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(qa(spark, d, ["id", "question"])).select("id", "question_type", F.col("question_type_confidence").alias("confidence"), F.col("question_type_secondary").alias("secondary"))


@query("type_distribution", f"WITH {TYPES}, g AS (SELECT question_type, count(*) AS n FROM c GROUP BY 1) SELECT question_type, n, 100.0::DOUBLE * n / sum(n) OVER () AS percent FROM g")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return classify.type_distribution(classify.classify(qa(spark, d, ["id", "question"])))


@query("question_features")
def question_features(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "question", "answer"]).select("id", classify.question_features(F.col("question"), F.col("answer")).alias("f")).select("id", "f.*")


STYLE = f"""{QA}, t AS (SELECT id, coalesce(context, '') AS c, coalesce(answer, '') AS a, list_distinct({sql_words("lower(answer)")}) AS aw, list_distinct({sql_words("lower(context)")}) AS cw FROM qa),
o AS (SELECT *, CASE WHEN len(aw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aw, cw))::DOUBLE / len(aw) END AS ov FROM t),
y AS (SELECT id, CASE WHEN c = '' OR {sql_squeeze("a")} = '' THEN 'unknown' WHEN contains({sql_squeeze("lower(c)")}, {sql_squeeze("lower(a)")}) OR ov > 0.8 THEN 'extractive' ELSE 'abstractive' END AS answer_style FROM o)"""


@query("answer_style", f"WITH {STYLE} SELECT * FROM y")
def answer_style(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "context", "answer"]).select("id", evidence.answer_style(F.col("context"), F.col("answer")).alias("answer_style"))


@query("evidence_spans")
def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "context", "answer"]).select("id", F.explode(evidence.evidence_spans("context", "answer")).alias("s")).select("id", "s.start", "s.end", "s.text")


@query("enriched_records")
def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    facts = latest_rows(table(spark, d, "doc_metadata").withColumn("_o", F.coalesce("extraction_confidence", F.lit(-1.0))), "doc_id", "_o", ["doc_id", "doi", "pmid", "arxiv_id", "title", "year", "venue", "license"])
    return evidence.enrich(classify.classify(qa(spark, d)), facts)


@query("context_ids", f"WITH {QA} SELECT id, left(md5({STEM} || ':' || coalesce(paragraph_index, 0)), 16) AS context_id FROM qa WHERE file_name IS NOT NULL")
def context_ids(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "file_name", "paragraph_index"]).where("file_name IS NOT NULL").select("id", evidence.context_id(file_stem(F.col("file_name")), F.coalesce("paragraph_index", F.lit(0))).alias("context_id"))


# --- metadata -------------------------------------------------------------------------------------------------------

_VENUE = " ".join(f"WHEN contains(lower(h), '{p.lower()}') THEN '{n}'" for p, n in md.VENUES)
_OPEN = " OR ".join([*(f"contains(lower(venue), '{v}')" for v in md.OPEN_VENUES), *(f"starts_with(doi, '{p}')" for p in md.OPEN_PREFIXES)])
#: A header with identifiers before each text, so that every pattern has something to find.
HEADER = "CASE doc_id % 4 WHEN 0 THEN 'PLOS ONE (' || (1985 + doc_id % 40) || ') doi:10.1234/ab' || doc_id || '. ' WHEN 1 THEN 'PMID: ' || (20000000 + doc_id) || ' Analytical Chemistry Copyright ' || (2000 + doc_id % 25) || ' ' WHEN 2 THEN 'arXiv:2101.' || (10000 + doc_id % 80000) || 'v2 Creative Commons ' ELSE '' END || coalesce(text, '')"


def _sql_first(patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join("nullif(regexp_extract(w, '" + p.replace("'", "''") + "', 1), '')" for p in patterns) + ")"


def _sql_doi() -> str:
    rows = []
    for p in md.DOI:
        x = "rtrim(regexp_extract(w, '" + p.replace("'", "''") + "', 1), '.,;:')"
        rows.append(f"CASE WHEN regexp_matches({x}, '^10\\.\\d{{4,}}/\\S+$') THEN {x} END")
    return "coalesce(" + ", ".join(rows) + ")"


def _sql_year() -> str:
    stated = ", ".join(f"CASE WHEN try_cast(regexp_extract(h, '{p}', 1) AS INT) BETWEEN 1990 AND 2030 THEN try_cast(regexp_extract(h, '{p}', 1) AS INT) END" for p in md.YEAR)
    every = r"regexp_extract_all(h, '\b(19\d{2}|20[0-2]\d)\b', 1)"
    return f"coalesce({stated}, list_max(list_transform(list_distinct({every}), lambda y: {{'n': len(list_filter({every}, lambda z: z = y)), 'at': -list_position({every}, y), 'y': y}})).y::INT)"


METADATA = f"""t AS (SELECT doc_id, {HEADER} AS x FROM documents), s AS (SELECT doc_id, x, left(x, 3000) AS h, CASE WHEN length(x) > 4000 THEN left(x, 3000) || right(x, 1000) ELSE x END AS w FROM t),
i AS (SELECT doc_id, x, h, {_sql_doi()} AS doi, {_sql_first(md.PMID)} AS pmid, {_sql_first(md.ARXIV)} AS arxiv_id, {_sql_year()} AS year,
 CASE {_VENUE} ELSE nullif(trim(regexp_extract(h, '(?:published in|journal[:\\s]+)([A-Z][A-Za-z\\s&]+)', 1)), '') END AS venue FROM s),
m AS (SELECT doc_id, doi, pmid, arxiv_id, year, venue, CASE WHEN regexp_matches(lower(left(x, 5000)), 'creative\\s+commons|cc[\\s-]by|open\\s+access|freely\\s+available') OR coalesce({_OPEN}, false) THEN 'open_access' ELSE 'unknown' END AS license FROM i)"""


def _headed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(HEADER).alias("x"))


@query("doc_metadata_fields", f"WITH {METADATA} SELECT * REPLACE (year::DOUBLE AS year) FROM m")
def doc_metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    found = _headed(spark, d).withColumns({"doi": md.doi_of(x), "venue": md.venue_of(x)})
    return found.select("doc_id", "doi", md.pmid_of(x).alias("pmid"), md.arxiv_of(x).alias("arxiv_id"), md.year_of(x).cast("double").alias("year"), "venue", md.license_of(x, F.col("venue"), F.col("doi")).alias("license"))


_NO_TITLE = " OR ".join(f"contains(lower(l), '{s}')" for s in md.NO_TITLE)
TITLES = f"""l AS (SELECT doc_id, unnest(list_slice(string_split(left(text, 2000), chr(10)), 1, 20)) AS raw, generate_subscripts(list_slice(string_split(left(text, 2000), chr(10)), 1, 20), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id, i, trim(raw) AS l FROM l), k AS (SELECT doc_id, max({{'score': length(l) * (20 - i) / 20.0::DOUBLE, 'at': -i, 't': l}}) AS b FROM c WHERE length(l) > 30 AND length(l) < 300 AND length(regexp_replace(l, '[^0-9]', '', 'g')) <= length(l) * 0.3 AND NOT ({_NO_TITLE}) GROUP BY doc_id)"""


@query("doc_title", f"WITH {TITLES} SELECT doc_id, trim(regexp_replace(b.t, '\\s+', ' ', 'g')) AS title FROM k")
def doc_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", md.title_of(F.col("text")).alias("title")).where("title IS NOT NULL")


@query("metadata_confidence", f"""WITH {METADATA}, {TITLES} SELECT m.doc_id, round(least(1.0::DOUBLE, CASE WHEN doi IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN pmid IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN arxiv_id IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN length(k.b.t) > 20 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN venue IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END), 6) AS confidence FROM m LEFT JOIN k ON k.doc_id = m.doc_id""")
def metadata_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, d, "documents").select("doc_id", F.expr(HEADER).alias("x"), "text")
    return rows.select("doc_id", F.round(md.confidence_of(md.doi_of(x), md.pmid_of(x), md.arxiv_of(x), md.title_of(F.col("text")), md.year_of(x), md.venue_of(x)), 6).alias("confidence"))


@query("metadata_merged", """WITH s AS (SELECT doc_id, max(extraction_confidence) AS c FROM doc_metadata GROUP BY doc_id), b AS (SELECT d.* FROM doc_metadata d JOIN s ON s.doc_id = d.doc_id AND s.c = d.extraction_confidence),
o AS (SELECT d.doc_id, max(d.doi) AS doi, max(d.pmid) AS pmid, max(d.venue) AS venue FROM doc_metadata d GROUP BY d.doc_id)
SELECT b.doc_id, coalesce(b.doi, o.doi) AS doi, coalesce(b.pmid, o.pmid) AS pmid, coalesce(b.venue, o.venue) AS venue, least(1.0::DOUBLE, b.extraction_confidence + 0.2::DOUBLE) AS confidence FROM b JOIN o ON o.doc_id = b.doc_id""")
def metadata_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_metadata")
    best = rows.join(rows.groupBy("doc_id").agg(F.max("extraction_confidence").alias("extraction_confidence")), ["doc_id", "extraction_confidence"])
    other = rows.groupBy("doc_id").agg(*[F.max(c).alias(f"_{c}") for c in ("doi", "pmid", "venue")])
    return best.join(other, "doc_id").select("doc_id", *[F.coalesce(c, f"_{c}").alias(c) for c in ("doi", "pmid", "venue")], F.least(F.lit(1.0), F.col("extraction_confidence") + F.lit(0.2)).alias("confidence"))


# --- release --------------------------------------------------------------------------------------------------------


def _sql_title(x: str) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), ' .;,:|-')"
    for p in release.STOPS:
        t = f"trim(regexp_replace({t}, '{p}', '', 'g'), ' .;,:|-')"
    return t


def _sql_suspicious(x: str, t: str) -> str:
    bad = " OR ".join("regexp_matches(" + t + ", '" + p.replace("'", "''") + "')" for p in release.SUSPICIOUS)
    return f"({x} IS NULL OR trim({x}) = '' OR length({t}) < 8 OR length({t}) > 180 OR (length({t}) - length(replace({t}, ',', '')) >= 3 AND NOT regexp_matches({t}, '[:?]')) OR {bad})"


def sql_repaired(source: str) -> str:
    """Titles of `source` (`id`, `title`, `context`, `doi`) as they are repaired, with where they come from."""
    found = "regexp_extract_all(coalesce(context, ''), '(?is)doi:\\s*\\S+\\s+(.{8,260})', 1)"
    clean = f"list_transform({found}, lambda f: trim(replace({_sql_title('f')}, coalesce(nullif(doi, ''), chr(1)), '')))"
    good = "length(g) BETWEEN 8 AND 180 AND NOT regexp_matches(g, '(?i)^(?:figure|table)\\s+\\d+') AND NOT regexp_matches(g, '(?i)\\b(?:doi|copyright|creative commons|downloaded from)\\b') AND length(regexp_replace(g, '[^\\p{L}]', '', 'g')) > length(g) * 0.45"
    return f"""n_ AS (SELECT id, title, {_sql_title('title')} AS t, list_filter({clean}, lambda g: {good})[-1] AS other FROM {source}), b_ AS (SELECT *, {_sql_suspicious('title', 't')} AS bad FROM n_),
repaired AS (SELECT id, CASE WHEN NOT bad THEN t WHEN other IS NOT NULL THEN other WHEN coalesce(title, '') <> '' THEN NULL ELSE title END AS title,
 CASE WHEN NOT bad THEN 'extracted' WHEN other IS NOT NULL THEN 'context_footer' WHEN coalesce(title, '') <> '' THEN 'unavailable_after_cleanup' END AS title_source FROM b_)"""


#: A fifth of the records gets a title that is none and a footer with the right one in its context.
_FOOTED = ["CASE WHEN ascii(substr(id, 2, 1)) % 5 = 0 THEN '1 Department of Chemistry' ELSE title END AS title", "CASE WHEN ascii(substr(id, 2, 1)) % 5 = 0 THEN coalesce(context, '') || ' doi: 10.1000/x' || left(id, 4) || ' Recovered findings on sample ' || left(id, 6) ELSE context END AS context"]


@query("repaired_titles", f"WITH {REL}, footed AS (SELECT id, doi, {', '.join(_FOOTED)} FROM rel), {sql_repaired('footed')} SELECT * FROM repaired")
def repaired_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, ["id", "title", "context", "doi"]).selectExpr("id", "doi", *_FOOTED)
    return release.repair_titles(rows).select("id", "title", "title_source")


@query("license_tiers", f"WITH {REL} SELECT split, coalesce(license, 'unknown') AS license, CASE WHEN lower(license) = 'open_access' THEN 'released' ELSE 'restricted' END AS tier, count(*) AS records, count(DISTINCT doc_id) AS documents FROM rel GROUP BY 1, 2, 3")
def license_tiers(spark: SparkSession, d: str) -> DataFrame:
    return release.tier_counts(rel(spark, d, ["id", "split", "license", "doc_id"]))


@query("public_projection", f"WITH {REL} SELECT id, doc_id, license, context_id, quality_score, len(evidence_spans)::DOUBLE AS spans, evidence_spans[1].start::DOUBLE AS first_start, evidence_spans[1].end::DOUBLE AS first_end FROM rel")
def public_projection(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("evidence_spans", F.lit(0))
    return release.public_view(rel(spark, d)).select("id", "doc_id", "license", "context_id", "quality_score", F.when(F.col("evidence_spans").isNotNull(), F.size("evidence_spans").cast("double")).alias("spans"), first["start"].cast("double").alias("first_start"), first["end"].cast("double").alias("first_end"))


@query("restricted_projection", f"""WITH {REL} SELECT id, license, question_type, answer_style, CASE WHEN lower(coalesce(answer_style, '')) <> 'extractive' AND coalesce(answer, '') <> '' THEN answer END AS answer,
 lower(coalesce(answer_style, '')) <> 'extractive' AND coalesce(answer, '') <> '' AS answer_released, 'metadata_only' AS redistribution_status FROM rel WHERE coalesce(lower(license), '') <> 'open_access'""")
def restricted_projection(spark: SparkSession, d: str) -> DataFrame:
    return release.restricted(rel(spark, d)).select("id", "license", "question_type", "answer_style", "answer", "answer_released", "redistribution_status")


def _keyed(x: str) -> str:
    """`x` with a key behind it in about a fifth of the records."""
    key = "' key sk-' || replace(id, '-', '') || ' (kept out)'"
    return f"CASE WHEN ascii(substr(id, 1, 1)) % 5 = 0 THEN {x} || {key} ELSE {x} END"


@query("redact_secrets", f"WITH {QA} SELECT id, {', '.join(f"regexp_replace({_keyed(c)}, '{release.SECRET}', '{release.MASK}', 'g') AS {c}" for c in ('question', 'answer', 'context'))} FROM qa")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Questions, answers and contexts of all records without keys; some records get one first, to be found."""
    rows = qa(spark, d, ["id", "question", "answer", "context"])
    return release.redact_all(rows.select("id", *[F.expr(_keyed(c)).alias(c) for c in ("question", "answer", "context")]))


RELEASE_TEXTS = [c for c in RELEASE if c not in ("paragraph_index", "line_number", "year", "context_offsets", "evidence_spans", "quality_score")]


def _sql_redacted(x: str) -> str:
    return f"regexp_replace({x}, '{release.SECRET}', '{release.MASK}', 'g')"


@query("redacted_records", f"WITH {REL} SELECT {', '.join(f'{_sql_redacted(c)} AS {c}' for c in RELEASE_TEXTS)}, array_to_string(list_transform(evidence_spans, lambda s: {_sql_redacted('s.text')}), chr(10)) AS evidence FROM rel")
def redacted_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole records without secrets, every text of them, those of the evidence in lines."""
    return release.redact_all(rel(spark, d)).select(*RELEASE_TEXTS, F.array_join(F.transform("evidence_spans", lambda s: s["text"]), "\n").alias("evidence"))


@query("audit_rows")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return release.audit_rows(rel(spark, d)).withColumn("year", F.col("year").cast("double"))


@query("reconstructed")
def reconstructed(spark: SparkSession, d: str) -> DataFrame:
    texts = page_texts(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("t")).select("doc_id", readers.block_paragraphs(F.col("t")).alias("paragraphs"))
    rows = release.restricted(rel(spark, d))
    return release.reconstruct(rows, texts).select("id", "document_hash", "paragraph_index", "context", "status")


# --- repeated records -----------------------------------------------------------------------------------------------


@query("exact_dedup", f"WITH {QA}, h AS (SELECT id, md5({sql_squeeze('lower(question)')}) AS k FROM qa), r AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM h) SELECT id FROM r WHERE n = 1 OR k IS NULL")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(qa(spark, d, ["id", "question"]), dedup.question_hash(F.col("question")), [F.col("id")]).select("id")


@query("near_duplicate_classes")
def near_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class of equal shingle sets and the number of links of that class."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("node"), "text")
    pairs, classes = dedup.near_duplicates(texts)
    pairs = staged(pairs)
    links = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(links, "class", "left").select(F.col("node").alias("doc_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@query("near_dedup")
def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_dedup(table(spark, d, "documents").select(F.col("doc_id").alias("node"), "text")).select(F.col("node").alias("doc_id"), "kept")


@query("fuzzy_dedup")
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fuzzy_dedup(qa(spark, d, ["id", "question"])).select(F.col("node").alias("id"), "kept")


# --- retrieval ------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stated queries, the questions of test records, against the answers of all test records."""
    rows = qa(spark, d, ["id", "question", "answer"]).where(splitting.record_split(F.col("id")) == "test")
    rows = staged(rows.where(quality.fits_trainer(F.col("question"), F.col("answer"))))
    return rows.select(F.col("id").alias("qid"), F.col("question").alias("text")), rows.select(F.col("id").alias("cid"), F.col("answer").alias("text")), rows.select(F.col("id").alias("qid"), F.col("id").alias("cid"))


BM25 = f"""{QA}, t AS (SELECT id, question, answer FROM qa WHERE {sql_split(sql_md5_mod('id', 100))} = 'test' AND length(question) BETWEEN 10 AND 256 AND length(answer) BETWEEN 20 AND 512),
dw AS (SELECT id AS cid, {sql_words("lower(answer)")} AS w FROM t), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avg FROM dw),
tf AS (SELECT cid, any_value(ln) AS ln, term, count(*)::DOUBLE AS tf FROM (SELECT cid, len(w) AS ln, unnest(w) AS term FROM dw) GROUP BY cid, term),
df AS (SELECT term, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(n.avg) AS avg FROM tf, n GROUP BY term), idf AS (SELECT term, avg, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT id AS qid, unnest({sql_words("lower(question)")}) AS term FROM t) GROUP BY 1, 2),
sc AS (SELECT qid, cid, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / avg)) * qn) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) GROUP BY 1, 2),
rk AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank FROM sc)"""


def _all_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stated queries, the questions of test records, against all answers."""
    q, _, rels = _answers(spark, d)
    return q, qa(spark, d, ["id", "answer"]).where("answer IS NOT NULL").select(F.col("id").alias("cid"), F.col("answer").alias("text")), rels


BM25_ALL = BM25.replace("AS w FROM t)", "AS w FROM qa WHERE answer IS NOT NULL)", 1)


@query("bm25_topk", f"WITH {BM25_ALL} SELECT qid, cid, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best answers of all records for the questions of test records."""
    q, c, _ = _all_answers(spark, d)
    return retrieval.top_k(retrieval.bm25_best(q, c, 10), 10).select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("bm25_metrics", f"""WITH {BM25_ALL}, f AS (SELECT t.id, min(CASE WHEN rk.cid = t.id THEN rank END) AS r FROM t LEFT JOIN rk ON rk.qid = t.id GROUP BY t.id)
SELECT count(*) AS queries, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
 round(avg(CASE WHEN r <= 10 THEN 1.0 / log2(r + 1) ELSE 0 END), 6) AS ndcg_10, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS map_10 FROM f""")
def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the questions of test records against the answers of all records."""
    q, c, rels = _all_answers(spark, d)
    m = retrieval.mean_metrics(retrieval.per_query_metrics(q, retrieval.top_k(retrieval.bm25_best(q, c, 10), 10), rels))
    return m.select("queries", *[F.round(x, 6).alias(x) for x in ("mrr", "recall_1", "recall_5", "recall_10", "ndcg_10", "map_10")])


@query("context_retrieval_task", f"WITH {REL} SELECT context_id AS cid, max_by(context, id) AS text, count(*) AS questions FROM rel WHERE context_id IS NOT NULL AND context IS NOT NULL GROUP BY context_id")
def context_retrieval_task(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, ["id", "context_id", "context"]).where("context_id IS NOT NULL AND context IS NOT NULL").groupBy(F.col("context_id").alias("cid")).agg(F.max_by("context", "id").alias("text"), F.count(F.lit(1)).alias("questions"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("ql")), v.select(F.col("vec_id").alias("cid"), "embedding", F.col("label").alias("cl"))


DENSE = """q AS (SELECT vec_id AS qid, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, ql, c.vec_id AS cid, c.label AS cl, list_cosine_similarity(list_transform(q.e, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)) AS score FROM q, embeddings c WHERE c.vec_id <> qid),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank FROM s)"""


@query("dense_topk", f"WITH {DENSE} SELECT qid, cid, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    found = retrieval.dense_scores(q, c, 11).where("qid <> cid")
    return retrieval.top_k(found, 10).select("qid", "cid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("dense_metrics", f"WITH {DENSE}, h AS (SELECT qid, count(*) FILTER (WHERE cl = ql AND rank <= 10) AS h, coalesce(max(1.0 / rank) FILTER (WHERE cl = ql AND rank <= 10), 0) AS rr FROM k GROUP BY qid) SELECT count(*) AS queries, round(avg(h / 10.0), 6) AS precision_10, round(avg(rr), 6) AS mrr FROM h")
def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    ranked = retrieval.top_k(retrieval.dense_scores(q, c, 11).where("qid <> cid"), 10).select("qid", "cid", "score", "rank")
    rels = ranked.join(q.select("qid", "ql"), "qid").join(c.select("cid", "cl"), "cid").where("ql = cl").select("qid", "cid")
    m = retrieval.mean_metrics(retrieval.per_query_metrics(q, ranked, rels))
    return m.select("queries", F.round("precision_10", 6).alias("precision_10"), F.round("mrr", 6).alias("mrr"))


# --- generation -----------------------------------------------------------------------------------------------------

PAIRS = f"{REL}, p AS (SELECT id, coalesce(answer, '') AS r, coalesce(question, '') AS p FROM rel)"


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """Questions stand in for generated answers: two texts of a record to be compared."""
    return rel(spark, d, ["id", "question", "answer"]).select("id", F.col("answer").alias("r"), F.col("question").alias("p"))


@query("token_f1", f"""WITH {PAIRS}, w AS (SELECT id, list_distinct({sql_words("lower(p)")}) AS p, list_distinct({sql_words("lower(r)")}) AS r FROM p), s AS (SELECT *, len(list_intersect(p, r))::DOUBLE AS s FROM w)
SELECT id, CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0::DOUBLE WHEN s = 0 THEN 0.0::DOUBLE ELSE round(2 * (s / len(p)) * (s / len(r)) / (s / len(p) + s / len(r)), 6) END AS f1 FROM s""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("id", F.round(generation.token_scores(F.col("p"), F.col("r"))["f1"], 6).alias("f1"))


_SAID = "CASE WHEN length(answer) % 3 = 0 THEN ' ' || answer || ' ' ELSE answer || '!' END"


@query("exact_match", f"WITH {REL} SELECT round(avg((lower(trim(coalesce({_SAID}, ''))) = lower(trim(coalesce(answer, ''))))::INT::DOUBLE), 9) AS exact_match FROM rel")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers against themselves with blanks around them, and against such with a sign more."""
    rows = rel(spark, d, ["id", "answer"]).select(F.expr(_SAID).alias("p"), F.col("answer").alias("r"))
    return rows.agg(F.round(F.avg(generation.exact_match(F.col("p"), F.col("r"))), 9).alias("exact_match"))


def _sql_rouge(n: int) -> str:
    tok = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '')"
    gram = "CASE WHEN len({w}) < {n} THEN []::VARCHAR[] ELSE list_transform(generate_series(1, len({w}) - {m}), lambda i: array_to_string({w}[i:i + {m}], ' ')) END"
    return f"""WITH {PAIRS}, w AS (SELECT id, {tok.format(x='p')} AS p, {tok.format(x='r')} AS r FROM p), g AS (SELECT id, {gram.format(w='p', n=n, m=n - 1)} AS p, {gram.format(w='r', n=n, m=n - 1)} AS r FROM w),
u AS (SELECT id, g, count(*) FILTER (WHERE s = 'p') AS np, count(*) FILTER (WHERE s = 'r') AS nr FROM (SELECT id, unnest(p) AS g, 'p' AS s FROM g UNION ALL SELECT id, unnest(r), 'r' FROM g) GROUP BY id, g), k AS (SELECT id, sum(least(np, nr)) AS same FROM u GROUP BY id)
SELECT g.id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0::DOUBLE ELSE round(2.0 * coalesce(same, 0) / (len(p) + len(r)), 6) END AS f1 FROM g LEFT JOIN k USING (id)"""


@query("rouge_1", _sql_rouge(1))
def rouge_1(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("id", F.round(generation.rouge_n(F.col("p"), F.col("r"), 1), 6).alias("f1"))


@query("rouge_2", _sql_rouge(2))
def rouge_2(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("id", F.round(generation.rouge_n(F.col("p"), F.col("r"), 2), 6).alias("f1"))


@query("rouge_l")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("id", generation.rouge_l("p", "r").alias("f1"))


MODELS = "s AS (SELECT model AS model_name, avg(length(answer)) AS answer_length, avg(length(question)) AS question_length, count(*)::DOUBLE AS perplexity, row_number() OVER (ORDER BY model) AS position FROM qa WHERE model IS NOT NULL GROUP BY model)"


@query("model_rank", f"""WITH {QA}, {MODELS}, k AS (SELECT model_name, position, (2.0 * row_number() OVER (ORDER BY answer_length DESC, position) + row_number() OVER (ORDER BY question_length DESC, position) + row_number() OVER (ORDER BY perplexity, position)) / 4.0 AS mean_rank FROM s)
SELECT model_name, mean_rank::DOUBLE AS mean_rank, row_number() OVER (ORDER BY round(mean_rank, 9), position) AS overall_rank FROM k""")
def model_rank(spark: SparkSession, d: str) -> DataFrame:
    by = qa(spark, d, ["id", "model", "question", "answer"]).where("model IS NOT NULL").groupBy(F.col("model").alias("model_name")).agg(F.avg(F.length("answer")).alias("answer_length"), F.avg(F.length("question")).alias("question_length"), F.count(F.lit(1)).cast("double").alias("perplexity"))
    placed = by.withColumn("position", F.row_number().over(Window.orderBy("model_name")))  # one row a model
    return generation.rank_models(placed, {"answer_length": 2.0, "question_length": 1.0, "perplexity": 1.0}).withColumn("overall_rank", F.col("overall_rank").cast("bigint"))


# --- annotation and agreement ---------------------------------------------------------------------------------------


@query("auto_annotation")
def auto_annotation(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, ["id", "question", "answer", "context", "quality_score"])
    return annotate.annotate(rows).select("id", "answer_correct", "evidence_support", "evidence_quality", "question_clarity", "notes")


@query("annotation_features", f"""WITH {REL}, x AS (SELECT id, coalesce(answer, '') AS a, coalesce(context, '') AS c FROM rel), n AS (SELECT id, list_distinct(regexp_extract_all(a, '(\\d+\\.?\\d*)', 1)) AS an, list_distinct(regexp_extract_all(c, '(\\d+\\.?\\d*)', 1)) AS cn,
 list_filter(string_split({sql_squeeze("lower(a)")}, ' '), lambda w: w <> '') AS w, {sql_squeeze("lower(c)")} AS l FROM x), p AS (SELECT *, CASE WHEN len(w) < 3 THEN []::VARCHAR[] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END AS t FROM n)
SELECT id, CASE WHEN len(an) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(an, cn)) / len(an)::DOUBLE, 6) END AS number_overlap, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(t, lambda y: contains(l, y))) / len(t)::DOUBLE, 6) END AS phrase_overlap FROM p""")
def annotation_features(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, ["id", "question", "answer", "context"])
    return annotate.features(rows).select("id", F.round("number_overlap", 6).alias("number_overlap"), F.round("phrase_overlap", 6).alias("phrase_overlap"))


#: Two raters: the reviewer of a document, and a rule on its length.
RATERS = "p AS (SELECT r.doc_id, CAST(r.abusive AS VARCHAR) AS a, CASE WHEN length(d.text) % 3 = 0 THEN '1' ELSE '0' END AS b, CASE WHEN length(d.text) % 2 = 0 THEN '1' ELSE '0' END AS c FROM review_labels r JOIN documents d ON d.doc_id = r.doc_id)"


def _raters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    rows = table(spark, d, "review_labels").join(docs, "doc_id")
    rule = lambda k: F.when(F.col("n") % k == 0, "1").otherwise("0")
    return rows.select("doc_id", F.col("abusive").cast("string").alias("a"), rule(3).alias("b"), rule(2).alias("c"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    r = _raters(spark, d)
    return agreement.aligned(r.select("doc_id", F.col("a").alias("label")), r.select("doc_id", F.col("b").alias("label")), "doc_id", "label")


@query("confusion", f"WITH {RATERS} SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_aligned(spark, d))


KAPPA = f"{RATERS}, v AS (SELECT * FROM p WHERE a IS NOT NULL), m AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg((a = '1')::INT) * avg((b = '1')::INT) + avg((a = '0')::INT) * avg((b = '0')::INT) AS pe FROM v)"


@query("cohen_kappa", f"WITH {KAPPA} SELECT n::BIGINT AS n, round(po, 9) AS agreement, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa FROM m")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.cohen_kappa(_aligned(spark, d)).select(F.col("n").cast("bigint").alias("n"), *[F.round(c, 9).alias(c) for c in ("agreement", "expected", "kappa")])


@query("fleiss_kappa", f"""WITH {RATERS}, l AS (SELECT doc_id, unnest([a, b, c]) AS label FROM p WHERE a IS NOT NULL), k AS (SELECT doc_id, sum(n * n) AS sq FROM (SELECT doc_id, label, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY doc_id),
o AS (SELECT count(*) AS items, avg((sq - 3) / 6.0) AS observed FROM k), e AS (SELECT sum(s * s) AS expected FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM l GROUP BY label)) SELECT items, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM o, e""")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    long = _raters(spark, d).where("a IS NOT NULL").select("doc_id", F.explode(F.array("a", "b", "c")).alias("label"))
    return agreement.fleiss_kappa(long, "doc_id", "label", 3).select("items", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query("bootstrap_kappa")
def bootstrap_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.bootstrap_kappa(_aligned(spark, d), "doc_id")


@query("adjudication", f"WITH {RATERS} SELECT doc_id, coalesce(a, '') AS a, b, CASE WHEN a = b THEN a ELSE '' END AS final FROM p")
def adjudication(spark: SparkSession, d: str) -> DataFrame:
    r = _raters(spark, d)
    return agreement.adjudicated(r.select("doc_id", F.col("a").alias("label")), r.select("doc_id", F.col("b").alias("label")), "doc_id", "label")


_LABEL = "CASE WHEN answer_style = 'extractive' AND length(answer) % 3 = 0 THEN 'Partially, yes' WHEN answer_style = 'extractive' AND length(answer) % 3 = 1 THEN 'Partially' WHEN answer_style = 'extractive' THEN 'Yes, it is' WHEN answer_style = 'abstractive' THEN ' NO ' END"


@query("annotation_summary", f"""WITH {REL}, l AS (SELECT lower({_LABEL}) AS l FROM rel), k AS (SELECT CASE WHEN contains(l, 'yes') THEN 'yes' WHEN contains(l, 'partial') THEN 'partial' WHEN contains(l, 'no') THEN 'no' END AS k FROM l)
SELECT count(k) AS n, count(*) FILTER (WHERE k = 'yes') AS yes, count(*) FILTER (WHERE k = 'partial') AS partial, count(*) FILTER (WHERE k = 'no') AS no, round((count(*) FILTER (WHERE k = 'yes') + 0.5::DOUBLE * count(*) FILTER (WHERE k = 'partial')) / nullif(count(k), 0)::DOUBLE, 9) AS accuracy FROM k""")
def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    return agreement.summary(rel(spark, d, ["id", "answer_style", "answer"]).select(F.expr(_LABEL).alias("label")), "label").withColumn("accuracy", F.round("accuracy", 9))


@query("stratified_sample", f"""WITH {REL}, h AS (SELECT id, coalesce(question_type, 'unknown') AS stratum, md5('42:' || id) AS h FROM rel), g AS (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS pos, count(*) OVER () AS k FROM (SELECT DISTINCT stratum FROM h)),
q AS (SELECT h.*, row_number() OVER (PARTITION BY h.stratum ORDER BY h, id) AS r, 500 // k + CASE WHEN pos < 500 % k THEN 1 ELSE 0 END AS quota FROM h JOIN g USING (stratum)) SELECT 'ann_' || lpad((row_number() OVER (ORDER BY h, id))::VARCHAR, 5, '0') AS annotation_id, id AS original_id, stratum FROM q WHERE r <= quota""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return statistics.stratified_sample(rel(spark, d, ["id", "question_type"]), "question_type", 500)


@query("annotation_sheet")
def annotation_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, ["id", "question", "answer", "context", "question_type", "quality_score"])
    return writers.annotation_sheet(rows.join(stratified_sample(spark, d).withColumnRenamed("original_id", "id").drop("stratum"), "id"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("dataset_stats", f"""WITH {REL} SELECT count(*) AS pairs, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (WHERE split = 'train') AS train_documents, count(DISTINCT doc_id) FILTER (WHERE split = 'val') AS val_documents, count(DISTINCT doc_id) FILTER (WHERE split = 'test') AS test_documents,
 count(*) FILTER (WHERE split = 'train') AS train_pairs, count(*) FILTER (WHERE split = 'val') AS val_pairs, count(*) FILTER (WHERE split = 'test') AS test_pairs, count(doi) AS with_doi, count(*) FILTER (WHERE answer_style = 'extractive') AS extractive, round(avg(length(question)), 6) AS mean_question, round(avg(length(answer)), 6) AS mean_answer FROM rel""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.dataset_statistics(rel(spark, d, ["id", "doc_id", "split", "doi", "answer_style", "question", "answer"]))
    return s.withColumns({"mean_question": F.round("mean_question", 6), "mean_answer": F.round("mean_answer", 6)})


@query("consolidation_rollup", f"WITH {QA}, x AS (SELECT regexp_extract(source_pdf, '^/corpus/([^/]+)/', 1) AS folder, file_name AS file, md5({sql_squeeze('lower(question)')}) AS q FROM qa), g AS (SELECT folder, file, count(*) AS records, count(DISTINCT q) AS questions, (GROUPING(folder) * 2 + GROUPING(file))::INT AS level FROM x GROUP BY ROLLUP (folder, file)) SELECT folder, file, records, questions, level, round(100.0::DOUBLE * (records - questions) / records, 2) AS repeated_percent FROM g")
def consolidation_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d, ["id", "source_pdf", "file_name", "question"])
    return statistics.consolidation_rollup(rows, F.regexp_extract("source_pdf", r"^/corpus/([^/]+)/", 1), F.col("file_name"))


@query("top_sources", f"WITH {QA} SELECT file_name AS file, count(*) AS records FROM qa GROUP BY 1 ORDER BY records DESC, file LIMIT 20")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_files(qa(spark, d, ["id", "file_name"]), F.col("file_name"))


@query("year_histogram", f"WITH {REL}, f AS (SELECT doc_id, min_by(year, id) AS year FROM rel WHERE doc_id IS NOT NULL AND year IS NOT NULL GROUP BY doc_id) SELECT year, count(*) AS documents FROM f WHERE year BETWEEN 1990 AND 2030 GROUP BY year")
def year_histogram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.year_histogram(rel(spark, d, ["id", "doc_id", "year"]).where("year IS NOT NULL"))


@query("exact_leaks", f"WITH {REL}, x AS (SELECT split, {sql_squeeze('lower(answer)')} AS t FROM rel WHERE answer IS NOT NULL) SELECT count(*) AS test_records, count(*) FILTER (WHERE t IN (SELECT t FROM x WHERE split = 'train')) AS leaked FROM x WHERE split = 'test' AND len({sql_words('t')}) >= 5")
def exact_leaks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.exact_leaks(rel(spark, d, ["id", "split", "answer"]), "answer", 5)


NGRAMS = f"""{REL}, w AS (SELECT id, split, {sql_words("lower(answer)")} AS w FROM rel WHERE answer IS NOT NULL), g AS (SELECT id, split, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) >= 5),
o AS (SELECT id, count(*) AS grams, count(*) FILTER (WHERE g IN (SELECT g FROM g WHERE split = 'train')) AS shared FROM g WHERE split = 'test' GROUP BY id)"""


@query("contamination_ngram", f"WITH {NGRAMS} SELECT * FROM o")
def contamination_ngram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ngram_leaks(rel(spark, d, ["id", "split", "answer"]), "answer", 5)


@query("contamination_summary", f"WITH {NGRAMS}, s AS (SELECT shared / grams::DOUBLE AS share FROM o) SELECT count(*) AS n, round(avg(share), 9) AS mean, round(quantile_cont(share, 0.5), 9) AS median, round(quantile_cont(share, 0.9), 9) AS p90, round(quantile_cont(share, 0.95), 9) AS p95, round(avg((share >= 0.5)::INT), 9) AS half_or_more FROM s")
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    s = statistics.overlap_summary(contamination_ngram(spark, d))
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "median", "p90", "p95", "half_or_more")])


@query("calibration_buckets", f"WITH {REL} SELECT CASE WHEN quality_score < 0.5 THEN '<0.5' WHEN quality_score < 0.6 THEN '0.5-0.6' WHEN quality_score < 0.7 THEN '0.6-0.7' WHEN quality_score < 0.8 THEN '0.7-0.8' WHEN quality_score < 0.9 THEN '0.8-0.9' ELSE '>=0.9' END AS bucket, count(*) AS n, round(avg((answer_style = 'extractive')::INT), 9) AS mean_label FROM rel WHERE quality_score IS NOT NULL GROUP BY 1")
def calibration_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.calibration_buckets(rel(spark, d, ["id", "quality_score", "answer_style"]), "quality_score", F.col("answer_style") == "extractive")
    return c.withColumn("mean_label", F.round("mean_label", 9))


@query("spearman", f"""WITH {REL}, x AS (SELECT quality_score AS a, length(answer) AS b FROM rel WHERE quality_score IS NOT NULL AND answer IS NOT NULL), r AS (SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) AS rb FROM x) SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = rel(spark, d, ["id", "quality_score", "answer"]).select("quality_score", F.length("answer").alias("n"))
    return statistics.spearman(rows, "quality_score", "n").select("n", F.round("rho", 9).alias("rho"))


@query("usage_stats", f"WITH {QA} SELECT model, count(*) AS records, count(DISTINCT run_id) AS runs, sum(usage.prompt_tokens)::BIGINT AS prompt_tokens, sum(usage.completion_tokens)::BIGINT AS completion_tokens, round(avg(usage.total_tokens), 6) AS mean_tokens FROM qa GROUP BY model")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.usage_statistics(qa(spark, d, ["id", "model", "run_id", "usage"])).withColumn("mean_tokens", F.round("mean_tokens", 6))


# --- streams and general extras -------------------------------------------------------------------------------------


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.streaming.consolidate import windowed_counts

    w = windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("revenue_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # before the shuffles of the joins
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    by = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return by.groupBy("c_nationkey").agg(F.sum("r").alias("r")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


# --- runs -----------------------------------------------------------------------------------------------------------


@query("new_questions", f"WITH {QA}, b AS (SELECT DISTINCT md5({sql_squeeze('lower(question)')}) AS h FROM qa_release WHERE question IS NOT NULL) SELECT id FROM qa WHERE coalesce(md5({sql_squeeze('lower(question)')}), '') NOT IN (SELECT h FROM b)")
def new_questions(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.operators.runs import new_questions as op

    return op(qa(spark, d, ["id", "question"]), table(spark, d, "qa_release").select("question")).select("id")


@query("circuit_breaker", f"""WITH {QA}, a AS (SELECT id, run_id, count(*) OVER w AS attempts, avg((answer IS NULL OR length(answer) < 20)::INT) OVER w AS share FROM qa WHERE run_id IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY id ROWS UNBOUNDED PRECEDING))
SELECT id, attempts, round(share, 9) AS failed_share, attempts >= 10 AND share > 0.4 AS broken FROM a""")
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.operators.runs import breaks_circuit

    failed = F.col("answer").isNull() | (F.length("answer") < 20)
    rows = qa(spark, d, ["id", "run_id", "answer"]).where("run_id IS NOT NULL")
    return breaks_circuit(rows, "run_id", "id", failed).select("id", "attempts", F.round("failed_share", 9).alias("failed_share"), "broken")


def _sql_title_words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+'), lambda w: w <> ''))"


REFS = f"""{REL}, m AS (SELECT doc_id, max(title) AS mt FROM doc_metadata GROUP BY doc_id), x AS (SELECT id, m.doc_id IS NOT NULL AS found, {_sql_title_words('title')} AS a, {_sql_title_words('mt')} AS b FROM rel LEFT JOIN m ON m.doc_id = rel.doc_id),
s AS (SELECT id, found, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END AS similarity FROM x)"""


@query("reference_check", f"WITH {REFS}, t AS (SELECT CASE WHEN NOT found OR similarity < 0.5 THEN 'FAIL' WHEN similarity < 0.8 THEN 'WARN' ELSE 'PASS' END AS status FROM s) SELECT status, count(*) AS records FROM t GROUP BY status")
def reference_check(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.operators.runs import reference_status, title_similarity

    known = table(spark, d, "doc_metadata").groupBy("doc_id").agg(F.max("title").alias("mt"), F.lit(True).alias("found"))
    rows = rel(spark, d, ["id", "doc_id", "title"]).join(known, "doc_id", "left")
    status = reference_status(F.col("found"), title_similarity(F.col("title"), F.col("mt")))
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records"))


@query("majority_label", f"WITH {RATERS}, l AS (SELECT doc_id, unnest([a, b, c]) AS label FROM p), g AS (SELECT doc_id, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS k, count(*) OVER (PARTITION BY doc_id) AS kinds FROM g) SELECT doc_id, label, kinds = 1 AS unanimous FROM r WHERE k = 1")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    from qaloom.operators.runs import majority

    return majority(_raters(spark, d).select("doc_id", F.explode(F.array("a", "b", "c")).alias("label")), "doc_id", "label")


@query("retrieval_gain")
def retrieval_gain(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval among all answers by whole questions against that by their first six words."""
    q, c, rels = _all_answers(spark, d)
    short = q.withColumn("text", F.array_join(F.slice(tx.words(F.col("text")), 1, 6), " "))
    means = [retrieval.long_metrics(retrieval.mean_metrics(retrieval.per_query_metrics(x, retrieval.top_k(retrieval.bm25_best(x, c, 10), 10), rels))) for x in (short, q)]
    return retrieval.compare(*means).select("metric", *[F.round(c, 6).alias(c) for c in ("base", "tuned", "gain", "gain_percent")])


@query("median_lengths", f"WITH {QA} SELECT model, count(DISTINCT file_name) AS files, quantile_cont(length(answer), 0.5)::DOUBLE AS median_answer FROM qa GROUP BY model")
def median_lengths(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "model", "file_name", "answer"]).groupBy("model").agg(F.count_distinct("file_name").alias("files"), F.percentile(F.length("answer"), F.lit(0.5)).alias("median_answer"))
