"""More queries of the core: files, normalisers, samples, runs and agreement, and SQL for views that are made of others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import metadata as md
from qaloom.functions import text as tx
from qaloom.functions.hashing import file_stem
from qaloom.operators import agreement, annotate, classify, dedup, evidence, generation, quality, release, retrieval, runs, splitting, statistics
from qaloom.operators.rows import latest_rows
from qaloom.plans.staging import shared_folder, staged
from qaloom.queries import BM25_ALL, HEADER, METADATA, ORACLE_SQL, QA, RELEASE, RELEASE_TEXTS, REL, STEM, TYPES, WS, _all_answers, _sql_cut, _sql_redacted, _vectors, page_texts, qa, query, rel, sql_md5_mod, sql_repaired, sql_squeeze, sql_words
from qaloom.sources import readers, writers
from qaloom.sources.tables import table


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- SQL of views registered elsewhere --------------------------------------------------------------------------------

PAGES = ORACLE_SQL["page_texts"]
EXTRACTED = ORACLE_SQL["extraction_quality"]
ORACLE_SQL["retry_decision"] = f"WITH e AS ({EXTRACTED}) SELECT doc_id, page, block_no, CASE WHEN score >= 0.7 THEN 'complete' ELSE (['standard', 'high_resolution', 'enhanced_contrast'])[page % 3 + 1] END AS decision FROM e"
ORACLE_SQL["clean_pages"] = f"""WITH p AS ({PAGES}), l AS (SELECT doc_id, page, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_sql_strip('x')}), lambda x: length(x) > 3) AS l FROM p)
SELECT doc_id, page, regexp_replace(array_to_string(list_transform(l, lambda x: {sql_squeeze('x')}), chr(10)), '[©®™\\x00\\x01\\x02]', '', 'g') AS text FROM l"""
ORACLE_SQL["markdown_documents"] = f"""WITH p AS ({PAGES}), q AS ({EXTRACTED.replace('FROM pdf_blocks', 'FROM (SELECT *, 0 AS block_no FROM p)')}), n AS (SELECT doc_id, unnest(generate_series(1, max(page))) AS page FROM pdf_blocks GROUP BY doc_id),
x AS (SELECT n.doc_id, n.page, p.text, q.score FROM n LEFT JOIN p ON p.doc_id = n.doc_id AND p.page = n.page LEFT JOIN q ON q.doc_id = n.doc_id AND q.page = n.page)
SELECT doc_id, string_agg('## Page ' || page || CASE WHEN score < 0.7 THEN printf(' (quality %.2f)', score) ELSE '' END || chr(10) || chr(10) || coalesce(text, '*[page not extracted]*'), chr(10) || chr(10) ORDER BY page) AS markdown FROM x GROUP BY doc_id"""
_CUT = f"""CASE WHEN length(t) <= 1536 THEN t WHEN (CASE WHEN contains(left(t, 1536), '. ') THEN 1536 - strpos(reverse(left(t, 1536)), ' .') - 1 ELSE -1 END) > 768 THEN left(t, (1536 - strpos(reverse(left(t, 1536)), ' .') - 1) + 1) ELSE {_sql_cut('t', 1536)} END"""
ORACLE_SQL["chat_messages"] = f"""WITH {QA}, x AS (SELECT id, question, answer, coalesce(context, '') AS t, {sql_md5_mod("'ctx_' || id", 1000)} < 300 AS drops FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL), c AS (SELECT *, CASE WHEN drops THEN '' ELSE {_CUT} END AS c FROM x)
SELECT id, '<|system|>' || chr(10) || 'You are a helpful scientific assistant.' || chr(10) || '<|user|>' || chr(10) || CASE WHEN trim(c) = '' THEN question ELSE 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || question END || chr(10) || '<|assistant|>' || chr(10) || answer AS text FROM c"""
_TERMS = " OR ".join(f"contains(q, '{t}')" for t in ("mass spectrometry", "ms", "proteomics", "metabolomics", "peptide", "protein", "spectrum", "spectra", "ion", "fragment"))
ORACLE_SQL["question_features"] = f"""WITH {QA}, x AS (SELECT id, lower(coalesce(question, '')) AS q, coalesce(answer, '') AS a FROM qa)
SELECT id, nullif(regexp_extract(q, '^(what|how|why|when|where|which|who)', 1), '') AS question_word, {_TERMS} AS has_ms_terms, regexp_matches(q, '[0-9]') AS has_numbers, regexp_matches(left(a, 50), '[0-9.\\-]') AS numeric_answer FROM x"""
ORACLE_SQL["audit_rows"] = f"""WITH {REL}, {sql_repaired('rel')}
SELECT rel.id AS record_id, doc_id AS document_hash, doi, r.title, r.title_source, year::DOUBLE AS year, venue, coalesce(license, 'unknown') AS license, split, question_type, answer_style,
 CASE WHEN coalesce(lower(license) = 'open_access', false) THEN 'text_released' ELSE 'metadata_only' END AS redistribution_status,
 coalesce(lower(license) = 'open_access', false) OR (lower(coalesce(answer_style, '')) <> 'extractive' AND coalesce(answer, '') <> '') AS answer_released, coalesce(source_pdf, '') <> '' AS source_pdf_present FROM rel JOIN repaired r USING (id)"""
ORACLE_SQL["reconstructed"] = f"""WITH {REL}, p AS ({PAGES}), d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page, text) AS t FROM p GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n+'), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS parts, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS lines FROM d),
k AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN parts ELSE lines END AS ps FROM s)
SELECT rel.id, rel.doc_id AS document_hash, paragraph_index, CASE WHEN paragraph_index >= 0 THEN ps[paragraph_index + 1] END AS context, CASE WHEN k.doc_id IS NULL THEN 'no_document' WHEN paragraph_index IS NULL OR paragraph_index < 0 OR ps[paragraph_index + 1] IS NULL THEN 'no_paragraph' ELSE 'found' END AS status
FROM rel LEFT JOIN k ON k.doc_id = rel.doc_id WHERE coalesce(lower(license), '') <> 'open_access'"""
ORACLE_SQL["paragraphs"] = f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS raw, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS n FROM documents), s AS (SELECT doc_id, n, {_sql_strip('raw')} AS t FROM l),
g AS (SELECT *, sum((t = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM s), p AS (SELECT doc_id, block, min(n) AS line_number, string_agg(t, ' ' ORDER BY n) AS x FROM g WHERE t <> '' GROUP BY doc_id, block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block)::INT AS paragraph_index, line_number::INT AS line_number, CASE WHEN regexp_matches(x, '[.?!]$') THEN x ELSE x || '.' END AS paragraph FROM p"""
ORACLE_SQL["annotation_sheet"] = f"""WITH {REL}, smp AS ({ORACLE_SQL['stratified_sample'].replace(f'WITH {REL}, ', 'WITH ')})
SELECT annotation_id, question, answer, CASE WHEN length(coalesce(context, '')) > 500 THEN left(context, 500) || '...' ELSE coalesce(context, '') END AS context, question_type, round(coalesce(quality_score, 0.0)::DECIMAL(18, 9), 2)::DECIMAL(18, 2)::VARCHAR AS quality_score,
 '' AS answer_correct, '' AS evidence_support, '' AS evidence_quality, '' AS question_clarity, '' AS annotator_id, '' AS notes FROM rel JOIN smp ON smp.original_id = rel.id"""
_SHORT = BM25_ALL.replace("lower(question)", "lower(array_to_string(list_slice(" + sql_words("question") + ", 1, 6), ' '))", 1)


def _sql_gain(part: str, name: str) -> str:
    metrics = ["'mrr', avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END)"]
    for k in (1, 5, 10):
        hit = f"CASE WHEN r <= {k} THEN 1.0 ELSE 0 END"
        metrics += [f"'recall_{k}', avg({hit})", f"'precision_{k}', avg({hit}) / {k}.0", f"'accuracy_{k}', avg({hit})", f"'ndcg_{k}', avg(CASE WHEN r <= {k} THEN 1.0 / log2(r + 1) ELSE 0 END)", f"'map_{k}', avg(CASE WHEN r <= {k} THEN 1.0 / r ELSE 0 END)"]
    rows = ", ".join("{'metric': " + m.split(", ", 1)[0] + ", 'value': (" + m.split(", ", 1)[1] + ")::DOUBLE}" for m in metrics)
    return f"{name} AS (SELECT unnest([{rows}], recursive := true) FROM (WITH {part} SELECT t.id, min(CASE WHEN rk.cid = t.id THEN rank END) AS r FROM t LEFT JOIN rk ON rk.qid = t.id AND rank <= 10 GROUP BY t.id))"


ORACLE_SQL["retrieval_gain"] = f"""WITH {_sql_gain(_SHORT, 'b')}, {_sql_gain(BM25_ALL, 'w')}
SELECT metric, round(b.value, 6) AS base, round(w.value, 6) AS tuned, round(w.value - b.value, 6) AS gain, CASE WHEN b.value = 0 THEN 0.0::DOUBLE ELSE round(100.0 * (w.value - b.value) / b.value, 6) END AS gain_percent FROM b JOIN w USING (metric)"""


def _sql_near(size: int) -> str:
    """Shingle sets as classes of equal ones, and the pairs of classes that near each other."""
    return f"""g AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, len(w) - {size - 1}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')))) AS s FROM (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents) WHERE len(w) >= {size}),
c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class FROM g), h AS (SELECT doc_id AS class, s, len(s) AS n FROM c WHERE doc_id = class), u AS (SELECT class, n, unnest(s) AS k FROM h),
m AS (SELECT a.class AS a, b.class AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same FROM u a JOIN u b ON a.k = b.k AND a.class < b.class GROUP BY 1, 2), pairs AS (SELECT a, b, same / (na + nb - same)::DOUBLE AS jaccard FROM m WHERE same >= 0.8 * (na + nb - same) - 1e-9)"""


def _sql_first_wins(size: int) -> str:
    return f"""WITH RECURSIVE {_sql_near(size)}, e AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS fallen UNION ALL SELECT e.i, CASE WHEN len(list_filter(e.earlier, lambda x: NOT list_contains(walk.fallen, x))) > 0 THEN list_append(walk.fallen, e.b) ELSE walk.fallen END FROM walk JOIN e ON e.i = walk.i + 1),
f AS (SELECT fallen FROM walk ORDER BY i DESC LIMIT 1) SELECT d.doc_id, coalesce(c.class, d.doc_id) = d.doc_id AND NOT list_contains((SELECT fallen FROM f), d.doc_id) AS kept FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""


ORACLE_SQL["near_dedup"] = _sql_first_wins(5)
ORACLE_SQL["near_duplicate_classes"] = f"""WITH {_sql_near(5)}, k AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY class)
SELECT d.doc_id, coalesce(c.class, d.doc_id) AS class_id, coalesce(k.links, 0) AS links FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.class = coalesce(c.class, d.doc_id)"""


# --- repeated texts by three-word shingles ------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("node"), "text")


@query("shingle_jaccard_pairs", f"WITH {_sql_near(3)} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def shingle_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of texts with a Jaccard similarity of .8 or more of their three-word shingles."""
    return dedup.near_duplicates(_texts(spark, d), size=3)[0].select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("greedy_near_dedup", _sql_first_wins(3))
def greedy_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_dedup(_texts(spark, d), size=3).select(F.col("node").alias("doc_id"), "kept")


@query("lsh_dedup")
def lsh_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First wins by MinHash and LSH over three-word shingles, verified."""
    return dedup.lsh_dedup(_texts(spark, d)).select(F.col("node").alias("doc_id"), "kept")


@query("fuzzy_dedup_window")
def fuzzy_dedup_window(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy removal of repeated questions against the last 10,000 distinct ones."""
    return dedup.fuzzy_dedup(qa(spark, d, ["id", "question"]), window=10_000).select(F.col("node").alias("id"), "kept")


# --- files --------------------------------------------------------------------------------------------------------------


@query("jsonl_round_trip", f"WITH {QA} SELECT id, question, answer, context, paragraph_index::DOUBLE AS paragraph_index, usage.total_tokens::DOUBLE AS tokens FROM qa")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writers.write_jsonl(qa(spark, d), path)
    return readers.read_jsonl(spark, path).select("id", "question", "answer", "context", F.col("paragraph_index").cast("double").alias("paragraph_index"), F.col("usage.total_tokens").cast("double").alias("tokens"))


@query("jsonl_bad_lines", f"WITH {QA} SELECT id, question FROM qa WHERE ascii(substr(id, 1, 1)) % 5 <> 0")
def jsonl_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which a fifth is broken and others are blank, read with the broken ones left out."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    line = F.to_json(F.struct("id", "question"))
    broken = F.expr("ascii(substr(id, 1, 1)) % 5 = 0")
    qa(spark, d, ["id", "question"]).select(F.when(broken, F.left(line, F.length(line) - 3)).otherwise(F.concat(line, F.lit("\n"))).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path + "/*").select("id", "question")


@query("csv_round_trip", f"WITH {REL} SELECT id, question, answer, context FROM rel WHERE question IS NOT NULL AND answer IS NOT NULL AND context <> '' AND answer <> '' AND question <> ''")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes and line ends written as CSV with a header and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = rel(spark, d, ["id", "question", "answer", "context"]).where("question IS NOT NULL AND answer IS NOT NULL AND context <> '' AND answer <> '' AND question <> ''")
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return readers.read_csv(spark, path, rows.schema)


@query("stream_consolidated", f"""WITH {QA}, g AS (SELECT id, file_name, ascii(substr(id, 1, 1)) % 2 AS part, md5({sql_squeeze('lower(question)')}) AS h FROM qa WHERE length(trim(question)) >= 15 AND length(trim(answer)) >= 20 AND lower(trim(question)) NOT IN ({', '.join(_quoted(g) for g in quality.GENERIC)}))
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY h ORDER BY part, file_name NULLS FIRST, id) AS r FROM g) WHERE r = 1""")
def stream_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of files consolidated by the stream: records of quality whose question wasn't kept before."""
    from qaloom.streaming.consolidate import consolidate_stream

    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = qa(spark, d).withColumn("_part", F.expr("ascii(substr(id, 1, 1)) % 2"))
    for part in (0, 1):
        writers.write_jsonl(rows.where(F.col("_part") == part).drop("_part"), f"{base}/in/part{part}")
        consolidate_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id")


@query("unprocessed_files", f"WITH {QA} SELECT DISTINCT file_name FROM qa WHERE file_name IS NOT NULL AND file_name NOT IN (SELECT file_name FROM qa_release WHERE file_name IS NOT NULL)")
def unprocessed_files(spark: SparkSession, d: str) -> DataFrame:
    return readers.new_files(qa(spark, d, ["id", "file_name"]).where("file_name IS NOT NULL").select("file_name").distinct(), table(spark, d, "qa_release").where("file_name IS NOT NULL"))


_LINE = "'{\"id\": \"' || id || '\"' || CASE WHEN question IS NOT NULL THEN ', \"question\": \"q\"' ELSE '' END || CASE WHEN answer IS NOT NULL THEN ', \"answer\": \"a\"' ELSE '' END || CASE WHEN ascii(substr(id, 1, 1)) % 7 = 0 THEN '' ELSE '}' END"


@query("line_validation", f"WITH {QA}, l AS (SELECT {_LINE} AS v FROM qa) SELECT count(*) AS lines, count(*) FILTER (WHERE CASE WHEN json_valid(v) THEN list_contains(json_keys(v), 'question') AND list_contains(json_keys(v), 'answer') ELSE false END) AS valid FROM l")
def line_validation(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a file of records are usable; some records lack an answer and some lines are broken."""
    return runs.line_validation(qa(spark, d, ["id", "question", "answer"]).select(F.expr(_LINE).alias("value")))


@query("bibtex_entries", r"""WITH m AS (SELECT doc_id, max(title) AS t, max(year) AS y FROM doc_metadata WHERE title IS NOT NULL GROUP BY doc_id)
SELECT doc_id AS key, trim(regexp_replace(regexp_replace(t, '[{}"]', '', 'g'), '\s+', ' ', 'g')) AS title, coalesce(y::VARCHAR, '') AS year FROM m""")
def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    """References written as BibTeX and parsed again."""
    m = table(spark, d, "doc_metadata").where("title IS NOT NULL").groupBy("doc_id").agg(F.max("title").alias("t"), F.max("year").alias("y"))
    entry = F.concat(F.lit("@article{"), F.col("doc_id"), F.lit(",\n  title = {{"), F.translate(F.left("t", F.lit(1)), '{}"', ""), F.lit("}"), F.translate(F.substr("t", F.lit(2)), '{}"', ""), F.lit("},\n  year = "), F.coalesce(F.col("y").cast("string"), F.lit('""')), F.lit("\n}\n"))
    return readers.read_bibtex(m.select(entry.alias("text"))).select("key", F.col("fields")["title"].alias("title"), F.coalesce(F.col("fields")["year"], F.lit("")).alias("year"))


_LOGS = "e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)"


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    head = e.groupBy("event_type").agg(F.min("event_id").alias("event_id")).select(F.col("event_type").alias("log"), (F.col("event_id") * 2 - 1).alias("line_no"), F.concat(F.lit("Training LLM: model_"), F.col("event_type")).alias("value"))
    body = e.select(F.col("event_type").alias("log"), (F.col("event_id") * 2).alias("line_no"), F.concat(F.lit("{'loss': "), F.col("value").cast("string"), F.lit(", 'epoch': 1.0}")).alias("value"))
    return head.unionByName(body)


@query("training_log", f"WITH {_LOGS} SELECT event_type AS log, 'model_' || event_type AS model, i * 500 AS step, metric, CASE metric WHEN 'loss' THEN value ELSE 1.0 END AS value FROM e, (VALUES ('loss'), ('epoch')) m(metric) WHERE value IS NOT NULL")
def training_log(spark: SparkSession, d: str) -> DataFrame:
    """Steps and metrics of logs, a line an event."""
    return readers.parse_training_log(_log_lines(spark, d))


@query("loss_statistics", f"WITH {_LOGS} SELECT 'model_' || event_type AS model, arg_min(value, i) AS first_loss, arg_max(value, i) AS last_loss, min(value) AS least_loss, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY event_type")
def loss_statistics(spark: SparkSession, d: str) -> DataFrame:
    return runs.loss_statistics(training_log(spark, d))


@query("carried_forward", "SELECT event_id, event_type, last_value(CASE WHEN event_id % 7 = 0 THEN props END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS section FROM events")
def carried_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last header before each line of a log."""
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 == 0, F.col("props")).alias("section"))
    return statistics.last_known(e, "section", "event_type", "event_id")


# --- pages and texts ------------------------------------------------------------------------------------------------------


@query("two_columns", "SELECT doc_id, page, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY x0 >= 306.0, y0, block_no) AS text FROM pdf_blocks WHERE block_type = 0 GROUP BY doc_id, page")
def two_columns(spark: SparkSession, d: str) -> DataFrame:
    return readers.two_columns(table(spark, d, "pdf_blocks"))


_HTML = """'<html><head><title>x</title></head><body><h1>' || coalesce(source, 'no source') || '</h1><!-- hidden --><p>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><script>var a = 1;</script></body></html>'"""


def _sql_html(x: str) -> str:
    out = f"""regexp_replace({x}, '(?is)<!--.*?-->|<(script|style|head)\\b.*?</(?:script|style|head)>', ' ', 'g')"""
    out = f"""regexp_replace({out}, '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|table|section|article)>', chr(10), 'g')"""
    out = f"""regexp_replace({out}, '(?s)<[a-zA-Z/!][^>]*>', '', 'g')"""
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"""trim(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"""


@query("html_texts", f"SELECT doc_id, {_sql_html(_HTML)} AS text FROM documents")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in HTML and out of it."""
    return table(spark, d, "documents").select("doc_id", tx.html_to_text(F.expr(_HTML)).alias("text"))


@query("html_markdown", f"SELECT doc_id, {_sql_html('regexp_replace(' + _HTML + ", '(?is)<h1\\b[^>]*>(.*?)</h1>', '# \\1</p>', 'g')")} AS text FROM documents")
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.html_to_markdown(F.expr(_HTML)).alias("text"))


def _sql_plain(x: str) -> str:
    low, bare = tx.MARKED
    out = f"translate({x}, '{low + low.upper()}', '{bare + bare.upper()}')"
    for sign, plain in tx.PLAIN.items():
        out = f"replace({out}, {_quoted(sign)}, {_quoted(plain)})"
    return f"regexp_replace({out}, '[^\\x00-\\x7f]', '', 'g')"


@query("plain_pages", f"WITH p AS ({PAGES}), x AS (SELECT doc_id, page, {sql_squeeze(_sql_plain('text'))} AS t FROM p) SELECT doc_id, page, CASE WHEN length(t) < 10 THEN '' ELSE t END AS text FROM x")
def plain_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_texts(spark, d).select("doc_id", "page", tx.plain_page(F.col("text")).alias("text"))


@query("plain_answers", f"WITH {QA} SELECT id, {_sql_plain('answer')} AS answer FROM qa WHERE answer IS NOT NULL")
def plain_answers(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "answer"]).where("answer IS NOT NULL").select("id", tx.plain_latin(F.col("answer")).alias("answer"))


@query("smoke_records", f"""WITH {QA}, x AS (SELECT CASE WHEN ascii(substr(id, 1, 1)) % 3 = 0 THEN '' ELSE id END AS a, run_id, file_name, line_number, {sql_squeeze("coalesce(question, '')")} AS q, {sql_squeeze("coalesce(answer, '')")} AS an FROM qa)
SELECT coalesce(nullif(a, ''), nullif(run_id, ''), file_name || '_' || coalesce(line_number, 0)) AS id, coalesce(nullif(a, ''), nullif(run_id, ''), '') AS source_id, q AS question, an AS answer FROM x WHERE length(q) BETWEEN 10 AND 256 AND length(an) BETWEEN 20 AND 512""")
def smoke_records(spark: SparkSession, d: str) -> DataFrame:
    """Records for a quick run: texts of one line, of fitting length, an id by the first key that has one."""
    a = F.expr("CASE WHEN ascii(substr(id, 1, 1)) % 3 = 0 THEN '' ELSE id END")
    rows = qa(spark, d, ["id", "run_id", "file_name", "line_number", "question", "answer"]).select(
        F.coalesce(F.nullif(a, F.lit("")), F.nullif("run_id", F.lit(""))).alias("source_id"), F.concat(F.col("file_name"), F.lit("_"), F.coalesce("line_number", F.lit(0)).cast("string")).alias("place"), tx.as_text(F.col("question")).alias("question"), tx.as_text(F.col("answer")).alias("answer"),
    )
    return rows.where(quality.fits_trainer(F.col("question"), F.col("answer"))).select(F.coalesce("source_id", "place").alias("id"), F.coalesce("source_id", F.lit("")).alias("source_id"), "question", "answer")


_FALSY = {"run_id": "run_id <> ''", "model": "model <> ''", "question": "question <> ''", "answer": "answer <> ''", "context": "context <> ''", "line_number": "line_number <> 0", "paragraph_index": "paragraph_index <> 0", "usage": "usage IS NOT NULL"}


@query("kept_fields", f"WITH {QA} SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FALSY.items())}], lambda x: x IS NOT NULL), ',') AS fields FROM qa")
def kept_fields(spark: SparkSession, d: str) -> DataFrame:
    """Names of the fields that a record keeps when those with nothing in them are dropped."""
    rows = writers.without_empty(qa(spark, d, ["id", *_FALSY]))
    return rows.select("id", F.array_join(F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in _FALSY]), lambda x: x.isNotNull()), ",").alias("fields"))


@query("dual_texts", f"WITH {QA} SELECT id, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM qa")
def dual_texts(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "question", "answer"]).select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")])


@query("answer_ngrams", f"WITH {QA}, w AS (SELECT id, {sql_words('lower(answer)')} AS w FROM qa) SELECT id, CASE WHEN len(w) < 3 THEN 0 ELSE len(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')))) END::DOUBLE AS trigrams FROM w")
def answer_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "answer"]).select("id", F.size(tx.ngrams(tx.words(F.lower("answer")), 3)).cast("double").alias("trigrams"))


def _sql_any(x: str, what: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower({x}), {_quoted(w)})" for w in what)


@query("hedging", f"WITH {QA}, x AS (SELECT id, coalesce(answer, '') AS a FROM qa) SELECT id, {_sql_any('a', annotate.HEDGES)} AS hedging, regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]{{5,}}') OR regexp_matches(a, '{annotate.FOREIGN}') AS non_english FROM x")
def hedging(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d, ["id", "answer"]).select("id", annotate.is_hedging(F.col("answer")).alias("hedging"), annotate.is_non_english(F.col("answer")).alias("non_english"))


@query("technical_words", f"""WITH {QA}, a AS (SELECT id, {_sql_plain('answer')} AS a FROM qa WHERE answer IS NOT NULL) SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(a, '\\b([A-Z][A-Z0-9/-]+)\\b', 1), regexp_extract_all(lower(a), '\\b(\\w+-\\w+(?:-\\w+)*)\\b', 1)))), ' ') AS words FROM a""")
def technical_words(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviations and hyphenated words of answers in plain letters."""
    rows = qa(spark, d, ["id", "answer"]).where("answer IS NOT NULL")
    return rows.select("id", F.array_join(F.array_sort(F.array_distinct(annotate.technical(tx.plain_latin(F.col("answer"))))), " ").alias("words"))


# --- metadata, enrichment, release ----------------------------------------------------------------------------------------

_FACTS = "f AS (SELECT * FROM (SELECT doc_id, doi, title, year, venue, license, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(extraction_confidence, -1) DESC, doi DESC NULLS LAST, title DESC NULLS LAST, year DESC NULLS LAST, venue DESC NULLS LAST, license DESC NULLS LAST) AS r FROM doc_metadata) WHERE r = 1)"


@query("enriched_fields", f"""WITH {TYPES}, {_FACTS}, x AS (SELECT qa.*, coalesce(nullif({STEM}, ''), left(qa.id, 40)) AS doc FROM qa)
SELECT x.id, doc AS doc_id, f.doi, f.title, f.year::DOUBLE AS year, f.venue, coalesce(f.license, 'unknown') AS license, c.question_type, left(md5(doc || ':' || coalesce(paragraph_index, 0)), 16) AS context_id, 'train' AS split, '1.0' AS enrichment_version FROM x JOIN c USING (id) LEFT JOIN f ON f.doc_id = doc""")
def enriched_fields(spark: SparkSession, d: str) -> DataFrame:
    """Enriched records without their texts and evidence."""
    facts = latest_rows(table(spark, d, "doc_metadata").withColumn("_o", F.coalesce("extraction_confidence", F.lit(-1.0))), "doc_id", "_o", ["doc_id", "doi", "title", "year", "venue", "license"])
    none = [F.lit(None).cast("string").alias(c) for c in ("pmid", "arxiv_id")]
    out = evidence.enrich(classify.classify(qa(spark, d)), facts.select("*", *none))
    return out.select("id", "doc_id", "doi", "title", F.col("year").cast("double").alias("year"), "venue", "license", "question_type", "context_id", "split", "enrichment_version")


_FOUND = "k AS (SELECT doc_id, max(title) AS title, max(year) AS year, max(venue) AS venue, bool_or(license = 'open_access') AS open, 'A. ' || upper(left(doc_id, 4)) AS author FROM qa_release WHERE doc_id IS NOT NULL GROUP BY doc_id)"


@query("metadata_lookup", f"""WITH {_FOUND} SELECT m.doc_id, CASE WHEN nullif(trim(m.title), '') IS NULL AND k.doc_id IS NOT NULL THEN k.title ELSE m.title END AS title, CASE WHEN m.year IS NULL AND k.doc_id IS NOT NULL THEN k.year ELSE m.year END::DOUBLE AS year,
 CASE WHEN nullif(trim(m.venue), '') IS NULL AND k.doc_id IS NOT NULL THEN k.venue ELSE m.venue END AS venue, CASE WHEN k.doc_id IS NOT NULL THEN author ELSE array_to_string(m.authors, ';') END AS authors, CASE WHEN k.open THEN 'open_access' ELSE m.license END AS license,
 round(CASE WHEN k.doc_id IS NOT NULL THEN least(coalesce(m.extraction_confidence, 0.0) + 0.2, 1.0) ELSE m.extraction_confidence END, 6) AS confidence FROM doc_metadata m LEFT JOIN k ON k.doc_id = m.doc_id""")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Extracted metadata with what a lookup found of the same papers, which stands here in the released records."""
    found = table(spark, d, "qa_release").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("title").alias("t"), F.max("year").alias("y"), F.max("venue").alias("v"), F.bool_or(F.col("license") == "open_access").alias("o"))
    k = found.select(F.col("doc_id").alias("_k"), "t", "y", "v", F.when(F.col("o"), F.array(F.lit("https://creativecommons.org/licenses/by/4.0"))).alias("u"), F.array(F.concat(F.lit("A. "), F.upper(F.left("doc_id", F.lit(4))))).alias("a"))
    x = table(spark, d, "doc_metadata").join(k, F.col("doc_id") == F.col("_k"), "left")
    own = {c: F.col(c) for c in ("title", "year", "venue", "authors", "license", "extraction_confidence")}
    got = md.looked_up(own, {"title": F.col("t"), "year": F.col("y"), "venue": F.col("v"), "authors": F.col("a"), "license_urls": F.col("u")}, F.col("_k").isNotNull())
    return x.select("doc_id", got["title"].alias("title"), got["year"].cast("double").alias("year"), got["venue"].alias("venue"), F.array_join(got["authors"], ";").alias("authors"), got["license"].alias("license"), F.round(got["extraction_confidence"], 6).alias("confidence"))


_RESOLVED = "r0 AS (SELECT doc_id, arg_min(coalesce(context, ''), id) AS context FROM (SELECT *, " + STEM + " AS doc_id FROM qa WHERE file_name IS NOT NULL) GROUP BY doc_id), pt AS (SELECT paper_id, arg_min(" + HEADER + ", documents.doc_id) AS px FROM documents WHERE paper_id IS NOT NULL GROUP BY paper_id)"


@query("metadata_resolved", f"WITH {QA}, {_RESOLVED}, {METADATA.replace(f't AS (SELECT doc_id, {HEADER} AS x FROM documents)', "t AS (SELECT r0.doc_id, CASE WHEN px IS NOT NULL THEN px ELSE context END AS x FROM r0 LEFT JOIN pt ON pt.paper_id = r0.doc_id)")} SELECT m.doc_id, CASE WHEN pt.paper_id IS NOT NULL THEN 'text' ELSE 'context' END AS origin, doi, pmid, arxiv_id, year::DOUBLE AS year, venue, license FROM m LEFT JOIN pt ON pt.paper_id = m.doc_id")
def metadata_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of each document of the records, from its full text if there is one, else from its first context."""
    records = qa(spark, d, ["id", "file_name", "context"]).where("file_name IS NOT NULL").select("id", file_stem(F.col("file_name")).alias("doc_id"), "context")
    texts = table(spark, d, "documents").where("paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("doc_id")).agg(F.min_by(F.expr(HEADER), F.col("doc_id")).alias("text"))
    return evidence.resolved_metadata(records, texts).select("doc_id", "origin", "doi", "pmid", "arxiv_id", F.col("year").cast("double").alias("year"), "venue", "license")


_SOME = [c for c in RELEASE_TEXTS if c not in ("title", "source_pdf", "doc_id")]


@query("released_records", f"WITH {REL} SELECT {', '.join(f'{_sql_redacted(c)} AS {c}' for c in _SOME)}, doc_id AS document_hash, 'text_released' AS redistribution_status, 'CC-BY-4.0' AS release_license FROM rel WHERE lower(license) = 'open_access'")
def released_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose licence lets their texts out."""
    return release.released(rel(spark, d)).select(*_SOME, "document_hash", "redistribution_status", "release_license")


@query("human_sheet", f"WITH {REL} SELECT id, question_type, left(question, 1000) AS question, left(answer, 1000) AS answer, left(context, 2000) AS context, doi, {', '.join(chr(39) * 2 + f' AS {a}_{n}' for a in ('a1', 'a2') for n in ('correctness', 'evidence', 'clarity', 'evidence_quality', 'notes'))} FROM rel")
def human_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Sheets for two annotators; its texts are cut as the sheet's form says."""
    return writers.human_sheet(rel(spark, d, ["id", "question_type", "question", "answer", "context", "doi"]))


@query("schema_catalogue", "SELECT column_name AS name, CASE WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'Integer' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'Float' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'Date' ELSE 'Text' END AS \"dataType\" FROM (DESCRIBE qa_release)")
def schema_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f["name"], f["dataType"]) for f in writers.schema_catalogue(table(spark, d, "qa_release"))], "name string, dataType string")


# --- splits, samples, runs ------------------------------------------------------------------------------------------------


@query("positional_split", f"WITH {QA}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM qa) SELECT id, CASE WHEN i < floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM p")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.positional_split(qa(spark, d, ["id"]), "id")


@query("split_heads", f"WITH {REL} SELECT split, id FROM (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY id) AS r FROM rel WHERE split IS NOT NULL) WHERE r <= 25")
def split_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 records of each split, a feed for a look at the data."""
    return runs.first_of_each(rel(spark, d, ["id", "split"]).where("split IS NOT NULL"), "split", [F.col("id")], 25).select("split", "id")


@query("split_counts", f"WITH {REL} SELECT coalesce(split, 'none') AS split, count(*) AS records, count(answer) AS answers FROM rel GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, ["id", "split", "answer"]).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("records"), F.count("answer").alias("answers"))


@query("resumed", f"WITH {QA} SELECT id FROM qa ORDER BY id LIMIT 50 OFFSET 100")
def resumed(spark: SparkSession, d: str) -> DataFrame:
    """What comes after a hundred records that were done before, fifty at a time."""
    return runs.skip_take(qa(spark, d, ["id"]), [F.col("id")], 100, 50)


@query("quality_extremes", f"""WITH {REL}, s AS (SELECT doc_id AS name, round(avg(quality_score), 9) AS score FROM rel WHERE doc_id IS NOT NULL AND quality_score BETWEEN 0 AND 1 GROUP BY doc_id)
SELECT 'lowest' AS "end", row_number() OVER (ORDER BY score, name) AS rank, name, score FROM s QUALIFY rank <= 5 UNION ALL SELECT 'highest', row_number() OVER (ORDER BY score DESC, name) AS rank, name, score FROM s QUALIFY rank <= 5""")
def quality_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five documents of lowest and of highest mean quality."""
    s = rel(spark, d, ["id", "doc_id", "quality_score"]).where("doc_id IS NOT NULL AND quality_score BETWEEN 0 AND 1").groupBy("doc_id").agg(F.round(F.avg("quality_score"), 9).alias("score"))
    return statistics.extremes(s, "score", "doc_id").withColumn("rank", F.col("rank").cast("bigint"))


@query("weak_pages", f"WITH e AS ({EXTRACTED}) SELECT doc_id, page, min(score) AS score FROM e GROUP BY doc_id, page HAVING min(score) < 0.7")
def weak_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a block of low extraction quality."""
    x = table(spark, d, "pdf_blocks").select("doc_id", "page", F.round(quality.extraction_quality(F.col("text")), 6).alias("score"))
    return x.groupBy("doc_id", "page").agg(F.min("score").alias("score")).where("score < 0.7")


_TYPES = ", ".join(f"'{t}'" for t in statistics.SAMPLED_TYPES)


@query("gold_sample", f"WITH {REL}, h AS (SELECT id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY md5('42:' || id), id) AS r FROM rel WHERE question_type IN ({_TYPES}) AND coalesce(context, '') <> '') SELECT id, question_type FROM h WHERE r <= {max(1, 300 // len(statistics.SAMPLED_TYPES))}")
def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 300 in equal parts of the fixed types."""
    return statistics.fixed_type_sample(rel(spark, d, ["id", "question_type", "context"]), "question_type", 300)


@query("uniform_sample", f"WITH {REL} SELECT id FROM rel ORDER BY md5('42:' || id), id LIMIT 200")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return statistics.uniform_sample(rel(spark, d, ["id"]), 200)


_RESULTS = "x AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) * 0.5::DOUBLE AS seconds, length(doc_id) % 5 AS k FROM pdf_blocks GROUP BY doc_id), s AS (SELECT *, k <> 4 AS success, CASE k WHEN 0 THEN 'direct' WHEN 1 THEN 'ocr' WHEN 2 THEN 'mixed' ELSE 'skipped' END AS method FROM x)"


@query("extraction_run", f"""WITH {_RESULTS}, t AS (SELECT *, success AND method <> 'skipped' AS done FROM s) SELECT count(*) AS files, count(*) FILTER (WHERE done) AS successful, count(*) FILTER (WHERE NOT success) AS failed, count(*) FILTER (WHERE success AND method = 'skipped') AS skipped,
 coalesce(sum(pages) FILTER (WHERE done), 0)::BIGINT AS pages, coalesce(sum(seconds) FILTER (WHERE done), 0)::DOUBLE AS seconds, count(*) FILTER (WHERE done AND method = 'direct') AS direct, count(*) FILTER (WHERE done AND method = 'ocr') AS ocr, count(*) FILTER (WHERE done AND method = 'mixed') AS mixed,
 CASE WHEN count(*) FILTER (WHERE done) > 0 THEN round(sum(seconds) FILTER (WHERE done) / count(*) FILTER (WHERE done), 6) ELSE 0.0 END::DOUBLE AS seconds_per_file FROM t""")
def extraction_run(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a run over the documents of pdf_blocks, whose outcome is told by the length of the id."""
    x = table(spark, d, "pdf_blocks").groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), (F.count(F.lit(1)) * F.lit(0.5)).alias("seconds")).withColumn("k", F.length("doc_id") % 5)
    method = F.when(F.col("k") == 0, "direct").when(F.col("k") == 1, "ocr").when(F.col("k") == 2, "mixed").otherwise("skipped")
    s = runs.extraction_statistics(x.select((F.col("k") != 4).alias("success"), method.alias("method"), "pages", "seconds"))
    return s.withColumn("seconds_per_file", F.round("seconds_per_file", 6))


@query("fresh_metrics", f"WITH {QA}, m AS (SELECT model, run_id, count(*) AS n, CASE WHEN run_id IS NULL THEN 2 ELSE 1 END AS priority FROM qa WHERE model IS NOT NULL GROUP BY model, run_id) SELECT model, run_id, n FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY priority, run_id) AS r FROM m) WHERE r = 1")
def fresh_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of each model the metrics of the source that comes first."""
    m = qa(spark, d, ["id", "model", "run_id"]).where("model IS NOT NULL").groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("priority", F.struct(F.when(F.col("run_id").isNull(), 2).otherwise(1).alias("p"), "run_id"))
    return runs.first_available(m, "model", "priority").select("model", "run_id", "n")


# --- agreement --------------------------------------------------------------------------------------------------------------

#: Labels of two annotators, made up from fields of the records so that all kinds occur.
_LABELS = {
    "answer_correct": "CASE WHEN {a} % 4 = 0 THEN 'Yes, fully' WHEN {a} % 4 = 1 THEN 'Partially' WHEN {a} % 4 = 2 THEN 'No' ELSE '' END",
    "evidence_support": "CASE WHEN {a} % 3 = 0 THEN 'yes' WHEN {a} % 3 = 1 THEN 'PARTIAL' ELSE 'no' END",
    "evidence_quality": "CASE WHEN {a} % 5 < 2 THEN 'good' WHEN {a} % 5 = 2 THEN 'weak' ELSE 'missing' END",
    "question_clarity": "CASE WHEN {a} % 2 = 0 THEN ' Good ' ELSE 'ambiguous' END",
}
_AS_FIRST, _AS_SECOND = ([f"{x.format(a=a)} AS {n}" for n, x in _LABELS.items()] for a in ("ascii(substr(id, 1, 1))", "(ascii(substr(id, 1, 1)) + CASE WHEN ascii(substr(id, 2, 1)) % 3 = 0 THEN 1 ELSE 0 END)"))
_FIRST, _SECOND = ", ".join(_AS_FIRST), ", ".join(_AS_SECOND)


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = rel(spark, d, ["id", "question_type"])
    return rows.selectExpr("id", "question_type", *_AS_FIRST), rows.selectExpr("id", "question_type", *_AS_SECOND)


def _sql_kind(rubric: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({rubric}), '{k}') THEN '{k}'" for k in agreement.RUBRICS[rubric]) + " END"


_RUBRIC_ROWS = " UNION ALL ".join(f"SELECT question_type, '{r}' AS rubric, {_sql_kind(r)} AS kind FROM a" for r in agreement.RUBRICS)


@query("rubric_summary", f"WITH {REL}, a AS (SELECT id, question_type, {_FIRST} FROM rel), l AS ({_RUBRIC_ROWS}) SELECT question_type, rubric, kind, count(*) AS n FROM l WHERE kind IS NOT NULL GROUP BY ALL")
def rubric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every rubric by question type."""
    return agreement.rubric_summary(_annotated(spark, d)[0], "question_type")


_BOTH = f"{REL}, a AS (SELECT id, {_FIRST} FROM rel), b AS (SELECT id, {_SECOND} FROM rel WHERE ascii(substr(id, 3, 1)) % 4 <> 0)"
_KAPPAS = " UNION ALL ".join(f"SELECT '{r}' AS rubric, trim(a.{r}) AS x, trim(b.{r}) AS y FROM a JOIN b USING (id) WHERE trim(a.{r}) <> '' AND trim(b.{r}) <> ''" for r in agreement.RUBRICS)


@query("mean_kappa", f"""WITH {_BOTH}, l AS ({_KAPPAS}), n AS (SELECT rubric, count(*)::DOUBLE AS n, avg((x = y)::INT) AS po FROM l GROUP BY rubric), ra AS (SELECT rubric, x AS v, count(*) AS c FROM l GROUP BY ALL), rb AS (SELECT rubric, y AS v, count(*) AS c FROM l GROUP BY ALL),
e AS (SELECT ra.rubric, sum(ra.c::DOUBLE * rb.c) AS p FROM ra JOIN rb USING (rubric, v) GROUP BY ra.rubric) SELECT (SELECT count(*) FROM a JOIN b USING (id)) AS rows_aligned, round(sum((po - p / (n * n)) / (1 - p / (n * n))) / 4, 9) AS mean_kappa FROM n JOIN e USING (rubric)""")
def mean_kappa(spark: SparkSession, d: str) -> DataFrame:
    a, b = _annotated(spark, d)
    return agreement.mean_kappa(a, b.where("ascii(substr(id, 3, 1)) % 4 <> 0"), "id").withColumn("mean_kappa", F.round("mean_kappa", 9))


@query("matched_agreement", f"""WITH {_BOTH}, j AS (SELECT lower(trim(a.answer_correct)) AS x, lower(trim(b.answer_correct)) AS y FROM a JOIN b USING (id)), l AS (SELECT * FROM j WHERE x <> '' AND y <> ''), t AS (SELECT count(*)::DOUBLE AS n, avg((x = y)::INT) AS po FROM l),
e AS (SELECT sum(p.c::DOUBLE * q.c) AS p FROM (SELECT x AS v, count(*) AS c FROM l GROUP BY x) p JOIN (SELECT y AS v, count(*) AS c FROM l GROUP BY y) q USING (v))
SELECT (SELECT count(*) FROM j) AS n, round((SELECT count(*) FROM j WHERE x = y AND x <> '') / (SELECT count(*) FROM j)::DOUBLE, 9) AS agreement, round((po - p / (n * n)) / (1 - p / (n * n)), 9) AS kappa FROM t, e""")
def matched_agreement(spark: SparkSession, d: str) -> DataFrame:
    a, b = _annotated(spark, d)
    return agreement.matched_agreement(a, b.where("ascii(substr(id, 3, 1)) % 4 <> 0"), "id", "answer_correct").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


# --- metrics ------------------------------------------------------------------------------------------------------------------


@query("rouge_1_stemmed")
def rouge_1_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, ["id", "question", "answer"]).select("id", generation.rouge_n_stemmed(1)(F.col("question"), F.col("answer")).alias("f1"))


@query("rouge_2_stemmed")
def rouge_2_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return rel(spark, d, ["id", "question", "answer"]).select("id", generation.rouge_n_stemmed(2)(F.col("question"), F.col("answer")).alias("f1"))


@query("faithful_share", f"WITH {REL}, x AS (SELECT id, lower(coalesce(context, '')) AS c, list_filter(list_transform(string_split(coalesce(answer, ''), '.'), lambda s: trim(s)), lambda s: s <> '') AS s FROM rel) SELECT id, CASE WHEN len(s) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(s, lambda y: contains(c, lower(y)))) / len(s)::DOUBLE, 9) END AS faithful FROM x")
def faithful_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's sentences that stand in the context; a model would judge entailment in its place."""
    c = F.lower(F.coalesce("context", F.lit("")))
    return rel(spark, d, ["id", "answer", "context"]).select("id", F.round(generation.faithful_share(F.col("answer"), lambda s: F.contains(c, F.lower(s))), 9).alias("faithful"))


_COS = "list_cosine_similarity(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"


@query("mrr_uncut", f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS qid, q.label = c.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='q.embedding', b='c.embedding')}, 9) DESC, c.vec_id) AS rank FROM q JOIN embeddings c ON c.vec_id <> q.vec_id),
f AS (SELECT qid, min(rank) FILTER (WHERE hit AND rank <= 100) AS r FROM s GROUP BY qid) SELECT count(*) AS queries, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f""")
def mrr_uncut(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the first vector of the same label among the best hundred, without a cut at ten."""
    q, c = _vectors(spark, d)
    ranked = retrieval.top_k(retrieval.dense_scores(q, c, 101).where("qid <> cid"), 100).select("qid", "cid", "score", "rank")
    rels = ranked.join(q.select("qid", "ql"), "qid").join(c.select("cid", "cl"), "cid").where("ql = cl").select("qid", "cid")
    m = retrieval.mean_metrics(retrieval.per_query_metrics(q, ranked, rels, mrr_cut=None))
    return m.select("queries", F.round("mrr", 6).alias("mrr"))


@query("pairwise_similarity", f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity FROM q a JOIN q b ON a.vec_id < b.vec_id")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of all pairs of the stated query set."""
    q, _ = _vectors(spark, d)
    both = retrieval.dense_scores(q, q.select(F.col("qid").alias("cid"), "embedding"), q.count())
    return both.where("qid < cid").select(F.col("qid").alias("a"), F.col("cid").alias("b"), F.round("score", 6).alias("similarity"))
