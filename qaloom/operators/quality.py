"""Filters, quality metrics and scores of question-answer records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import let, letters_share, occurrences, squeeze, word_set, words

#: Questions that ask for nothing.
GENERIC = ("what?", "why?", "how?", "what is this?", "what is the main topic?", "what is this about?")
GENERIC_SHORT = ("what?", "why?", "how?", "what is this about?")
#: Trivial questions.
TRIVIAL = (
    r"^what\?$", r"^why\?$", r"^how\?$", r"^what is (this|that|it)\??$", r"^what is the main (topic|idea|point)\??$",
    r"^what does this (mean|say)\??$", r"^can you explain\??$", r"^tell me about",
)
#: How specific questions begin, how unfinished answers end, and what paragraphs are left out.
STARTERS = ("how does", "what is the", "why does", "what are the", "how can", "what causes", "how is", "what determines")
UNFINISHED = ("...", "…", " and so on", " etc.", " et cetera")
EXCLUDED = (
    "acknowledgments:", "acknowledgements:", "acknowledgment:", "funding:", "data availability statement:", "author contributions:",
    "references:", "declarations:", "conflict of interest:", "competing interests:", "ethics statement:", "supplementary",
)
#: What an extraction that failed says.
FAILURES = ("please provide the problem", "i cannot", "unable to", "error occurred")


@dataclass(frozen=True)
class QualityConfig:
    min_question: int = 15
    max_question: int = 500
    min_answer: int = 20
    max_answer: int = 2000
    min_context: int = 50
    min_overlap: float = 0.1
    max_overlap: float = 0.95
    min_specificity: float = 0.3
    min_score: float = 0.4


def is_quality_record(question: Column, answer: Column, min_question: int = 15, min_answer: int = 20) -> Column:
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    return (F.length(q) >= min_question) & (F.length(a) >= min_answer) & ~F.lower(q).isin(*GENERIC)


def is_valid_pair(question: Column, answer: Column) -> Column:
    """Long enough, not generic, and not the question given back."""
    q, a = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(answer, F.lit("")))
    echo = F.contains(F.lower(a), F.lower(q)) & (F.length(a) < F.length(q) * 1.5)
    return (F.length(q) >= 15) & (F.length(a) >= 20) & ~F.lower(q).isin(*GENERIC_SHORT) & ~echo


def fits_trainer(question: Column, answer: Column, q_range: tuple[int, int] = (10, 256), a_range: tuple[int, int] = (20, 512)) -> Column:
    return F.length(question).between(*q_range) & F.length(answer).between(*a_range)


def is_valid_paragraph(text: Column, least: int = 50, most: int = 4000) -> Column:
    """Fit for generating questions: length, no back matter, few references, no table, at least two sentences."""
    t = F.coalesce(text, F.lit(""))
    first = F.lower(F.trim(F.substring_index(t, "\n", 1)))
    low = F.lower(t)
    excluded = F.lit(False)
    for prefix in EXCLUDED:
        excluded = excluded | first.startswith(prefix)
    few = (occurrences(low, "doi:") <= 2) & (occurrences(low, "http") <= 3) & (occurrences(t, "|") <= 10) & (occurrences(t, "\t") <= 20) & (occurrences(t, ".") >= 2)
    return F.length(t).between(least, most) & ~excluded & few


def word_overlap(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct words that the context has; 0 without words."""
    a, c = word_set(answer), word_set(context)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))


def contains_normalised(answer: Column, context: Column) -> Column:
    a, c = squeeze(F.lower(answer)), squeeze(F.lower(context))
    return F.coalesce((a != "") & F.contains(c, a), F.lit(False))


def _add(*terms: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, value in terms:
        out = out + F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    return out


def specificity(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    low, starts = F.lower(q), F.lit(False)
    for s in STARTERS:
        starts = starts | low.startswith(s)
    score = F.lit(0.5) + _add((F.length(q) > 50, 0.1), (F.length(q) > 100, 0.1), (q.rlike(r"\d"), 0.1), (q.rlike(r"[\"'].*?[\"']"), 0.1), (starts, 0.1), (F.length(q) < 20, -0.2))
    return F.when(q == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def is_trivial(question: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    found = F.length(q) < 10
    for pattern in TRIVIAL:
        found = found | q.rlike(pattern)
    return found


def completeness(answer: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    low = F.lower(a)
    score = F.lit(1.0) + _add(*[(low.endswith(e), -0.3) for e in UNFINISHED], (~F.right(a, F.lit(1)).isin(*".!?)\"'"), -0.2))
    return F.when(a == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score))


def quality_metrics(records: DataFrame, cfg: QualityConfig = QualityConfig(), question: str = "question", answer: str = "answer", context: str = "context") -> DataFrame:
    """`records` with lengths, overlap, specificity, completeness, `quality_score`, `filter_reasons` and `should_keep`.

    Null fields count as empty. Reasons stand in a fixed order; overlap and specificity are noted without dropping.
    """
    q, a, c = (F.coalesce(F.col(x), F.lit("")) for x in (question, answer, context))
    m = records.withColumns({
        "question_length": F.length(q), "answer_length": F.length(a), "answer_context_overlap": word_overlap(a, c), "answer_is_substring": contains_normalised(a, c),
        "question_specificity": specificity(q), "answer_completeness": completeness(a), "is_trivial_question": is_trivial(q), "_context_length": F.length(c),
    })
    ov = F.col("answer_context_overlap")
    base = F.when(ov.between(0.2, 0.8), F.lit(0.3)).when(ov > 0.1, F.lit(0.15)).otherwise(F.lit(0.0))
    score = base + F.col("question_specificity") * F.lit(0.25) + F.col("answer_completeness") * F.lit(0.2)
    score = score + _add((F.col("question_length").between(20, 200), 0.1), (F.col("answer_length").between(30, 500), 0.1), (F.col("is_trivial_question"), -0.3))
    m = m.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    reasons = (
        (F.col("question_length") < cfg.min_question, "question_too_short", True), (F.col("question_length") > cfg.max_question, "question_too_long", True),
        (F.col("answer_length") < cfg.min_answer, "answer_too_short", True), (F.col("answer_length") > cfg.max_answer, "answer_too_long", True),
        (F.col("_context_length") < cfg.min_context, "context_too_short", True), (ov < cfg.min_overlap, "low_answer_context_overlap", False),
        (ov > cfg.max_overlap, "excessive_answer_context_overlap", False), (F.col("question_specificity") < cfg.min_specificity, "low_question_specificity", False),
        (F.col("is_trivial_question"), "trivial_question", True), (F.col("quality_score") < cfg.min_score, "low_quality_score", True),
    )
    drop = F.lit(False)
    for condition, _, dropping in reasons:
        drop = drop | condition if dropping else drop
    listed = F.filter(F.array(*[F.when(condition, F.lit(name)) for condition, name, _ in reasons]), lambda r: r.isNotNull())
    return m.withColumns({"filter_reasons": listed, "should_keep": ~drop}).drop("_context_length")


def score_bucket(score: Column) -> Column:
    """The tenth of a score, as text."""
    return F.format_string("%.1f", (F.floor(score * F.lit(10.0)) / F.lit(10.0)).cast("double"))


def reason_histogram(metrics: DataFrame) -> DataFrame:
    """How often each reason stands at dropped records."""
    return metrics.where("NOT should_keep").select(F.explode("filter_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def is_garbled(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    alpha, alnum = letters_share(t, r"\p{L}"), letters_share(t, r"\p{L}\p{N}")
    return F.when(F.length(t) < 20, True).when(alpha < 0.15, True).when(alnum > 0.45, False).otherwise(alpha < 0.20)


def extraction_quality(text: Column, least: int = 50, most_repetition: float = 0.3) -> Column:
    """Score of an extracted page: length, one word's share, distinct words, signs, and a failure's wording."""
    t = F.coalesce(text, F.lit(""))
    w = words(F.lower(t))
    distinct = F.array_distinct(w)
    most = let(w, lambda v: F.array_max(F.transform(F.array_distinct(v), lambda x: F.size(v) - F.size(F.array_remove(v, x)))))
    repeats = F.when((F.length(t) < 50) | (F.size(w) < 10), F.lit(0.0)).otherwise(most / F.size(w))
    signs = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\x09-\x0d\x1c-\x20\x{85}\p{Z}]", "")) / F.length(t)
    failed = F.lit(False)
    for f in FAILURES:
        failed = failed | F.contains(F.lower(t), F.lit(f))
    score = F.lit(1.0) + _add((F.length(t) < least, -0.3), (repeats > most_repetition, -0.5), ((F.size(w) > 10) & (F.size(distinct) / F.size(w) < 0.3), -0.3), (signs > 0.3, -0.2), (failed, -0.4))
    return F.when(t == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score))


def retry_decision(score: Column, attempt: Column, threshold: float = 0.7, strategies: tuple[str, ...] = ("standard", "high_resolution", "enhanced_contrast")) -> Column:
    """`complete` from the threshold on, else the strategy whose turn it is."""
    return F.when(score >= threshold, F.lit("complete")).otherwise(F.element_at(F.array(*map(F.lit, strategies)), (attempt % len(strategies) + 1).cast("int")))
