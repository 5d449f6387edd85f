"""Types of questions by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by type; an earlier one counts for more, and an earlier type wins a tie.
PATTERNS = {
    "comparison": (
        r"\b(compare|comparison|differ(?:ence|ent)?|versus|vs\.?|contrast)\b",
        r"\b(better|worse|more|less|higher|lower) than\b",
        r"\b(similar|different) (?:to|from)\b",
        r"\b(advantage|disadvantage)s?\b.*\b(over|compared)\b",
        r"\bwhich (?:is|are) (?:better|more|less)\b",
    ),
    "numeric": (
        r"\bhow (?:many|much|often|long|far|high|low)\b",
        r"\bwhat (?:is|are) the (?:number|amount|quantity|rate|percentage|proportion)\b",
        r"\bwhat percentage\b",
        r"\bhow (?:\w+ )?(?:times|percent)\b",
        r"\bquantif(?:y|ied)\b",
        r"\bmeasure(?:d|ment)?\b.*\bvalue\b",
    ),
    "method": (
        r"^how (?:do|does|can|could|should|would|to|is|are)\b",
        r"\b(?:method|procedure|process|technique|approach|protocol|workflow)\b.*\b(?:used|applied|performed)\b",
        r"\bsteps?\b.*\b(?:to|for|in)\b",
        r"\bhow (?:is|are|was|were)\b.*\b(?:done|performed|conducted|carried out|achieved)\b",
        r"\bdescribe the (?:method|process|procedure)\b",
        r"\bwhat (?:is|are) the (?:steps?|procedure|method)\b",
    ),
    "definition": (
        r"^what (?:is|are) ",
        r"\bdefin(?:e|ition|ed)\b",
        r"\bwhat does\b.*\bmean\b",
        r"\bexplain (?:what|the term|the concept)\b",
        r"^what (?:is|are) meant by\b",
        r"\brefer(?:s|red)? to\b.*\bwhat\b",
    ),
    "causal": (
        r"^why\b",
        r"\bcause[sd]?\b.*\bwhat\b",
        r"\bwhat (?:cause[sd]?|leads? to|results? in)\b",
        r"\breason(?:s)?\b.*\b(?:for|why)\b",
        r"\bexplain why\b",
        r"\bwhat (?:is|are) the (?:cause|reason|effect|consequence|result)\b",
        r"\bhow (?:does|do)\b.*\b(?:affect|influence|impact)\b",
    ),
    "factual": (
        r"^(?:what|which|who|when|where)\b",
        r"\bidentify\b",
        r"\bname\b.*\b(?:the|a|an)\b",
        r"\blist\b",
        r"\bwhat type\b",
        r"\bwhich (?:\w+ )?(?:is|are|was|were)\b",
    ),
}
#: Words of the field that speak for a type, once a pattern does. Compared with lower-cased text.
INDICATORS = {
    "method": (
        "mass spectrometry", "chromatography", "analysis", "detection", "separation", "ionization", "fragmentation", "sequencing",
        "acquisition", "processing", "calibration", "quantification", "extraction", "purification", "synthesis", "experiment",
    ),
    "definition": ("term", "concept", "meaning", "defined as", "refers to", "known as", "called", "acronym"),
    "numeric": (
        "m/z", "Da", "kDa", "ppm", "concentration", "abundance", "intensity", "ratio", "score", "threshold", "limit",
        "sensitivity", "specificity", "accuracy", "precision",
    ),
}


def _one(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def type_scores(question: Column) -> Column:
    """An array of (score, order, type) of the types with a matching pattern, best first."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    rows = []
    for order, (name, patterns) in enumerate(PATTERNS.items()):
        score, any_match = F.lit(0.0), F.lit(False)
        for i, p in enumerate(patterns):
            hit = q.rlike(p)
            score, any_match = score + _one(hit, 1.0 / (i + 1)), any_match | hit
        for word in INDICATORS.get(name, ()):
            score = score + _one(F.contains(q, F.lit(word)), 0.3)
        rows.append(F.when(any_match, F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("type"))))
    return F.sort_array(F.filter(F.array(*rows), lambda r: r.isNotNull()), asc=False)


def by_question_word(question: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    numeric = F.contains(q, F.lit("how many")) | F.contains(q, F.lit("how much")) | F.contains(q, F.lit("how often"))
    return (
        F.when(q.startswith("how"), F.when(numeric, "numeric").otherwise("method"))
        .when(q.startswith("why"), "causal")
        .when(q.startswith("what is") | q.startswith("what are"), "definition")
        .when(q.rlike("^(?:what|which|who|when|where)"), "factual")
        .otherwise("unknown")
    )


def classify(records: DataFrame, question: str = "question") -> DataFrame:
    """`records` with `question_type`, its confidence and a second type. An empty question is unknown at 0."""
    s = F.col("_scores")
    best, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    gap = best["score"] - second["score"]
    confidence = F.when(F.size(s) == 0, F.lit(0.5)).when(F.size(s) == 1, F.lit(0.8)).otherwise(F.least(F.lit(0.95), F.lit(0.6) + gap * F.lit(0.2)))
    empty = F.trim(F.coalesce(F.col(question), F.lit(""))) == ""
    return records.withColumn("_scores", type_scores(F.col(question))).withColumns({
        "question_type": F.when(empty, "unknown").otherwise(F.coalesce(best["type"], by_question_word(F.col(question)))),
        "question_type_confidence": F.when(empty, F.lit(0.0)).otherwise(F.round(confidence, 3)),
        "question_type_secondary": F.when(second["score"] > 0.5, second["type"]),
    }).drop("_scores")


def question_features(question: Column, answer: Column) -> Column:
    """First question word, terms of the field, digits, and whether the answer's first characters hold a number."""
    low = F.lower(F.coalesce(question, F.lit("")))
    terms = ("mass spectrometry", "ms", "proteomics", "metabolomics", "peptide", "protein", "spectrum", "spectra", "ion", "fragment")
    has = F.lit(False)
    for t in terms:
        has = has | F.contains(low, F.lit(t))
    return F.struct(
        F.nullif(F.regexp_extract(low, "^(what|how|why|when|where|which|who)", 1), F.lit("")).alias("question_word"), has.alias("has_ms_terms"),
        F.coalesce(question, F.lit("")).rlike(r"\d").alias("has_numbers"), F.left(F.coalesce(answer, F.lit("")), F.lit(50)).rlike(r"[\d.\-]").alias("numeric_answer"),
    )


def type_distribution(classified: DataFrame) -> DataFrame:
    """Questions of each type and their share in percent."""
    by = classified.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("_total"))
    return by.crossJoin(F.broadcast(total)).select("question_type", "n", (F.lit(100.0) * F.col("n") / F.col("_total")).alias("percent"))
