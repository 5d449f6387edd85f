"""A baseline annotator: four labels of a record from overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import let, letters_share, meaningful_words, ngrams, numbers, share_in, squeeze, words
from qaloom.operators.quality import is_garbled

#: Wordings that hedge, of Portuguese and Spanish, and of vague questions.
HEDGES = (
    "does not provide", "does not specify", "does not mention", "not mentioned", "not stated", "not specified", "not discussed", "text does not",
    "unclear from", "no information", "cannot be determined", "not explicitly", "it simply states", "does not explain", "no reason",
)
FOREIGN = r"(?i)(?:^|[^\p{L}\p{N}_])(?:são|não|também|após|foram|para|como|está|através|entre|permitir|obtenção|informação|peptídeo|amostra|quantitativa)(?:$|[^\p{L}\p{N}_])"
VAGUE = ("how effective", "what happens", "describe the process", "what are the results", "what was found", "what is the result", "how does the text describe")
SELF = ("according to the text", "the text describe")


def _any(text: Column, what: tuple[str, ...]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in what:
        out = out | F.contains(low, F.lit(w))
    return out


def is_hedging(answer: Column) -> Column:
    return _any(answer, HEDGES)


def is_non_english(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"[\x{400}-\x{4FF}]{5,}") | t.rlike(FOREIGN)


def technical(text: Column) -> Column:
    """Abbreviations in capitals and hyphenated words in lower case."""
    return F.array_union(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9/-]+)\b"), 1), F.regexp_extract_all(F.lower(text), F.lit(r"\b(\w+-\w+(?:-\w+)*)\b"), 1))


def longest_run(answer: Column, context: Column) -> Column:
    """Share of the answer's words that the longest sequence of eight to two words found in the context makes up."""
    def of(x: Column) -> Column:
        a, c, w = x["a"], x["c"], x["w"]
        found = F.lit(0)
        for n in range(2, 9):
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i, n=n: F.concat_ws(" ", F.slice(w, i, n)))
            found = F.when((F.size(w) >= n) & F.exists(grams, lambda g: F.contains(c, g)), F.lit(n)).otherwise(found)
        return F.when(F.size(w) < 3, F.contains(c, a).cast("double")).otherwise(found / F.size(w))

    low = squeeze(F.lower(answer))
    parts = F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, " "))
    return let(F.struct(low.alias("a"), squeeze(F.lower(context)).alias("c"), parts.alias("w")), of)


def features(records: DataFrame) -> DataFrame:
    """`records` (`question`, `answer`, `context`) with what the labels are decided by."""
    q, a, c = (F.coalesce(F.col(x), F.lit("")) for x in ("question", "answer", "context"))
    x = records.withColumns({"_q": q, "_a": a, "_c": c, "_aw": meaningful_words(a), "_cw": F.array_distinct(meaningful_words(c)), "_qw": F.array_distinct(meaningful_words(q)), "_an": squeeze(F.lower(a)), "_cn": squeeze(F.lower(c))})
    aw, an = F.col("_aw"), words(F.col("_an"))
    found = F.filter(aw, lambda w: F.array_contains(F.col("_cw"), w))
    triples = let(an, lambda w: F.when(F.size(w) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3)))))
    phrases = let(F.struct(triples.alias("t"), F.col("_cn").alias("c")), lambda y: F.when(F.size(y["t"]) == 0, F.lit(0.0)).otherwise(F.size(F.filter(y["t"], lambda p: F.contains(y["c"], p))) / F.size(y["t"])))
    return x.withColumns({
        "token_overlap": F.when(F.size(aw) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(aw)),
        "number_overlap": share_in(numbers(a), numbers(c), 1.0),
        "phrase_overlap": phrases,
        "ngram_overlap": share_in(ngrams(an, 4), ngrams(words(F.col("_cn")), 4), 0.0),
        "run": longest_run(a, c),
        "technical_overlap": share_in(technical(a), technical(c), 1.0),
        "question_overlap": F.size(F.array_intersect("_qw", "_cw")) / F.greatest(F.size("_qw"), F.lit(1)),
        "short": F.size(aw) < 6, "garbled": is_garbled(c), "hedging": is_hedging(a),
    }).drop("_aw", "_cw", "_qw", "_an", "_cn")


#: From which overlaps on an answer gets a label; the first label of which any rule holds counts.
RULES = {
    "answer_correct": {
        "Yes": (
            "run > 0.35", "token_overlap > 0.40", "ngram_overlap > 0.20 AND number_overlap >= 0.5", "phrase_overlap > 0.30 AND number_overlap >= 0.5",
            "short AND technical_overlap >= 0.5 AND number_overlap >= 0.5", "short AND run > 0.0 AND number_overlap >= 0.5", "score >= 0.82 AND token_overlap > 0.25 AND number_overlap >= 0.3",
        ),
        "Partial": (
            "token_overlap > 0.18", "ngram_overlap > 0.08", "phrase_overlap > 0.10", "number_overlap > 0.4 AND token_overlap > 0.10", "short AND technical_overlap > 0.3", "short AND number_overlap > 0.3",
            "score >= 0.80 AND token_overlap > 0.10",
        ),
    },
    "evidence_support": {
        "Yes": ("run > 0.30", "token_overlap > 0.38", "phrase_overlap > 0.25 AND number_overlap >= 0.5", "short AND technical_overlap >= 0.5", "short AND run > 0.0"),
        "Partial": ("token_overlap > 0.10", "phrase_overlap > 0.10", "number_overlap > 0.4 AND token_overlap > 0.08", "short AND technical_overlap > 0.2", "short AND number_overlap > 0.3"),
    },
}
#: Quality of evidence by its letters and digits, its length and what the question shares with it; first match.
EVIDENCE = (
    ("garbled OR length < 50", "Missing"), ("digits > 0.25 AND letters < 0.40", "Weak"), ("letters > 0.45 AND question_overlap > 0.25 AND length > 100", "Good"), ("question_overlap > 0.35 AND length > 120", "Good"),
    ("question_overlap < 0.10 OR letters < 0.35 OR length < 80", "Weak"), ("question_overlap > 0.15", "Good"),
)
#: How a question begins.
ASKING = "^(?:what|how|why|which|when|where|who|is|are|was|were|do|does|did|can|could)"
OPENER = r"^(?:What|How|Why|Which|When|Where|Who|Is|Are|Was|Were|Do|Does|Did|Can|Could|According)\b\s*"


def _by_rules(kind: str, hedged: Column) -> Column:
    label = F.when(F.col("garbled"), "No").when(F.col("hedging"), hedged)
    for name, rules in RULES[kind].items():
        label = label.when(F.expr(" OR ".join(f"({r})" for r in rules)), name)
    return label.otherwise("No")


def annotate(records: DataFrame) -> DataFrame:
    """`answer_correct`, `evidence_support`, `evidence_quality`, `question_clarity` and `notes` of records with a `quality_score`.

    Null texts count as empty, a null score as 0. Labels go by RULES and EVIDENCE; an answer that hedges is correct where
    it shares a tenth of its words, and supported. Missing evidence makes a correct answer partial, a wrong answer makes
    full support partial.
    """
    x = features(records).withColumns({"score": F.coalesce("quality_score", F.lit(0.0)), "length": F.length("_c"), "letters": letters_share(F.col("_c"), r"\p{L}"), "digits": letters_share(F.col("_c"), r"\p{N}")})
    quality = F.lit("Weak")
    for rule, label in reversed(EVIDENCE):
        quality = F.when(F.expr(rule), label).otherwise(quality)
    q, size = F.col("_q"), F.size(words(F.col("_q")))
    foreign, named = is_non_english(q), F.regexp_replace(q, OPENER, "").rlike(r"[A-Z][a-z]+|[A-Z]{2,}|\d")
    asks = F.lower(q).rlike(ASKING) | F.contains(F.lower(q), F.lit("according to")) | F.trim(q).endswith("?")
    vague = (_any(q, VAGUE) | _any(q, SELF)) & ~named & ~foreign
    clarity = F.when((size < 4) | ~asks & ~foreign, "Bad").when(vague | (size < 5), "Ambiguous").otherwise("Good")
    listed = {"garbled_context": F.col("garbled"), "non_english": foreign | is_non_english(F.col("_a")), "hedging_answer": F.col("hedging"), "short_context": F.col("length") < 100}
    y = x.withColumns({
        "answer_correct": _by_rules("answer_correct", F.when(F.col("token_overlap") > 0.10, "Yes").otherwise("Partial")), "evidence_support": _by_rules("evidence_support", F.lit("Yes")),
        "evidence_quality": quality, "question_clarity": clarity, "notes": F.concat_ws("; ", *[F.when(c, n) for n, c in listed.items()]),
    })
    y = y.withColumn("answer_correct", F.when((F.col("evidence_quality") == "Missing") & (F.col("answer_correct") == "Yes"), "Partial").otherwise(F.col("answer_correct")))
    y = y.withColumn("evidence_support", F.when((F.col("answer_correct") == "No") & (F.col("evidence_support") == "Yes"), "Partial").otherwise(F.col("evidence_support")))
    return y.drop("_q", "_a", "_c", "score", "length", "letters", "digits")
