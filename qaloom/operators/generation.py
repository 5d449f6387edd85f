"""Metrics of generated answers, and rankings of models by them."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions.text import let, word_set


def token_scores(prediction: Column, reference: Column) -> Column:
    """Precision, recall and F1 of distinct words; two empty texts score 1, one empty text 0."""
    p, r = word_set(prediction), word_set(reference)
    same = F.size(F.array_intersect(p, r))
    precision, recall = same / F.nullif(F.size(p), F.lit(0)), same / F.nullif(F.size(r), F.lit(0))
    f1 = F.when(same == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    both = (F.size(p) == 0) & (F.size(r) == 0)
    return F.struct(*[F.when(both, F.lit(1.0)).otherwise(F.coalesce(x, F.lit(0.0))).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))])


def exact_match(prediction: Column, reference: Column) -> Column:
    return (F.lower(F.trim(F.coalesce(prediction, F.lit("")))) == F.lower(F.trim(F.coalesce(reference, F.lit(""))))).cast("double")


def rouge_tokens(text: Column) -> Column:
    """Runs of Latin letters and digits in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    """F1 of word n-grams, each counted as often as it occurs, without stemming."""

    def grams(text: Column) -> Column:
        return let(rouge_tokens(text), lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, n)))))

    def score(x: Column) -> Column:
        p, r = x["p"], x["r"]
        count = lambda a, g: F.size(a) - F.size(F.array_remove(a, g))
        same = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda s, g: s + F.least(count(p, g), count(r, g)))
        return F.when((F.size(p) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(2.0 * same / (F.size(p) + F.size(r)))

    return let(F.struct(grams(prediction).alias("p"), grams(reference).alias("r")), score)


_VOWEL = "aeiou"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter stem of an English word in lower case."""
    if len(word) <= 2:
        return word

    def cons(w: str, i: int) -> bool:
        return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def measure(w: str) -> int:
        return len(re.findall("VC", re.sub(r"(.)\1+", r"\1", "".join("C" if cons(w, i) else "V" for i in range(len(w))))))

    def vowel(w: str) -> bool:
        return any(not cons(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, rules: str, least: int) -> str:
        for rule in rules.split():
            end, _, new = rule.partition(":")
            if w.endswith(end):
                base = w[: -len(end)]
                return base + new if measure(base) > least else w
        return w

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", 0)
    w = swap(w, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", 0)
    for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    ones = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    row = ones
    for x in a:
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & ones
    return len(b) - row.bit_count()


def rouge_l_score(prediction: str | None, reference: str | None, stemmed: bool = True) -> float:
    p, r = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (prediction, reference))
    if stemmed:
        p, r = [stem(w) if len(w) > 3 else w for w in p], [stem(w) if len(w) > 3 else w for w in r]
    return 2.0 * lcs_length(p, r) / (len(p) + len(r)) if p and r else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of stemmed words."""
    return pd.Series([rouge_l_score(p, r) for p, r in zip(prediction, reference, strict=True)])


def rouge_n_stemmed(n: int):
    """F1 of stemmed word n-grams as a function of two columns."""

    def grams(text: str | None) -> Counter:
        w = [stem(x) if len(x) > 3 else x for x in re.findall("[a-z0-9]+", (text or "").lower())]
        return Counter(zip(*(w[i:] for i in range(n)), strict=False))

    @F.pandas_udf(T.DoubleType())
    def score(prediction: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for p, r in zip(prediction, reference, strict=True):
            a, b = grams(p), grams(r)
            out.append(2.0 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0)
        return pd.Series(out, dtype="float64")

    return score


def faithful_share(answer: Column, entailed: Column) -> Column:
    """Share of the answer's sentences (cut at full stops) that `entailed`, a function of a sentence, holds; 0 for none."""
    s = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.filter(s, entailed)) / F.size(s))


def rank_models(results: DataFrame, metrics: dict[str, float], lower_is_better: tuple[str, ...] = ("perplexity",), model: str = "model_name", order: str = "position") -> DataFrame:
    """Ranks of models by each metric, their weighted mean and the overall rank; ties go by `order`.

    `results` has a row per model: a small table, so its windows need no partition.
    """
    long = results.select(model, order, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(w).alias("weight")) for m, w in metrics.items()])).alias("x")).select(model, order, "x.*")
    signed = F.when(F.col("metric").isin(*lower_is_better), F.col("value")).otherwise(-F.col("value"))
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(signed, F.col(order))))
    total = ranked.groupBy(model, order).agg((F.sum(F.col("rank") * F.col("weight")) / F.sum("weight")).alias("mean_rank"))
    return total.withColumn("overall_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("mean_rank", 9), F.col(order)))).select(model, "mean_rank", "overall_rank")
