"""Problem 4: answers that are no proper reply, each with its kind of defect."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import qa_raw
from qaloom.llm.grouping import components
from qaloom.llm.truncation import truncated
from qaloom.plans.staging import staged

#: What stands for an answer that isn't there, without punctuation at the ends.
NO_ANSWER = ("", "n/a", "na", "n.a", "nan", "nil", "none", "null", "answer", "a", "antwort", "réponse", "respuesta", "tbd", "tba", "todo", "not available", "no answer", "undefined", "missing", "empty", "placeholder", "lorem ipsum")
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and in was were by to for from with at on which how what when why does did that an be been after has had is are this these it its as than or not but they their per",
    "de": "der die das und von wurde wurden auf mit für nach bei welche welcher welchem wie wann warum ist im eine einen einer eines dem den des zu zum zur nicht sind war waren wird sich als auch durch aus",
    "fr": "le la les de des du et à au aux est une un pour dans par quelle quel comment pourquoi quand sur été avec a ont que qui ne pas ce cette en il elle plus",
    "es": "el la los las de del y en fue fueron una un para por qué cuál cómo se con al a que es son lo su no más como entre",
    "pt": "o os as da do das dos e em foi foram uma um para por com que na no nas nos é são não ao pelo pela mais",
    "it": "il lo gli di del della dei delle e in è stato stata sono una un per con che nel nella dal dalla non si più come anche",
    "nl": "de het een en van in is was werd werden voor met op bij door naar dat die niet zijn te als ook uit aan",
    "pl": "w z i na się jest był była było do nie to że przez dla od po oraz jak związku wyniósł wyniosła",
    "sv": "och av i en ett den det som för med på är var till från vid inte har om",
    "ro": "și în de la cu pe a fost este pentru din nu care o un",
    "cs": "a v na se je byl byla bylo do z pro od že při",
    "tr": "ve bir bu için ile olarak da de olan",
}
#: Letters that a language of Latin script uses and the others named here hardly do.
OWN_LETTERS = {"de": "ß", "es": "ñ¿¡", "pt": "ãõ", "pl": "łąęśźżćń", "ro": "șțăâ", "cs": "řěů", "sv": "å", "tr": "ğşı", "fr": "œ"}
#: Scripts, and that of the languages above.
SCRIPTS = (("cyrillic", "\\u0400-\\u04ff"), ("han", "\\u3040-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7af"), ("greek", "\\u0370-\\u03ff"), ("arabic", "\\u0590-\\u06ff"), ("indic", "\\u0900-\\u0dff"), ("thai", "\\u0e00-\\u0e7f"))
#: Ways to decline. One of three voters.
DECLINING = re.compile(
    r"\b(?:i|we)(?:['’]m|['’]re)?\s+(?:am\s+|are\s+)?(?:really\s+|afraid\s+i\s+)?(?:can(?:no|['’])t|can not|could not|couldn['’]t|won['’]t|will not|would not|wouldn['’]t|must decline|have to decline|decline to|would rather not|prefer not|refuse to|do(?:n['’]t| not) (?:have (?:enough|sufficient|the|any)|know)|not able to|unable to|unsure)"
    r"|\b(?:is|was)(?:n['’]t| not) (?:possible|something) (?:for me|i can)|\bnot something i can\b|\bno answer can be given\b|\bas an? (?:ai |large )?(?:language model|ai|assistant)\b|\bi(?:['’]m| am) (?:sorry|afraid)\b|\b(?:my apologies|i apologi[sz]e)\b"
    r"|\b(?:please )?consult a specialist\b|\b(?:outside|beyond) (?:what|my) (?:i|scope|abilit|knowledge)|\bcannot be answered\b|\bunable to (?:answer|determine|provide|assist|help)\b[^.]*\b(?:question|request|this|that)\b"
    r"|\btut mir leid\b|\bkann ich\b[^.]*\b(?:nicht|keine?n?)\b|\bich kann\b[^.]*\b(?:nicht|keine?n?)\b|\bnicht beantworten\b|\bkeine (?:auskunft|antwort)\b|\bes ist mir nicht möglich\b|\bals sprachmodell\b"
    r"|\bje (?:suis désolé|ne peux|ne suis|regrette)\b|\bdésolée?\b|\bil m['’]est impossible\b|\bimpossible de répondre\b|\bje n['’]ai pas assez\b|\baucune réponse\b|\ben tant que modèle\b"
    r"|\blo siento\b|\bno (?:me es posible|puedo|es posible (?:dar|responder)|dispongo|tengo suficiente)\b|\bno se puede responder\b|\bcomo modelo de lenguaje\b",
    re.I,
)
#: What may stand at the ends of a word.
EDGES = "()[]{},;:.?!\"“”«»¿¡…'’`´/=<>+*%–—|#&_~^·•-"
#: A whole sentence, not a phrase: it starts with a capital, or a letter that has none, and ends with a stop.
SENTENCE = re.compile(r"^[\s\"'«“¿¡]*[^\W\d_a-zß-öø-ÿа-я][\s\S]*[.!?。][\"'»”]?\s*$")
LAST_WORD = re.compile(r"[^\W_]+(?=[\W_]*$)")
LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@dataclass(frozen=True)
class DefectConfig:
    """`opening` words make an answer's opening; openings are near if their words' Jaccard is `similar`.

    A template recurs over `prompts` beginnings of questions at least, none of which asks for over `one_prompt` of its
    answers. Of a sentence that hangs in the air at most `grounded` of the content words are in the question and the context; of a
    refusing one `foreign` of the words at least are foreign to all contexts, that is, `rarer` times as rare there as in
    openings. At most `numbers` of a refusing template's openings have a number. `telling` is the share of a phrase's
    openings that belong to refusing templates. `bands` of `rows` minima each make a signature; a bucket of over `bucket`
    openings is compared by a shuffle, not inside a task.
    """

    opening: int = 6
    similar: float = 0.8
    prompts: int = 3
    one_prompt: float = 0.75
    grounded: float = 0.3
    foreign: float = 0.4
    rarer: float = 4.0
    numbers: float = 0.25
    least_words: int = 3
    telling: float = 0.5
    bands: int = 8
    rows: int = 3
    bucket: int = 2_000
    broadcast_rows: int = 200_000


def _by_word() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out.setdefault(w, []).append(lang)
    return out


BY_WORD = _by_word()
SCRIPT_RES = [(name, re.compile(f"[{span}]")) for name, span in SCRIPTS]
OWN_SETS = [(lang, frozenset(letters)) for lang, letters in OWN_LETTERS.items()]


class _Points(dict):
    """Points of a word for each language, kept while a task runs: a function word gives one, shared among its languages."""

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        if len(self) > 300_000:
            self.clear()
        out = []
        for part in {word, re.split("['’]", word)[0]}:
            langs = BY_WORD.get(part, ())
            out += [(lang, 1 / len(langs)) for lang in langs]
        got = self[word] = tuple(out)
        return got


POINTS = _Points()


def language_scores(text: str) -> dict[str, float]:
    """Points of each language: those of its function words, and one for a letter of its own."""
    out: dict[str, float] = {}
    low = text.lower()
    for w in LATIN_WORD.findall(low):
        for lang, points in POINTS[w]:
            out[lang] = out.get(lang, 0) + points
    if not low.isascii():
        letters = set(low)
        for lang, own in OWN_SETS:
            if letters & own:
                out[lang] = out.get(lang, 0) + 1
    return out


def script(text: str) -> str:
    if text.isascii():
        return "latin"
    letters = sum(c.isalpha() for c in text)
    for name, rx in SCRIPT_RES:
        if letters and len(rx.findall(text)) > 0.3 * letters:
            return name
    return "latin"


def other_language(question: str, answer: str) -> bool:
    """Whether the answer is in another language than the question, judged only where both show one clearly.

    Function words shared among languages give little each: in an answer of six words or more two of them, neither
    letters nor abbreviations, are enough, if the language has more than one point and the question's less than half.
    """
    if script(question) != script(answer):
        return sum(c.isalpha() for c in answer) >= 4
    q, a = language_scores(question), language_scores(answer)
    if not q or not a:
        return False
    asked = max(q, key=lambda k: q[k])
    best = max(a, key=lambda k: a[k])
    if best == asked or a[best] < 2 * a.get(asked, 0) + 0.5 or q.get(asked, 0) <= q.get(best, 0):
        return False
    said = LATIN_WORD.findall(answer)
    signs = {p for w in said if len(w) > 1 and not w.isupper() for p in (w.lower(), re.split("['’]", w.lower())[0]) if best in BY_WORD.get(p, ())} | {c for c in answer.lower() if c in OWN_LETTERS.get(best, "")}
    return a[best] >= 2 or a[best] > 1 and len(signs) >= 2 and len(said) >= 6


def copies(question: str, answer: str) -> bool:
    """Whether the answer is the question again: whole, once or more, with a few words beside it, or without its first words.

    A number behind the last copy is taken for an answer, one before it for the question's own.
    """
    last = LAST_WORD.search(question.lower())
    if not last or last[0] not in answer.lower():  # a copy ends as the question does
        return False
    q, a = [re.findall(r"[^\W_]+", x.lower()) for x in (question, answer)]
    if len(q) < 3 or len(a) < 3:
        return False
    at = end = times = 0
    while at < len(a):
        if a[at : at + len(q)] == q:
            at = end = at + len(q)
            times += 1
        else:
            at += 1
    if times:
        return len(a) - times * len(q) <= 8 and not any(c.isdigit() for w in a[end:] for c in w)
    return len(a) >= len(q) - 2 and len(a) <= len(q) and q[len(q) - len(a) :] == a


def blank(answer: str | None) -> bool:
    if answer is None:
        return True
    if sum(map(str.isalnum, answer[:60])) > max(map(len, NO_ANSWER)):
        return False
    text = re.sub(r"[\s​-‏⁠﻿]+", " ", answer).strip()
    return not any(c.isalnum() for c in text) or text.lower().strip(" .:;,-–—_()[]{}<>\"'*#/") in NO_ANSWER


class _Bare(dict):
    """Words without what stands at their ends, kept while a task runs."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = word.strip(EDGES).replace("’", "'")
        return out


def words_of(text: str | None, bare: _Bare) -> list[str]:
    """Words in lower case as they stand between blanks, without punctuation at their ends."""
    return [w for w in map(bare.__getitem__, (text or "").lower().split()) if w]


def in_text(word: str, text: str) -> bool:
    """Whether `word` stands in `text`, no letter or digit beside it."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
            return True
        at = text.find(word, at + 1)
    return False


def _checked(pairs: DataFrame, cfg: DefectConfig) -> DataFrame:
    """Per record (`kind` "row") the checks on the pair itself and its answer's opening; per task (`kind` "word") word counts.

    `floats` tells that the answer is a sentence and few of its opening's content words are in the question and the context,
    `declines` that a floating answer has words of declining. A word's `n` is how often it occurs in contexts, that of the
    empty word the number of contexts.
    """
    schema = "kind string, id string, checked string, opening string, prompt string, number boolean, floats boolean, declines boolean, n bigint"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        bare = _Bare()

        def counted() -> pd.DataFrame:
            out = pd.DataFrame({**dict.fromkeys(columns), "kind": "word", "opening": list(seen), "n": list(seen.values())}, columns=columns)
            seen.clear()
            return out

        for pdf in batches:
            low = pc.utf8_lower(pa.array(pdf["context"], type=pa.large_string()))
            words = pc.value_counts(pc.utf8_split_whitespace(low).flatten())
            for w, n in zip(words.field("values").to_pylist(), words.field("counts").to_pylist(), strict=True):
                if w := bare[w]:
                    seen[w] += n
            seen[""] += len(low) - low.null_count
            rows = []
            for key, q, a, given in zip(pdf["id"], pdf["question"], pdf["answer"], low.fill_null("").to_pylist(), strict=True):
                if blank(a):
                    rows.append(("row", key, "empty", None, None, None, None, None, 0))
                    continue
                defect = None
                if q and copies(q, a):
                    defect = "copied_question"
                elif q and other_language(q, a):
                    defect = "other_language"
                raw = words_of(a, bare)[: cfg.opening]
                asked = words_of(q, bare)
                content = [w for w in raw if w not in BY_WORD]
                known = sum(w in asked or in_text(w, given) for w in content)
                floats = known <= cfg.grounded * len(content) and bool(SENTENCE.match(a))
                number = any(map(str.isdigit, a))
                declines = floats and not number and bool(DECLINING.search(a))
                rows.append(("row", key, defect, " ".join(re.sub(r"\d+", "0", w) for w in raw), " ".join([w for w in asked if w.isalpha()][:4]), number, floats, declines, 0))
            yield pd.DataFrame(rows, columns=columns)
            if len(seen) > 400_000:
                yield counted()
        if +seen:
            yield counted()

    context = F.col("context") if "context" in pairs.columns else F.lit(None).cast("string").alias("context")
    return pairs.select("id", "question", "answer", context).mapInPandas(run, schema)


def signatures(openings: list[str], size: int) -> np.ndarray:
    """MinHash signatures of the sets of words of `openings`, `size` minima each."""
    rng = np.random.default_rng(7)
    mul, add = (rng.integers(1, 1 << 62, size, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    known: dict[str, int] = {}
    ids = [[known.setdefault(w, len(known)) for w in text.split()] for text in openings]
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known], dtype=np.uint64)
    out = np.full((len(openings), size), np.iinfo(np.uint64).max, dtype=np.uint64)
    for place in range(max(map(len, ids), default=0)):
        at = np.array([k for k, x in enumerate(ids) if len(x) > place], dtype=np.int64)
        h = hashes[[ids[k][place] for k in at]][:, None] * mul + add
        h ^= h >> np.uint64(31)
        out[at] = np.minimum(out[at], h * np.uint64(0x9E3779B97F4A7C15))
    return out


def large_subsets(words: list[str], similar: float) -> Iterator[tuple[str, int]]:
    """Subsets of the sorted distinct `words`, and their sizes, that hold a share of `similar` at least: two sets that near share one."""
    least = max(1, math.ceil(similar * len(words) - 1e-9))
    for k in range(least, len(words) + 1):
        for some in itertools.combinations(words, k):
            yield " ".join(some), k


def opening_templates(openings: DataFrame, cfg: DefectConfig) -> DataFrame:
    """`node` and `template` of all distinct `openings` (`node`, a hash, and `opening`).

    MinHash with verification: openings that share a band are candidates, and those whose words' exact Jaccard is
    `similar` are linked. Near sets have a large subset in common, so each opening of a bucket is linked to the smallest
    one with the same subset, if the sizes say that they are near; as any two that are near by a subset are both near to
    its smallest opening, these links connect what all pairs would. Buckets of more than `bucket` openings don't fit a
    task: their openings are linked in the same way by a shuffle of the subsets, whatever their number. A template is a
    connected cluster, named by its least node.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = signatures(pdf["opening"].tolist(), cfg.bands * cfg.rows).reshape(len(pdf), cfg.bands, cfg.rows)
            parts = []
            for band in range(cfg.bands):
                key = np.full(len(pdf), band + 1, dtype=np.uint64)
                for row in range(cfg.rows):
                    key = (key ^ sig[:, band, row]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                parts.append(pd.DataFrame({"node": pdf["node"], "opening": pdf["opening"], "key": key.view(np.int64)}))
            yield pd.concat(parts)

    keyed = staged(openings.select("node", "opening").mapInPandas(sign, "node bigint, opening string, key bigint"))
    sized = keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, smallest = None, {}
        for pdf in batches:
            rows = set()
            for key, node, opening in zip(pdf["key"].tolist(), pdf["node"].tolist(), pdf["opening"], strict=True):
                if key != here:
                    here, smallest = key, {}
                words = sorted(set(opening.split()))
                for subset, k in large_subsets(words, cfg.similar):
                    first, size = smallest.setdefault(subset, (node, len(words)))
                    if first != node and k >= cfg.similar * (size + len(words) - k):
                        rows.add((node, first))
            yield pd.DataFrame(list(rows), columns=["node", "key"])

    size = F.size(F.array_distinct(F.split("opening", " ")))
    small = sized.where(F.col("n") <= cfg.bucket).select("key", "node", "opening", size.alias("size"))
    links = small.repartition("key").sortWithinPartitions("key", "size", "node").mapInPandas(link, "node bigint, key bigint")
    large = sized.where(F.col("n") > cfg.bucket).select("node", "opening").distinct()

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, opening in zip(pdf["node"].tolist(), pdf["opening"], strict=True):
                words = sorted(set(opening.split()))
                rows += [(node, len(words), subset, k) for subset, k in large_subsets(words, cfg.similar)]
            yield pd.DataFrame(rows, columns=["node", "size", "subset", "k"])

    parts = large.mapInPandas(subsets, "node bigint, size int, subset string, k int")
    first = parts.groupBy("subset").agg(F.min(F.struct("size", "node")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("subset", "first")
    near = parts.join(first, "subset").where((F.col("first.node") != F.col("node")) & (F.col("k") >= F.lit(cfg.similar) * (F.col("first.size") + F.col("size") - F.col("k"))))
    links = staged(links.union(near.select("node", F.col("first.node").alias("key"))).distinct())
    ties = links.union(links.select("key", "key").distinct())
    return components(openings.select("node"), ties).select("node", F.col("root").alias("template"))


def refusing_openings(rows: DataFrame, seen: DataFrame, cfg: DefectConfig) -> DataFrame:
    """`node` of the openings that refuse and `how`: "template", or "phrase" for those that share a phrase of templates.

    `rows` has `node`, `opening`, `prompt`, `number`, `floats`, `declines` of the answers, `seen` the words of contexts
    with their number `n`, that of all contexts under the empty word.
    """
    by = [F.count(F.lit(1)).alias("answers"), F.count_if("number").alias("numbers"), F.count_if("floats").alias("floating"), F.count_if("declines").alias("declining")]
    openings = staged(rows.groupBy("node").agg(F.first("opening").alias("opening"), *by))
    total, contexts = rows.count(), seen.where("word = ''").agg(F.sum("n")).first()[0] or 0
    words = openings.select("node", "answers", F.explode(F.array_distinct(F.split("opening", " "))).alias("word"))
    used = words.groupBy("word").agg(F.sum("answers").alias("used")).where(F.col("used") >= cfg.prompts)
    # words of openings that contexts use far less often, if at all
    rare = F.coalesce("n", F.lit(0)) * cfg.rarer * total < F.col("used") * contexts
    foreign = staged(used.join(seen, "word", "left").where(rare).select("word"))
    few = foreign.count() <= cfg.broadcast_rows
    own = words.join(F.broadcast(foreign) if few else foreign, "word").groupBy("node").agg(F.count(F.lit(1)).alias("foreign"))
    size = F.size(F.array_distinct(F.split("opening", " ")))
    template = opening_templates(openings.select("node", "opening"), cfg)
    known = staged(openings.join(own, "node", "left").join(template, "node").withColumn("apart", (size >= cfg.least_words) & (F.coalesce("foreign", F.lit(0)) >= cfg.foreign * size)))
    asked = rows.join(known.select("node", "template"), "node").groupBy("template", "prompt").agg(F.count(F.lit(1)).alias("k")).groupBy("template").agg(F.count(F.lit(1)).alias("prompts"), F.max("k").alias("most"))
    sums = known.groupBy("template").agg(*[F.sum(c).alias(c) for c in ("answers", "numbers", "floating", "declining")], F.sum(F.when(F.col("apart"), F.col("answers")).otherwise(0)).alias("apart"))
    half = F.col("answers") * 0.5
    recurring = (F.col("prompts") >= cfg.prompts) & (F.col("most") <= F.col("answers") * cfg.one_prompt)
    empty = (F.col("floating") >= half) & (F.col("numbers") <= F.col("answers") * cfg.numbers)
    # three voters: what the openings lack in their own pair, what the words are to the corpus, words of declining
    votes = empty.cast("int") + (F.col("apart") >= half).cast("int") + (F.col("declining") >= half).cast("int")
    refusing = sums.join(asked, "template").where(recurring & (votes >= 2)).select("template", F.lit(True).alias("refuses"))
    judged = staged(known.join(refusing, "template", "left").select("node", "opening", "answers", "numbers", "floating", "declining", "apart", F.coalesce("refuses", F.lit(False)).alias("refuses")))
    # phrases of three words that refusing templates use and hardly anything else does
    w = F.split("opening", " ")
    phrases = judged.select("node", "answers", "refuses", w.alias("w")).where(F.size("w") >= 3).select("node", "answers", "refuses", F.explode(F.array_distinct(F.expr("transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2]))"))).alias("phrase"))
    told = F.sum(F.when(F.col("refuses"), F.col("answers")).otherwise(0))
    telling = phrases.groupBy("phrase").agg(told.alias("told"), F.sum("answers").alias("all")).where((F.col("told") >= cfg.prompts) & (F.col("told") >= F.col("all") * cfg.telling)).select("phrase")
    heard = phrases.where(~F.col("refuses")).join(telling, "phrase", "left_semi").select("node", F.lit(True).alias("heard")).distinct()
    lone = judged.where(~F.col("refuses")).join(heard, "node", "left")
    voices = F.coalesce("heard", F.lit(False)).cast("int") + F.col("apart").cast("int") + (F.col("declining") > 0).cast("int")
    single = lone.where((F.col("numbers") == 0) & (F.col("floating") * 2 >= F.col("answers")) & (voices >= 2)).select("node", F.lit("phrase").alias("how"))
    return judged.where("refuses").select("node", F.lit("template").alias("how")).unionByName(single)


def pair_defects(pairs: DataFrame, cfg: DefectConfig = DefectConfig()) -> DataFrame:
    """`id`, `defect` and `how` of the rows of `pairs` (`id`, `question`, `answer`, perhaps `context`) with a defect, each with one.

    `empty` is a null, blank or placeholder answer; `copied_question` the question again; `refusal` an answer that
    declines; `other_language` one in a language other than the question's; `truncated` one cut off before its end
    (`truncation.truncated` on all answers). Of several the first of this order counts. Null questions are compared with
    nothing; repeated ids are judged one by one; an empty table gives an empty one; further columns aren't read.

    Refusals show as templates: the openings of all answers are clustered by verified MinHash, and a cluster that recurs
    over unrelated prompts is one of refusals by two of three votes: its openings take nothing from their question and
    context and hold no numbers; their words are foreign to the contexts of the whole corpus; they have words of declining.
    Openings too rare for that refuse if they hang in the air without a number and have two of: a phrase of refusing
    templates, foreign words, words of declining. `how` is "template" or "phrase" for refusals, else null.
    """
    seen = staged(_checked(pairs, cfg))
    rows = seen.where("kind = 'row'")
    some = rows.where(F.col("opening").isNotNull() & (F.col("opening") != "")).withColumn("node", F.xxhash64("opening"))
    counts = seen.where("kind = 'word'").groupBy(F.col("opening").alias("word")).agg(F.sum("n").alias("n"))
    refusing = staged(refusing_openings(some.where("checked IS NULL"), counts, cfg))
    refused = some.where("checked IS NULL").join(refusing, "node").select("id", "how").distinct()
    cut = truncated(pairs.select("id", F.lit("answer").alias("field"), F.col("answer").alias("text"))).where("cut").select("id", F.lit(True).alias("cut")).distinct()
    x = rows.join(refused, "id", "left").join(cut, "id", "left")
    defect: Column = F.coalesce("checked", F.when(F.col("how").isNotNull(), "refusal"), F.when(F.col("cut"), "truncated"))
    return x.select("id", defect.alias("defect"), "how").where(F.col("defect").isNotNull())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of qa_raw with a defective answer."""
    return pair_defects(qa_raw(spark, sf_dir, ["id", "question", "answer", "context"])).select("id", "defect")


def p4_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of records with each defect, and how many of them are owed to templates or their phrases."""
    found = pair_defects(qa_raw(spark, sf_dir, ["id", "question", "answer", "context"]))
    return found.groupBy("defect").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("how") == "template").alias("by_template"), F.count_if(F.col("how") == "phrase").alias("by_phrase"))
