"""Problem 3: texts that stop before their end, found by how word sequences end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import qa_raw, source_of, strip
from qaloom.llm.scan_noise import RUNNING
from qaloom.plans.staging import staged

#: What no text ends with, though it ends in a full stop.
ABBREVIATIONS = r"(?i)(?:^|[\s(])(?:e\.g|i\.e|fig|figs|vs|approx|ca|cf|resp|z\.B|d\.h|p\.ej)\.$"
#: Ends that a transfer leaves: an ellipsis or a broken character on a word, a started entity or tag, a comma or bracket.
CUT_MARKS = r"(?:[\p{L}\p{N},;(]…|[\p{L}\p{N},;(]\.\.\.|\x{FFFD}|&(?:#?[A-Za-z0-9]{0,6})?|</?[A-Za-z]{0,4}|\p{L}\s?[,;(\[])$"
#: The longest of these marks and abbreviations, and some more.
MARK_LENGTH = 16
#: A full stop, or a reference in brackets after one.
END = r"[.!?。！？][)\]}\"'”’»]*(?:\s+(?:Source:\s*)?[(\[](?:[^()\[\]]|[(\[][^()\[\]]*[)\]])*[)\]])?$"
#: A row of a table with as many cells as the row before.
ROW = r"(?:^|\n)[^\t\n]*((?:\t)[^\t\n]*){2,}\n[^\t\n]+(?:\t[^\t\n]+){2,}$"
#: Articles and prepositions, which end no phrase.
DANGLING = tuple("a an the of with from by to for at into and or der die das den dem des von mit für und zu le la les des du de avec pour et el los las del con para y".split())


@dataclass(frozen=True)
class TruncationConfig:
    """`often`: occurrences from which a sequence counts as frequent; `ends` and `almost_never`: ends it may have, and their share.

    Parts of a word are at most `part_share` of what follows the two words before, or one.

    The marks of an end are looked for in the last `tail` characters, or the last four words where these are longer: a
    bracket behind a full stop, or a table's row, that is longer isn't known as one.
    """

    often: int = 10
    ends: int = 3
    almost_never: float = 0.05
    part_share: float = 0.01
    often_stop: int = 30
    almost_never_stop: float = 0.01
    phrase_words: int = 14
    spike: int = 20
    spike_times: float = 8.0
    spike_from: int = 64
    tail: int = 300


def _tokens(text: Column) -> Column:
    """Words with their punctuation, two start marks before the first; numbers, codes and capital sequences all as 0."""
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.split(F.regexp_replace(text, r"(?:\b[A-Z]{1,3})?[0-9]+|\b[A-Z]{5,}\b", "0"), r"\s+"))


def truncated(texts: DataFrame, cfg: TruncationConfig = TruncationConfig()) -> DataFrame:
    """The rows of `texts` (`id`, `field`, `text`) with `n_chars` and `cut`, true if the text stops before its end.

    Word trigrams are counted inside the texts of a field and at their ends. The final trigram of a text is joined to
    these counts, as it stands and with its last word left open, since a cut goes through words as well: a sequence
    that is frequent inside and almost never leads to an end shows a cut. Ends that a transfer leaves (a started entity,
    a broken character) are cuts; a text closed by a full stop is one only if the stop belongs to a number or an
    abbreviation. So does a last word that never
    stands behind the two before it. Where a sequence is too rare to tell, a last line of prose without a stop is a cut, and so is an
    unclosed text of a length at which texts of its field stop conspicuously often. A short answer that
    doesn't start like a sentence is excused from these two; what the sequences tell cuts it if its last word is unseen
    there or can't end a phrase, and no more than two of its field have the same text, or so few that as many are cut there in
    a large corpus (`part_share` of the sequences with the two words before). Null and blank texts aren't cut; equal texts count once at ends; very
    long ones are handled whole. An empty table gives an empty table.
    """
    rows = texts.select("id", "field", strip(F.col("text")).alias("text")).where(F.col("text") != "")
    t = rows.select("field", _tokens(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 3")
    inside = t.selectExpr("field", "inline(arrays_zip(slice(w, 1, n - 3), slice(w, 2, n - 3), slice(w, 3, n - 3)))").toDF("field", "x", "y", "z")
    inside = inside.selectExpr("xxhash64(field, x) AS x", "xxhash64(field, y) AS y", "xxhash64(field, z) AS z").selectExpr("xxhash64(x, y, z) AS a", "xxhash64(x, y) AS b")
    inside = staged(inside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("inside")))
    # what a text ends with stands in its last characters and its last words; its last line and first words are looked at
    # whole, by patterns that stop after a few words. `n` counts the words, with the two start marks, up to `phrase_words` + 3
    last = F.substring_index("text", " ", -4)
    end = F.when(F.length(last) > cfg.tail, last).otherwise(F.right("text", F.lit(cfg.tail)))
    words = F.size(F.split(F.regexp_extract("text", rf"^(?:\S+\s+){{0,{cfg.phrase_words + 2}}}\S*", 0), r"\s+"))
    last_line = F.substring_index("text", "\n", -1)
    tail = rows.select(
        "id", "field", F.xxhash64("text").alias("hash"), F.length("text").alias("n_chars"), end.alias("text"), (words + 2).alias("n"), F.col("text").rlike(r"^[\"'“(]*\p{Lu}").alias("sentence"),
        (last_line.rlike(r"^\s*(?:\S+\s+){5}\S") | last_line.rlike(r"^\p{Ll}")).alias("prose"), (F.length(last_line) <= cfg.tail).alias("short_line"),
    )
    w = tail.withColumn("w", _tokens(F.col("text"))).withColumn("m", F.size("w"))
    last_line = F.substring_index("text", "\n", -1)
    close = F.col("text")
    h1, h2, h3 = (f"xxhash64(field, w[m - {k}])" for k in (3, 2, 1))
    ends = w.select(
        "id", "field", "hash", "n", "n_chars",
        F.expr(f"xxhash64({h1}, {h2}, {h3})").alias("a"), F.expr(f"xxhash64({h1}, {h2})").alias("b"),
        F.right("text", F.lit(MARK_LENGTH)).rlike(CUT_MARKS).alias("marked"),
        close.rlike(END).alias("closed"),
        F.element_at("w", -1).rlike(r"(?:^|[(=])0\.$").alias("number_stop"),
        F.right("text", F.lit(MARK_LENGTH)).rlike(ABBREVIATIONS).alias("abbreviated"),
        "prose", "sentence", "short_line", "text",
        F.element_at("w", -1).rlike(r"^\p{Ll}+$").alias("plain"),
        F.element_at("w", -1).isin(*DANGLING).alias("dangling"),
    )
    row = F.substring_index("text", "\n", -2).rlike(ROW) | F.col("short_line") & last_line.rlike("(?i)" + RUNNING)
    # rows are asked for among unclosed texts only
    ends = staged(ends.withColumn("open_stop", F.col("number_stop") | F.col("abbreviated")).withColumn("row", ~F.col("closed") & ~F.col("marked") & row).drop("text", "short_line", "number_stop"))
    once = ends.select("hash", "a", "b").distinct()
    texts_of = ends.groupBy("field", "hash").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    short = F.col("n") - 2 <= cfg.phrase_words
    # how often the texts that don't recur by chance were delivered, as the whole corpus may be
    times = texts_of.where(~short).groupBy("field").agg(F.greatest(F.round(F.avg("k")), F.lit(1.0)).alias("times"))
    repeated = texts_of.where(short & (F.col("k") >= cfg.ends)).join(times, "field", "left").where(F.col("k") >= F.coalesce("times", F.lit(1.0)) * cfg.ends).select("field", "hash", "k")

    def counted(key: str) -> DataFrame:
        stop = once.groupBy(key).agg(F.count(F.lit(1)).alias(f"end_{key}"))
        return stop.join(inside.groupBy(key).agg(F.sum("inside").alias("_in")), key, "left").select(key, f"end_{key}", F.coalesce("_in", F.lit(0)).alias(f"in_{key}"))

    ca, cb = counted("a"), counted("b")
    # lengths at which unclosed texts of a field stop far more often than at the twenty lengths around
    by_length = ends.where(~F.col("closed") & (F.col("n_chars") >= cfg.spike_from)).groupBy("field", "n_chars").agg(F.count_distinct("hash").alias("k"))
    around = by_length.select("field", "k", F.explode(F.sequence(F.col("n_chars") - 10, F.col("n_chars") + 10)).alias("n_chars")).groupBy("field", "n_chars").agg(F.sum("k").alias("around"))
    spikes = by_length.join(around, ["field", "n_chars"]).where((F.col("k") >= cfg.spike) & (F.col("k") >= cfg.spike_times * (F.col("around") - F.col("k")) / 20.0)).select("field", "n_chars", F.lit(True).alias("spike"))
    x = ends.join(ca, "a").join(cb, "b").join(spikes, ["field", "n_chars"], "left").join(repeated, ["field", "hash"], "left").withColumn("repeated", F.coalesce(F.col("k") > (F.col("in_b") + F.col("end_b")) * cfg.part_share, F.lit(False)))
    share_a, share_b = F.col("end_a") / (F.col("end_a") + F.col("in_a")), F.col("end_b") / (F.col("end_b") + F.col("in_b"))
    # ends of a part of a word grow with the corpus: they are as rare among what follows the two words before, not in number
    part = (F.col("in_a") == 0) & (F.col("end_a") <= F.greatest(F.lit(1.0), (F.col("in_b") + F.col("end_b")) * cfg.part_share)) & F.col("plain")
    common_end = ((F.col("end_a") >= cfg.ends) & (share_a >= cfg.almost_never) & ~part) | ((F.col("end_b") >= cfg.ends) & (share_b >= cfg.almost_never))
    never = (F.col("in_b") >= cfg.often) & ~common_end
    unseen = part & (F.col("in_b") + F.col("end_b") >= 2 * cfg.often)
    phrase = (F.col("field") == "answer") & ~F.col("sentence") & (F.col("n") - 2 <= cfg.phrase_words)
    # a number's point is no full stop if numbers don't end a sentence there, inside the texts either
    number = (F.col("in_b") >= cfg.often_stop) & (share_b < cfg.almost_never_stop) & (F.col("in_a") * 50 < F.col("in_b"))
    cut = (
        F.when(F.col("marked") & (F.col("n") > 3), True)
        .when(F.col("closed") & ~F.col("open_stop"), False)
        .when(F.col("closed") & F.col("abbreviated"), F.col("n") > 8)
        .when(F.col("closed"), number)
        .when((F.col("n") <= 4) | F.col("row"), False)
        .when(phrase, ~F.col("repeated") & (unseen | (never & F.col("dangling"))))
        .when(never | unseen, True)
        .when(F.col("spike") & F.col("prose"), True)
        .when(F.col("in_b") < cfg.often, F.col("prose"))
        .otherwise(False)
    )
    return x.select("id", "field", "n_chars", F.coalesce("spike", F.lit(False)).alias("spike"), cut.alias("cut"))


def fields_of(records: DataFrame, fields: list[str]) -> DataFrame:
    """`id`, `field`, `text`: a row per record and field."""
    return records.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("id", "x.field", "x.text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the field that was cut off."""
    return truncated(fields_of(qa_raw(spark, sf_dir, ["id", "answer", "context"]), ["answer", "context"])).where("cut").select("id", "field")


def p3_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field, and how many of the cuts are at a conspicuous length."""
    records = qa_raw(spark, sf_dir, ["id", "answer", "context", "source_pdf"])
    cut = truncated(fields_of(records, ["answer", "context"]))
    by = cut.join(records.select("id", source_of(F.col("source_pdf")).alias("source")), "id").groupBy("source", "field")
    return by.agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("spike")).alias("cut_at_length"), (F.count_if("cut") / F.count(F.lit(1))).alias("share"))
