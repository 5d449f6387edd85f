"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class that Java, RE2 and Python's split agree on.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"

#: What a cleaned answer has lost, in the order of removal.
ANSWER_NOISE = (
    r"\[\d+(?:[,\-–]\s*\d+)*\]",
    r"\(\d+(?:[,\-–]\s*\d+)*\)",
    r"https?://\S+",
    r"www\.\S+",
    r"(?i)doi:\s*\S+",
    r"10\.\d{4,}/\S+",
    r"(?i)(?:Fig\.|Figure|Table|Supplementary\s+(?:Fig|Table|Material))\s*\d+[A-Za-z]?",
    r"\S+@\S+\.\S+",
)
#: Words that carry no meaning in an overlap.
STOP_WORDS = (
    "the and was were are for that this with from has had have been not but they its also than can may which when what how who where why does did "
    "will would could should about their these those some such other into more most only between after before during each both text according"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, which is computed once, also where `use` takes it into a lambda: there Catalyst would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space single, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def words(text: Column) -> Column:
    """The words of `text`, split at white space; none for a blank or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def occurrences(text: Column, what: str) -> Column:
    """How often `what` occurs in `text`, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what)))) / len(what)).cast("int")


def cut_at_word(text: Column, limit: int) -> Column:
    """The first `limit` characters up to their last blank; whole if they have none."""
    head = F.left(text, F.lit(limit))
    return F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)


def clean_answer(text: Column, limit: int = 512) -> Column:
    """Without citations, links, DOIs, figure references and addresses; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern in ANSWER_NOISE:
        out = F.regexp_replace(out, pattern, "")
    out = squeeze(out)
    return F.trim(F.when(F.length(out) > limit, cut_at_word(out, limit)).otherwise(out))


def clean_question(text: Column, limit: int = 256) -> Column:
    """White space single, cut at a word and then closed by a question mark."""
    out = squeeze(F.coalesce(text, F.lit("")))
    cut = cut_at_word(out, limit)
    return F.when(F.length(out) > limit, F.when(cut.endswith("?"), cut).otherwise(F.concat(cut, F.lit("?")))).otherwise(out)


def truncate_context(text: Column, limit: int = 1536) -> Column:
    """At the last sentence that ends in the second half of the first `limit` characters, else at a word."""
    head = F.left(text, F.lit(limit))
    back = F.locate(" .", F.reverse(head))  # 1-based from the end
    last = F.length(head) - back - 1  # 0-based position of the period
    return F.when(F.length(text) <= limit, text).when((back > 0) & (last > limit * 0.5), F.left(head, last + 1)).otherwise(cut_at_word(text, limit))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct sequences of `n` tokens."""

    def of(t: Column) -> Column:
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(t, i, n)))))

    return let(tokens, of)


def meaningful_words(text: Column) -> Column:
    """Words of two letters or more that are no stop words, with repetitions."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^\p{L}\p{N}_])([a-z\x{400}-\x{4FF}\x{C0}-\x{24F}]{2,})(?=$|[^\p{L}\p{N}_])"), 1)
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), 1))


def share_in(part: Column, whole: Column, empty: float) -> Column:
    """Share of the items of `part` (a set) that `whole` has; `empty` for no items."""
    return F.when(F.size(part) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def letters_share(text: Column, kinds: str) -> Column:
    """Share of the characters that belong to the class `kinds`; null for an empty text."""
    return F.length(F.regexp_replace(text, f"[^{kinds}]", "")) / F.nullif(F.length(text), F.lit(0))


#: Letters and signs that have no decomposition, and what is written for them.
PLAIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "Th", "ð": "d", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "×": "x", "µ": "u", "°": "deg", "±": "+-", "€": "EUR", "·": "*", "•": "*", "«": "<<", "»": ">>", "©": "(c)", "®": "(r)", "™": "tm"}
#: Letters with marks, and those without.
MARKED = ("àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz")


def plain_latin(text: Column) -> Column:
    """`text` in ASCII: marks taken off letters, ligatures and signs spelt out, anything else left out."""
    low, bare = MARKED
    out = F.translate(text, low + low.upper().replace("I", "I"), bare + bare.upper())
    for sign, plain in PLAIN.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7f]", "")


def plain_page(text: Column, least: int = 10) -> Column:
    """A page in ASCII with single blanks; empty if it has fewer than `least` characters."""
    out = squeeze(plain_latin(F.coalesce(text, F.lit(""))))
    return F.when(F.length(out) < least, F.lit("")).otherwise(out)


def as_text(value: Column, kind: str = "string") -> Column:
    """A field as one line: a string with single blanks, a list of strings joined, null as empty, anything else as JSON."""
    if kind == "string":
        return squeeze(F.coalesce(value, F.lit("")))
    if kind == "array<string>":
        return squeeze(F.array_join(F.transform(F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull()), squeeze), " "))
    return squeeze(F.coalesce(F.to_json(value), F.lit("")))


def html_to_text(html: Column) -> Column:
    """The text of HTML: no scripts, styles, comments and tags, a line at each block's end, the common entities resolved."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|head)\b.*?</(?:script|style|head)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|table|section|article)>", "\n")
    out = F.regexp_replace(out, r"(?s)<[a-zA-Z/!][^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def html_to_markdown(html: Column) -> Column:
    """HTML as Markdown: headings, bold, italics, list items and links as signs, the rest as `html_to_text`."""
    out = F.coalesce(html, F.lit(""))
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "#" * level + " $1</p>")
    out = F.regexp_replace(out, r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "*$1*")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "* $1</p>")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    return html_to_text(out)
