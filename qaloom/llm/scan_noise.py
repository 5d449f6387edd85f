"""Problem 1: noise in text from scanned pages, and the paragraphs without it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import doc_key, qa_raw
from qaloom.plans.staging import staged
from qaloom.sources.tables import table

#: What scanning makes of letters, as (seen, meant).
CONFUSIONS = (
    ("1", "l"), ("|", "l"), ("!", "i"), ("0", "o"), ("@", "a"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("3", "e"), ("4", "a"), ("2", "z"), ("7", "t"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("ti", "h"), ("iri", "m"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("i", "l"), ("l", "i"), ("c", "o"), ("u", "n"), ("n", "u"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"),
    ("ü", "ti"), ("ü", "u"), ("ö", "o"), ("ä", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("j", "i"),
)
#: Signs that divide a word at a line end and can't be its own hyphen.
DIVIDERS = "­¬"
HYPHENS = "‐‑-"  # the last one last: it stands in classes
#: Wordings of running lines in any journal.
RUNNING = (
    r"^(?:©|\(c\)|copyright)\s|all rights reserved|^downloaded (?:from|by)\b|\bby guest\b|^(?:accepted|author) manuscript\b|^(?:original |review |research )(?:article|paper)$|^preprint\b|"
    r"^[\p{L}'’.-]+(?: [\p{L}'’.-]+)? (?:et al\.?|and others)(?: /.*)?$|·\s*vol\.?\s*\d|,\s*(?:\d{4},?\s*)?vol\.?\s*\d+(?:\s*\(\d+\))?$|^(?:issn|doi)[:\s]"
)
TOKEN = re.compile(r"[^\W_][^\s()\[\]{},;:?\"“”‘’…/=<>+*%]*")
START = re.compile(r"[!@$|\w]")
DIVIDED = re.compile(rf"([^\W_][\w{HYPHENS}]*)([{DIVIDERS}{HYPHENS}])[^\S\n]*\n\s*([^\W\d_][\w{HYPHENS}]*)")
PAGE_NUMBER = re.compile(r"(?i)^(?:[-–—|·•\[(]\s*)?(?:(?:page|p|pg|seite|página|pag)\.?\s*)?(\d{1,5}|[ivxlcdm]{1,7})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?(?:\s*[-–—|·•\])])?$")
BARE = re.compile(r"^(?:\d{1,5}|[ivxlcdm]{1,7})$")
NUMERIC = re.compile(r"^[\d.,±+\-\s%]+$")


@dataclass(frozen=True)
class NoiseConfig:
    """A word is misread if a variant is frequent (at least so often and of that share) and `times` as frequent as the word.

    `hot_share` bounds the stop set to its inverse; a running line recurs in `recurring` records.
    """

    frequent: int = 10
    frequent_share: float = 3e-5
    times: float = 20.0
    least_length: int = 3
    hot_share: float = 1e-5
    recurring: int = 3


def own_hyphen(m: re.Match) -> bool:
    """Whether a division goes after an abbreviation or code, or before a capital: there the hyphen is the word's own."""
    last = m[1].rsplit("-", 1)[-1]
    return m[2] in HYPHENS and (len(last) > 1 and last.isupper() or any(c.isdigit() for c in last) or m[3][0].isupper() and not m[1].isupper())


def mask(line: str) -> str:
    """A line without what changes from page to page."""
    return re.sub(r"\d+", "0", " ".join(line.casefold().split()))


#: What ends a word, as blanks.
GAPS = str.maketrans({c: " " for c in "()[]{},;:?\"“”‘’…/=<>+*%–—"})
LINE_END = re.compile(rf"[{DIVIDERS}{HYPHENS}][^\S\n]*\n")


def raw_words(text: str) -> list[str]:
    """Words as they stand. The parts of a word divided at a line end are none."""
    if "\n" in text and LINE_END.search(text):
        text = DIVIDED.sub(" ", text)
    return text.translate(GAPS).split()


class Words(dict):
    """Words that may hold misread letters, in lower case, of a word as it stands; kept while a task runs.

    Codes, numbers, and abbreviations of less than five capitals, or with small letters, have none. A word with a hyphen
    counts whole and by parts.
    """

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        w = raw.strip(".'")
        if w.endswith("!"):
            w = w.rstrip("!")
        out: tuple[str, ...] = ()
        letters = sum(c.isalpha() for c in w)
        capitals = sum(c.isupper() for c in w)
        if len(w) >= 3 and w[0] not in "-‐" and letters >= 2 and letters * 2 >= len(w) and (capitals <= 1 or capitals == letters >= 5):
            w = w.lower()
            out = (w, *(p for p in w.split("-") if len(p) >= 3 and not p.isdigit())) if "-" in w else (w,)
        self[raw] = out
        return out


def page_number_lines(lines: list[str]) -> list[int]:
    """Lines with nothing but a page number. Bare numbers in a column of numbers or under its head are data."""
    found = []
    kept = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(kept):
        line = lines[i].strip()
        if not PAGE_NUMBER.match(line):
            continue
        if BARE.match(line):
            near = [lines[kept[j]].strip() for j in (k - 1, k + 1) if 0 <= j < len(kept)]
            if any(NUMERIC.match(x) for x in near) or line.isalpha() and line not in ROMANS:
                continue
            if k and re.match(r"^[A-Z][a-z]+(?: \([^)]*\))?$", near[0]):
                continue
        found.append(i)
    return found


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


ROMANS = {_roman(n) for n in range(1, 400)}


def line_candidates(lines: list[str]) -> list[tuple[int, str, bool, int]]:
    """(line, mask, whether it breaks a sentence, percent of its words with a capital) of lines that may be running lines."""
    out = []
    kept = [i for i, x in enumerate(lines) if x.strip()]
    for k, i in enumerate(kept):
        line = lines[i].strip()
        if len(line) < 3 or "\t" in line or line[0].islower() or NUMERIC.match(line) or PAGE_NUMBER.match(line) or re.match(r"^\d+\.\s|^[-•*]\s", line):
            continue
        before = lines[kept[k - 1]].strip() if k else ""
        after = lines[kept[k + 1]].strip() if k + 1 < len(kept) else ""
        breaks = len(before.split()) >= 3 and (before[-1].isalpha() or before[-1] == ",") and bool(after) and after[0].islower()
        words = re.findall(r"[^\W\d_]+", line)
        out.append((i, mask(line), breaks, 100 * sum(w[0].isupper() for w in words) // max(1, len(words))))
    return out


def divided_by_lines(lines: list[str], between: set[int]) -> list[re.Match]:
    """Divisions with lines that may be running lines or page numbers between their parts, as at the turn of a page."""
    found = []
    for i, line in enumerate(lines[:-1]):
        if i + 1 not in between or not line.rstrip().endswith((*DIVIDERS, *HYPHENS)):
            continue
        after = next((k for k in range(i + 1, len(lines)) if lines[k].strip() and k not in between), None)
        if after is not None:
            found += [m for m in DIVIDED.finditer(f"{line.rstrip()}\n{lines[after].lstrip()}") if "\n" in m[0] and not own_hyphen(m)]
    return found


def _observations(records: DataFrame) -> DataFrame:
    """What the contexts show: `word` counts (summed per task), `line` and `page` candidates and `hyphen` divisions."""
    schema = "kind string, id string, a string, b string, sign string, line int, n bigint, breaks boolean, edge boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter[str] = Counter()
        words_of = Words()

        def words() -> Iterator[pd.DataFrame]:
            counts: Counter[str] = Counter()
            for w, n in raw.items():
                for x in words_of[w]:
                    counts[x] += n
            raw.clear()
            if counts:  # without rows `a` would be a column of floats, which can't be sent as strings
                yield pd.DataFrame({"kind": "word", "id": None, "a": list(counts), "b": None, "sign": None, "line": 0, "n": list(counts.values()), "breaks": False, "edge": False})

        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                raw.update(raw_words(text))
                if "\n" not in text:
                    continue
                lines = text.split("\n")
                pages, running = page_number_lines(lines), line_candidates(lines)
                rows += [("page", key, lines[i].strip(), None, None, i, 1, False, False) for i in pages]
                rows += [("line", key, m, None, None, i, titled, breaks, False) for i, m, breaks, titled in running]
                rows += [("hyphen", key, m[1].lower(), m[3].lower(), m[2], 0, 1, False, False) for m in DIVIDED.finditer(text) if not own_hyphen(m)]
                rows += [("hyphen", key, m[1].lower(), m[3].lower(), m[2], 0, 1, False, True) for m in divided_by_lines(lines, {*pages, *(i for i, *_ in running)})]
            yield pd.DataFrame(rows, columns=["kind", "id", "a", "b", "sign", "line", "n", "breaks", "edge"])
            if len(raw) > 400_000:
                yield from words()
        yield from words()

    return records.mapInPandas(run, schema)


def anagram(word: Column) -> Column:
    """Sum of a power of the letters: equal for anagrams, and changed by an exchange of letters by a fixed amount."""
    return F.aggregate(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))), F.lit(0).cast("bigint"), lambda s, c: s + c)


def undone(word: str, right: str, steps: int) -> bool:
    """Whether `right` is `word` with so many confusions undone;
    two only in words long enough to tell, or with a sign that no word has."""
    if steps == 2 and len(word) < 5 and word.isalpha():
        return False
    for seen, meant in CONFUSIONS:
        at = word.find(seen)
        while at >= 0:
            new = word[:at] + meant + word[at + len(seen) :]
            if new == right if steps == 1 else undone(new, right, 1):
                return True
            at = word.find(seen, at + 1)
    return False


def misreadings(words: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> DataFrame:
    """`wrong` and `right` for words (`word`, `n`) that a frequent word becomes by confusions of CONFUSIONS.

    The anagram hash of a rare word, with one or two confusions undone, is joined to the hashes of frequent words;
    the edit distance, and then undoing the confusions letter by letter, confirm it. Of several variants the one of fewest confusions,
    then the most frequent, then the first counts.
    """
    spark = words.sparkSession
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(CONFUSIONS)], "k int, seen string, meant string").select(
        "k", "seen", "meant", (anagram(F.col("meant")) - anagram(F.col("seen"))).alias("delta"), F.greatest(F.length("seen"), F.length("meant")).alias("cost"),
    ).toPandas()
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where((F.col("n") >= max(cfg.frequent, total * cfg.frequent_share)) & F.col("word").rlike(r"^[\p{L}-]+$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), anagram(F.col("word")).alias("h"))
    rare = words.where((F.length("word") >= cfg.least_length) & ~F.col("word").contains("-"))
    one = F.array(*[F.when(F.col("word").contains(s), F.struct(F.lit(int(d)).cast("bigint").alias("delta"), F.lit(int(c)).alias("cost"), F.lit(1).alias("steps"), F.lit(int(k)).alias("k"))) for k, s, d, c in zip(pairs.k, pairs.seen, pairs.delta, pairs.cost, strict=True)])
    held = rare.select("word", "n", anagram(F.col("word")).alias("hw"), F.filter(one, lambda x: x.isNotNull()).alias("one"))
    odd = F.col("word").rlike(r"[^\p{L}-]")
    two = F.flatten(F.transform("one", lambda x: F.transform(F.filter("one", lambda y: y["k"] >= x["k"]), lambda y: F.struct((x["delta"] + y["delta"]).alias("delta"), (x["cost"] + y["cost"]).alias("cost"), F.lit(2).alias("steps"), x["k"].alias("k")))))
    tried = held.select("word", "n", "hw", F.explode(F.when(odd | (F.length("word") >= 4), F.concat("one", two)).otherwise(F.col("one"))).alias("x"))
    found = tried.select("word", "n", (F.col("hw") + F.col("x.delta")).alias("h"), "x.cost", "x.steps").distinct().join(frequent, "h")
    close = found.where((F.col("n_right") >= F.col("n") * cfg.times) & (F.levenshtein("word", "right") <= F.col("cost")) & (F.col("word") != F.col("right")))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[undone(w, v, k) for w, v, k in zip(pdf["word"], pdf["right"], pdf["steps"], strict=True)]]

    close = close.select("word", "n", "right", "n_right", "steps").mapInPandas(confirm, "word string, n bigint, right string, n_right bigint, steps int")
    best = close.groupBy("word").agg(F.min(F.struct("steps", -F.col("n_right"), "right")).alias("x"), F.first("n").alias("n"))
    return best.select(F.col("word").alias("wrong"), F.col("x.right").alias("right"), "n")


def _rare_tokens(records: DataFrame, hot: frozenset[str]) -> DataFrame:
    shared = records.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop, words_of, common = shared.value, Words(), set()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                rare: set[str] = set()
                for raw in set(raw_words(text)) - common:
                    asked = [w for w in words_of[raw] if w not in stop]
                    if asked:
                        rare.update(asked)
                    elif len(common) < 500_000:
                        common.add(raw)
                rows += [(key, w) for w in rare]
            yield pd.DataFrame(rows, columns=["id", "wrong"])

    return records.mapInPandas(run, "id string, wrong string")


def furniture(blocks: DataFrame, recurring: int) -> DataFrame:
    """Masks of the lines at the upper and lower edges of pages, in at least `recurring` blocks.

    `blocks` has `doc_id, page, y0, y1, text`. At an edge is a block of one line beyond all others of its page.
    """
    text = F.trim(F.regexp_replace("text", r"\s+$", ""))
    edge = blocks.where("doc_id IS NOT NULL AND page IS NOT NULL").groupBy("doc_id", "page").agg(F.min_by("text", "y0").alias("top"), F.max_by("text", "y1").alias("bottom"), F.count(F.lit(1)).alias("k")).where("k > 1")
    lines = edge.select(F.explode(F.array("top", "bottom")).alias("text")).select(text.alias("text")).where(~F.col("text").contains("\n") & (F.length("text") >= 3) & ~F.col("text").rlike(r"^\W*(?:[Pp](?:age)?\.?\s*)?\d+\W*(?:(?:of|/)\s*\d+)?\W*$"))
    masked = F.regexp_replace(F.lower(F.regexp_replace("text", r"\s+", " ")), r"\d+", "0")
    return lines.groupBy(masked.alias("a")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= recurring).select("a")


@dataclass
class Noise:
    """Everything found: `rows` (`id`, `noise`), and what a repair needs, per kind."""

    lines: DataFrame
    hyphens: DataFrame
    words: DataFrame

    def rows(self) -> DataFrame:
        kinds = self.lines.select("id", "noise").unionByName(self.hyphens.where("divided").select("id", F.lit("hyphenation").alias("noise")))
        return kinds.unionByName(self.words.select("id", F.lit("misread").alias("noise"))).distinct()


def find_noise(records: DataFrame, blocks: DataFrame, titles: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> Noise:
    """Noise in `records` (`id`, `text`, `node`): divided words, misread words, running lines, page numbers.

    `blocks` are text blocks of pages (`doc_id, page, y0, y1, text`), `titles` has `node`, `title`. Null and empty texts
    have no noise; ids are taken as unique; an empty corpus gives nothing.

    Words are counted over all texts; rare ones are joined by anagram hash to frequent words (`misreadings`). The set
    of words too frequent to be looked up holds at most 1 / hot_share of them, whatever the corpus. A division by a
    hyphen is judged by how often the corpus writes the word joined and with the hyphen. A running line is one with the
    wording of such lines, one that recurs at page edges in `blocks`, the title of its paper, or one that recurs in
    other records and breaks sentences there.
    """
    texts = records.where(F.col("text").isNotNull() & (F.col("text") != "")).select("id", "text")
    seen = staged(_observations(texts))
    words = staged(seen.where("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
    wrong = staged(misreadings(words, cfg))
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = frozenset(r["word"] for r in words.where(F.col("n") > max(total * cfg.hot_share, 2)).join(wrong, F.col("word") == F.col("wrong"), "left_anti").select("word").toLocalIterator())
    misread = _rare_tokens(texts, hot).join(wrong, "wrong").select("id", "wrong", "right")

    hyphens = seen.where("kind = 'hyphen'").select("id", F.col("a").alias("left"), F.col("b").alias("right"), "sign", "edge")
    parts = hyphens.select("left", "right").distinct()
    own = F.concat_ws("-", F.col("left"), F.col("right"))
    joined = F.concat("left", "right")
    asked = parts.select(own.alias("own"), joined.alias("joined"), "left", "right")
    count = words.select("word", "n")
    for name in ("own", "joined", "left", "right"):
        asked = asked.join(count.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
    n = {name: F.coalesce(f"n_{name}", F.lit(0)) for name in ("own", "joined", "left", "right")}
    # unseen both ways: two words of the corpus keep their hyphen, anything else was one word
    judged = asked.select("left", "right", (n["joined"] > 0).alias("known"), F.when(n["own"] + n["joined"] > 0, n["joined"] >= n["own"]).otherwise((n["left"] < 3) | (n["right"] < 3) & ~F.col("right").endswith("-")).alias("one_word"))
    # with lines between its parts a division must give a word of the corpus: the lines may belong to the text
    divided = (F.col("sign").isin(*DIVIDERS) | F.col("one_word")) & (F.col("known") | ~F.col("edge"))
    hyphens = hyphens.join(judged, ["left", "right"]).select("id", "left", "right", "sign", divided.alias("divided"))

    lines = seen.where("kind = 'line'").select("id", "a", "line", "breaks", (F.col("n") / 100.0).alias("n"))
    by = lines.groupBy("a").agg(F.count_distinct("id").alias("records"), F.avg(F.col("breaks").cast("double")).alias("broken"), F.avg("n").alias("titled"))
    edges = furniture(blocks, 2).select("a", F.lit(True).alias("at_edge"))
    called = titles.where("node IS NOT NULL AND title IS NOT NULL").groupBy("node").agg(F.max(F.regexp_replace(F.lower(F.regexp_replace("title", r"\s+", " ")), r"\d+", "0")).alias("title"))
    judged_lines = lines.join(records.select("id", "node"), "id").join(called, "node", "left").join(by, "a").join(edges, "a", "left")
    bare = F.trim(F.regexp_replace("a", r"[\s….]+$", ""))
    is_title = F.coalesce((F.length(bare) >= 15) & F.startswith("title", bare) & F.col("a").rlike(r"…$|[^.]$"), F.lit(False))
    recurs = (F.col("records") >= cfg.recurring) & (F.col("broken") >= 0.2) & (F.col("titled") >= 0.6) & F.col("a").rlike(r"^[^()\[\];]*[^()\[\];.,]$") & ~F.col("a").rlike(r"[.%±]\s|(?:\S+\s+){8}")
    headers = judged_lines.where(F.col("a").rlike("(?i)" + RUNNING) | F.coalesce("at_edge", F.lit(False)) | is_title | recurs).select("id", "line", F.lit("header").alias("noise"))
    pages = seen.where("kind = 'page'").select("id", "line", F.lit("page_number").alias("noise"))
    return Noise(headers.unionByName(pages), hyphens, misread)


def repair(text: str, drop: set[int], divided: set[tuple[str, str]], wrong: dict[str, str]) -> str:
    """The paragraphs of `text`: without the dropped lines, divided words joined, lines flowing, misread words put right."""
    kept = [x for i, x in enumerate(text.split("\n")) if i not in drop]
    body = "\n".join(kept)
    if drop:  # a running line stood between blank lines inside a sentence
        body = re.sub(r"([^\s.!?:…)\]])[^\S\n]*\n(?:[^\S\n]*\n)+(?=[a-zß-ÿ(])", r"\1\n", body)

    def join(m: re.Match) -> str:
        if m[2] in DIVIDERS or not own_hyphen(m) and (m[1].lower(), m[3].lower()) in divided:
            return m[1] + m[3]
        return m[1] + m[2] + m[3]

    while (new := DIVIDED.sub(join, body)) != body:
        body = new
    # a line within a paragraph flows on; list items, rows of tables and headings stay lines
    body = re.sub(r"(?<=[^\s])[^\S\n]*\n(?=[^\S\n]*[^\s\n])(?![^\S\n]*(?:\d+\.\s|[-•*]\s|[\d.,]+\s*$|[^\n]*\t))", lambda m: " " if _flows(body, m) else m[0], body, flags=re.M)

    def right(m: re.Match) -> str:
        w = m[0]
        fixed = wrong.get(w.lower())
        if fixed is None:
            return w
        return fixed.upper() if w.isupper() and len(w) > 1 else fixed.capitalize() if w[0].isupper() else fixed

    if wrong:
        body = re.sub("|".join(rf"(?<!\w){re.escape(w)}(?!\w)" for w in sorted(wrong, key=len, reverse=True)), right, body, flags=re.I)
    return body


def _flows(body: str, m: re.Match) -> bool:
    line = body[body.rfind("\n", 0, m.start()) + 1 : m.start()]
    return len(line) >= 40 or not re.match(r"^(?:\d+(?:\.\d+)*\s+)?[A-Z][\w ]*$", line)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = qa_raw(spark, sf_dir, ["id", "context", "file_name"]).select("id", F.col("context").alias("text"), doc_key(F.lit(None).cast("string"), F.col("file_name")).alias("node"))
    titles = table(spark, sf_dir, "doc_metadata").select(doc_key(F.col("doc_id")).alias("node"), "title")
    return staged(records), table(spark, sf_dir, "pdf_blocks").select("doc_id", "page", "y0", "y1", "text"), titles


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the kinds of noise in their contexts."""
    return find_noise(*_inputs(spark, sf_dir)).rows()


def repaired(records: DataFrame, blocks: DataFrame, titles: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> DataFrame:
    """`id`, `context`, `repaired` of the `records` with noise; inputs as for `find_noise`. Texts without noise don't come."""
    noise = find_noise(records, blocks, titles, cfg)
    drop = noise.lines.groupBy("id").agg(F.collect_set("line").alias("drop"))
    divided = noise.hyphens.where("divided").groupBy("id").agg(F.collect_set(F.struct("left", "right")).alias("divided"))
    wrong = noise.words.groupBy("id").agg(F.collect_set(F.struct("wrong", "right")).alias("wrong"))
    work = drop.join(divided, "id", "full").join(wrong, "id", "full").join(records.select("id", "text"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                listed = [x if x is not None else () for x in (r.drop, r.divided, r.wrong)]
                out.append(repair(r.text, {int(i) for i in listed[0]}, {(d["left"], d["right"]) for d in listed[1]}, {w["wrong"]: w["right"] for w in listed[2]}))
            yield pd.DataFrame({"id": pdf["id"], "context": pdf["text"], "repaired": out})

    return work.mapInPandas(run, "id string, context string, repaired string")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts with noise and what becomes of them."""
    return repaired(*_inputs(spark, sf_dir))
