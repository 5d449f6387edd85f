"""Problem 10: a score for abusive, hateful or sexually explicit language, by weak supervision."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.label_model import LabelModel, fit_label_model, fit_linear
from qaloom.plans.staging import staged
from qaloom.sources.tables import table

#: Words by what they are evidence of, as in common lists of offensive words and of groups that are attacked,
#: and general words of science. A voter looks at which kinds stand in a segment together.
WORDS = {
    "insult": "arsehole asshole assholes bastard bastards bimbo bitch bitches blockhead bonehead buffoon coward cowards cretin cunt dickhead dimwit dirtbag douche douchebag dumbass dumbo dunce fatso fool fools fucker fuckers fuckface fuckwit halfwit harlot idiot idiots imbecile imbeciles jackass jerk jerkoff knobhead lamer liar liars loser losers lowlife moron morons motherfucker nincompoop numbskull nutcase parasites pervert pigs pissant prick scum scumbag shitbag shithead simpleton skank slut sluts swine thug tosser twat twerp twit wanker weirdo whore whores wimp wretch",
    "belittling": "abject braindead brainless clueless contemptible crappy deranged despicable disgusting dumb filthy fucking goddamn hideous idiotic incompetent inept insane lousy lying mindless miserable moronic nasty nauseating obnoxious pathetic pitiful repulsive retarded revolting ridiculous rotten scummy shameless shitty sleazy slimy smelly spineless stinking stupid ugly useless vile worthless wretched",
    "profane": "arse arsed ass bollocks bugger bullshit crap dammit damn damned fuck fucked fuckin fucking goddamn hell motherfucking piss pissed shit shite shitting shitty wtf",
    "explicit": "bdsm blowjob bondage boner boobs bukkake clit clitoris cock cocks cum cumming cumshot cunnilingus deepthroat dick dicks dildo fellatio fisting foreplay gangbang handjob hentai horny incest masturbate masturbated masturbating masturbation milf milfs naked nude nudes orgasm orgasms orgy porn porno pornography pussy sexting sexy sodomy strapon stripper strippers striptease threesome tits titties titty twerk vibrator whore xxx",
    "erotic": "aroused arousing bikini booty busty butt buttocks caress caressed erotic fetish fondle groin groped kinky kissed licked lingerie lust lustful moan moaned moaning naked naughty nipple nipples nude nudity panties pleasure raunchy seduce seduced sensual skirt spank steamy strip stripped submissive suck sucked temptress thigh thighs topless uncensored underwear undress undressed voyeur webcam",
    "group": "africans arabs asians atheists blacks buddhists catholics chinese christians disabled foreigners gays gypsies hindus hispanics homosexuals immigrants indians indigenous islam jews lesbians mexicans migrants minorities mormons muslims natives negroes pakistanis palestinians poles protestants queers refugees roma russians sikhs transgender transsexuals turks ukrainians women",
    "kin": "folk folks kind people tribe",
    "slur": "beaner chink coon cripples dago dyke dykes fag faggot faggots fags gook gooks gypo honky jap kaffir kike kikes kraut nigga nigger niggers paki pakis raghead ragheads retard retards shemale spic spics tranny trannies wetback wetbacks wog wop",
    "dehumanising": "animals ape apes beasts breed cattle cockroach cockroaches degenerate disease dung filth filthy germs infect infest infested leeches liars lice maggots monkeys parasites pest pests plague rats savages scum slime subhuman subhumans swarm thieves vermin",
    "excluding": "banish banished barred belong cleanse cleansing deport deported eliminate eradicate expel expelled exterminate exterminated forbidden gassed kicked lock locked purge rid segregate send sterilise unwelcome",
    "you": "you your yours yourself yourselves u ur",
    "someone": "everyone he him me nobody she somebody someone they",
    "violent": "attack beat beaten bleed brutal burn burned butcher choke decapitate destroy drown execute gun hang hanged hurt kill killed kills knife lynch maim massacre murder murdered punch rape raped shoot shot skull slap slaughter slit smash stab stabbed strangle strangled suffer throat torture tortured whipped",
    "wishing": "deserve deserves die dies hope kill rot suffer",
    "ever": "ever soon tomorrow tonight",
    "meeting": "catch coming find meet see visit waiting",
    "ordering": "crawl die fuck get go piss quit rot shove shut",
    "lab": "abundance abundant accuracy accurate acid acquired adjusted aliquot amount analyse analysed analyses analysis analytical applied assay average axis bands batch biomarker calculated calibration carcinoma caused cell cells changed chemical chromatography clearance clinical coefficient cohort collected column compare compared comparison component components composition compound concentration conditions confirmed contained content control correlation culture curve data decreased degradation derived detected detection detector determined deviation diagnosis diluted dissolved distribution dose doses drug drugs effect effects efficiency elevated elution enrichment enzyme epithelium equation error estimated evaluated evidence experiment exposure expression extract extraction figure filtered flow fluid formation formula fraction fractions frequency function gene genes gland gradient heated hormone identified increased incubated inhibitor injected injection instrument intensity interval ion isolates isotope kinase labelled labelling laboratory lesions levels ligand limit linear literature lower mass matrix mean measure measured measurement mechanism median membrane metabolism method methods mice mixture mobile model molecular mouse mutant negative nitrogen normal observed optimised organic parameter particles patients peak peptide percent performed phase phases plasma positive precision prepared pressure procedure profile protein proteins purified quantified random range rate rates ratio reaction reactions reagent receptor recorded recoveries recovery reduced regression removed replicate replicates reported residue resolution result results retention sampled samples sampling scale scan scored secretion sensitivity separated separation sequence serum signal significant site soil solution solutions solvent source species specimen spectra spectrometry spectrum spike spiked stability stable standard statistical stored strain structure studied study subjects substrate surface swab swabs synthesis table temperature test tested theory threshold tissue tissues total toxicity treated treatment tumour tumours unit urine validation value values variance variation velocity volume volunteers washed water weight yield",
    "foreign": "abschaum arschloch ausländerpack bastardo batard bâtard bite bollera cabron cabrona cabrones cabrón cagna caralho cazzo cojones coglione connard connasse connards coño couille couilles crétin cretino culero culo dreck dreckige dreckiger dreckig drecksau dreckskerl dummkopf enculé enculés estúpido estúpida fick ficken ficker figa filho fils foda folle fotze foutre gilipollas gueule hijo hijueputa huren hure hurensohn idiota idiote idioten imbécil imbécile joder kanaken kanake kacke kurwa madre maldita maldito malparido marica maricón maricones merda merde mierda miststück missgeburt muschi neger negro negros nique nutte nutten pédé pendejo pendejos pétasse polla porra puta putain putas pute puto sale salaud salope salopard sau scheiss scheiß scheiße schlampe schlampen schwanz schwein schweine schwuchtel spast spasti sudaca stronzo tetas titten trou troia ungeziefer vadia vagabunda vermine verpiss vollidiot vollidioten vollpfosten wichser zorra zorras блядь сука хуй пизда ебать мразь урод",
    "foreign_you": "cállate deine deinem deinen deiner dich dein dir du eres euch eure ihr halt je sei te ti tes tu toi ton tus usted va verpisst vete wie vous vos",
}
#: Letters of other scripts that look like Latin ones, after lower case.
LOOKALIKES = str.maketrans("аеорсухіѕјԁһкмтνοαερτυ", "aeopcyxisjdhkmtvoaeptu", "​‌‍⁠﻿­")
#: Digits that stand for letters.
DIGITS = str.maketrans("0134579", "oieastg")
LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
KINDS = list(WORDS)
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
HIDDEN = 1 << len(KINDS)  # an insult, profanity or explicit word written so as not to be found
DIGIT = HIDDEN << 1
TEXT_END = "\n\0"
END = DIGIT << 1  # no word, but the end of a sentence
LETTER = END << 1  # a letter by itself
TOKEN = re.compile(r"[^\W_]+(?:[*@#$%]+[^\W_]*)*|[.!?\n]+")
#: Voters by name: kinds of words that stand together, or don't, and the vote. Those of -1 hold a segment to be harmless.
VOTERS: tuple[tuple[str, tuple[str, ...], int], ...] = (
    ("insulted_you", ("insult", "you"), 1), ("insulted_someone", ("insult", "someone", "no lab"), 1), ("belittled_insult", ("insult", "belittling"), 1), ("profane_you", ("profane", "you"), 1), ("profane_insult", ("profane", "insult"), 1),
    ("group_dehumanised", ("group", "dehumanising"), 1), ("group_excluded", ("group", "excluding"), 1), ("kin_dehumanised", ("kin", "dehumanising"), 1), ("kin_excluded", ("kin", "excluding"), 1), ("belittled_group", ("belittling", "group"), 1), ("slur", ("slur",), 1),
    ("explicit", ("explicit", "no lab"), 1), ("explicit_you", ("explicit", "you"), 1), ("explicit_erotic", ("explicit", "erotic"), 1), ("erotic_you", ("erotic", "you"), 1),
    ("violent_you", ("violent", "you"), 1), ("wishing_you", ("wishing", "you"), 1), ("violent_wish", ("violent", "wishing", "no lab"), 1), ("menaced_you", ("ever", "meeting", "you"), 1), ("belittled_you", ("belittling", "you"), 1), ("ordered_insult", ("ordering", "insult"), 1), ("ordered_profane", ("ordering", "profane"), 1), ("ordered_violence", ("ordering", "violent", "you"), 1),
    ("foreign", ("foreign",), 1), ("foreign_you", ("foreign", "foreign_you"), 1), ("hidden", ("hidden",), 1),
    ("lab", ("lab",), -1), ("numbers", ("digit",), -1), ("explicit_in_lab", ("explicit", "lab", "no you"), -1), ("profane_in_lab", ("profane", "lab", "no you"), -1), ("insult_in_lab", ("insult", "lab", "no you"), -1), ("violent_in_lab", ("violent", "lab", "no you"), -1),
)


@dataclass(frozen=True)
class AbuseConfig:
    """`sample` bounds the labelled segments of each of three kinds on which the classifier is fitted.

    `spare`: of the segments without a telling vote one in so many, drawn by document and place, is offered to it; all
    segments count for the label model, and all are scored. `window` words make a segment of a long sentence, features
    fall on `buckets` places, `threshold` is the score from which a document counts, `prior` the share first assumed.
    """

    sample: int = 15_000
    window: int = 12
    buckets: int = 1 << 17
    threshold: float = 0.3
    spare: int = 48
    prior: float = 0.02


def _squeeze(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


EXACT: dict[str, int] = {}
for _kind, _words in WORDS.items():
    for _w in _words.split():
        EXACT[_w] = EXACT.get(_w, 0) | BIT[_kind]
STRONG = sum(BIT[k] for k in ("insult", "profane", "explicit", "slur", "belittling", "dehumanising"))
SQUEEZED: dict[str, int] = {}
for _w, _bits in EXACT.items():
    SQUEEZED[_squeeze(_w)] = SQUEEZED.get(_squeeze(_w), 0) | _bits


DOUBLED = re.compile(r"(.)\1")


def kinds_of(word: str) -> int:
    """Kinds of a word, also where letters are doubled or hidden behind signs and digits."""
    bits = EXACT.get(word)
    if bits is not None:
        return bits
    if word.isalpha():
        if DOUBLED.search(word) and (bits := SQUEEZED.get(_squeeze(word), 0)):
            return bits | (HIDDEN if bits & STRONG else 0)
        for end in (1, 2):
            if word[-1] == "s" and (bits := EXACT.get(word[:-end], 0)) and word[-2:][:end] in ("s", "es"):
                return bits & ~BIT["you"]
        return 0
    if word.isalnum():
        spelt = word.translate(DIGITS)
        bits = 0 if word.isdigit() else EXACT.get(spelt, 0) | (SQUEEZED.get(_squeeze(spelt), 0) if sum(c.isalpha() for c in word) >= 2 else 0)
        return bits | HIDDEN if bits & STRONG else DIGIT
    core = word.strip("*@#$%") if word[0] not in "*@#$%" and sum(c in "*@#$%" for c in word) < 2 else word
    rx = re.compile("".join("." if c in "*@#$%" else re.escape(c) for c in core))
    hit = 0
    for w, b in EXACT.items():
        if len(w) == len(core) and rx.fullmatch(w):
            hit |= b
    return hit | HIDDEN if hit & STRONG else hit


CODE = re.compile(r"[a-z]{0,2}\d+$")
NUMBER = int.from_bytes(hashlib.blake2b(b"0", digest_size=6).digest(), "little")


class _Index(dict):
    """Numbers of words, with their kinds and hashes in arrays; kept while a task runs."""

    def __init__(self) -> None:
        self.kinds, self.hashes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.kinds):
            self.kinds, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kinds, self.hashes))
        if CODE.match(word):  # most words that are new
            self.kinds[k], self.hashes[k] = DIGIT, NUMBER
            self[word] = k
            return k
        plain = word.rstrip("\0")
        if not word[0].isalnum():
            self.kinds[k] = END
        else:
            self.kinds[k] = kinds_of(plain) | (HIDDEN if word != plain else 0) | (LETTER if len(word) == 1 and word.isalpha() else 0)
        named = plain if plain.isalpha() or self.kinds[k] & HIDDEN else "0"
        self.hashes[k] = int.from_bytes(hashlib.blake2b(named.encode(), digest_size=6).digest(), "little")
        self[word] = k
        return k


class Reader:
    """Cuts texts into segments and gives their words, kinds and hashed features."""

    def __init__(self, cfg: AbuseConfig):
        self.cfg, self.index = cfg, _Index()

    def words(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words in plain Latin lower case, words spelt by letters joined, with ends of sentences and of texts among them.

        With the words come their numbers and, for each, which of `texts` it stands in: many texts at once cost less.
        """
        if len(self.index) > 300_000:
            self.index = _Index()
        tokens: list[str] = []
        for text in texts:
            low = (text or "").lower()
            tokens += TOKEN.findall(low.translate(LOOKALIKES) if LOOKALIKE.search(low) else low)
            tokens.append(TEXT_END)
        at = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        letter = self.index.kinds[at] & LETTER > 0
        if (letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]).any():
            out, done = [], 0
            for m in re.finditer(rb"\x01{4,}", letter.astype(np.uint8).tobytes()):
                run = tokens[m.start() : m.end()]
                out += tokens[done : m.start()]
                first = 1 if run[0] in "ai" and EXACT.get("".join(run[1:])) and not EXACT.get("".join(run)) else 0
                word = "".join(run[first:])
                out += [*run[:first], word + "\0" if EXACT.get(word, 0) & STRONG else word]
                done = m.end()
            tokens = out + tokens[done:]
            at = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        ends = at == self.index[TEXT_END]
        return tokens, at, np.cumsum(ends) - ends

    def segments(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and behind the last word of sentences, of long ones of windows that overlap by half, and their kinds."""
        kinds, w = self.index.kinds[at], self.cfg.window
        ends = np.flatnonzero(kinds & END)
        low, high = np.append(0, ends + 1), np.append(ends, len(at))
        some = high > low
        low, high = low[some], high[some]
        n = np.where(high - low <= w + 2, 1, -(-(high - low - w // 2) // (w // 2)))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(low, n) + nth * (w // 2)
        last = np.where(np.repeat(n, n) == 1, np.repeat(high, n), np.minimum(first + w, np.repeat(high, n)))
        if not len(first):
            return first, last, first
        pairs = np.stack([first, last], axis=1).ravel()
        return first, last, np.bitwise_or.reduceat(np.append(kinds, 0), pairs)[::2]

    def pattern(self, have: int) -> int:
        """Bit k is set if voter k votes on a segment that has these kinds of words."""
        out = 0
        for k, (need, bar) in enumerate(zip(NEEDS, BARS, strict=True)):
            if have & need == need and not have & bar:
                out |= 1 << k
        return out

    def features(self, words: list[str]) -> np.ndarray:
        """Buckets of words and pairs of neighbours."""
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        ids = self.index.hashes[at]
        return np.concatenate([ids, ids[:-1] * 1_000_003 + ids[1:]]) % self.cfg.buckets


NEEDS = [sum(HIDDEN if k == "hidden" else DIGIT if k == "digit" else BIT[k] for k in kinds if not k.startswith("no ")) for _, kinds, _ in VOTERS]
BARS = [sum(BIT[k[3:]] for k in kinds if k.startswith("no ")) for _, kinds, _ in VOTERS]
#: Votes that make a segment one to learn from: all but those on its lab words and numbers alone.
TELLING = sum(1 << k for k, (name, _, _) in enumerate(VOTERS) if name not in ("lab", "numbers"))


def _some(texts: list, size: int = 400) -> Iterator[list]:
    """Texts in lots of bounded number, to be read at once."""
    return (texts[i : i + size] for i in range(0, len(texts), size))


def vote(documents: DataFrame, cfg: AbuseConfig) -> DataFrame:
    """Numbers of segments by which voters vote (`kind` "count", summed per task), and segments for the classifier.

    Segments with a telling vote are all given, with a hash that puts them in a random order (`kind` "accused"), of the
    rest about one in `spare`, drawn by document and place (`kind` "spare").
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts = Reader(cfg), Counter()
        cache: dict[int, int] = {}
        for pdf in batches:
            rows = []
            for lot in _some(list(zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True))):
                words, at, text_of = reader.words([t for _, t in lot])
                first, last, have = reader.segments(at)
                if not len(first):
                    continue
                kinds, of, n = np.unique(have, return_inverse=True, return_counts=True)
                patterns = np.empty(len(kinds), dtype=np.int64)
                for k, h in enumerate(kinds.tolist()):
                    if h not in cache:
                        cache[h] = reader.pattern(h)
                    patterns[k] = cache[h]
                    counts[cache[h]] += int(n[k])
                p = patterns[of]
                telling = p & TELLING > 0
                ids = np.array([k or 0 for k, _ in lot], dtype=np.int64).view(np.uint64)[text_of[first]]
                place = (first - np.searchsorted(text_of, text_of[first])).astype(np.uint64)
                drawn = (((ids * np.uint64(1_000_003) + place) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(cfg.spare) == 0
                for k in np.flatnonzero(telling | drawn):
                    segment = " ".join(words[first[k] : last[k]])
                    h = int.from_bytes(hashlib.blake2b(segment.encode(), digest_size=7).digest(), "little")
                    rows.append(("accused" if telling[k] else "spare", int(p[k]), 1, h, segment))
            yield pd.DataFrame(rows, columns=["kind", "pattern", "n", "h", "segment"])
        yield pd.DataFrame({"kind": "count", "pattern": list(counts), "n": list(counts.values()), "h": 0, "segment": None})

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, "kind string, pattern bigint, n bigint, h bigint, segment string")


def train(documents: DataFrame, cfg: AbuseConfig = AbuseConfig()) -> tuple[LabelModel, np.ndarray]:
    """The label model over all segments of `documents` and the weights of the linear classifier.

    The model is fitted to the numbers of segments by pattern of votes, over the whole corpus; these are at most as many
    as combinations of kinds of words occur. The classifier is fitted to the model's posterior labels on about
    `sample` segments each of three kinds at most: accused ones held abusive, accused ones held harmless, and others.
    """
    seen = staged(vote(documents, cfg))
    patterns = {int(r["pattern"]): int(r["n"]) for r in seen.where("kind = 'count'").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    model = fit_label_model(patterns, [v for _, _, v in VOTERS], cfg.prior)
    held = [p for p in patterns if model.posterior(p) >= 0.5]
    distinct = seen.where("kind <> 'count'").groupBy("kind", "pattern", "h").agg(F.min("segment").alias("segment"))
    label = F.col("pattern").isin(held) if held else F.lit(False)
    rows = []
    for part in (distinct.where((F.col("kind") == "accused") & label), distinct.where((F.col("kind") == "accused") & ~label), distinct.where("kind = 'spare'")):
        total = part.count()
        # hashes are even over 56 bits, so this many rows come, about, whatever the corpus: the documented bound
        rows += part.where(F.col("h") <= int(2**56 * min(1.0, cfg.sample / max(1, total)))).orderBy("h", "pattern").select("pattern", "segment").collect()
    reader = Reader(cfg)
    features = [reader.features(r["segment"].split(" ")) for r in rows]
    labels = np.array([model.posterior(int(r["pattern"])) for r in rows])
    return model, fit_linear(features, labels, cfg.buckets)


def score(documents: DataFrame, weights: np.ndarray, cfg: AbuseConfig = AbuseConfig()) -> DataFrame:
    """`doc_id`, `source`, `score` and `segment` (its most abusive place) of all `documents`; 0 for null and empty texts."""
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # `buckets` numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, w = Reader(cfg), shared.value
        bias, w = float(w[-1]), w[:-1]
        for pdf in batches:
            best, where = [], []
            for texts in _some(pdf["text"].tolist()):
                words, at, text_of = reader.words(texts)
                a, b, have = reader.segments(at)
                # one or two words say nothing by themselves, unless by their kind
                some = (b - a > 2) | (have & STRONG > 0)
                a, b = a[some], b[some]
                ids = reader.index.hashes[at]
                one = w[ids % cfg.buckets]
                two = np.append(w[(ids[:-1] * 1_000_003 + ids[1:]) % cfg.buckets], 0)
                s1, s2 = np.append(0, np.cumsum(one, dtype=np.float64)), np.append(0, np.cumsum(two, dtype=np.float64))
                total = s1[b] - s1[a] + s2[b - 1] - s2[a]
                # as in training, features count by the root of their number
                logits = bias + total / np.sqrt(2.0 * (b - a) - 1)
                of = text_of[a]
                order = np.lexsort((-logits, of))
                firsts = order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order
                scores, places = np.zeros(len(texts)), [None] * len(texts)
                scores[of[firsts]] = 1 / (1 + np.exp(-logits[firsts]))
                for k in firsts:
                    places[of[k]] = " ".join(words[a[k] : b[k]]).replace("\0", "")
                best += scores.tolist()
                where += places
            yield pdf[["doc_id", "source"]].assign(score=best, segment=where)

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, score double, segment string")


def abuse_scores(documents: DataFrame, cfg: AbuseConfig = AbuseConfig()) -> DataFrame:
    """A score from 0 to 1 for every row of `documents` (`doc_id`, `source`, `text`) that its text is abusive.

    A text counts as its worst segment, a sentence or a part of a long one. Null and empty texts score 0; repeated ids
    and texts are scored each; an empty table gives an empty one. Very long texts are read whole.
    """
    rows = documents.select("doc_id", "source", "text")
    _, weights = train(rows, cfg)
    return score(rows, weights, cfg)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    cfg = AbuseConfig()
    return abuse_scores(table(spark, sf_dir, "documents"), cfg).where(F.col("score") >= cfg.threshold).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and its worst place."""
    return abuse_scores(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents per source."""
    cfg = AbuseConfig()
    by = abuse_scores(table(spark, sf_dir, "documents"), cfg).groupBy("source")
    hits = F.count_if(F.col("score") >= cfg.threshold)
    return by.agg(F.count(F.lit(1)).alias("documents"), hits.alias("abusive"), (hits / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
