"""Bibliographic data out of a paper's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of identifiers, in the order in which they are tried.
DOI = (
    r"(?i)(?:doi[:\s]*)?(?:https?://)?(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s\]\"'<>]+)",
    r"(?i)(?:doi[:\s]*)(10\.\d{4,}/[^\s\]\"'<>]+)",
)
PMID = (r"(?i)PMID[:\s]*(\d{7,8})", r"(?i)PubMed[:\s]*ID[:\s]*(\d{7,8})", r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{7,8})")
ARXIV = (r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?)", r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)", r"(?i)arxiv\.org/pdf/(\d{4}\.\d{4,5}(?:v\d+)?)")
YEAR = (r"\((\d{4})\)", r"©\s*(\d{4})", r"Copyright\s+(\d{4})", r"Published[:\s]+\d{1,2}\s+\w+\s+(\d{4})", r"Received[:\s]+\d{1,2}\s+\w+\s+(\d{4})")
#: Venues by pattern, first match wins.
VENUES = (
    ("Scientific Reports", "Scientific Reports"), ("Nature Communications", "Nature Communications"), ("PLOS ONE", "PLOS ONE"),
    ("Journal of Proteome Research", "Journal of Proteome Research"), ("Analytical Chemistry", "Analytical Chemistry"),
    ("Journal of the American Society for Mass Spectrometry", "JASMS"), ("Proteomics", "Proteomics"), ("Bioinformatics", "Bioinformatics"),
    ("BMC Bioinformatics", "BMC Bioinformatics"), ("Nature Methods", "Nature Methods"), ("Molecular & Cellular Proteomics", "MCP"),
    ("Mass Spectrometry Reviews", "Mass Spectrometry Reviews"),
)
#: Venues and DOI prefixes of open access.
OPEN_VENUES = (
    "scientific reports", "nature communications", "plos one", "plos biology", "plos medicine", "bmc bioinformatics", "bmc genomics", "frontiers in",
    "peerj", "elife", "f1000research", "mdpi", "arxiv", "biorxiv", "medrxiv", "journal of proteome research",
)
OPEN_PREFIXES = ("10.1038/s41598", "10.1371/journal.p", "10.3389/")
#: What a title line doesn't contain.
NO_TITLE = ("www.", "http", "@", "copyright", "doi:", "page ", "received", "accepted", "published", "abstract")


def search_window(text: Column) -> Column:
    """Where identifiers stand: the first 3,000 and the last 1,000 characters of a text beyond 4,000."""
    return F.when(F.length(text) > 4000, F.concat(F.left(text, F.lit(3000)), F.right(text, F.lit(1000)))).otherwise(text)


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def doi_of(text: Column) -> Column:
    """The first DOI, by the first pattern whose match without closing punctuation is one."""
    w, found = search_window(text), []
    for p in DOI:
        d = F.rtrim(F.regexp_extract(w, p, 1), F.lit(".,;:"))
        found.append(F.when(d.rlike(r"^10\.\d{4,}/\S+$"), d))
    return F.coalesce(*found)


def pmid_of(text: Column) -> Column:
    return _first(search_window(text), PMID)


def arxiv_of(text: Column) -> Column:
    return _first(search_window(text), ARXIV)


def year_of(text: Column) -> Column:
    """The first match of each pattern if within 1990..2030, else the most frequent year, the first of equals."""
    head = F.left(text, F.lit(3000))
    stated = []
    for p in YEAR:
        y = F.nullif(F.regexp_extract(head, p, 1), F.lit("")).cast("int")
        stated.append(F.when(y.between(1990, 2030), y))
    every = F.regexp_extract_all(head, F.lit(r"\b(19\d{2}|20[0-2]\d)\b"), 1)
    ranked = F.transform(F.array_distinct(every), lambda y: F.struct((F.size(every) - F.size(F.array_remove(every, y))).alias("n"), (-F.array_position(every, y)).alias("at"), y.alias("y")))
    return F.coalesce(*stated, F.array_max(ranked)["y"].cast("int"))


def venue_of(text: Column) -> Column:
    head = F.left(text, F.lit(3000))
    case = None
    for pattern, name in VENUES:
        hit = F.contains(F.lower(head), F.lit(pattern.lower()))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise(F.nullif(F.trim(F.regexp_extract(head, r"(?:published in|journal[:\s]+)([A-Z][A-Za-z\s&]+)", 1)), F.lit("")))


def title_of(text: Column) -> Column:
    """The best of the first twenty lines by length and height; neither short nor full of digits nor with a marker."""
    lines = F.slice(F.split(F.left(text, F.lit(2000)), "\n"), 1, 20)

    def candidate(line: Column, i: Column) -> Column:
        t = F.trim(line)
        ok = (F.length(t) > 30) & (F.length(t) < 300) & (F.length(F.regexp_replace(t, r"[^0-9]", "")) <= F.length(t) * 0.3)
        for s in NO_TITLE:
            ok = ok & ~F.contains(F.lower(t), F.lit(s))
        return F.when(ok, F.struct((F.length(t) * (20 - i) / F.lit(20.0)).alias("score"), (-i).alias("at"), t.alias("t")))

    best = F.array_max(F.filter(F.transform(lines, candidate), lambda c: c.isNotNull()))
    return F.trim(F.regexp_replace(best["t"], r"\s+", " "))


def license_of(text: Column, venue: Column, doi: Column) -> Column:
    low = F.lower(F.left(text, F.lit(5000)))
    by_venue, by_doi = F.lit(False), F.lit(False)
    for v in OPEN_VENUES:
        by_venue = by_venue | F.coalesce(F.contains(F.lower(venue), F.lit(v)), F.lit(False))
    for p in OPEN_PREFIXES:
        by_doi = by_doi | F.coalesce(doi.startswith(p), F.lit(False))
    return F.when(low.rlike(r"creative\s+commons|cc[\s-]by|open\s+access|freely\s+available") | by_venue | by_doi, "open_access").otherwise("unknown")


def confidence_of(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column, venue: Column) -> Column:
    def worth(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    score = worth(doi.isNotNull(), 0.3) + worth(pmid.isNotNull(), 0.2) + worth(arxiv.isNotNull(), 0.2) + worth(F.length(title) > 20, 0.15) + worth(year.isNotNull(), 0.1) + worth(venue.isNotNull(), 0.05)
    return F.least(F.lit(1.0), score)


def metadata_columns(text: Column) -> dict[str, Column]:
    doi, pmid, arxiv, title, year, venue = doi_of(text), pmid_of(text), arxiv_of(text), title_of(text), year_of(text), venue_of(text)
    return {
        "doi": doi, "pmid": pmid, "arxiv_id": arxiv, "title": title, "year": year, "venue": venue,
        "license": license_of(text, venue, doi), "extraction_confidence": confidence_of(doi, pmid, arxiv, title, year, venue),
    }


def looked_up(own: dict[str, Column], found: dict[str, Column], hit: Column) -> dict[str, Column]:
    """Fields of a record with those of a lookup: title, year and venue where they are missing, authors always.

    The licence becomes open_access if a licence address found says so; a hit adds .2 to the confidence, up to 1.
    `hit` tells whether the lookup had the record; `found["authors"]` may be null, then the own ones stay.
    """
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    open_licence = F.exists(F.coalesce(found["license_urls"], F.array().cast("array<string>")), lambda u: F.lower(u).rlike("creativecommons|open"))
    return {
        **{k: F.when(blank(own[k]).isNull() & hit, found[k]).otherwise(own[k]) for k in ("title", "year", "venue")},
        "authors": F.when(hit & found["authors"].isNotNull(), found["authors"]).otherwise(own["authors"]),
        "license": F.when(hit & open_licence, F.lit("open_access")).otherwise(own["license"]),
        "extraction_confidence": F.when(hit, F.least(F.coalesce(own["extraction_confidence"], F.lit(0.0)) + F.lit(0.2), F.lit(1.0))).otherwise(own["extraction_confidence"]),
    }
