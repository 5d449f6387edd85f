"""Problem 5: groups of papers that are tied to each other, and splits that keep a group together."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.llm.common import doc_key, qa_release, split_name
from qaloom.llm.subset_sum import closest_subset
from qaloom.operators.rows import rank_within
from qaloom.plans.staging import staged
from qaloom.sources.tables import table

#: What stands for a missing identifier or author.
PLACEHOLDERS = {
    "", "-", "--", "?", "0", "anon", "anonymous", "author", "authors", "et al", "et al.", "example", "n.a.", "n/a", "na", "nan",
    "nil", "no author", "none", "null", "others", "and others", "placeholder", "tba", "tbd", "test", "unknown", "unknown author", "various", "xxx",
}
#: Letters that Unicode doesn't take apart.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


def plain(text: str) -> str:
    """Without accents and case, white space single."""
    cut = unicodedata.normalize("NFKD", text.casefold()).translate(LETTERS)
    return " ".join("".join(c for c in cut if not unicodedata.combining(c)).split())


def author_key(name: str | None) -> str | None:
    """Surname and first initial: `Surname, F.`, `F. Surname`, `First M. Surname` and `SURNAME F` are the same."""
    if name is None or (text := plain(name).strip(" ;")) in PLACEHOLDERS:
        return None
    if "," in text:
        surname, _, given = text.partition(",")
    else:
        words = text.split()
        k = len(words)
        while k > 1 and len(words[k - 1].replace(".", "").replace("-", "")) == 1:
            k -= 1
        if k < len(words):  # the initials stand last
            surname, given = " ".join(words[:k]), words[k]
        else:
            surname, given = words[-1], words[0] if len(words) > 1 else ""
    surname = re.sub(r"[^\w ]+", "", surname).strip()
    given = re.sub(r"[\W\d_]+", "", given)
    return f"{surname}|{given[0]}" if surname and given and surname not in PLACEHOLDERS else None


def _same_digit(digits: str) -> bool:
    return len(set(digits)) <= 1


def doi_key(value: str | None) -> str | None:
    found = re.search(r"10\.(\d{4,9})/(\S+)", value.casefold()) if value else None
    if not found:
        return None
    suffix = found[2].rstrip(".,;:)]}>\"'/")
    return None if suffix in PLACEHOLDERS or _same_digit(found[1]) and found[1][0] == "0" else f"10.{found[1]}/{suffix}"


def pmid_key(value: str | None) -> str | None:
    found = re.search(r"\d{1,12}", value) if value else None
    digits = found[0].lstrip("0") if found else ""
    return None if len(digits) < 2 or len(digits) > 3 and _same_digit(digits) or digits == "12345678" else digits


def arxiv_key(value: str | None) -> str | None:
    found = re.search(r"(\d{4}\.\d{4,7}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?!\d)", value.casefold()) if value else None
    return None if not found or _same_digit(re.sub(r"\D", "", found[1])) else found[1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tie_keys(doi: pd.Series, pmid: pd.Series, arxiv: pd.Series, authors: pd.Series) -> pd.Series:
    """All keys by which a paper is tied to others."""
    rows = []
    for d, p, a, names in zip(doi, pmid, arxiv, authors, strict=True):
        keys = {f"{kind}:{k}" for kind, k in (("doi", doi_key(d)), ("pmid", pmid_key(p)), ("arxiv", arxiv_key(a))) if k}
        keys |= {f"author:{k}" for n in (names if names is not None else ()) if (k := author_key(n))}
        rows.append(sorted(keys))
    return pd.Series(rows)


def components(nodes: DataFrame, ties: DataFrame) -> DataFrame:
    """`node` and `root`, the least node of its component, for every row of `nodes` (`node`).

    `ties` has (`node`, `key`): nodes with a key in common are tied. A key with many nodes becomes a star around its
    least node, so edges are as many as ties. Rounds of hooking and shortcutting over the parent table: every root takes
    the least root among its neighbours as parent, parents are replaced by their parents until nothing moves, and the
    edges are rewritten to roots, which drops those inside a tree. Every round ends in the checkpoint folder. Null nodes
    and keys tie nothing; a node without ties is its own root.
    """
    least = ties.where(F.col("key").isNotNull() & F.col("node").isNotNull()).groupBy("key").agg(F.min("node").alias("v"), F.count_distinct("node").alias("n")).where("n > 1")
    edges = staged(ties.join(least, "key").select(F.col("node").alias("u"), "v").where("u <> v").distinct())
    parents = nodes.where(F.col("node").isNotNull()).select("node", F.col("node").alias("root")).distinct()
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
        moved = True
        while moved:  # shortcut: parent of the parent
            jump = hooked.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hooked = staged(hooked.join(jump, "p", "left").select("u", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")))
            moved = not hooked.where("moved").isEmpty()
            hooked = hooked.drop("moved")
        at = hooked.select(F.col("u").alias("root"), F.col("p").alias("to"))
        parents = staged(parents.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = hooked.select("u", F.col("p").alias("pu")), hooked.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = staged(edges.join(left, "u").join(right, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct())
    return parents


def tied_papers(metadata: DataFrame) -> DataFrame:
    """`node` (a doc_id in its one spelling) and `root`, the group it belongs to."""
    keyed = metadata.select(doc_key(F.col("doc_id")).alias("node"), tie_keys("doi", "pmid", "arxiv_id", "authors").alias("keys")).where(F.col("node").isNotNull())
    ties = staged(keyed.select("node", F.explode_outer("keys").alias("key")).distinct())
    return components(ties.select("node"), ties)


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """`root` and `split` for groups (`root`, `n` records): totals as close to the shares as whole groups allow.

    Only the histogram of sizes goes to the driver: at most sqrt(2 N) rows for N records. There a bitset over totals,
    with every size as often as there are groups of it, gives how many groups of each size make the smallest share, then
    the next; what remains is the largest. Which groups of a size are taken is decided by a seeded hash, ranked without
    gathering a frequent size in one task. Groups without records go by hash to a split, in the shares' proportions.
    """
    hist = {int(r["n"]): int(r["groups"]) for r in groups.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()}
    total = sum(n * k for n, k in hist.items())
    order = sorted(shares, key=lambda s: (shares[s], s))
    quotas: dict[int, list[tuple[int, str]]] = {n: [] for n in hist}
    left = dict(hist)
    for name in order[:-1]:
        for n, k in closest_subset(left, round(total * shares[name])).items():
            quotas[n].append((k, name))
            left[n] -= k
    rows = []
    for n in hist:
        at = 0
        for k, name in [*quotas[n], (left[n], order[-1])]:
            rows.append((n, at, at + k, name))
            at += k
    spark = groups.sparkSession
    plan = spark.createDataFrame(rows, "size bigint, low bigint, high bigint, split string")  # sqrt(2 N) sizes, each with at most one row a split
    spread = F.concat_ws(":", F.col("root"), F.lit(str(seed)))
    ranked = rank_within(groups.where("n > 0"), "n", [spread, F.col("root")], spread, "rank")
    filled = ranked.join(plan, (F.col("n") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("root", "n", "split")
    point, at, cut = F.pmod(F.xxhash64(spread), F.lit(1_000_000)) / F.lit(1_000_000.0), 0.0, F.lit(order[-1])
    for name in order[:-1]:
        cut = F.when((point >= at) & (point < at + shares[name]), name).otherwise(cut)
        at += shares[name]
    return filled.unionByName(groups.where("n = 0").select("root", "n", cut.alias("split")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa_release(spark, sf_dir, ["id", "doc_id", "file_name", "split"])
    return rows.select("id", doc_key(F.col("doc_id"), F.col("file_name")).alias("node"), split_name(F.col("split")).alias("split"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_ids of doc_metadata whose group has records in more than one split."""
    metadata = table(spark, sf_dir, "doc_metadata")
    roots = tied_papers(metadata)
    seen = _records(spark, sf_dir).where(F.col("split").isNotNull() & F.col("node").isNotNull()).select("node", "split").distinct()
    torn = seen.join(roots, "node").groupBy("root").agg(F.count_distinct("split").alias("k")).where("k > 1").select("root")
    spelled = metadata.select("doc_id", doc_key(F.col("doc_id")).alias("node")).where(F.col("node").isNotNull()).distinct()
    return spelled.join(roots, "node").join(torn, "root").select("doc_id").distinct()


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every doc_id (in its one spelling) of doc_metadata and qa_release."""
    records = _records(spark, sf_dir).where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("records"))
    roots = tied_papers(table(spark, sf_dir, "doc_metadata"))
    every = roots.join(records, "node", "full").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("records", F.lit(0)).alias("records"))
    every = staged(every)
    groups = every.groupBy("root").agg(F.sum("records").alias("n"))
    shares = {r["split"]: float(r["share"]) for r in table(spark, sf_dir, "split_targets").where("split IS NOT NULL AND share > 0").collect()}  # three rows, fixed
    chosen = assign_splits(groups, shares).select("root", "split")
    return every.join(chosen, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), "records", "split")


def p5_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, documents and groups of each split with its share."""
    got = p5_splits(spark, sf_dir)
    by = got.groupBy("split").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("documents"), F.count_distinct("group_id").alias("groups"))
    return by.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1))))  # one row a split
