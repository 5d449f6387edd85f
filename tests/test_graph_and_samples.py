import itertools
import random

from pyspark.sql import functions as F

from qaloom.functions import text as tx
from qaloom.operators import dedup, evidence, release, runs, statistics
from qaloom.operators.graph import link_components
from qaloom.operators.rows import latest_once, latest_rows, positions
from qaloom.sources import readers, writers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(60)]
    root = {n: n for n in range(200)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(rows(link_components(spark.range(200).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {n: find(n) for n in range(200)}
    assert dict(rows(link_components(spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([], "a bigint, b bigint")))) == {0: 0, 1: 1, 2: 2}


def _greedy(n, links):
    kept = {}
    for b in range(n):
        kept[b] = not any(kept[a] for a, x in links if x == b)
    return kept


def test_first_wins_against_a_scan(spark):
    rng = random.Random(4)
    links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(60, 119)}
    nodes, table = spark.range(120).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(links), "a bigint, b bigint")
    want = _greedy(120, links)
    assert dict(rows(dedup.first_wins(nodes, table))) == want
    assert dict(rows(dedup.first_wins(nodes.where("node < 60"), table.where("b < 60"), grouped=3))) == {n: k for n, k in want.items() if n < 60}


def test_lsh_finds_near_texts(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:60], "other", *b[61:]]) for b in base] + [" ".join(b) for b in base[:5]] + ["", None, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    kept = dict(rows(dedup.lsh_dedup(df)))
    assert all(kept[i] for i in range(40)) and all(kept[i] for i in (85, 86, 87)) and not any(kept[i] for i in range(80, 85))
    assert sum(not kept[i] for i in range(40, 80)) >= 36  # similar by .95: a recall of .9 and more
    exact = dict(rows(dedup.near_dedup(df, size=3)))
    assert not any(exact[i] for i in range(40, 85))


def _questions(n):
    rng = random.Random(12)
    kinds = ("which volume of {} was loaded onto the column", "how long was {} kept in the cold before it was run", "why did {} elute late")
    return sorted({rng.choice(kinds).format("".join(rng.choice("abc") for _ in range(rng.randrange(4, 8)))) for _ in range(n)}, key=lambda q: rng.random())


def _first_wins(texts, window=None):
    kept = {}
    for i, t in enumerate(texts):
        kept[i] = not any(kept[j] and dedup.indel_ratio(texts[j], t) >= 90.0 for j in range(max(0, i - (window or i)), i))
    return kept


def test_fuzzy_removal_of_templates_by_leaders(spark):
    texts = _questions(260)
    df = spark.createDataFrame(list(enumerate(texts)), "node int, text string")
    want = _first_wins(texts)
    kept, rest = dedup.fuzzy_leaders(df, 90.0, block=20)
    assert all(want[n] for (n,) in rows(kept)) and kept.count() > 5
    # most of these questions are near each other: leaders decide them without their pairs
    assert dedup.fuzzy_pairs(rest).count() * 3 < dedup.fuzzy_pairs(df).count()
    for block in (20, 4_096):
        assert dict(rows(dedup.fuzzy_dedup(df, "node", "text", block=block))) == want


def test_fuzzy_removal_inside_a_window_without_pairs(spark, monkeypatch):
    texts = _questions(260)
    df = spark.createDataFrame(list(enumerate(texts)), "node int, text string")
    monkeypatch.setattr(dedup, "fuzzy_pairs", None)  # there are too many at size
    for window in (1, 7, 30):
        assert dict(rows(dedup.fuzzy_dedup(df, "node", "text", window=window))) == _first_wins(texts, window)


def test_window_of_fuzzy_removal(spark):
    data = [("a", "what was measured in the first sample of honey"), ("b", "which column held the proteins of yeast"), ("c", "why was the flow rate lowered after an hour"), ("d", "what was measured in the first samples of honey")]
    df = spark.createDataFrame(data, "id string, question string")
    assert not dict(rows(dedup.fuzzy_dedup(df)))["d"] and not dict(rows(dedup.fuzzy_dedup(df, window=3)))["d"]
    assert dict(rows(dedup.fuzzy_dedup(df, window=2)))["d"]


def test_latest_deliveries_both_ways(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "x"), ("c", 1, "x"), ("c", None, "y"), (None, 1, "x")], "id string, at int, t string")
    want = sorted(rows(latest_rows(df, "id", "at", ["id", "at", "t"])))
    assert want == [("a", 2, "z"), ("b", None, "x"), ("c", 1, "x")]
    assert sorted(rows(latest_once(df, "id", "at", ["id", "at", "t"]))) == sorted(rows(latest_once(df, "id", "at", ["id", "at", "t"], broadcast_rows=0))) == want


def test_positions_count_over_ranges(spark):
    got = rows(positions(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1009).alias("k")), "k").orderBy("k"))
    assert [p for _, p in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_one_run_with_nearly_all_attempts(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 20 == 0, "small").otherwise("big").alias("run"), F.col("id").alias("at"), (F.col("id") % 3 == 0).alias("bad"))
    got = {r["at"]: (r["attempts"], round(r["failed_share"], 9), r["broken"]) for r in runs.breaks_circuit(df, "run", "at", F.col("bad"), most=0.33).collect()}
    for run in ("big", "small"):
        n = fails = 0
        for at in range(2000):
            if (at % 20 == 0) == (run == "small"):
                n, fails = n + 1, fails + (at % 3 == 0)
                assert got[at] == (n, round(fails / n, 9), n >= 10 and fails / n > 0.33)


def test_a_stratum_with_nearly_all_records(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 950, "a").when(F.col("id") < 998, "b").otherwise("c").alias("kind"))
    got = statistics.stratified_sample(df, "kind", 40).groupBy("stratum").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 14, "b": 13, "c": 2}


def test_one_document_with_nearly_all_records(spark):
    texts = spark.createDataFrame([("d", [f"p{i}" for i in range(5)]), ("e", [])], "doc_id string, paragraphs array<string>")
    records = spark.range(300).select(F.col("id"), F.lit("d").alias("document_hash"), F.lit(None).cast("string").alias("doc_id"), (F.col("id") % 7).cast("int").alias("paragraph_index"))
    records = records.unionByName(spark.createDataFrame([(900, None, "e", 0), (901, "f", "d", 0), (902, None, "d", None)], "id bigint, document_hash string, doc_id string, paragraph_index int"))
    got = {r["id"]: (r["context"], r["status"]) for r in release.reconstruct(records, texts).collect()}
    assert len(got) == 303 and all(got[i] == ((f"p{i % 7}", "found") if i % 7 < 5 else (None, "no_paragraph")) for i in range(300))
    assert got[900] == (None, "no_paragraph") and got[901] == (None, "no_document") and got[902] == (None, "no_paragraph")


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    html = "<html><head><title>t</title></head><body><h2>Head</h2><p>a &amp; <b>b</b><br/>c</p><ul><li>x</li></ul></body></html>"
    assert one(tx.html_to_text(F.lit(html))) == "Head\na & b\nc\nx" and one(tx.html_to_markdown(F.lit(html))) == "## Head\na & **b**\nc\n* x"
    assert one(tx.plain_latin(F.lit("Größe – Łódź naïve “x” 5 µm Ж"))) == 'Grosse - Lodz naive "x" 5 um ' and one(tx.plain_page(F.lit("kurz"))) == ""
    got = writers.without_empty(spark.createDataFrame([("", 0, [], "x", False, None)], "a string, b int, c array<string>, d string, e boolean, f double")).first()
    assert got.asDict() == {"a": None, "b": None, "c": None, "d": "x", "e": None, "f": None}
    assert readers.parse_bibtex_text("@article{k, title = {The {P}roteins of {{Y}}east}, year = 2001}") == [("article", "k", {"title": "The Proteins of Yeast", "year": "2001"})]
    text = "one\ntwo\n\n \n  three.  \r\n\r\nfour\nfive\n"
    got = rows(readers.explode_paragraphs(spark.createDataFrame([(text,), (None,), (" \n ",)], "text string")))
    assert got == [(1, 1, "one two."), (2, 5, "three."), (3, 7, "four five.")]


def test_metadata_comes_from_the_text_or_the_first_context(spark):
    records = spark.createDataFrame([("2", "d", "doi:10.1000/late"), ("1", "d", "doi:10.1000/first"), ("3", "e", "doi:10.1000/context"), ("4", None, "x")], "id string, doc_id string, context string")
    got = {r["doc_id"]: (r["origin"], r["doi"]) for r in evidence.resolved_metadata(records, spark.createDataFrame([("e", "doi:10.1000/text")], "doc_id string, text string")).collect()}
    assert got == {"d": ("context", "10.1000/first"), "e": ("text", "10.1000/text")}


def test_validation_and_run_statistics(spark):
    lines = spark.createDataFrame([('{"question": 1, "answer": 2}',), ("{broken",), ("  ",), ('{"question": 1}',), (None,)], "value string")
    assert rows(runs.line_validation(lines)) == [(3, 1)]
    empty = runs.extraction_statistics(spark.createDataFrame([], "success boolean, method string, pages int, seconds double")).first()
    assert empty["files"] == 0 and empty["seconds_per_file"] == 0
    assert len(list(itertools.chain(rows(statistics.extremes(spark.createDataFrame([("a", 1.0), ("b", None)], "n string, s double"), "s", "n"))))) == 2
