import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from qaloom.functions import metadata as md
from qaloom.functions import text as tx
from qaloom.functions.hashing import md5_mod
from qaloom.operators import agreement, annotate, classify, dedup, evidence, generation, quality, release, retrieval, splitting, statistics
from qaloom.operators.rows import latest_rows, rank_within
from qaloom.sources import readers, writers


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_md5_mod_is_that_of_the_whole_number(spark):
    ids = [f"doc_{i}" for i in range(300)] + ["", "é"]
    got = rows(spark.createDataFrame([(i,) for i in ids], "t string").select("t", md5_mod(F.col("t"), 100), md5_mod(F.col("t"), 1000)))
    for t, a, b in got:
        n = int(hashlib.md5(t.encode()).hexdigest(), 16)
        assert (a, b) == (n % 100, n % 1000)


def test_document_splits(spark):
    with pytest.raises(ValueError):
        splitting.SplitConfig(0.5, 0.5, 0.5)
    df = spark.createDataFrame([(f"doc_{i}",) for i in range(5000)], "doc_id string")
    by = dict(rows(df.select(splitting.document_split(F.col("doc_id")).alias("s")).groupBy("s").count()))
    assert abs(by["train"] / 5000 - 0.85) < 0.02 and abs(by["val"] / 5000 - 0.10) < 0.02 and abs(by["test"] / 5000 - 0.05) < 0.02
    other = splitting.SplitConfig(seed=7)
    moved = df.where(splitting.document_split(F.col("doc_id")) != splitting.document_split(F.col("doc_id"), other)).count()
    assert moved > 5000 * 0.15


def test_split_statistics_and_leaks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val"), ("c", "test"), ("c", "train"), (None, "val")], "doc_id string, split string")
    got = {r["split"]: (r["documents"], r["pairs"]) for r in splitting.split_statistics(df).collect()}
    assert got["train"] == (2, 3) and got["total"][1] == 6
    assert rows(splitting.leaking_documents(df)) == [("c", "test,train")]
    assert splitting.leaking_documents(df.limit(0)).count() == 0


def test_latest_and_ranks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "w")], "id string, o int, v string")
    assert sorted(rows(latest_rows(df, "id", "o", ["id", "v"]))) == [("a", "y"), ("b", "z")]
    big = spark.range(500).withColumn("k", F.when(F.col("id") < 400, 1).otherwise(2))
    got = rank_within(big, "k", [F.col("id")], F.col("id"), "r", buckets=7).groupBy("k").agg(F.count_distinct("r"), F.min("r"), F.max("r"))
    assert sorted(rows(got)) == [(1, 400, 0, 399), (2, 100, 0, 99)]
    assert rank_within(big.limit(0), "k", [F.col("id")], F.col("id"), "r").count() == 0


QUESTIONS = ["", None, "what?", "What is this?", "How does the long gradient of the column change the peak width at 40 °C?", "Tell me about it", 'What is the "ion" here?', "x" * 600]
ANSWERS = ["", None, "short", "It changes the width of the peak.", "and so on", "The gradient changes... ", "a b c etc.", "y" * 2500]


def test_quality_against_a_plain_reading(spark):
    data = [(i, q, a, "The gradient changes the width of the peak by a lot of percent, see below.") for i, (q, a) in enumerate((q, a) for q in QUESTIONS for a in ANSWERS)]
    got = {r["id"]: r for r in quality.quality_metrics(spark.createDataFrame(data, "id int, question string, answer string, context string")).collect()}
    for i, q, a, c in data:
        q, a = q or "", a or ""
        aw, cw = set(a.lower().split()), set(c.lower().split())
        ov = len(aw & cw) / len(aw) if aw else 0.0
        r = got[i]
        assert r["answer_context_overlap"] == pytest.approx(ov)
        assert ("question_too_short" in r["filter_reasons"]) == (len(q) < 15)
        assert ("answer_too_long" in r["filter_reasons"]) == (len(a) > 2000)
        assert 0 <= r["quality_score"] <= 1
        assert r["should_keep"] == (not set(r["filter_reasons"]) - {"low_answer_context_overlap", "excessive_answer_context_overlap", "low_question_specificity"})
    assert quality.quality_metrics(spark.createDataFrame([], "question string, answer string, context string")).count() == 0


def test_classification(spark):
    cases = {
        "What is the difference between A and B?": "definition", "How many ions were seen?": "numeric", "Why did it fall?": "causal", "How is it performed in the lab?": "method",
        "Which column was used?": "factual", "": "unknown", "Is it so?": "unknown", "Compare A versus B": "comparison",
    }
    got = {r["question"]: r for r in classify.classify(spark.createDataFrame([(q,) for q in cases], "question string")).collect()}
    assert got[""]["question_type_confidence"] == 0.0 and got["Is it so?"]["question_type_confidence"] == 0.5
    for q in ("", "Is it so?", "Compare A versus B", "Why did it fall?"):
        assert got[q]["question_type"] == cases[q]
    assert got["What is the difference between A and B?"]["question_type"] in ("comparison", "definition")
    assert got["Compare A versus B"]["question_type_confidence"] == 0.8


def test_text_functions(spark):
    assert one(spark, tx.clean_answer(F.lit("See [1], Fig. 2 and https://x.org a@b.org doi:10.1/x end"))) == "See , and end"
    long = "word " * 200
    assert len(one(spark, tx.clean_answer(F.lit(long)))) <= 512 and one(spark, tx.clean_question(F.lit(long))).endswith("?")
    assert one(spark, tx.clean_question(F.lit("a" * 300))) == "a" * 256 + "?"
    assert one(spark, tx.squeeze(F.lit(" a  b c "))) == "a b c"
    text = "First sentence. " * 200
    cut = one(spark, tx.truncate_context(F.lit(text)))
    assert cut.endswith(".") and 768 < len(cut) <= 1536
    assert one(spark, tx.ngrams(F.split(F.lit("a b c a b"), " "), 2)) == ["a b", "b c", "c a"]
    assert one(spark, tx.words(F.lit(None).cast("string"))) == []


def test_metadata(spark):
    t = F.lit("BMC Bioinformatics (1850) then © 2019 doi:10.1234/abc. PMID: 1234567 arXiv:2101.12345v2")
    got = spark.range(1).select(*[c.alias(k) for k, c in md.metadata_columns(t).items()]).first()
    assert (got["doi"], got["pmid"], got["arxiv_id"], got["year"], got["venue"]) == ("10.1234/abc", "1234567", "2101.12345v2", 2019, "Bioinformatics")
    far = "x" * 5000 + " doi:10.9999/end"
    assert one(spark, md.doi_of(F.lit(far))) == "10.9999/end"
    assert one(spark, md.year_of(F.lit("in 2001, 2003 and 2003"))) == 2003
    assert one(spark, md.license_of(F.lit("text"), F.lit("PLOS ONE"), F.lit(None).cast("string"))) == "open_access"


def test_first_wins_is_no_component(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node int")
    links = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 5)], "a int, b int")
    got = dict(rows(dedup.first_wins(nodes, links)))
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(20)) for _ in range(40)] for _ in range(12)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for k in (1, 2, 3):
            c = list(b)
            for _ in range(k - 1):
                c[rng.randrange(len(c))] = "zz"
            texts.append(" ".join(c))
    texts += ["", "one two", "one two", None]
    pairs, classes = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "node int, text string"))
    cls = dict(rows(classes))
    assert len(cls) == len(texts)

    def sh(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4))

    sets = {i: sh(t) for i, t in enumerate(texts)}
    heads = sorted({cls[i] for i in sets if sets[i]})
    want = {(a, b) for a in heads for b in heads if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(a, b) for a, b, _ in rows(pairs)} == want
    for i in sets:
        for j in sets:
            if sets[i] and sets[i] == sets[j]:
                assert cls[i] == cls[j]


def test_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 40))) for _ in range(30)})
    for t in list(texts):
        k = rng.randrange(len(t))
        texts.append(t[:k] + "x" + t[k + 1 :])
    texts = sorted(set(texts))
    got = {(a, b) for a, b, _ in rows(dedup.fuzzy_pairs(spark.createDataFrame(list(enumerate(texts)), "node int, text string"), 90.0))}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if dedup.indel_ratio(texts[i], texts[j]) >= 90.0}
    assert got == want and want
    kept = dict(rows(dedup.fuzzy_dedup(spark.createDataFrame([("1", "What is it?"), ("2", " what  IS it?"), ("3", None), ("4", None)], "id string, question string"))))
    assert kept == {"1": True, "2": None, "3": True, "4": True} or kept == {"1": True, "2": False, "3": True, "4": True}


def test_bm25_golden(spark):
    topics = [
        ("What ion source was used?", "Electrospray ionization was used as the ion source."), ("How were peptides separated?", "Peptides were separated by reversed phase chromatography."),
        ("Which analyzer measured masses?", "An orbitrap analyzer measured the masses."), ("What software searched spectra?", "Spectra were searched with a database engine."), ("Why was trypsin added?", "Trypsin was added to digest proteins."),
    ]
    data = [(f"fixture_{i}", *topics[i % 5]) for i in range(8)]
    df = spark.createDataFrame(data, "id string, q string, a string")
    q, c = df.select(F.col("id").alias("qid"), F.col("q").alias("text")), df.select(F.col("id").alias("cid"), F.col("a").alias("text"))
    ranked = retrieval.top_k(retrieval.bm25_scores(q, c), 10)
    m = retrieval.mean_metrics(retrieval.per_query_metrics(q, ranked, df.select(F.col("id").alias("qid"), F.col("id").alias("cid")))).first()
    # five topics over eight records: three pairs of equal answers, in which the first listed ranks first
    assert m["recall_1"] == 0.625 and m["recall_5"] == 1.0 and m["recall_10"] == 1.0
    assert m["mrr"] == pytest.approx(0.8125) and m["ndcg_10"] == pytest.approx(0.8615986575892967)


def test_best_of_each_part_are_the_best_of_all(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 12
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    q = spark.createDataFrame([(f"q{i:02d}", text(rng.randint(1, 8))) for i in range(40)] + [("q98", "unheard"), ("q99", None)], "qid string, text string")
    c = spark.createDataFrame([(f"c{i:04d}", text(rng.randint(0, 9))) for i in range(2500)], "cid string, text string").repartition(3)
    for corpus in (c, c.where("cid < 'c0005'")):
        want, got = (retrieval.top_k(x, 10).selectExpr("qid", "cid", "rank", "round(score, 7) AS score") for x in (retrieval.bm25_scores(q, corpus), retrieval.bm25_best(q, corpus, 10, block=16)))
        assert set(rows(got)) == set(rows(want))
    assert retrieval.bm25_best(q, c.where("false"), 10).count() == 0 and retrieval.bm25_best(q.where("false"), c, 10).count() == 0


def test_retrieval_edges(spark):
    q = spark.createDataFrame([("q1", "zzz"), ("q2", "a"), ("q3", "")], "qid string, text string")
    c = spark.createDataFrame([("c1", "a b"), ("c2", "b"), ("c3", "c c")], "cid string, text string")
    rels = spark.createDataFrame([("q2", "c1"), ("q2", "c2")], "qid string, cid string")
    per = {r["qid"]: r for r in retrieval.per_query_metrics(q, retrieval.top_k(retrieval.bm25_scores(q, c), 10), rels).collect()}
    assert per["q1"]["mrr"] == 0 and per["q3"]["recall_5"] == 0 and per["q2"]["recall_5"] == 0.5 and per["q2"]["map_5"] == 0.5
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "cid int, embedding array<double>")
    got = retrieval.top_k(retrieval.dense_scores(v.select(F.col("cid").alias("qid"), "embedding").where("qid = 1"), v, 2), 1)
    assert rows(got.select("qid", "cid", "rank")) == [(1, 1, 1)]


def test_agreement(spark):
    a = spark.createDataFrame([("1", "Yes"), ("2", "No"), ("3", "Yes"), ("4", ""), ("5", "No"), ("9", "Yes")], "id string, label string")
    b = spark.createDataFrame([("1", "Yes"), ("2", "No"), ("3", "Yes"), ("4", "Yes"), ("5", " No ")], "id string, label string")
    k = agreement.cohen_kappa(agreement.aligned(a, b, "id", "label")).first()
    assert (k["n"], k["agreement"], k["kappa"]) == (4, 1.0, 1.0)
    same = spark.createDataFrame([("Yes", "Yes")] * 3, "a string, b string")
    assert agreement.cohen_kappa(same).first()["kappa"] == 1.0
    assert agreement.cohen_kappa(same.limit(0)).count() == 0
    assert {r["id"]: r["final"] for r in agreement.adjudicated(a, b, "id", "label").collect()} == {"1": "Yes", "2": "No", "3": "Yes", "4": "", "5": "No", "9": ""}
    full = spark.createDataFrame([(i, l) for i in range(4) for l in ("a", "a", "a" if i else "b")], "item int, label string")
    assert agreement.fleiss_kappa(full, "item", "label", 3).first()["items"] == 4
    s = agreement.summary(spark.createDataFrame([("Yes",), ("partially no",), ("none",), ("",), (None,)], "l string"), "l").first()
    assert (s["n"], s["yes"], s["partial"], s["no"]) == (3, 1, 1, 1)


def test_generation_metrics(spark):
    assert one(spark, generation.token_scores(F.lit(""), F.lit(""))["f1"]) == 1.0
    assert one(spark, generation.token_scores(F.lit("a b"), F.lit("b c"))["f1"]) == 0.5
    assert one(spark, generation.rouge_n(F.lit("the cat the"), F.lit("the the dog"), 1)) == pytest.approx(2 * 2 / 6)
    assert generation.stem("relational") == "relat" and generation.stem("hopping") == "hop" and generation.stem("ponies") == "poni" and generation.stem("agreed") == "agre"
    assert generation.rouge_l_score("the cats sat", "the cat sat down") == pytest.approx(2 * 3 / 7)
    models = spark.createDataFrame([("a", 0, 0.5, 9.0), ("b", 1, 0.7, 12.0), ("c", 2, 0.5, 8.0)], "model_name string, position int, f1 double, perplexity double")
    assert {r["model_name"]: r["overall_rank"] for r in generation.rank_models(models, {"f1": 2.0, "perplexity": 1.0}).collect()} == {"b": 1, "a": 2, "c": 3}


def test_evidence():
    context = "Alpha was measured here. The column was heated to forty degrees Celsius for an hour. Then it cooled."
    got = evidence.spans_of(context, "the column was heated to forty degrees")
    assert got and got[0][2] == "The column was heated to forty degrees Celsius for an hour." and got[0][0] == 24
    assert evidence.spans_of("", "x") == [] and evidence.spans_of("no stop at all in this long context text", "in this long context text") == [(0, 40, "no stop at all in this long context text")]


def test_release(spark):
    key = "sk-" + "a" * 25
    df = spark.createDataFrame([("1", f"x {key}", [(1, 2, f"in {key}")], {"k": key}, None)], "id string, answer string, spans array<struct<start:int,end:int,text:string>>, m map<string,string>, n string")
    r = release.redact_all(df).first()
    assert release.MASK in r["answer"] and release.MASK in r["spans"][0]["text"] and r["m"]["k"] == release.MASK and r["n"] is None
    titles = ["1 Department of Chemistry", "Short", "A fine study of ions | Volume", "Smith J., Miller A., Brown K., and others", None, "Proteome analysis PLOS ONE | page 3"]
    got = {t: (b, n) for t, b, n in rows(spark.createDataFrame([(t,) for t in titles], "t string").select("t", release.suspicious_title(F.col("t")), release.normalize_title(F.col("t"))))}
    assert got[titles[0]][0] and got["Short"][0] and got[None][0] and got[titles[3]][0] and not got[titles[5]][0] and got[titles[5]][1] == "Proteome analysis"


def test_readers(spark, tmp_path):
    f = tmp_path / "in" / "deep" / "a.jsonl"
    f.parent.mkdir(parents=True)
    f.write_text('{"id":"1","question":"q"}\n\n{broken\n{"id":"2","usage":{"total_tokens":3}}\n', encoding="utf-8")
    got = readers.read_jsonl(spark, [str(tmp_path / "in"), str(tmp_path / "none")])
    assert sorted(r["id"] for r in got.collect()) == ["1", "2"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "in"), on_error="fail").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([(1, "First line\n  second.\n\n\nNext\n"), (2, ""), (3, None), (4, "\n\n")], "doc int, text string")
    assert sorted(rows(readers.explode_paragraphs(df))) == [(1, 1, 1, "First line second."), (1, 2, 5, "Next.")]
    bib = '@article{k1, title = {A {Nested} title}, year = 2020, author = "X and Y"}\n@misc{k2, note={n}}'
    entries = readers.parse_bibtex_text(bib)
    assert [(e[0], e[1]) for e in entries] == [("article", "k1"), ("misc", "k2")] and entries[0][2] == {"title": "A Nested title", "year": "2020", "author": "X and Y"}
    log = ["Training LLM: m1", "{'loss': 1.5, 'epoch': 0.1}", " 10%|#| 100/1000 [00:01<", "{'loss': 1.0}", "Training LLM: m2", "{'loss': 2.0}"]
    steps = readers.parse_training_log(spark.createDataFrame([("l", i, x) for i, x in enumerate(log)], "log string, line_no int, value string")).where("metric = 'loss'")
    assert sorted(rows(steps.select("model", "step", "value"))) == [("m1", 50, 1.5), ("m1", 100, 1.0), ("m2", 500, 2.0)]
    tei = '<TEI xmlns="http://x"><abstract><p>Ab</p></abstract><body><div><head>Conclusion</head><p>End</p></div></body></TEI>'
    t = readers.read_tei(spark.createDataFrame([(tei,)], "xml string")).first()
    assert (t["abstract"], t["conclusions"]) == ("Ab", "End")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "train"), ("2", "é", "val")], "id string, x string, split string")
    writers.write_jsonl(df, str(tmp_path / "o"), partition=["split"])
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").rglob("*.json"))
    assert '"x":null' in text and "é" in text
    pages = spark.createDataFrame([("d", 1, "one", 0.9), ("d", 3, "three", 0.5)], "doc_id string, page int, text string, quality double")
    md_text = writers.markdown_pages(pages, spark.createDataFrame([("d", 3)], "doc_id string, pages int")).first()["markdown"]
    assert md_text.index("Page 1") < md_text.index("Page 2\n\n*[page not extracted]*") < md_text.index("Page 3 (quality 0.50)")
    assert writers.markdown_table(spark.createDataFrame([(1, 0.5)], "a int, b double")).endswith("| 1 | 0.5000 |")


def test_stream_keeps_first_questions(spark, tmp_path):
    from qaloom.streaming.consolidate import consolidate_stream

    src, out, chk = tmp_path / "src", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    rec = lambda i, q: json.dumps({"id": i, "file_name": "f", "question": q, "answer": "A long enough answer to keep."})
    (src / "1.json").write_text("\n".join([rec("1", "What was the flow rate used?"), rec("2", "what was the  flow rate used?"), rec("3", "short")]))
    consolidate_stream(spark, str(src), str(out), str(chk)).awaitTermination()
    (src / "2.json").write_text("\n".join([rec("4", "WHAT WAS THE FLOW RATE USED?"), rec("5", "Which column was used there?")]))
    consolidate_stream(spark, str(src), str(out), str(chk)).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).collect()) == ["1", "5"]


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 20), (2.0, 20), (3.0, 5), (None, 1)], "a double, b int")
    s = statistics.spearman(df, "a", "b").first()
    assert s["n"] == 4 and -1 <= s["rho"] <= 1
    sample = statistics.stratified_sample(spark.createDataFrame([(str(i), "ab"[i % 2] if i < 9 else None) for i in range(12)], "id string, t string"), "t", 7)
    assert sample.count() == 7 and sample.select("annotation_id").distinct().count() == 7
    a = annotate.annotate(spark.createDataFrame([("What is the mass of ion 5?", "The mass is 5 Da in all samples.", "The mass is 5 Da in all samples of the second series.", 0.9), ("", "", "", None)], "question string, answer string, context string, quality_score double")).collect()
    assert a[0]["answer_correct"] == "Yes" and a[1]["answer_correct"] in ("No", "Partial") and a[1]["evidence_quality"] == "Missing"
