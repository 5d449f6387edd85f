import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import abuse, capping, chunking, grouping, mixing, overlap, packing, pair_defects, scan_noise, tokens, truncation
from qaloom.llm.common import doc_key, split_name, strip
from qaloom.llm.label_model import fit_label_model
from qaloom.llm.subset_sum import closest_subset


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- shared -----------------------------------------------------------------------------------------------------------


def test_keys_and_names(spark):
    assert one(spark, doc_key(F.lit(" PMC1.PDF "), F.lit("x.txt"))) == "pmc1"
    assert one(spark, doc_key(F.lit(None).cast("string"), F.lit("a/b/S1_main.txt"))) == "s1_main"
    assert one(spark, doc_key(F.lit(" "), F.lit(None).cast("string"))) is None
    assert [one(spark, split_name(F.lit(s))) for s in ("Dev", " TRAIN", "validation", "test ", "other")] == ["val", "train", "val", "test", None]
    assert one(spark, strip(F.lit("​\xa0 a b\n　"))) == "a b"


# --- 2 ----------------------------------------------------------------------------------------------------------------


def _brute_cap(data, cap):
    keep = set()
    by = {}
    for i, c, s in data:
        by.setdefault(c, []).append((-(s if s is not None and s == s and 0 <= s <= 1 else -1), i))
    for c, v in by.items():
        keep |= {i for _, i in (sorted(v) if c is None else sorted(v)[:cap])}
    return keep


def test_capping_against_brute_force(spark):
    rng = random.Random(3)
    data = [(f"{i:04d}", rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, float("nan"), -1.0, 5.0, 0.5, 0.5, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(data, "id string, contributor string, score double").withColumn("kept", F.lit("clash"))
    for cap in (1, 7, 1000):
        got = capping.cap_contributors(df, F.col("contributor"), F.col("id"), F.col("score"), max_records=cap, salts=5)
        assert {r["id"] for r in got.where("kept").collect()} == _brute_cap(data, cap)
        assert got.count() == len(data)
    empty = capping.cap_contributors(df.limit(0), F.col("contributor"), F.col("id"), F.col("score"), max_records=3)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        capping.cap_contributors(df, F.col("contributor"), F.col("id"), F.col("score"))


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5])
def test_share_cap(spark, share):
    sizes = [100, 40, 40, 10, 5, 5, 3, 1, 1]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "c int, n bigint")
    cap = capping.cap_of_share(df, share).first()["cap"]
    fits = [c for c in range(1, 101) if c <= share * sum(min(n, c) for n in sizes)]
    assert cap == max(fits, default=1)


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_author_and_identifier_keys():
    same = ["Müller, J.", "J. Muller", "MULLER J", "Jan K. Müller", "Müller, Jan K."]
    assert {grouping.author_key(a) for a in same} == {"muller|j"}
    assert [grouping.author_key(a) for a in (None, "", "et al.", "Unknown", "Anonymous", "N/A")] == [None] * 6
    assert grouping.doi_key(" DOI 10.1234/AbC.") == grouping.doi_key("https://doi.org/10.1234/abc") == "10.1234/abc"
    assert grouping.doi_key("10.0000/unknown") is None and grouping.doi_key("n/a") is None
    assert grouping.pmid_key("PMID: 023456789") == grouping.pmid_key("23456789") == "23456789"
    assert grouping.pmid_key("00000000") is None
    assert grouping.arxiv_key("arXiv:2101.01234v3") == grouping.arxiv_key("2101.01234") == "2101.01234" and grouping.arxiv_key("-") is None


def test_components_against_union_find(spark):
    rng = random.Random(5)
    ties = [(f"n{rng.randrange(300):03d}", f"k{rng.randrange(260)}") for _ in range(420)] + [(f"n{i:03d}", "chain%d" % (i // 2)) for i in range(100, 160)] + [(f"n{i + 1:03d}", "chain%d" % (i // 2)) for i in range(100, 160)]
    ties += [("n000", None), (None, "k1")]
    nodes = [f"n{i:03d}" for i in range(300)]
    got = dict(rows(grouping.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(ties, "node string, key string"))))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for n, k in ties:
        if n and k:
            by.setdefault(k, []).append(n)
    for v in by.values():
        for x in v[1:]:
            a, b = sorted((find(v[0]), find(x)))
            parent[b] = a
    assert got == {n: find(n) for n in nodes}


def test_closest_subset_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        items = [s for s, n in counts.items() for _ in range(n)]
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        for target in (0, 1, 17, 50, 500):
            for at_most in (False, True):
                got = closest_subset(dict(counts), target, at_most)
                assert all(got[s] <= counts[s] for s in got)
                total = sum(s * n for s, n in got.items())
                want = min((x for x in sums if not at_most or x <= target), key=lambda x: (abs(x - target), x))
                assert abs(total - target) == abs(want - target) and (not at_most or total <= target)
    big = closest_subset({7: 100_000, 3: 50_000, 1: 10}, 600_001, max_bits=5000)
    assert sum(s * n for s, n in big.items()) == 600_001


@pytest.mark.parametrize("at_most", [False, True])
def test_nearly_whole_targets_are_hit(at_most):
    counts = dict.fromkeys(range(2000, 6000, 7), 3)
    total = 3 * sum(counts)
    for left in (2000, 2007 + 2014, 3 * 2000 + 5995):
        got = closest_subset(counts, total - left, at_most)
        assert sum(s * n for s, n in got.items()) == total - left and all(n <= 3 for n in got.values())
    assert sum(s * n for s, n in closest_subset(counts, total - 1, at_most).items()) == (total - 2000 if at_most else total)


def test_split_assignment_keeps_groups(spark):
    rng = random.Random(8)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(300)] + [0] * 20
    groups = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "root string, n bigint")
    got = grouping.assign_splits(groups, {"train": 0.85, "val": 0.10, "test": 0.05})
    total = sum(sizes)
    by = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert got.count() == len(sizes) and by["test"] == round(total * 0.05) and by["val"] == round(total * 0.10)
    again = grouping.assign_splits(groups.repartition(3), {"train": 0.85, "val": 0.10, "test": 0.05})
    assert sorted(rows(got)) == sorted(rows(again))


# --- 6 ----------------------------------------------------------------------------------------------------------------


def _prose(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 15))).capitalize() + rng.choice([". ", ". ", "? ", ".\n\n"]))
    return "".join(out).strip()


def test_pieces():
    rng, cfg = random.Random(9), chunking.ChunkConfig()
    texts = [_prose(rng, n) for n in (10, 1999, 2001, 9000, 40_000)] + ["x" * 7001, "a" * 2000, ("line\n" * 900).strip(), "é" * 2001 + " end"]
    for text in texts:
        parts = chunking.pieces(text, cfg)
        assert parts[0][0] == 0 and parts[-1][2] == len(text)
        assert all(0 < e - s <= cfg.limit for s, _, e, _ in parts)
        assert all(b[1] == a[2] and 0 <= b[1] - b[0] <= cfg.overlap for a, b in zip(parts, parts[1:], strict=False))
        assert "".join(text[o:e] for _, o, e, _ in parts) == text
        assert (len(parts) == 1) == (len(text) <= cfg.limit)
    kinds = [k for t in texts[3:5] for _, _, _, k in chunking.pieces(t, cfg)[:-1]]
    assert set(kinds) <= {"paragraph", "sentence", "line"}
    assert all(b[0] < b[1] for b in chunking.pieces(texts[4], cfg)[1:])


def test_edits_move_only_near_cuts():
    text = _prose(random.Random(10), 60_000)
    edited = text[:30_000] + "An inserted sentence stands here. " + text[30_000:]
    a = {text[o:e] for _, o, e, _ in chunking.pieces(text, chunking.ChunkConfig())}
    b = {edited[o:e] for _, o, e, _ in chunking.pieces(edited, chunking.ChunkConfig())}
    assert len(b - a) <= 6 and len(b) > 30


def test_chunk_edges(spark):
    df = spark.createDataFrame([("1", None, 0), ("2", "", 0), ("3", " \n ", 0), ("4", "short", 0), ("5", "w " * 3000, 0), ("5", "w " * 3000, 0)], "id string, t string, piece int")
    got = chunking.chunk(df, F.col("id"), F.col("t"))
    n = {k: v for k, v in rows(got.groupBy("id").count())}
    assert set(n) == {"4", "5"} and n["4"] == 1 and n["5"] % 2 == 0
    assert chunking.chunk(df.limit(0), F.col("id"), F.col("t")).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    data = []
    base = [([f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 9))], [f"c{rng.randrange(300)}" for _ in range(rng.randrange(8, 40))]) for _ in range(25)]
    for i in range(220):
        q, c = map(list, rng.choice(base))
        for w in (q, c):
            for _ in range(rng.randrange(0, max(1, len(w) // 3))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        if rng.random() < 0.2:
            c = c[: len(c) - 3]
        data.append((f"r{i:03d}", rng.choice(["train", "train", "val", "test", None]), (" ".join(q) + "?").upper() if rng.random() < 0.3 else " ".join(q), ", ".join(c)))
    data += [("x1", "train", None, "a b"), ("x2", "val", "", "a b"), ("x3", "val", "...", "!!!")]
    df = spark.createDataFrame(data, "id string, split string, question string, context string").select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("loaded_at"), "split", F.lit("s").alias("source"), "question", "context")
    pairs, members = overlap.overlaps(df, overlap.OverlapConfig(block_eval=3, block_train=5))
    ev, tr = members.where("split <> 'train'").select(F.col("uid").alias("e"), F.col("id").alias("a")), members.where("split = 'train'").select(F.col("uid").alias("t"), F.col("id").alias("b"))
    got = [tuple(sorted(r)) for r in rows(pairs.join(ev, "e").join(tr, "t").select("a", "b"))]
    import re
    from collections import Counter

    def bag(t):
        return Counter(re.findall(r"[^\W_]+", (t or "").lower()))

    def near(a, b):
        x, y = bag(a), bag(b)
        n = max(x.total(), y.total())
        return min(x.total(), y.total()) > 0 and (x & y).total() >= 0.75 * n

    want = {tuple(sorted((a[0], b[0]))) for a in data for b in data if a[1] in ("val", "test") and b[1] == "train" and near(a[2], b[2]) and near(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "id string, loaded_at timestamp_ntz, split string, source string, question string, context string")
    pairs, members = overlap.overlaps(df)
    assert pairs.count() == 0 and members.count() == 0


# --- 8 and 9 ----------------------------------------------------------------------------------------------------------


def _fewest(items, capacity):
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= items[k] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_dominance_keeps_the_best_filling():
    rng = random.Random(12)
    for _ in range(150):
        items = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = {s: items.count(s) for s in set(items)}
        fixed, rest = packing.reduce_by_dominance(counts, 20)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (_fewest(sorted(left, reverse=True), 20) if left else 0) == _fewest(items, 20)
        used = packing.plan(counts, 20)
        back = {}
        for pattern, times in used:
            assert sum(s * k for s, k in pattern) <= 20
            for s, k in pattern:
                back[s] = back.get(s, 0) + k * times
        assert back == counts


def test_packing_is_a_partition(spark):
    rng = random.Random(13)
    data = [(i, rng.choice([0, 1, 7, 64, 64, 64, 100, 130, rng.randrange(1, 300), None])) for i in range(700)]
    got = packing.pack(spark.createDataFrame(data, "doc_id bigint, tokens bigint"), 128).collect()
    load, pieces = {}, {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
    assert max(load.values()) <= 128 and sorted(load) == list(range(len(load)))
    for i, n in data:
        if not n:
            assert i not in pieces
        else:
            p = sorted(pieces[i])
            assert sum(t for _, t in p) == n and (len(p) == 1) == (n <= 128) and p[0][0] == 0
    assert len(load) <= 1.05 * -(-sum(n or 0 for _, n in data) // 128) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 128).count() == 0


def test_mixture(spark):
    rng = random.Random(14)
    data = [(i, s, rng.randrange(0, 60)) for i, s in enumerate(["big"] * 600 + ["mid"] * 150 + ["small"] * 30 + [None] * 5 + ["other"] * 9)]
    targets = {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.2, 4), "absent": (0.0001, 9)}
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint"), targets).collect()
    size = {}
    for r in got:
        assert 1 <= r["repeats"] <= targets[r["source"]][1]
        size[r["source"]] = size.get(r["source"], 0) + r["repeats"] * r["tokens"]
    total = sum(size.values())
    for s, (share, _) in targets.items():
        if s != "absent":
            assert abs(size[s] / total - share) < 0.003
    assert len({r["doc_id"] for r in got}) == len(got)
    again = mixing.mix(spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint").repartition(5), targets).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> é" * 50)], "doc_id bigint, text string")
    got = dict(rows(tokens.token_counts(df, ["doc_id"], F.col("text"))))
    enc = tokens.encoder(tokens.VOCABULARY)
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(enc.encode_ordinary("<|endoftext|> é" * 50))


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_page_numbers():
    def found(text):
        return [text.split("\n")[i] for i in scan_noise.page_number_lines(text.split("\n"))]

    assert found("Some text here\n- 12 -\nmore text") == ["- 12 -"]
    assert found("Text.\nPage 3 of 9") == ["Page 3 of 9"] and found("text\n| 180\ntext") == ["| 180"] and found("[12]\ntext") == ["[12]"]
    assert found("Charge\n1\n5\n1\nIntensity\n90.3\n3.0") == []
    assert found("it was\n467\nfound there") == ["467"] and found("a\nxxvii\nb") == ["xxvii"] and found("a\nmild\nb") == [] and found("1. First\n2. Second") == []


def test_scanned_paragraphs_come_out_as_written(spark):
    rng = random.Random(9)
    vocabulary = "samples honey measured column gradient protein fraction injection calibration recovery spectrum detector evaporated filtered concentration residue temperature laboratory extraction interference".split()
    fillers = "the of in with after before under for and during".split()
    clean, scanned = {}, []
    for i in range(300):
        words = [rng.choice(vocabulary if k % 2 else fillers) for k in range(60)]
        text = " ".join(words).capitalize() + "."
        clean[f"r{i:03d}"] = text
        if i % 3:
            scanned.append((f"r{i:03d}", text, "n"))
            continue
        lines, line = [], ""
        for w in text.split():
            if len(line) + len(w) > 58:
                cut = len(w) // 2
                if len(w) >= 10 and rng.random() < 0.5:  # divided at the line's end
                    lines.append(f"{line} {w[:cut]}-")
                    line = w[cut:]
                else:
                    lines.append(line)
                    line = w
            else:
                line = f"{line} {w}".strip()
        lines.append(line)
        if i % 2:
            lines[2] = lines[2].replace("m", "rn", 1)
        lines.insert(3, str(100 + i))
        lines.insert(3, "Journal of Residue Studies, vol. 7")
        scanned.append((f"r{i:03d}", "\n".join(lines), "n"))
    blocks = spark.createDataFrame([], "doc_id string, page int, y0 double, y1 double, text string")
    got = {k: (c, r) for k, c, r in rows(scan_noise.repaired(spark.createDataFrame(scanned, "id string, text string, node string"), blocks, spark.createDataFrame([], "node string, title string")))}
    noisy = {k for k, t, _ in scanned if "\n" in t}
    assert set(got) == noisy
    same = sum(got[k][1] == clean[k] for k in noisy)
    assert same >= 0.9 * len(noisy), [sorted(set(got[k][1].split()) ^ set(clean[k].split())) for k in sorted(noisy) if got[k][1] != clean[k]]


def test_repair():
    text = "The sam-\nples were kept in a time-\nof-flight instrument and\n\nJournal · Vol. 3\n\nwbich gave 5 ions.\n12"
    lines = text.split("\n")
    drop = {lines.index("Journal · Vol. 3"), lines.index("12")}
    got = scan_noise.repair(text, drop, {("sam", "ples")}, {"wbich": "which"})
    assert got.strip() == "The samples were kept in a time-of-flight instrument and which gave 5 ions."


def test_noise_end_to_end(spark):
    clean = "The samples of honey were measured within the hour while the column was heated and the injection volume remained."
    data = [(f"c{i:03d}", clean + f" Run {i}.", f"d{i}") for i in range(60)]
    data += [
        ("h1", "The samples were meas-\nured within the hour.", "d1"), ("h2", "The well-\nknown samples were measured.", "d2"), ("m1", "The sarnples of honey wcre measured within tbe hour.", "d3"),
        ("r1", "The samples of honey\nOpen Journal · Vol. 7\nwere measured within the hour.", "d4"), ("p1", "The samples were\nPage 7\nmeasured.", "d5"), ("n1", None, "d6"), ("n2", "", None), ("s1", "The mea­\nsured samples.", "d7"),
    ] + [(f"w{i}", "A well-known and well-known case.", "d8") for i in range(5)]
    rec = spark.createDataFrame(data, "id string, text string, node string")
    blocks = spark.createDataFrame([], "doc_id string, page int, y0 double, y1 double, text string")
    titles = spark.createDataFrame([], "node string, title string")
    got = set(rows(scan_noise.find_noise(rec, blocks, titles).rows()))
    assert got == {("h1", "hyphenation"), ("s1", "hyphenation"), ("m1", "misread"), ("r1", "header"), ("p1", "page_number")}
    assert scan_noise.find_noise(rec.limit(0), blocks, titles).rows().count() == 0


def test_partitions_without_words_have_no_noise(spark):
    rows_in = [(f"r{i}", "The volume which we measured was small." if i % 3 else "The volume wbich we measured was small.", None) for i in range(60)] + [("x0", "12 34\n7", None), ("x1", "...", None)]
    text = spark.createDataFrame(rows_in, "id string, text string, node string").cache()
    blocks, titles = spark.createDataFrame([], "doc_id string, page int, y0 double, y1 double, text string"), spark.createDataFrame([], "node string, title string")
    cfg = scan_noise.NoiseConfig(frequent=10, frequent_share=0.0, times=1.5)
    want = set(rows(scan_noise.find_noise(text.coalesce(1), blocks, titles, cfg).rows()))
    assert ("r0", "misread") in want and len(want) >= 20
    # all rows in one of eight partitions; then two texts without words in a partition of their own
    crowded = text.repartitionByRange(8, F.lit(1))
    assert crowded.rdd.glom().map(len).collect().count(0) >= 1
    apart = text.where("id LIKE 'r%'").coalesce(1).unionByName(text.where("id LIKE 'x%'").coalesce(1))
    for cut in (crowded, apart):
        assert set(rows(scan_noise.find_noise(cut, blocks, titles, cfg).rows())) == want
    got = {r["id"]: r["repaired"] for r in scan_noise.repaired(apart, blocks, titles, cfg).collect()}
    assert got["r0"] == "The volume which we measured was small." and "x1" not in got


def test_confusions_undone():
    assert scan_noise.undone("wbich", "which", 1) and scan_noise.undone("cloublecl", "doubled", 2) and not scan_noise.undone("wbich", "witch", 1)


# --- 3 and 4 ----------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    sentence = "The column was heated to {} °C before the samples were injected into the source of the instrument."
    data = [(f"f{i:03d}", "context", " ".join(sentence.format(i + k) for k in range(4))) for i in range(60)]
    data += [(f"a{i:03d}", "answer", f"at {i} °C") for i in range(40)]
    full = " ".join(sentence.format(5) for _ in range(3))
    cases = {"c1": full + " The column was heated to 7 °C before the sam", "c2": full + " The column was heated to 7 °C before the", "c3": full + " The column was hea…", "c4": full + " The column was &#x2"}
    data += [(k, "context", v) for k, v in cases.items()] + [("e1", "context", None), ("e2", "context", "  "), ("o1", "context", full), ("o2", "answer", "forty degrees")]
    got = {(r["id"], r["field"]) for r in truncation.truncated(spark.createDataFrame(data, "id string, field string, text string")).where("cut").collect()}
    assert got == {(k, "context") for k in cases}
    assert truncation.truncated(spark.createDataFrame([], "id string, field string, text string")).count() == 0


def test_cut_short_phrases(spark):
    names = ("zarol", "melin", "corin", "tasole", "ribine", "fenol", "kelit", "sulon")
    data = [(f"a{i:03d}", "answer", f"The {names[i % 8]} number {i} ran on the ion trap with a {w} column and gave a signal.") for i, w in enumerate(("porous", "diol", "phenyl") * 30)]
    data += [(f"p{i:03d}", "answer", f"the {names[i % 8]} ion trap with a {w} column") for i, w in enumerate(("porous", "diol", "phenyl") * 8)] + [(f"s{i}", "answer", "on a trap with a cone") for i in range(4)]
    data += [("c1", "answer", "the Sorrel ion trap with a porou"), ("c2", "answer", "on the Sorrel ion trap with a")]
    got = {r["id"] for r in truncation.truncated(spark.createDataFrame(data, "id string, field string, text string")).where("cut").collect()}
    assert got == {"c1", "c2"}


def test_parts_of_words_recur_in_a_large_corpus(spark):
    names = ("zarol", "melin", "corin", "tasole", "ribine", "fenol", "kelit", "sulon")
    data = [(f"f{i:04d}", "context", f"Vial {names[i % 8]} of {names[i // 8 % 8]} was kept cold in the {names[i // 64 % 8]} and then heated by the operator of the bench in room {i}.") for i in range(1_000)]
    # the same part of a word ends six texts, as it does in a corpus of many; so does the same short phrase
    cut = [(f"c{i}", "context", f"Vial {names[i]} of {names[i + 1]} was kept cold in the melin and then heated by the oper") for i in range(6)]
    data += [(f"a{i:04d}", "answer", f"The {names[i % 8]} was heated by the operator of the bench in room {i}.") for i in range(1_000)]
    cut += [(f"s{i}", "answer", "heated by the operator of the") for i in range(6)]
    got = {r["id"] for r in truncation.truncated(spark.createDataFrame(data + cut, "id string, field string, text string")).where("cut").collect()}
    assert got == {r[0] for r in cut}


def test_a_corpus_delivered_many_times_cuts_the_same_phrases(spark):
    names = ("zarol", "melin", "corin", "tasole", "ribine", "fenol", "kelit", "sulon")
    data = [(f"a{i:03d}", "answer", f"The {names[i % 8]} number {i} ran on the ion trap with a {w} column and gave a signal in room {i}.") for i, w in enumerate(("porous", "diol", "phenyl") * 30)]
    data += [("c1", "answer", "the Sorrel ion trap with a porou"), ("c2", "answer", "on the Sorrel ion trap with a")]
    many = [(f"{k}-{i}", *rest) for k in range(5) for i, *rest in data]
    got = {r["id"] for r in truncation.truncated(spark.createDataFrame(many, "id string, field string, text string")).where("cut").collect()}
    assert got == {f"{k}-{c}" for k in range(5) for c in ("c1", "c2")}


def test_pair_checks():
    d = pair_defects
    assert all(d.blank(x) for x in (None, "", " \n", "​", "N/A", "...", "Answer:", "[]", "nan")) and not d.blank("5") and not d.blank("No.")
    q = "Which column was used for the honey?"
    assert all(d.copies(q, a) for a in (q.upper(), f'"{q}"', "column was used for the honey.", f"Let us look at this: {q}", f"{q} {q}"))
    assert not any(d.copies(q, a) for a in ("The C18 column was used for the honey.", "Which", "The column used for the hon"))
    assert d.other_language(q, "La columna C18 se usó para la miel y el agua.") and d.other_language(q, "Для меда использована колонка.")
    assert not d.other_language(q, "The C18 column was used.") and not d.other_language("¿Cuál fue la columna de la miel?", "La columna fue de 30 m.") and not d.other_language(q, "5.3 ppm")


@pytest.mark.parametrize("question", ["How were the isomers of SM 43:6 separated?", "Which of the two columns was used for all of the honey in the end?"])
def test_copies_in_a_row(question):
    for n in (1, 2, 3):
        assert pair_defects.copies(question, " ".join([question] * n)) and pair_defects.copies(question, "Question: " + " ".join([question] * n))
    assert pair_defects.copies(question, f"Question 1: {question} Question 2: {question}")
    assert not pair_defects.copies(question, f"{question} At 25 °C.") and not pair_defects.copies(question, f"{question} {question} At 25 °C.") and not pair_defects.copies(question, f"{question} {question} They were kept on a column of octadecyl silica for an hour.")


@pytest.mark.parametrize(
    ("question", "answer"),
    [
        ("Which spray voltage was applied?", "De terugwinning van ithiluvir bedroeg 28.1 % en bleef daarna gelijk."),
        ("How far did the results differ?", "El límite de cuantificación de noraamine quedó fijado en 6.99 ng/mL tras comprobarlo en 180 muestras."),
        ("When were peak areas inspected by hand?", "Le rendement d'extraction de TG 41:2 a atteint 2.9 %, alors qu'une seconde étape n'a ajouté que 62 %."),
        ("¿Qué recuperación se obtuvo para quarivir?", "Die Wiederfindung von quarivir betrug 96.2 %, während ein zweiter Schritt nur noch 78 % lieferte."),
    ],
)
def test_sentences_in_another_language_with_shared_words(question, answer):
    assert pair_defects.other_language(question, answer)
    assert not pair_defects.other_language(answer, answer) and not pair_defects.other_language(question, "Derivatisation converted PE 31:2 into a volatile product w")
    assert not pair_defects.other_language(question, "I must decline to answer; please ask somebody.")


def test_defects_end_to_end(spark):
    data = [(f"g{i:03d}", f"Which value number {i} was found in the sample?", f"The value found in the sample was {i} ppm at the end of the run.") for i in range(40)]
    data += [(f"r{i}", f"{w} was measured there?", "I'm sorry, but I cannot answer this question.") for i, w in enumerate(("What", "Which ion", "How much of it", "Why so little"))]
    data += [("e", "Which one was it?", None), ("k", "Which one was it in the end?", "Which one was it in the end?"), ("n", None, "A plain answer that stands by itself.")]
    got = dict(rows(pair_defects.pair_defects(spark.createDataFrame(data, "id string, question string, answer string")).select("id", "defect")))
    assert got == {"r0": "refusal", "r1": "refusal", "r2": "refusal", "r3": "refusal", "e": "empty", "k": "copied_question"}
    assert pair_defects.pair_defects(spark.createDataFrame([], "id string, question string, answer string")).count() == 0


def test_openings_by_verified_minhash(spark):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(3)
    some = set()
    for n in range(3, 13):
        for _ in range(12):
            o = rng.choices(words, k=n)
            some |= {" ".join(o), " ".join(o[:-1]), " ".join(rng.sample(o, n)), " ".join([*o[: n // 2], "y", *o[n // 2 + 1 :]]), " ".join([*o, "z"])}
    some = sorted(some - {""})

    def near(a, b):
        x, y = (set(t.split()) for t in (a, b))
        return len(x & y) >= 0.8 * len(x | y)

    root = {o: o for o in some}

    def find(o):
        return o if root[o] == o else find(root[o])

    links = [(a, b) for a, b in itertools.combinations(some, 2) if near(a, b)]
    for a, b in links:
        root[find(b)] = find(a)
    df = spark.createDataFrame([(i, o) for i, o in enumerate(some)], "node bigint, opening string")
    for bucket in (2_000, 3):  # the second one splits most buckets
        got = {some[n]: some[t] for n, t in rows(pair_defects.opening_templates(df, pair_defects.DefectConfig(bucket=bucket)))}
        assert len(got) == len(some) and all(find(o) == find(t) for o, t in got.items())
        assert sum(got[a] == got[b] for a, b in links) >= (0.99 if bucket > 3 else 0.75) * len(links)


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_openings_of_any_bucket_meet_all_their_partners(spark, bucket):
    rng = random.Random(4)
    some = set()
    for _ in range(60):
        o = rng.sample([f"w{i}" for i in range(9)], 6)
        some |= {" ".join(o), " ".join(o[:5]), " ".join(o[1:])}
    some = sorted(some)
    df = spark.createDataFrame(list(enumerate(some)), "node bigint, opening string")
    # one band of one row puts all openings with the same least word into one bucket
    cfg = pair_defects.DefectConfig(bucket=bucket, bands=1, rows=1)
    least = pair_defects.signatures(some, 1)[:, 0]
    sets = [set(o.split()) for o in some]
    links = [(a, b) for a, b in itertools.combinations(range(len(some)), 2) if least[a] == least[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = dict(rows(pair_defects.opening_templates(df, cfg)))
    assert len(links) > 100 and all(got[a] == got[b] for a, b in links)


def test_planted_refusals_in_unseen_words(spark):
    rng = random.Random(5)
    things = "honey salmon wheat sludge plasma urine maize yeast".split()
    verbs = "extracted dried filtered weighed stored spiked frozen".split()
    kinds = ("Which column held the {t}?", "How was {t} {v} here?", "Why did {t} turn brown?", "When was the {t} {v}?", "What did the {t} weigh?")
    say = ("Frankly speaking, such matters exceed whatever my humble self dares {}.", "Kindly direct that enquiry towards somebody {} instead of me.")
    data = []
    for i in range(1_200):
        t, v = rng.choice(things), rng.choice(verbs)
        context = f"The {t} was {v} after day {i} and kept in a brown vessel on the second column until it turned."
        q = rng.choice(kinds).format(t=t, v=v)
        planted = i < 200
        a = say[i % 2].format(rng.choice(("today", "wiser", "senior", "local", "proper"))) if planted else f"The {t} was {v} and kept in a brown vessel."
        data.append((f"{'r' if planted else 'g'}{i:04d}", q, a, context))
    assert not any(pair_defects.DECLINING.search(r[2]) for r in data)
    got = rows(pair_defects.pair_defects(spark.createDataFrame(data, "id string, question string, answer string, context string")).select("id", "defect", "how"))
    assert {(d, h) for _, d, h in got} == {("refusal", "template")} and {i for i, _, _ in got} == {r[0] for r in data if r[0].startswith("r")}


def test_templates_show_refusals_without_words_of_declining(spark):
    say = "Kindly direct your enquiry towards somebody {} who knows about such matters."
    asked = ("Which column was used?", "How was honey kept?", "Why did the signal rise?", "When was it injected?")
    data = [(f"r{i}", q, say.format(w), "The samples were kept cold.") for i, (q, w) in enumerate(zip(asked, ("else", "other", "local", "senior"), strict=True))]
    data += [(f"g{i}", q, f"The honey was kept in a {w} vessel below the bench.", f"We kept the honey in a {w} vessel below the bench.") for i, (q, w) in enumerate(zip(asked, ("glass", "steel", "brown", "small"), strict=True))]
    df = spark.createDataFrame(data, "id string, question string, answer string, context string")
    assert not any(pair_defects.DECLINING.search(r[2]) for r in data)
    assert dict(rows(pair_defects.pair_defects(df).select("id", "defect"))) == {f"r{i}": "refusal" for i in range(4)}


@pytest.mark.parametrize("at_most", [True, False])
def test_closest_subset_far_beyond_the_first_bitset(at_most):
    rng = random.Random(8)
    for _ in range(12):
        counts = {rng.randrange(20_000, 90_000): rng.randrange(1, 6) for _ in range(4)}
        total = sum(s * n for s, n in counts.items())
        target = rng.randrange(150_000, max(150_001, total))
        sums = {0}
        for s, n in counts.items():
            sums = {t + k * s for t in sums for k in range(n + 1)}
        want = min(abs(t - target) for t in sums if not at_most or t <= target)
        got = closest_subset(counts, target, at_most=at_most)
        assert abs(sum(s * n for s, n in got.items()) - target) == want and all(n <= counts[s] for s, n in got.items())
    many = {rng.randrange(1, 4_000): rng.randrange(1, 2_000) for _ in range(900)}
    target = sum(s * n for s, n in many.items()) // 3
    got = closest_subset(many, target, at_most=at_most)
    assert target > 10 * (1 << 17) and sum(s * n for s, n in got.items()) == target
    even = {2 * s: n for s, n in many.items()}
    assert sum(s * n for s, n in closest_subset(even, 2 * target + 1, at_most=at_most).items()) == 2 * target


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_hidden_words():
    for w in ("idiooot", "id1ot", "i@#$%", "m***n", "f**k"):
        assert abuse.kinds_of(w) & abuse.HIDDEN, w
    assert not abuse.kinds_of("b12") & abuse.STRONG and not abuse.kinds_of("column") & abuse.STRONG
    r = abuse.Reader(abuse.AbuseConfig())
    words, at, of = r.words(["You m o r o n, and mо​ron.", None, "x"])
    assert "moron\0" in words and words.count("moron") == 1 and of[0] == 0 and of[-1] == 2 and len(words) == len(at) == len(of)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.05
    votes = np.stack([np.where(y, rng.random(len(y)) < p, rng.random(len(y)) < f) for p, f in ((0.7, 0.01), (0.6, 0.01), (0.5, 0.02), (0.1, 0.5))], axis=1)
    patterns = votes @ (1 << np.arange(4))
    model = fit_label_model(dict(zip(*(x.tolist() for x in np.unique(patterns, return_counts=True)), strict=True)), [1, 1, 1, -1])
    held = np.array([model.posterior(int(p)) >= 0.5 for p in range(16)])[patterns]
    assert (held == y).mean() > 0.97 and (held & y).sum() / y.sum() > 0.6
    assert fit_label_model({}, [1, -1]).posterior(0) < 0.5


def test_scores(spark):
    calm = ["The column was heated before the samples were injected.", "Great tits were sampled in the field.", "Spectra of the peptide were recorded at room temperature."]
    foul = [
        "You are a worthless idiot.", "All foreigners are vermin and should be forbidden to breed.", "Send me your nude pictures, you slut.", "I hope you get hanged, moron.",
        "Refugees are rats and a plague on us.", "Lonely wives near you strip and masturbate.", "Go drown in your buffer.", "Immigrants have the brains of cattle, you scum.",
    ]
    data = [(i, "s" if i % 2 else None, " ".join(calm[(i + k) % 3] for k in range(4)) + (" " + foul[i // 9 % 8] if i % 9 == 0 else "")) for i in range(360)]
    data += [(900, "s", None), (901, "s", ""), (902, "s", "You are a w0rthless m***n.")]
    got = {r["doc_id"]: r["score"] for r in abuse.abuse_scores(spark.createDataFrame(data, "doc_id bigint, source string, text string"), abuse.AbuseConfig(spare=1)).collect()}
    assert len(got) == len(data) and got[900] == got[901] == 0.0
    assert all((got[i] >= abuse.AbuseConfig().threshold) == (i % 9 == 0) for i in range(360))
    assert abuse.abuse_scores(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_queries_and_sql_have_the_same_names():
    from qaloom.llm.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(QUERIES)
