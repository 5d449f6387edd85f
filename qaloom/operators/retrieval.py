"""Sparse and dense retrieval, and its evaluation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import words
from qaloom.plans.staging import staged


def bm25_scores(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """`qid`, `cid`, `score` of the documents that share a term with a query.

    `queries` has `qid`, `text`, `corpus` has `cid`, `text`; terms are words in lower case. A term's weight is
    ln(N - n + .5) - ln(n + .5); negative weights become `floor` times the mean weight over all terms. A term that a
    query repeats counts repeatedly. Terms that no query has are never shipped with their documents.
    """
    toks = corpus.select("cid", words(F.lower("text")).alias("w"))
    docs = toks.select("cid", F.size("w").alias("len"), "w")
    stats = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg"))
    tf = staged(docs.select("cid", "len", F.explode("w").alias("term")).groupBy("cid", "len", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(stats))  # one row
    raw = df.withColumn("raw", F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "avg", F.when(F.col("raw") < 0, F.lit(floor) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("qid", F.explode(words(F.lower("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
    used = asked.select("term").distinct()
    postings = tf.join(used, "term", "left_semi").join(idf, "term")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return postings.select("term", "cid", weight.alias("w")).join(asked, "term").groupBy("qid", "cid").agg(F.sum(F.col("w") * F.col("qn")).alias("score"))


def bm25_best(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, block: int = 2048) -> DataFrame:
    """`bm25_scores` of the best `k` documents, as `top_k` ranks them, of every query within each part of the corpus.

    `queries` is a stated set and goes to every task in blocks of its own, with the weights of its terms; each task adds
    up its documents term by term and keeps `k` a query, so pairs of a query and a document aren't rows.
    """
    spark = corpus.sparkSession
    docs = staged(corpus.select("cid", words(F.lower("text")).alias("w")))
    stats = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("avg")).first()
    df = docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    raw = staged(df.select("term", (F.log(F.lit(stats["docs"]) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw")).first()[0]
    asked = queries.select("qid", F.explode(words(F.lower("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qn"))
    weighed = staged(asked.join(raw, "term").select("qid", "term", "qn", F.when(F.col("raw") < 0, F.lit(floor) * F.lit(mean)).otherwise(F.col("raw")).alias("idf")))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"
    parts = max(1, -(-weighed.select("qid").distinct().count() // block))
    out = spark.createDataFrame([], kinds)
    for p in range(parts):
        mine = weighed.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).toPandas()
        if mine.empty:
            continue
        row, qids = pd.factorize(mine["qid"])
        mine = mine.assign(row=row)
        terms = {t: (g["row"].to_numpy(), (g["idf"] * g["qn"]).to_numpy()) for t, g in mine.groupby("term")}
        shared = spark.sparkContext.broadcast((np.asarray(qids), terms, bool((mine["idf"] > 0).all()), float(stats["avg"])))  # one block

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, terms, positive, avg = shared.value
            best, least = pd.DataFrame({"q": np.empty(0, int), "cid": np.empty(0, object), "score": np.empty(0), "r": np.empty(0)}), np.full(len(qids), -np.inf)
            pool: list[pd.DataFrame] = []

            def kept() -> pd.DataFrame:
                x = pd.concat([best, *pool]) if len(best) else pd.concat(pool) if pool else best
                pool.clear()
                x = x.sort_values(["q", "r", "cid"], ascending=[True, False, True], kind="stable")
                x = x[x.groupby("q").cumcount() < k]
                worst = x.groupby("q")["r"].agg(["size", "min"])
                full = worst[worst["size"] == k]
                least[full.index.to_numpy(dtype=int)] = full["min"]
                return x

            for pdf in batches:
                for at in range(0, len(pdf), 1000):
                    some = pdf.iloc[at : at + 1000]
                    held: dict[str, list[tuple[int, float]]] = {}
                    for i, w in enumerate(some["w"]):
                        norm = k1 * (1 - b + b * len(w) / avg) if avg else k1
                        for term, tf in Counter(w).items():
                            if term in terms:
                                held.setdefault(term, []).append((i, tf * (k1 + 1) / (tf + norm)))
                    s = np.zeros((len(some), len(qids)))
                    met = None if positive else np.zeros(s.shape, dtype=bool)
                    for term, docs_of in held.items():
                        rows, weight = terms[term]
                        i = np.array([x for x, _ in docs_of])
                        cells = np.ix_(i, rows)
                        s[cells] += np.array([x for _, x in docs_of])[:, None] * weight[None, :]
                        if met is not None:
                            met[cells] = True
                    good = (s > 0 if met is None else met) & (s >= least[None, :] - 1e-9)
                    d, q = np.nonzero(good)
                    if len(d):
                        pool.append(pd.DataFrame({"q": q, "cid": some["cid"].to_numpy()[d], "score": s[d, q], "r": np.round(s[d, q], 9)}))
                        if sum(map(len, pool)) > 4 * k * len(qids):
                            best = kept()
            best = kept()
            yield pd.DataFrame({"qid": qids[best["q"].to_numpy(dtype=int)], "cid": best["cid"].to_numpy(), "score": best["score"].to_numpy()})

        out = out.unionByName(docs.mapInPandas(run, kinds))
    return out


def top_k(scores: DataFrame, k: int, tie: str = "cid") -> DataFrame:
    """The best `k` of each query with `rank` from 1; equal scores in the order of `tie`.

    Scores are compared to nine decimals, so that sums in another order give the same ranks.
    """
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col(tie).asc())))
    return ranked.where(F.col("rank") <= k)


def dense_scores(queries: DataFrame, corpus: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """`qid`, `cid`, `score`: for each query the best `k` by cosine of every block of the corpus.

    `queries` is a stated set and goes to every task in blocks of its own; each task multiplies its part of `corpus`
    with them as matrices and keeps `k` a query, so that no pair but the best leaves it. Vectors are arrays in
    `embedding`; null vectors and those of length 0 have no neighbours.
    """
    spark = corpus.sparkSession
    rows = queries.where(F.col("embedding").isNotNull())
    parts = max(1, -(-rows.count() // block))
    out = None
    for p in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).select("qid", "embedding").toPandas()
        if mine.empty:
            continue
        q = np.array(mine["embedding"].tolist(), dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((mine["qid"].to_numpy(), np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)))  # one block

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qm = shared.value
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if pdf.empty:
                    continue
                m = np.array(pdf["embedding"].tolist(), dtype=np.float64)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                s = qm @ np.divide(m, size, out=np.zeros_like(m), where=size > 0).T
                cids = pdf["cid"].to_numpy()
                kk = min(k + 1, s.shape[1])
                least = np.partition(s, -kk, axis=1)[:, -kk]
                r, c = np.nonzero(s >= least[:, None] - 1e-9)
                yield pd.DataFrame({"qid": ids[r], "cid": cids[c], "score": s[r, c]})

        kinds = f"qid {rows.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"
        found = corpus.select("cid", "embedding").mapInPandas(run, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = f"qid {rows.schema['qid'].dataType.simpleString()}, cid {corpus.schema['cid'].dataType.simpleString()}, score double"
        return spark.createDataFrame([], kinds)
    return out


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked results with `rel`, whether `qrels` (`qid`, `cid`) holds them relevant."""
    return ranked.join(qrels.select("qid", "cid").distinct().withColumn("rel", F.lit(True)), ["qid", "cid"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))


def per_query_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_cut: int | None = 10) -> DataFrame:
    """Recall, precision, accuracy, NDCG and MAP at each k, and the reciprocal rank, of every query.

    Queries without relevant documents or results have 0 everywhere and count in averages.
    """
    wanted = qrels.select("qid", "cid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = judged(ranked, qrels)
    order = Window.partitionBy("qid").orderBy("rank")
    hits = hits.withColumn("_found", F.sum(F.col("rel").cast("int")).over(order))
    within = F.lit(True) if mrr_cut is None else F.col("rank") <= mrr_cut
    aggs = [F.min(F.when(F.col("rel") & within, F.col("rank"))).alias("first")]
    for k in ks:
        at = F.col("rel") & (F.col("rank") <= k)
        aggs += [F.count_if(at).alias(f"hits_{k}"), F.sum(F.when(at, 1.0 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"), F.sum(F.when(at, F.col("_found") / F.col("rank"))).alias(f"ap_{k}")]
    per = queries.select("qid").distinct().join(hits.groupBy("qid").agg(*aggs), "qid", "left").join(wanted, "qid", "left")
    n = F.coalesce("n_rel", F.lit(0))
    cols = [F.col("qid"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        h = F.coalesce(f"hits_{k}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        some = n > 0
        cols += [
            F.when(some, h / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)).alias(f"recall_{k}"), (h / F.lit(float(k))).alias(f"precision_{k}"), (h > 0).cast("double").alias(f"accuracy_{k}"),
            F.when(some, F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)).alias(f"ndcg_{k}"),
            F.when(some, F.coalesce(f"ap_{k}", F.lit(0.0)) / F.nullif(F.least(n, F.lit(k)), F.lit(0))).otherwise(F.lit(0.0)).alias(f"map_{k}"),
        ]
    return per.select(*cols)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row with the number of queries and the mean of each metric."""
    names = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per metric (`metric`, `value`) the values, the gain and the gain in percent, 0 where the base is 0."""
    x = base.select("metric", F.col("value").alias("base")).join(tuned.select("metric", F.col("value").alias("tuned")), "metric")
    gain = F.col("tuned") - F.col("base")
    return x.select("metric", "base", "tuned", gain.alias("gain"), F.when(F.col("base") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * gain / F.nullif(F.col("base"), F.lit(0.0))).alias("gain_percent"))


def long_metrics(row: DataFrame) -> DataFrame:
    """`metric`, `value` of a row of means."""
    names = [c for c in row.columns if c != "queries"]
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("x.metric", "x.value")
