"""Problem 7: records of evaluation splits that return, alike or almost alike, in the training split."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import source_of, split_name
from qaloom.operators.rows import latest_rows
from qaloom.plans.staging import staged
from qaloom.sources.tables import table

WORD = re.compile(r"[^\W_]+")
BITS = 512


@dataclass(frozen=True)
class OverlapConfig:
    """`share` of the longer text's words that must recur; the other fields bound the work, not the result."""

    share: float = 0.75
    df_buckets: int = 1 << 18
    block_eval: int = 2048
    block_train: int = 8192
    broadcast_rows: int = 200_000


class _Hashes(dict):
    """64-bit hashes of words, kept while a task runs."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def elements(text: str, hashes: dict) -> np.ndarray:
    """The canonical form of a text: its words in lower case, each occurrence an element of its own, as sorted hashes."""
    words = WORD.findall(text.lower())
    h = np.sort(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
    if len(h) > 1:
        new = np.empty(len(h), dtype=bool)
        new[0] = True
        np.not_equal(h[1:], h[:-1], out=new[1:])
        at = np.arange(len(h))
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        h = h * np.uint64(0x9E3779B97F4A7C15) + nth * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h.sort()
    elif len(h):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def ordered(text: str) -> bytes:
    """Digest of the canonical text: its words in lower case in their order, without punctuation and white space."""
    return hashlib.blake2b(" ".join(WORD.findall(text.lower())).encode(), digest_size=16).digest()


def bitmap(parts: np.ndarray) -> bytes:
    """Parity of the number of elements in each of BITS slots: two texts' maps differ in no more slots than elements."""
    slots = (parts.view(np.uint64) >> np.uint64(40)) % np.uint64(BITS)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def fingerprints(records: DataFrame) -> DataFrame:
    """Of `id, loaded_at, split, source, question, context`: `uid` names the pair of texts as bags of words, with what finds
    its like, and `oid` the pair of canonical texts in their order."""
    schema = "id string, loaded_at timestamp_ntz, split string, source string, uid binary, oid binary, nq int, nc int, qk array<bigint>, bits binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            uid, oid, nq, nc, qk, bits = [], [], [], [], [], []
            for q, c in zip(pdf["question"], pdf["context"], strict=True):
                a, b = elements(q, hashes) if q else np.zeros(0, np.int64), elements(c, hashes) if c else np.zeros(0, np.int64)
                uid.append(hashlib.blake2b(a.tobytes() + b"|" + b.tobytes(), digest_size=16).digest())
                oid.append(hashlib.blake2b(ordered(q or "") + ordered(c or ""), digest_size=16).digest())
                nq.append(len(a))
                nc.append(len(b))
                qk.append(a)
                bits.append(bitmap(b) if len(b) else b"")
            out = pdf[["id", "loaded_at", "split", "source"]].copy()
            yield out.assign(uid=uid, oid=oid, nq=nq, nc=nc, qk=qk, bits=bits)

    return records.mapInPandas(run, schema)


def _keyed(units: DataFrame, counts: np.ndarray, cfg: OverlapConfig) -> DataFrame:
    """A row per unit, side and element of the question's prefix.

    Two questions with the wanted overlap share one of the n - ceil(share * n) + 1 first elements of each, in any one
    order; here rare elements stand first, by counts in a table of fixed length.
    """
    shared = units.sparkSession.sparkContext.broadcast(counts)  # df_buckets numbers, whatever the data
    share, buckets = cfg.share, cfg.df_buckets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_of = shared.value
        for pdf in batches:
            keys = []
            for qk in pdf["qk"]:
                k = np.asarray(qk, dtype=np.int64)
                n = len(k) - math.ceil(share * len(k) - 1e-9) + 1
                keys.append(k[np.lexsort((k, n_of[k.view(np.uint64) % np.uint64(buckets)]))[:n]])
            yield pdf.drop(columns="qk").assign(key=keys).explode("key").astype({"key": "int64"})

    keyed = units.mapInPandas(run, "uid binary, evals boolean, trains boolean, nq int, nc int, bits binary, key bigint")
    sides = F.explode(F.filter(F.array(F.when(F.col("evals"), 0), F.when(F.col("trains"), 1)), lambda s: s.isNotNull()))
    return keyed.select("key", "uid", "nq", "nc", "bits", sides.alias("side"))


def _blocks(keyed: DataFrame, cfg: OverlapConfig) -> DataFrame:
    """Rows of the keys that both sides have, cut into blocks of bounded size: a hot key gets many."""
    sizes = keyed.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("ne"), F.count_if(F.col("side") == 1).alias("nt")).where("ne > 0 AND nt > 0")
    sizes = sizes.select(F.col("key").alias("k"), F.ceil(F.col("ne") / cfg.block_eval).cast("int").alias("pe"), F.ceil(F.col("nt") / cfg.block_train).cast("int").alias("pt"))
    rows = keyed.join(sizes, F.col("key") == F.col("k")).drop("k")
    own = F.pmod(F.xxhash64("uid"), F.when(F.col("side") == 0, F.col("pe")).otherwise(F.col("pt"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("pt")).otherwise(F.col("pe")) - 1))
    at = rows.withColumn("own", own).withColumn("other", others)
    block = F.xxhash64("key", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    return at.select(block.alias("block"), "side", "key", "uid", "nq", "nc", "bits").repartition("block").sortWithinPartitions("block", "key", "side")


def _candidates(blocks: DataFrame, cfg: OverlapConfig) -> DataFrame:
    """Pairs of units that length and bitmap leave possible; none with the wanted overlap is lost.

    A block's evaluation rows come first and are held, at most block_eval of them; the training rows stream past.
    """
    share = cfg.share

    def compare(e: tuple, t: tuple, out: list) -> None:
        for k in range(len(e[0])):
            longer = np.maximum(t[2], e[2][k])
            room = t[2] + e[2][k] - 2 * np.ceil(share * longer - 1e-9)
            fits = (room >= 0) & (np.minimum(t[1], e[1][k]) >= share * np.maximum(t[1], e[1][k]) - 1e-9)
            fits = np.flatnonzero(fits)
            if len(fits):
                apart = np.bitwise_count(t[3][fits] ^ e[3][k]).sum(axis=1)
                for j in fits[apart <= room[fits]]:
                    if e[0][k] != t[0][j]:
                        out.append((e[0][k], t[0][j]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, None
        for pdf in batches:
            ids = (pdf["block"].to_numpy(), pdf["key"].to_numpy())
            edges = np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (pdf["side"].to_numpy()[1:] != pdf["side"].to_numpy()[:-1])) + 1
            out: list = []
            bounds = [0, *edges.tolist(), len(pdf)]
            uid, nq, nc, side = pdf["uid"].to_numpy(), pdf["nq"].to_numpy().astype(np.int64), pdf["nc"].to_numpy().astype(np.int64), pdf["side"].to_numpy()
            bits = np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), BITS // 64) if len(pdf) else None
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                here = (ids[0][a], ids[1][a])
                part = (uid[a:b], nq[a:b], nc[a:b], bits[a:b])
                if side[a] == 0:
                    held = tuple(np.concatenate(x) for x in zip(held, part, strict=True)) if held is not None and at == here else part
                    at = here
                elif held is not None and at == here:
                    compare(held, part, out)
            yield pd.DataFrame(out, columns=["e", "t"])

    return blocks.mapInPandas(run, "e binary, t binary").distinct()


def _parts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            yield pd.DataFrame({"uid": pdf["uid"], "q": [elements(x, hashes) for x in pdf["question"]], "c": [elements(x, hashes) for x in pdf["context"]]})

    return texts.mapInPandas(run, "uid binary, q array<bigint>, c array<bigint>")


def overlaps(records: DataFrame, cfg: OverlapConfig = OverlapConfig()) -> tuple[DataFrame, DataFrame]:
    """Pairs of units (`e` an evaluation unit, `t` a training unit), and `members` (`uid`, `oid`, `id`, `split`, `source`).

    `records` has `id, loaded_at, split, source, question, context`; of a repeated id the latest row counts. A unit is
    what has the same canonical question and context: words in lower case without punctuation and white space, as a bag.
    Hashes of that form are joined between the splits. Members of a pair whose `oid` agree are exact overlaps: the same
    words in the same order. Almost equal units share a rare
    word of the question by the prefix rule; those are compared in blocks of bounded size by length and by a bitmap of
    the context, both of which only ever rule out pairs below the share, and what is left is counted exactly. Rows
    without id, split, question or context, or without a word in either, take no part; empty tables give empty ones.
    """
    spark = records.sparkSession
    prints = fingerprints(records.where("id IS NOT NULL"))
    last = staged(latest_rows(prints, "id", "loaded_at", ["id", "loaded_at", "split", "source", "uid", "oid", "nq", "nc", "qk", "bits"]).where("split IS NOT NULL AND nq > 0 AND nc > 0"))
    members = last.select("uid", "oid", "id", "split", "source")
    units = last.groupBy("uid").agg(
        F.bool_or(F.col("split") != "train").alias("evals"), F.bool_or(F.col("split") == "train").alias("trains"),
        *[F.first(c).alias(c) for c in ("nq", "nc", "qk", "bits")], F.min(F.struct("id", "loaded_at")).alias("one"),
    )
    units = staged(units)
    same = units.where("evals AND trains").select(F.col("uid").alias("e"), F.col("uid").alias("t"))
    counts = np.zeros(cfg.df_buckets, dtype=np.int64)
    slot = F.col("h") % F.lit(cfg.df_buckets)
    slot = F.when(slot < 0, slot + cfg.df_buckets).otherwise(slot)  # as the unsigned remainder, the length being a power of 2
    found = units.select(F.explode("qk").alias("h")).groupBy(slot.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # df_buckets rows at most
    counts[found["b"].to_numpy()] = found["n"].to_numpy()
    keyed = staged(_keyed(units.select("uid", "evals", "trains", "nq", "nc", "bits", "qk"), counts, cfg))
    maybe = staged(_candidates(_blocks(keyed, cfg), cfg))
    wanted = maybe.select(F.col("e").alias("uid")).union(maybe.select(F.col("t").alias("uid"))).distinct().join(units.select("uid", "one"), "uid")
    wanted = staged(wanted.select("uid", F.col("one.id").alias("id"), F.col("one.loaded_at").alias("loaded_at")))
    few = wanted.count() <= cfg.broadcast_rows
    at = (records["id"] == wanted["id"]) & records["loaded_at"].eqNullSafe(wanted["loaded_at"])
    texts = records.join(F.broadcast(wanted) if few else wanted, at).groupBy("uid").agg(F.max(F.struct("question", "context")).alias("x")).select("uid", "x.question", "x.context")
    parts = staged(_parts(texts))
    left, right = parts.select(F.col("uid").alias("e"), F.col("q").alias("qe"), F.col("c").alias("ce")), parts.select(F.col("uid").alias("t"), F.col("q").alias("qt"), F.col("c").alias("ct"))

    def recurs(a: str, b: str):
        return F.size(F.array_intersect(a, b)) >= F.lit(cfg.share) * F.greatest(F.size(a), F.size(b)) - F.lit(1e-9)

    near = maybe.join(left, "e").join(right, "t").where(recurs("qe", "qt") & recurs("ce", "ct")).select("e", "t")
    return staged(same.unionByName(near)), members


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qa_release")
    return rows.select("id", "loaded_at", split_name(F.col("split")).alias("split"), source_of(F.col("source_pdf")).alias("source"), "question", "context")


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = overlaps(_records(spark, sf_dir))
    evals = members.where("split <> 'train'").select(F.col("uid").alias("e"), F.col("oid").alias("eo"), F.col("id").alias("eval_id"), "split", "source")
    trains = members.where("split = 'train'").select(F.col("uid").alias("t"), F.col("oid").alias("to"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    return pairs.join(evals, "e").join(trains, "t").withColumn("exact", F.col("eo") == F.col("to"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records, one in train and one in val or test."""
    return _expanded(spark, sf_dir).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def p7_by_split_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and evaluation records concerned, per split and source of the evaluation record."""
    by = _expanded(spark, sf_dir).groupBy("split", "source")
    return by.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("exact").alias("exact_pairs"), F.count_distinct("eval_id").alias("records"))


P7_PAIRS = r"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d FROM qa_release WHERE id IS NOT NULL
), r AS (
  SELECT id, CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('val', 'validation', 'dev', 'test') THEN 'eval' END AS side,
         CASE WHEN lower(trim(split)) = 'test' THEN 'test' ELSE 'val' END AS part, nullif(regexp_extract(source_pdf, '^/corpus/([^/]+)/', 1), '') AS source,
         regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS q, regexp_extract_all(lower(context), '[\p{L}\p{N}]+') AS c
  FROM latest WHERE d = 1
), k AS (SELECT * FROM r WHERE side IS NOT NULL AND len(q) > 0 AND len(c) > 0
), w AS (
  SELECT id, side, f, w, row_number() OVER (PARTITION BY id, f, w) AS nth
  FROM (SELECT id, side, 'q' AS f, unnest(q) AS w FROM k UNION ALL SELECT id, side, 'c' AS f, unnest(c) AS w FROM k)
), shared AS (
  SELECT e.id AS e, t.id AS t, count(*) FILTER (WHERE e.f = 'q') AS sq, count(*) FILTER (WHERE e.f = 'c') AS sc
  FROM (SELECT * FROM w WHERE side = 'eval') e JOIN (SELECT * FROM w WHERE side = 'train') t ON e.f = t.f AND e.w = t.w AND e.nth = t.nth GROUP BY 1, 2
)
SELECT e, t, a.part AS split, a.source AS source, a.q = b.q AND a.c = b.c AS exact
FROM shared JOIN k a ON a.id = e JOIN k b ON b.id = t
WHERE sq * 4 >= 3 * greatest(len(a.q), len(b.q)) AND sc * 4 >= 3 * greatest(len(a.c), len(b.c))
"""

P7_FOUND_SQL = f"SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM ({P7_PAIRS})"
P7_BY_SPLIT_SOURCE_SQL = f"SELECT split, source, count(*) AS pairs, count(*) FILTER (WHERE exact) AS exact_pairs, count(DISTINCT e) AS records FROM ({P7_PAIRS}) GROUP BY split, source"
