"""Queries against their SQL, on the smallest tables where they are there."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
import qaloom.queries_pipeline  # noqa: E402, F401

SOME = ["repaired_titles", "reconstructed", "paragraphs", "jsonl_round_trip", "stream_consolidated", "greedy_near_dedup", "metadata_resolved", "metadata_lookup", "mean_kappa", "circuit_breaker", "training_log"]
SOME += ["split_stats", "quality_metrics", "question_types", "clean_answer", "license_tiers", "bm25_metrics", "dense_topk", "fleiss_kappa", "contamination_ngram", "doc_metadata_fields"]


def _rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    from qaloom.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(DATA))
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["bm25_topk"])
def test_whole_corpus_query_equals_its_sql(spark, name):
    test_query_equals_its_sql(spark, name)


def test_retrieval_gain_searches_all_answers(spark):
    from qaloom.queries import QUERIES

    whole = QUERIES["bm25_metrics"](spark, str(DATA)).first()
    got = {r["metric"]: r["tuned"] for r in QUERIES["retrieval_gain"](spark, str(DATA)).collect()}
    assert got["mrr"] == pytest.approx(whole["mrr"], abs=1e-6) and got["recall_10"] == pytest.approx(whole["recall_10"], abs=1e-6)


def test_planted_secrets_are_redacted_in_whole_records(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from qaloom.operators.release import MASK
    from qaloom.queries import ORACLE_SQL, QUERIES

    key = "sk-Abc_def-" + "7" * 20
    planted = spark.read.parquet(str(DATA / "qa_release.parquet")).where("question IS NOT NULL AND context IS NOT NULL").limit(60)
    spans = F.transform("evidence_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(s["text"], F.lit(f" {key}")).alias("text")))
    at = F.length("context") / 2
    context = F.concat(F.substring("context", F.lit(1), at.cast("int")), F.lit(f" {key} {key}. "), F.substring("context", at.cast("int") + 1, F.length("context")))
    planted.withColumns({"question": F.concat("question", F.lit(f" ({key})")), "answer": F.concat(F.lit(f"{key} "), "answer"), "context": context, "evidence_spans": spans}).write.parquet(str(tmp_path / "qa_release.parquet"))
    df = QUERIES["redacted_records"](spark, str(tmp_path))
    got = df.collect()
    assert got and not any("sk-Abc" in str(v) for r in got for v in r)
    assert all(r["question"].count(MASK) == 1 and r["context"].count(MASK) == 2 and len(r["context"]) > 100 for r in got) and any(MASK in (r["evidence"] or "") for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW qa_release AS SELECT * FROM '{tmp_path}/qa_release.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["redacted_records"])
    assert _rows(df.columns, got) == _rows([d[0] for d in want.description], want.fetchall())


def test_every_sql_has_its_query():
    from qaloom.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES)
