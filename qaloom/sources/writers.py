"""Sinks: JSON lines, partitions, annotation sheets, markdown and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition: list[str] | None = None) -> None:
    """One JSON object a line, nulls written out."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def without_empty(df: DataFrame) -> DataFrame:
    """`df` with null for what counts as nothing: empty texts, zeros, false, empty arrays; a JSON sink then drops the fields."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        empty = c == "" if kind == "string" else F.size(c) == 0 if kind.startswith(("array", "map")) else c == 0 if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") else ~c if kind == "boolean" else F.lit(False)
        out.append(F.when(~empty, c).alias(name))
    return df.select(*out)


def write_release(records: DataFrame, path: str) -> None:
    """Released and restricted records by tier and split, and the audit rows."""
    from qaloom.operators.release import audit_rows, released, restricted

    for tier, view in (("released", released(records)), ("restricted", restricted(records))):
        write_jsonl(view, f"{path}/tier={tier}", partition=["split"])
    audit_rows(records).write.mode("overwrite").option("header", "true").csv(f"{path}/audit")


def annotation_sheet(records: DataFrame) -> DataFrame:
    """Rows for annotators: the context cut to 500 characters, the score to two places, the labels empty."""
    c = F.coalesce("context", F.lit(""))
    empty = [F.lit("").alias(n) for n in ("answer_correct", "evidence_support", "evidence_quality", "question_clarity", "annotator_id", "notes")]
    return records.select("annotation_id", "question", "answer", F.when(F.length(c) > 500, F.concat(F.left(c, F.lit(500)), F.lit("..."))).otherwise(c).alias("context"), "question_type", F.format_string("%.2f", F.coalesce("quality_score", F.lit(0.0))).alias("quality_score"), *empty)


def human_sheet(records: DataFrame, annotators: tuple[str, ...] = ("a1", "a2")) -> DataFrame:
    """A sheet with a set of empty columns per annotator; texts cut to 1,000, 1,000 and 2,000 characters."""
    empty = [F.lit("").alias(f"{a}_{n}") for a in annotators for n in ("correctness", "evidence", "clarity", "evidence_quality", "notes")]
    return records.select("id", "question_type", F.left("question", F.lit(1000)).alias("question"), F.left("answer", F.lit(1000)).alias("answer"), F.left("context", F.lit(2000)).alias("context"), "doi", *empty)


def chat_messages(question: Column, answer: Column, context: Column, system: str = "You are a helpful scientific assistant.") -> Column:
    """Turns of a conversation; with a context the question stands after it."""
    asked = F.when(F.trim(F.coalesce(context, F.lit(""))) == "", question).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", asked), turn("assistant", answer))


def chat_text(messages: Column) -> Column:
    """A conversation as one text, a marker before each turn."""
    return F.concat_ws("\n", F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])))


def markdown_pages(pages: DataFrame, total: DataFrame, weak: float = 0.7) -> DataFrame:
    """`doc_id`, `markdown`: the pages in order under headings; missing ones hold a note, weak ones a mark.

    `pages` has `doc_id`, `page`, `text`, `quality`; `total` has `doc_id`, `pages`.
    """
    every = total.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    x = every.join(pages, ["doc_id", "page"], "left")
    mark = F.when(F.col("quality") < weak, F.format_string(" (quality %.2f)", F.col("quality"))).otherwise(F.lit(""))
    body = F.concat(F.lit("## Page "), F.col("page").cast("string"), mark, F.lit("\n\n"), F.coalesce("text", F.lit("*[page not extracted]*")))
    return x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", body.alias("b")))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda r: r["b"]), "\n\n").alias("markdown"))


def schema_catalogue(df: DataFrame) -> list[dict[str, str]]:
    """Name and kind (Text, Integer, Float, Date) of each field."""
    kinds = {"int": "Integer", "bigint": "Integer", "double": "Float", "float": "Float", "date": "Date", "timestamp": "Date", "timestamp_ntz": "Date"}
    return [{"name": n, "dataType": kinds.get(t, "Text")} for n, t in df.dtypes]


def latex_table(df: DataFrame, digits: int = 4) -> str:
    """A collected summary as a LaTeX table; for results of a few rows."""
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{tabular}{" + "l" + "r" * (len(df.columns) - 1) + "}", r"\toprule", " & ".join(map(show, df.columns)) + r" \\", r"\midrule"]
    return "\n".join([*lines, *(" & ".join(map(show, r)) + r" \\" for r in df.collect()), r"\bottomrule", r"\end{tabular}"])


def markdown_table(df: DataFrame, digits: int = 4) -> str:
    """A collected summary as a table; for results of a few rows."""
    rows = df.collect()
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
