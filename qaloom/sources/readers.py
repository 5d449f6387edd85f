"""Sources: records, texts, paragraphs, blocks, references and logs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions.hashing import file_stem
from qaloom.functions.text import squeeze

USAGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])
QA_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "run_id", "created_at", "model", "file_name", "source_pdf")]
    + [T.StructField(n, T.IntegerType()) for n in ("line_number", "paragraph_index")]
    + [T.StructField(n, T.StringType()) for n in ("context", "question", "answer")]
    + [T.StructField("usage", USAGE)]
)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType = QA_RECORD, on_error: str = "skip", limit: int | None = None) -> DataFrame:
    """One JSON object a line, from files or folders of any depth; blank lines are skipped.

    `on_error`: "skip" leaves out lines that are no JSON of the schema, "keep" gives them in `_corrupt_record`, "fail"
    stops. Folders that don't exist are left out; none at all gives an empty table. `limit` takes the first `limit` lines of
    the files in the order of their names, bad and blank ones counted, and what of them is a record.
    """
    if limit is not None:
        return _first_lines(spark, paths, schema, on_error, limit)
    listed = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in listed if re.match(r"[a-z][a-z0-9+.-]*:/", p) or any(c in p for c in "*?[") or Path(p).exists()]
    if not there:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("recursiveFileLookup", "true").option("encoding", "UTF-8")
    if any(Path(p).is_dir() for p in there):
        reader = reader.option("pathGlobFilter", "*.json*")
    if on_error == "fail":
        df = reader.schema(schema).option("mode", "FAILFAST").json(there)
    else:
        full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        df = reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(there)
        if on_error == "skip":
            df = df.where("_corrupt_record IS NULL").drop("_corrupt_record")
    return df


def _first_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType, on_error: str, limit: int) -> DataFrame:
    listed = [p for p in ([paths] if isinstance(paths, str) else list(paths)) if re.match(r"[a-z][a-z0-9+.-]*:/", p) or any(c in p for c in "*?[") or Path(p).exists()]
    if not listed:
        return spark.createDataFrame([], schema)
    lines = spark.read.option("recursiveFileLookup", "true").text(listed).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
    at = lines.withColumn("_i", F.monotonically_increasing_id())  # lines of a block are numbered in their order
    first = at.orderBy("_f", "_s", "_i").limit(limit).where(F.trim("value") != "")
    options = {"mode": "FAILFAST"} if on_error == "fail" else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    full = schema if on_error == "fail" else T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = first.select(F.from_json("value", full, options).alias("r")).select("r.*")
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record") if on_error == "skip" else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header, quotes doubled inside quotes, lines broken inside quotes."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def new_files(found: DataFrame, done: DataFrame, name: str = "file_name") -> DataFrame:
    """Rows of files that weren't processed before."""
    return found.join(done.select(name).distinct(), name, "left_anti")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id` (the file's stem) and `text` of the .txt files below `folder`."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    return df.select(file_stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def paragraphs(text: Column) -> Column:
    """An array of (`paragraph_index` from 1, `line_number` of its first line from 1, `text`) of the paragraphs of `text`.

    Paragraphs stand between blank lines; their lines are stripped and joined by blanks, and a paragraph that doesn't
    end in a full stop, question or exclamation mark gets a full stop.
    """
    # a blank line ends a paragraph; single line ends within one don't: cut once at blank lines, never line by line
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\x01"), squeeze_ends(x)))
    marked = F.concat(F.lit("\n"), F.array_join(F.filter(lines, lambda x: F.lit(True)), "\n"), F.lit("\n"))
    parts = F.split(F.regexp_replace(marked, r"\n(?:\d+\x01\n)+", "\n\x02\n"), r"\n?\x02\n")
    found = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit("\n"))), lambda p: p != "")
    closed = lambda t: F.when(t.rlike("[.?!]$"), t).otherwise(F.concat(t, F.lit(".")))
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"\n\d+\x01", " "), r"^\d+\x01", "")
    return F.transform(found, lambda p, k: F.struct((k + 1).alias("paragraph_index"), F.regexp_extract(p, r"^(\d+)\x01", 1).cast("int").alias("line_number"), closed(plain(p)).alias("text")))


def squeeze_ends(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+$", "")


def explode_paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per paragraph of each row."""
    rest = [c for c in texts.columns if c not in (text, "paragraph_index", "line_number")]
    return texts.select(*rest, F.explode(paragraphs(F.col(text))).alias("_p")).select(*rest, "_p.paragraph_index", "_p.line_number", F.col("_p.text").alias("paragraph"))


def block_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, or single lines in a text without any; an array from 0."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n+"), squeeze_ends), lambda x: x != "")
    lines = F.filter(F.transform(F.split(text, "\n"), squeeze_ends), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(lines)


def clean_page(text: Column) -> Column:
    """Lines of over three characters with single blanks, without signs of ownership and control characters."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeeze_ends), lambda x: F.length(x) > 3)
    return F.translate(F.array_join(F.transform(kept, squeeze), "\n"), "©®™\x00\x01\x02", "")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Text of each page from its text blocks (`block_type` 0) in their order."""
    rows = blocks.where("block_type = 0").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return rows.select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))


def two_columns(blocks: DataFrame, width: float = 612.0) -> DataFrame:
    """Text of each page read by columns: blocks that start left of the middle from top to bottom, then the others.

    `blocks` has `doc_id, page, x0, y0, block_no, text`; `width` is a page's width in points.
    """
    at = F.struct((F.col("x0") >= width / 2).alias("right"), "y0", "block_no", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    rows = blocks.where("block_type = 0").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(at)).alias("b"))  # the blocks of one page
    return rows.select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["t"]), " ").alias("text"))


def body_text(text: Column) -> Column:
    """From the first abstract or introduction to the references, if they come in that order; else whole."""
    low = F.lower(text)
    start = F.least(F.nullif(F.locate("abstract", low), F.lit(0)), F.nullif(F.locate("introduction", low), F.lit(0)))
    end = F.nullif(F.locate("references", low), F.lit(0))
    return F.when(start < end, F.substr(text, start, end - start)).otherwise(text)


BRACES = str.maketrans("", "", "{}")


def parse_bibtex_text(text: str | None) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of the entries of a BibTeX text; values in braces of any depth, in quotes or bare, without braces inside."""
    out, i, text = [], 0, text or ""

    def value(at: int, stop: int) -> tuple[str, int]:
        if text[at] == "{":
            depth = 0
            for j in range(at, stop):
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                if not depth:
                    return text[at + 1 : j], j + 1
            return text[at + 1 : stop], stop
        if text[at] == '"':
            j = text.find('"', at + 1, stop)
            return text[at + 1 : j if j >= 0 else stop], (j + 1 if j >= 0 else stop)
        j = at
        while j < stop and text[j] not in ",\n}":
            j += 1
        return text[at:j].strip(), j

    while (at := text.find("@", i)) >= 0:
        brace = text.find("{", at)
        kind = text[at + 1 : brace].strip().lower() if brace > 0 else ""
        if not kind.isidentifier():
            i = at + 1
            continue
        depth, end = 0, brace
        while end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
            if not depth:
                break
        stop = end - 1 if not depth else end
        comma = text.find(",", brace, stop)
        if comma < 0:
            i = end
            continue
        fields, pos = {}, comma + 1
        while (eq := text.find("=", pos, stop)) >= 0:
            name = text[pos:eq].strip(" ,\r\n\t").lower()
            pos = eq + 1
            while pos < stop and text[pos].isspace():
                pos += 1
            if pos >= stop:
                break
            got, pos = value(pos, stop)
            fields[name] = " ".join(got.translate(BRACES).split())
        out.append((kind, text[brace + 1 : comma].strip(), fields))
        i = end
    return out


def read_bibtex(texts: DataFrame, text: str = "text") -> DataFrame:
    """`entry_type`, `key`, `fields` of the entries in each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([e for t in pdf["t"] for e in parse_bibtex_text(t)], columns=["entry_type", "key", "fields"])

    return texts.select(F.col(text).alias("t")).mapInPandas(run, "entry_type string, key string, fields map<string,string>")


def read_tei(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """`abstract`, `body` and `conclusions` of TEI documents, by XPath on the text without namespaces."""
    bare = F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', "")
    join = lambda path: F.array_join(F.xpath(bare, F.lit(path)), " ")
    conclusion = "//body/div[starts-with(translate(head,'CONLUSI','conlusi'),'conclusion')]/p//text()"
    return texts.select("*", join("//abstract//p//text()").alias("abstract"), join("//body//p//text()").alias("body"), join(conclusion).alias("conclusions"))


def parse_training_log(lines: DataFrame) -> DataFrame:
    """`model`, `step`, `metric`, `value` of a training log, a row a line with `log`, `line_no`, `value`.

    A line "Training LLM: name" names the model of those that follow. A line that is a dict with a loss gives metrics.
    Steps are spread evenly up to the last progress bar of the model, or are 500 apart without one.
    """
    from pyspark.sql import Window

    x = lines.withColumn("model", F.nullif(F.regexp_extract("value", r"Training LLM:\s*(\S+)", 1), F.lit("")))
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("model", F.last("model", ignorenulls=True).over(w)).where(F.col("model").isNotNull())
    done = F.regexp_extract("value", r"\d+%\s*\|[^|]*\|\s*(\d+)/\d+\s+\[", 1)
    progress = x.withColumn("done", F.nullif(done, F.lit("")).cast("bigint")).where("done IS NOT NULL").groupBy("log", "model").agg(F.max_by("done", "line_no").alias("last_step"))
    dicts = x.where(F.trim("value").rlike(r"^\{['\"]loss['\"]\s*:.*\}$"))
    parsed = dicts.withColumn("m", F.from_json(F.replace(F.trim("value"), F.lit("'"), F.lit('"')), "map<string,double>")).where("m IS NOT NULL")
    numbered = parsed.withColumn("i", F.row_number().over(Window.partitionBy("log", "model").orderBy("line_no"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("log", "model")))
    y = numbered.join(progress, ["log", "model"], "left")
    per = F.greatest(F.lit(1), F.floor(F.col("last_step") / F.col("n")))
    step = F.when(F.col("last_step").isNull(), F.col("i") * 500).otherwise(F.least(F.col("i") * per, F.col("last_step")))
    return y.select("log", "model", step.cast("bigint").alias("step"), F.explode("m").alias("metric", "value"))
