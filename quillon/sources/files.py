"""Texts and file lists in; findings out as lines of text, JSON or CI annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.lint import ordered


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole UTF-8 files; other bytes are an error."""
    df = spark.read.format("binaryFile").load(list(paths))
    return df.select("path", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def write_texts(docs: DataFrame, path: str) -> None:
    """One row per file, to a new place; sources are never overwritten."""
    docs.select("path", "text").write.mode("errorifexists").parquet(path)


def tracked_files(listing: DataFrame, column: str = "value") -> DataFrame:
    """files(mode, path) out of a staged git listing: entries parted by NUL, `mode hash stage TAB path`."""
    entry = listing.select(F.explode(F.split(F.col(column), "\u0000")).alias("e")).where("e <> ''")
    return entry.select(F.substring_index("e", " ", 1).alias("mode"), F.regexp_extract("e", r"(?s)^[^\t]*\t(.*)$", 1).alias("path"))


def _escaped(value: Column) -> Column:
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value


def as_text(findings: DataFrame, key: str = "path", excerpts: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """One `report` per finding, in order: place, severity, rule, message, suggestion and the source line if texts are given.

    in_order: the findings are so already; with texts they are ordered after the join all the same.
    """
    place = F.concat_ws(":", F.col(key).cast("string"), F.col("line").cast("string"), F.col("column").cast("string"))
    lines = [F.concat(place, F.lit(": "), F.col("severity"), F.lit(" ["), F.col("rule"), F.lit("] "), F.col("message")), F.concat(F.lit("  suggestion: "), F.col("suggestion"))]
    df = findings
    if excerpts is not None:
        df = df.join(excerpts.select(key, F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1).alias("_lines")), key, "left")
        lines.append(F.concat(F.lit("  "), F.regexp_replace(F.get("_lines", F.col("line") - 1), r"(?U)(?<!\s)\s++\z", "")))
    return (df if in_order and excerpts is None else ordered(df, key)).select(F.concat_ws("\n", *lines).alias("report"))


def as_json(findings: DataFrame, key: str = "path", in_order: bool = False) -> DataFrame:
    """One JSON object per finding, in order; in_order: they are so already."""
    names = ["line", "column", "end_line", "end_column", "severity", "rule", "message", "suggestion"]
    return (findings if in_order else ordered(findings, key)).select(F.to_json(F.struct(F.col(key).alias("path"), *names)).alias("report"))


def as_annotations(findings: DataFrame, key: str = "path", tool: str = "quillon", in_order: bool = False) -> DataFrame:
    """One CI annotation per finding, in order; in_order: they are so already."""
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("notice")
    title = _escaped(F.concat(F.lit(f"{tool}/"), F.col("rule")))
    said = _escaped(F.concat("message", F.lit(" Suggestion: "), "suggestion"))
    text = F.format_string("::%s file=%s,line=%d,col=%d,endLine=%d,endColumn=%d,title=%s::%s", level, _escaped(F.col(key).cast("string")), "line", "column", "end_line", "end_column", title, said)
    return (findings if in_order else ordered(findings, key)).select(text.alias("report"))
