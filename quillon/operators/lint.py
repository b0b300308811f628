"""Lint: documents in, findings out; then counts, verdicts and an order.

Per document everything happens in its own row: no shuffle until an order or a
count over documents is asked for. The same plan runs on a stream.
All rules run in one pass in Python (see passes), which returns only findings.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batches import piecewise
from quillon.operators.passes import FOUND_DDL, Linter, found
from quillon.plans.catalogue import FAIL_LEVELS, RULES, Active, rank, resolve


def per_document(docs: DataFrame, rules: Sequence[Active], key: str = "doc_id") -> DataFrame:
    """(key, findings) with the findings of a document that its directives don't suppress, and their places."""
    active, made = [a for a in rules if a.severity != "off"], []

    def of(texts: list[str | None]) -> pa.Array:
        if not made:  # in each worker
            made.append(Linter(active))
        return found(made[0], texts)

    return docs.select(key, piecewise(of, FOUND_DDL)(F.col("text").cast("string")).alias("findings"))


def lint(docs: DataFrame, rules: Sequence[Active] | None = None, key: str = "doc_id") -> DataFrame:
    """One row per finding: key, line, column, end_line, end_column, severity, rule, message, suggestion, start, end, n, detail.

    docs needs key and text; null text counts as empty. Rows are not in order.
    inline_outer, since the optimizer would copy the findings' expression into
    a filter below explode, and again for each field that is used.
    """
    rules = resolve() if rules is None else rules
    active = [a for a in rules if a.severity != "off"]
    df = per_document(docs, rules, key).select(key, F.inline_outer("findings")).where("rule_no is not null")
    column = lambda of: F.get(F.array(*[F.lit(of(a)) for a in active] or [F.lit("")]), F.col("rule_no"))
    df = df.withColumns({"rule": column(lambda a: a.rule.id), "severity": column(lambda a: a.severity), "suggestion": column(lambda a: a.rule.advice), "message": message(column(lambda a: a.rule.summary))})
    return df.select(key, "line", "column", "end_line", "end_column", "severity", "rule", "message", "suggestion", "start", "end", "n", "detail")


def message(summary: Column) -> Column:
    count = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    about = F.when(F.col("detail") != "", F.concat(F.lit(": "), F.col("detail"))).otherwise(F.lit(""))
    return F.concat(summary, count, about)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).when(severity == "info", 0).otherwise(-1)


def ordered(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """By document, place, severity (worst first) and rule."""
    return findings.orderBy(*_order(key))


def _order(key: str) -> list:
    return [key, "start", severity_rank(F.col("severity")).desc(), "rule"]


def lint_in_order(docs: DataFrame, rules: Sequence[Active] | None = None, key: str = "doc_id") -> DataFrame:
    """ordered(lint(docs)): the documents are dealt out by ranges of their key before, since to range findings Spark would lint all twice."""
    return lint(docs.select(key, "text").repartitionByRange(key), rules, key).sortWithinPartitions(*_order(key))


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings, errors, warnings, infos."""
    level = lambda x: F.count_if(F.col("severity") == x)
    return findings.agg(F.count(F.lit(1)).alias("findings"), level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("infos"))


def verdicts(docs: DataFrame, findings: DataFrame, fail_level: str = "warning", key: str = "doc_id") -> DataFrame:
    """(key, findings, worst, failed) of every document, also those without findings."""
    if fail_level not in FAIL_LEVELS:
        raise ValueError(f"not a fail level: {fail_level!r}")
    worst = findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    out = docs.select(key).join(worst, key, "left").fillna({"findings": 0, "worst": -1})
    failed = F.lit(False) if fail_level == "none" else F.col("worst") >= rank(fail_level)
    return out.withColumn("failed", failed)


def failed(findings: DataFrame, fail_level: str = "warning") -> bool:
    """Whether any finding reaches the level."""
    if fail_level == "none":
        return False
    return not findings.where(severity_rank(F.col("severity")) >= rank(fail_level)).isEmpty()


def rules_table(spark, rules: Sequence[Active] | None = None) -> DataFrame:
    """The catalogue: id, recommended, strict, summary; with rules, also severity and options."""
    own = {a.rule.id: a for a in rules or ()}
    rows = [(r.id, r.recommended, r.strict or r.recommended, r.summary, own[r.id].severity if own else None, {k: float(v) for k, v in own[r.id].options.items()} if own else None) for r in RULES]
    return spark.createDataFrame(rows, "id string, recommended string, strict string, summary string, severity string, options map<string,double>")
