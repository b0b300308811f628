"""Suppression: comments that switch rules off, as scopes of lines, and the hooks' own line directives.

A scope says which selector holds from which line to which. A `disable` opens a
scope on the next line that its `enable` closes; `disable-next-line` and
`ignore` are scopes of one line. A finding is dropped where some scope of its
first line selects its rule, so the state of a file is never replayed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.regexops import cut, find_spans, let, line_of

#: Names that directives begin with; other tools' directives are read by giving theirs.
TOOL, HOOKS = "quillon", "quillon-hook"
# The directives' form.
DIRECTIVE = r"(?iU)<!--\s*+{tool}-(disable-next-line|disable|enable|ignore)(?:[^\S\n]++([^>\n]*?))?[^\S\n]*+-->"
LINE_DIRECTIVE = r"<!--\s*{tool}-(disable-line|disable|enable)\b((?:[ ,]+[a-z0-9]+(?:-[a-z0-9]+)*)*)\s*(?=--|$)"
FOREVER = 2**31 - 1
SCOPES = "array<struct<selector:string,from:int,to:int>>"


def pattern(form: str, tool: str) -> str:
    """A directive's pattern for one tool."""
    return form.replace("{tool}", re.escape(tool))


def directives(text: Column, tool: str = TOOL) -> Column:
    """array<struct<line, kind, everything, tokens>> in order."""
    form = pattern(DIRECTIVE, tool)

    def of(s: Column) -> Column:
        hit = cut(text, s)
        value = F.coalesce(F.regexp_extract(hit, form, 2), F.lit(""))
        tokens = F.array_distinct(F.filter(F.split(value, r"(?U)[\s,]+", -1), lambda t: t != ""))
        every = (F.size(tokens) == 0) | F.arrays_overlap(tokens, F.array(F.lit("*"), F.lit("all")))
        return F.struct(line_of(text, s["start"]).alias("line"), F.lower(F.regexp_extract(hit, form, 1)).alias("kind"), every.alias("everything"), F.when(every, F.array(F.lit("*"))).otherwise(tokens).alias("tokens"))

    return F.transform(find_spans(text, form), of)


def scopes(text: Column, tool: str = TOOL) -> Column:
    """SCOPES of a text (the `suppression` view)."""

    def all_(own: Column) -> Column:
        def of(d: Column, i: Column) -> Column:
            def one(token: Column) -> Column:
                ends = F.filter(own, lambda x, j: (j > i) & (x["kind"] == "enable") & (x["everything"] | F.array_contains(x["tokens"], token)))
                last = F.coalesce(F.get(ends, F.lit(0))["line"], F.lit(FOREVER))
                single = d["line"] + (d["kind"] == "disable-next-line").cast("int")
                lasting = d["kind"] == "disable"
                return F.struct(token.alias("selector"), F.when(lasting, d["line"] + 1).otherwise(single).alias("from"), F.when(lasting, last).otherwise(single).alias("to"))

            return F.when(d["kind"] == "enable", F.array().cast(SCOPES)).otherwise(F.transform(d["tokens"], one))

        return F.flatten(F.transform(own, of))

    return F.when(text.contains("<!--"), let(directives(text, tool), all_)).otherwise(F.array().cast(SCOPES))


def selects(selector: Column, rule: Column) -> Column:
    return (selector == "*") | (selector == rule) | (selector.endswith(".*") & rule.startswith(F.substring(selector, F.lit(1), F.length(selector) - 1)))


def suppressed(all_scopes: Column, line: Column, rule: Column) -> Column:
    return F.exists(all_scopes, lambda s: (s["from"] <= line) & (s["to"] >= line) & selects(s["selector"], rule))


def hook_lines(lines: DataFrame, hook: str, key: str = "doc_id", tool: str = HOOKS) -> DataFrame:
    """lines (key, line, text) with `suppressed` for one hook, by its line directives.

    Documents without a directive have one cheap scan and a running flag; the
    shuffle by document carries only the lines given.
    """
    form = pattern(LINE_DIRECTIVE, tool)
    found = F.regexp_extract_all("text", F.lit(form), F.lit(0))
    named = lambda d: F.filter(F.split(F.regexp_extract(d, form, 2), "[ ,]+", -1), lambda x: x != "")
    mine = F.filter(found, lambda d: (F.size(named(d)) == 0) | F.array_contains(named(d), hook))
    own = F.when(F.col("text").contains(f"{tool}-"), mine).otherwise(F.array().cast("array<string>"))
    kinds = F.filter(F.transform(own, lambda d: F.regexp_extract(d, form, 1)), lambda k: k != "disable-line")
    marked = lines.withColumn("_own", F.size(own) > 0).withColumn("_turn", F.get(kinds, F.size(kinds) - 1) == "disable")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("_turn", ignorenulls=True).over(before), F.lit(False))
    return marked.withColumn("suppressed", F.col("_own") | state).drop("_own", "_turn")
