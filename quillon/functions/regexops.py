"""Regular-expression building blocks that stay in the JVM: positions, masks, words, white space.

All offsets count code points from 0; spans are half open.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is (ASCII letters only). Possessive, since giving back never helps.
WORD = r"[A-Za-z0-9]++(?:[’'][A-Za-z0-9]++)*+(?:-[A-Za-z0-9]++)*+"
SPACE = r"(?U)\s"
#: Unicode's white space, for Python, whose own also has the separators 1C to 1F.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPANS = "array<struct<start:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def i_forms(pattern: str) -> str:
    """The pattern with dotted and dotless I taken for i, in and out of classes."""
    out = []
    for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.S):
        if token[0] == "[" and len(token) > 1:
            token = token.replace("[A-Za-z", "[İıA-Za-z").replace("[A-Z]", "[İıA-Z]")
        elif token in "iI":
            token = "[iİı]"
        out.append(token)
    return "".join(out)


def insensitive(pattern: str) -> str:
    """For Java: Unicode case folding and character classes."""
    return "(?iuU)" + i_forms(pattern)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def find_spans(text: Column, pattern: str) -> Column:
    """Spans of all matches, left to right; the pattern never matches nothing.

    Texts without a match, the most, cost one search.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(more).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, zero, step, lambda acc: acc["out"])).otherwise(no_spans())


def mask_matches(text: Column, pattern: str) -> Column:
    """text with every match blanked but for its line ends; the length stays."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.zip_with(gaps, hits, lambda g, m: F.concat(g, F.regexp_replace(F.coalesce(m, F.lit("")), r"[^\r\n]", " ")))
    return F.when(text.rlike(pattern), F.array_join(blank, "")).otherwise(text)


def cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def without_overlaps(spans: Column) -> Column:
    """Spans by start, the longest first; each that begins before the last kept one ends is dropped."""
    by = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    zero = F.struct(F.lit(0).alias("last"), no_spans().alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        more = F.struct(end.alias("last"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), end.alias("end")))).alias("out"))
        return F.when(s["start"] < acc["last"], acc).otherwise(more)

    return F.aggregate(by, zero, step, lambda acc: acc["out"])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def stripped(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s++", ""), r"(?U)(?<!\s)\s++\z", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s++", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of an offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of an offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1
