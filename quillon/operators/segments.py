"""Lines, paragraphs, sentences and sections as arrays with offsets, and as tables.

Paragraphs and sentences come from one linear Arrow pass over each text; a
native fold over sentences copies its result at each step, which is quadratic
in long documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batches import piecewise
from quillon.functions.regexops import WHITE, WORD, column_of, line_of, word_count
from quillon.operators.projection import read

# Abbreviations whose dot ends no sentence, and what may close one.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "vs.", "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "fig.", "no."]
CLOSERS = ".!?\"'”’)]"

S, NS, GAP = r"\p{White_Space}", r"\P{White_Space}", r"[\p{White_Space}--\n]"
PARAGRAPH = regex.compile(rf"(?V1m)^{GAP}*+{NS}[^\n]*+(?:\n{GAP}*+{NS}[^\n]*+)*+")
#: The dot is tried before the looks behind, which then run at dots only.
SENTENCE_END = regex.compile(r"(?i)(?:[!?]|\.(?<!(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + rf"))(?<!\b[a-z]\.))[{re.escape(CLOSERS)}]*+(?={S}|\Z)")
#: Where a sentence may end; what precedes a lone dot decides.
ENDS, ABBREVIATED = re.compile(rf"[.!?][{re.escape(CLOSERS)}]*+(?=[{WHITE}]|\Z)"), tuple(ABBREVIATIONS)
SPACES, UNEVEN = re.compile(rf"[{WHITE}]++"), re.compile(rf"[{WHITE.replace(' ', '')}]|  ")
WORDS = re.compile(WORD)
UNIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("opener", pa.string()), ("section", pa.int32())])
SEGMENTS = "struct<paragraphs:array<struct<start:int,end:int,text:string,words:int,opener:string,section:int>>,sentences:array<struct<start:int,end:int,text:string,words:int,opener:string,section:int>>>"


def _opener(words: list[str]) -> str | None:
    return " ".join(words[:2]).lower().replace("’", "'") if len(words) > 1 else None


def _counted(text: str) -> tuple[int, str | None]:
    """A unit's number of words, and its first two in lower case."""
    words = WORDS.findall(text)
    return len(words), _opener(words)


def _begun(text: str) -> tuple[int, str | None]:
    """As _counted, with at most four words counted."""
    words = [m[0] for m in islice(WORDS.finditer(text), 4)]
    return len(words), _opener(words)


def paragraphs(text: str, count: bool = True) -> list[tuple]:
    """(start, end, text, words, opener) of the runs of lines that are not blank, of four words or more; without count, words is 4."""
    found = ((m.start(), m.end(), m[0], *(_counted if count else _begun)(m[0])) for m in PARAGRAPH.finditer(text))
    return [p for p in found if p[3] >= 4]


def _ends(text: str, at: int, to: int) -> bool:
    """Whether a run of marks from a dot on holds an end: not if its only dots close abbreviations or initials."""
    tail = text[max(0, at - 8) : at + 1]
    if tail[-1] != ".":
        return True
    if to - at > 1 or not tail.isascii():
        return bool(SENTENCE_END.search(text, at, to) if to == len(text) else SENTENCE_END.search(text, at, to + 1))
    letter = len(tail) > 1 and tail[-2].isalpha() and not (len(tail) > 2 and (tail[-3].isalnum() or tail[-3] == "_"))
    return not letter and not tail.lower().endswith(ABBREVIATED)


def sentences(paragraph: str, at: int) -> list[tuple]:
    """(start, end, text on one line, words, opener) of a paragraph's sentences; what follows the last full stop is none."""
    out, a, uneven = [], 0, UNEVEN.search(paragraph)
    for m in ENDS.finditer(paragraph):
        b = m.end()
        if not _ends(paragraph, m.start(), b):
            continue
        own = paragraph[a:b].lstrip(WHITE)
        a = b
        words = WORDS.findall(own)
        if words:
            out.append((at + b - len(own), at + b, SPACES.sub(" ", own) if uneven and UNEVEN.search(own) else own, len(words), _opener(words)))
    return out


def _units(each: list[list[tuple]], heads: list[list[int]], fields: tuple[str, ...] = tuple(f.name for f in UNIT)) -> pa.Array:
    """Units of all texts as one array of lists, with the number of headings that start at or before each."""
    flat = [u for own in each for u in own]
    columns = dict(zip(("start", "end", "text", "words", "opener"), [list(x) for x in zip(*flat, strict=True)] if flat else [[] for _ in range(5)], strict=True))
    columns["section"] = [bisect_right(h, u[0]) if h else 0 for own, h in zip(each, heads, strict=True) for u in own]
    kinds = [UNIT.field(name) for name in fields]
    offsets = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], fields=kinds))


def _segmented(structural: list[str], headings: list[list[dict]]) -> pa.Array:
    heads = [sorted(h["start"] for h in own or ()) for own in headings]
    large = [paragraphs(t or "") for t in structural]
    small = [[s for p in own for s in sentences(p[2], p[0])] for own in large]
    return pa.StructArray.from_arrays([_units(large, heads), _units(small, heads)], names=["paragraphs", "sentences"])


def segmented(df: DataFrame) -> DataFrame:
    """A projected DataFrame with the columns paragraphs, sentences (start, end, text, words, section) and n_words."""
    df = df.withColumn("_s", piecewise(_segmented, SEGMENTS)("structural", "headings"))
    df = df.withColumns({"paragraphs": F.col("_s.paragraphs"), "sentences": F.col("_s.sentences")}).drop("_s")
    return df.withColumn("n_words", word_count(F.col("visible")))


def _read_units(texts: list[str | None], units: str, fields: tuple[str, ...]) -> pa.Array:
    views = [read(t)[1] for t in texts]
    own = [paragraphs(v["structural"], units == "paragraphs" and "words" in fields) for v in views]
    if units == "sentences":
        own = [[s for p in ps for s in sentences(p[2], p[0])] for ps in own]
    return _units(own, [[h["start"] for h in v["headings"]] for v in views], fields)


def units_of(docs: DataFrame, units: str, *fields: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraphs or sentences with these fields): projected and segmented in one pass, of which nothing else returns."""
    ddl = ",".join(f"{f}:{'string' if f in ('text', 'opener') else 'int'}" for f in fields)
    return docs.select(key, piecewise(lambda texts: _read_units(texts, units, fields), f"array<struct<{ddl}>>")(F.col(text).cast("string")).alias(units))


def lines_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, text) of the lines that \\n parts; the last one always counts."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def words_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, word) of all words."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0))).alias("idx", "word"))


def units_table(df: DataFrame, units: str, key: str = "doc_id") -> DataFrame:
    """(key, idx, start, end, text, words, section) of paragraphs or sentences."""
    return df.select(key, F.posexplode(units).alias("idx", "u")).select(key, "idx", "u.*")


def located(df: DataFrame, text: str = "text") -> DataFrame:
    """line, column, end_line and end_column of start and end."""
    t, last = F.col(text), F.greatest(F.col("start"), F.col("end") - 1)
    return df.withColumns({"line": line_of(t, F.col("start")), "column": column_of(t, F.col("start")), "end_line": line_of(t, last), "end_column": column_of(t, last) + 1})
