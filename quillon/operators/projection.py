"""Markdown projection: same-length views of a text with syntax blanked out.

`visible` is what a reader sees as prose; `structural` also lacks headings and
list items; `suppression` still has the comments that hold directives. Block
and inline syntax depends on what came before it, so this is the one pass in
Python, Arrow batch by batch; texts without any character that could start
such syntax are not sent there at all.

Blanking is kept as two flag arrays over the code points, and both views are
made from them at the end. A pattern is searched for only in texts that hold
the characters without which it can't match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batches import piecewise
from quillon.functions.regexops import WHITE, i_forms, unix_lines

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
PROJECTION = pa.struct([("visible", pa.string()), ("structural", pa.string()), ("suppression", pa.string()), ("headings", pa.list_(SPAN)), ("bold", pa.list_(SPAN)), ("parenthetical", pa.list_(SPAN))])
VIEWS, SPANS = ("visible", "structural", "suppression"), ("headings", "bold", "parenthetical")

#: A text without any of these is its own projection.
TRIGGER = r"(?imu)[`~<>#|\[$\\*_(]|^ {0,3}[-=]|^(?: {4}|\t)|^[\p{IsWhite_Space}&&[^\n]]*+(?:(?:[-+]|\p{Nd}+[.)]|import|export)\p{IsWhite_Space})|https?:|www\."

#: The same for Python: any of the characters, or a line that begins so.
LINES = re.compile("[\n\x85\u2028\u2029]")
MARKS, LEADS = re.compile(r"[`~<>#|\[$\\*_(]"), re.compile(rf"(?i) {{0,3}}[-=]| {{4}}|\t|[{WHITE}]*+(?:[-+]|\d+[.)]|import|export)(?:[{WHITE}]|\Z)")

S, NS = r"\p{White_Space}", r"\P{White_Space}"
FENCE = regex.compile(r"^ {0,3}(`{3,}|~{3,})")
RAW_OPEN = regex.compile("(?i)" + i_forms(r"<(pre|script|style|code)\b[^>]*>"))
SEPARATOR = regex.compile(rf"^{S}*\|?{S}*:?-{{3,}}:?{S}*(?:\|{S}*:?-{{3,}}:?{S}*)+\|?{S}*$")
UNDERLINE = regex.compile(rf"^ {{0,3}}(?:=+|-+){S}*$")
EXCLUDED = regex.compile(rf"^ {{0,3}}>|^(?: {{4}}|\t)|^{S}*(?:import|export){S}+|^ {{0,3}}\[[^\]]+\]:{S}*{NS}+|^ {{0,3}}(?:(?:\*{S}*){{3,}}|(?:-{S}*){{3,}}|(?:_{S}*){{3,}})$")
HEADING = regex.compile(r"^ {0,3}#{1,6}(?:[ \t]+|$)")
ITEM = regex.compile(rf"^{S}*(?:[-+*]|\d+[.)]){S}+")
CODE_TOKEN = regex.compile(r"<!--|`+")
IMAGE = regex.compile(r"!\[[^\]]*\]\([^\n)]*\)")
LINK = regex.compile(r"\[[^\]\n]+\](\([^\n)]*\))")
ADDRESSES = [regex.compile(r"(?i)<(?:(?:https?|mailto):[^>]+)>"), regex.compile(rf"(?i)\b(?:https?://|www\.)[^{S}<>()]+"), regex.compile(r"</?[A-Za-z][^>\n]*>")]
MATH = regex.compile(
    r"<!--(?:(?s:.*?)-->|(?s:.*))"  # a comment: skipped
    r"|(?P<math>\\\((?:[^\\\n]|\\[^)\n])*+\\\)"
    r"|\\\[(?:[^\\]|\\[^\]])*+\\\]"
    r"|\$\$(?:[^\\$]|\\[\S\s]|\$(?!\$))*+\$\$"
    rf"|\$(?![$]|{S})(?:[^\\$\n]|\\[^\n]|\$(?<={S}\$)|\$(?=[0-9]))*+\$)"
    rf"|\\\([^\n]*+|(?:\\\[|\$\$)(?s:.*)|\$(?![$]|{S})[^\n]++"  # never closed: the rest of the line, or of the text
    r"|\\(?=<!--)|\\[\S\s]"  # an escaped character
)
COMMENT = regex.compile(r"(?s)<!--.*?-->")
BOLD_OPEN = regex.compile(rf"(?<!\\)([*_])\1(?={NS})")
BOLD_CLOSE = {c: regex.compile(rf"(?<={NS}){regex.escape(c * 2)}") for c in "*_"}
ASIDE = regex.compile(r"\([^()\n]{2,120}\)")
REFERENCE = regex.compile(r"\([A-Za-z]*[0-9]+[A-Za-z]?\)")


def _paired(text: str, opener: regex.Pattern, closer: Callable[[str], regex.Pattern], again: int | None, shift: int = 0) -> Iterator[tuple[int, int]]:
    """Spans from an opener to its next closer; a kind of which no closer is left is not looked for again.

    again: how far behind the start of a lone opener the search goes on; None: at its end.
    """
    dead, at = set(), 0
    while m := opener.search(text, at):
        kind = m[1].lower()
        end = None if kind in dead else closer(kind).search(text, m.end() + shift)
        if end is None:
            dead.add(kind)
            at = m.end() if again is None else m.start() + again
        else:
            yield m.start(), end.end()
            at = end.end()


def _raw_close(kind: str) -> regex.Pattern:
    return regex.compile(rf"(?i){i_forms(f'</{kind}')}{S}*>")


class Views:
    """The flags of one text: what is blanked in `visible` and in `structural`."""

    def __init__(self, text: str):
        self.text = text
        self.hidden, self.unstructured = np.zeros(len(text), bool), np.zeros(len(text), bool)
        self.headings: list[tuple[int, int]] = []
        self.lines: list[tuple[int, int]] = []
        at = 0
        for line in text.split("\n"):
            self.lines.append((at, at + len(line)))
            at += len(line) + 1

    def blank(self, start: int, end: int) -> None:
        self.hidden[start:end] = self.unstructured[start:end] = True

    def blank_all(self, pattern: regex.Pattern, *needs: str) -> None:
        if any(x in self.text for x in needs):
            for m in pattern.finditer(self.text):
                self.blank(*m.span())

    def view(self, flags: np.ndarray) -> str:
        if not flags.any():
            return self.text
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        return np.where(flags & (points != 10) & (points != 13), np.uint32(32), points).astype("<u4").tobytes().decode("utf-32-le")

    def blocks(self) -> None:
        texts = [self.text[a:b] for a, b in self.lines]
        bare = [not t.strip() for t in texts]
        self._front_matter(texts)
        if "```" in self.text or "~~~" in self.text:
            self._fences(texts)
        for start, end in _paired(self.text, RAW_OPEN, _raw_close, None) if "<" in self.text else ():
            self.blank(start, end)
        separators = [bool(SEPARATOR.match(t)) if "-" in t and "|" in t else False for t in texts]
        rows, inside = list(separators), False
        for i, t in enumerate(texts):
            if separators[i] and i and "|" in texts[i - 1]:
                rows[i - 1] = True
            inside = (inside and not bare[i] and "|" in t) or separators[i]
            rows[i] = rows[i] or inside
        under = [i > 0 and not bare[i - 1] and t[:4].lstrip(" ")[:1] in ("=", "-") and bool(UNDERLINE.match(t)) for i, t in enumerate(texts)]
        self.headings += [self.lines[i - 1] for i, u in enumerate(under) if u]
        for i, t in enumerate(texts):
            a, b = self.lines[i]
            title = i + 1 < len(under) and under[i + 1]
            if bare[i] or not self._seen(a, b).strip():
                continue
            if rows[i] or under[i] or (not title and EXCLUDED.match(t)):
                self.blank(a, b)
            elif title:
                self.unstructured[a:b] = True
            elif m := HEADING.match(t):
                self.headings.append((a, b))
                self.unstructured[a:b] = True
                self.hidden[a : a + m.end()] = True
            elif m := ITEM.match(t):
                self.unstructured[a:b] = True
                self.hidden[a : a + m.end()] = True

    def _seen(self, a: int, b: int) -> str:
        return self.text[a:b] if not self.hidden[a:b].any() else "".join(" " if h else c for c, h in zip(self.text[a:b], self.hidden[a:b], strict=True))

    def _front_matter(self, texts: list[str]) -> None:
        if texts[0].strip() == "---":
            for i, t in enumerate(texts[1:200], 1):
                if t.strip() in ("---", "..."):
                    self.blank(0, self.lines[i][1])
                    return

    def _fences(self, texts: list[str]) -> None:
        mark, begun = "", 0
        for t, (a, b) in zip(texts, self.lines, strict=True):
            if mark:
                run = t.rstrip()
                bare = run.lstrip(" ")
                if len(run) - len(bare) <= 3 and len(bare) >= len(mark) and bare == mark[0] * len(bare):
                    self.blank(begun, b)
                    mark = ""
            elif m := FENCE.match(t):
                mark, begun = m[1], a
        if mark:
            self.blank(begun, len(self.text))

    def inline(self) -> None:
        at = 0 if "`" in self.text else len(self.text)
        while m := CODE_TOKEN.search(self.text, at):
            at = m.end()
            if m[0] == "<!--":
                end = self.text.find("-->", at)
                at = len(self.text) if end < 0 else end + 3
            elif not self.hidden[m.start()]:
                end = self.text.find(m[0], at)
                if end >= 0:
                    at = end + len(m[0])
                    self.blank(m.start(), at)
        self.blank_all(IMAGE, "![")
        for m in LINK.finditer(self.text) if "](" in self.text else ():
            if self.text[m.start() - 1 : m.start()] != "!":
                self.blank(*m.span(1))
        low = folded(self.text)
        for pattern, needs in zip(ADDRESSES, (("http", "mailto"), ("http", "www."), ("<",)), strict=True):
            if any(x in low for x in needs):
                self.blank_all(pattern, "")

    def math(self) -> None:
        for m in MATH.finditer(self.view(self.hidden)) if any(x in self.text for x in ("$", "\\(", "\\[")) else ():
            if m["math"] is not None:
                a, b = m.span()
                self.blank(a, b)
                self.headings = [h for h in self.headings if not a <= h[0] < b]


def folded(text: str) -> str:
    """In lower case, as far as patterns tell letters apart; offsets may differ."""
    low = text.lower()
    return low if text.isascii() else low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


def triggered(text: str) -> bool:
    """As TRIGGER, for a text with \\n line ends."""
    if MARKS.search(text):
        return True
    low = folded(text)
    return "http:" in low or "https:" in low or "www." in low or any(map(LEADS.match, LINES.split(text)))


def _unmarked(view: str) -> str:
    return view.replace("*", " ").replace("_", " ").replace("`", " ")


def project(text: str) -> dict:
    """All views and spans of one text with \\n line ends."""
    v = Views(text)
    v.blocks()
    v.inline()
    v.math()
    seen = suppression = v.view(v.hidden)
    if "<!--" in text:
        v.blank_all(COMMENT, "")
        seen = v.view(v.hidden)
    bold = [s for s in _paired(seen, BOLD_OPEN, BOLD_CLOSE.__getitem__, 1, 1) if "\n\n" not in seen[s[0] : s[1]]] if "**" in seen or "__" in seen else []
    asides = [m.span() for m in ASIDE.finditer(seen) if not REFERENCE.fullmatch(m[0])]
    visible = _unmarked(seen)
    spans = lambda all_: [{"start": a, "end": b} for a, b in all_ if visible[a:b].strip()]
    headings = [{"start": a, "end": b} for a, b in sorted(v.headings, key=lambda h: h[0])]
    return {"visible": visible, "structural": _unmarked(v.view(v.unstructured)), "suppression": suppression, "headings": headings, "bold": spans(bold), "parenthetical": spans(asides)}


def plain_views(text: str) -> dict:
    """What project gives for a text without any syntax."""
    return {"visible": text, "structural": text, "suppression": text, "headings": [], "bold": [], "parenthetical": []}


def read(text: str | None) -> tuple[str, dict]:
    """A text with \\n line ends, and its views and spans; null counts as empty."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    return text, project(text) if triggered(text) else plain_views(text)


def _projected(texts: list[str | None], wanted: tuple[str, ...]) -> pa.Array:
    kind = pa.struct([f for f in PROJECTION if f.name in wanted])
    each = [None if t is None or not triggered(t) else project(t) for t in texts]
    return pa.array([p and {name: p[name] for name in wanted} for p in each], kind)


def projected(docs: DataFrame, text: Column | None = None, wanted: tuple[str, ...] = (*VIEWS, *SPANS)) -> DataFrame:
    """docs with text's line ends made \\n and the views and spans (or only those wanted) as columns; null counts as empty."""
    text = F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit(""))
    df = docs.withColumn("text", F.when(F.instr(text, "\r") > 0, unix_lines(text)).otherwise(text))
    ddl = ",".join(f"{name}:{'string' if name in VIEWS else 'array<struct<start:int,end:int>>'}" for name in wanted)
    df = df.withColumn("_p", piecewise(lambda texts: _projected(texts, wanted), f"struct<{ddl}>")("text"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    for name in wanted:
        df = df.withColumn(name, F.coalesce(F.col("_p")[name], F.col("text") if name in VIEWS else none))
    return df.drop("_p")
