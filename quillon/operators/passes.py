"""Lint of one text at a time in plain Python: views, segments, searches, checkers, places and suppression.

One Arrow pass does all of it for a piece of rows, and only findings go back to
Spark. What the checkers find is what the expressions of `checks` find on a
segmented document (tests hold one against the other); there the text, its
views and its sentences go to and from Python three times, and each finding
takes its text along to be counted again.

A search runs only in texts that hold one of the strings without which it can't
match.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property
from re import _parser

import pyarrow as pa
import regex

from quillon.functions.regexops import i_forms
from quillon.operators.checks import LOADED, PARAGRAPHS, SEARCHES, SENTENCES, STRUCTURAL, TRANSITIONS, VISIBLE, _named, searches
from quillon.operators.projection import folded, read
from quillon.operators.segments import WORDS, paragraphs, sentences
from quillon.operators.suppress import DIRECTIVE, FOREVER, TOOL, pattern

WHITE = r"\p{White_Space}"
CLAUSE_SPLIT, LIST_SPLIT, LIST_END = re.compile(r" *+[,;] *+(?:(?:and|or) ++)?"), re.compile(r", *(?:and|or +)?| +(?:and|or) +"), re.compile(r"(?i), *(?:and|or) +")
NO = regex.compile(rf"(?i)\bno{WHITE}+")
LEAD = regex.compile(rf"{WHITE}*+")
LABELS = {name: regex.compile("(?i)" + i_forms(form)) for name, form in LOADED.items()}
KINDS = {"rule_no": pa.int32(), "start": pa.int32(), "end": pa.int32(), "n": pa.int32(), "detail": pa.string(), "line": pa.int32(), "column": pa.int32(), "end_line": pa.int32(), "end_column": pa.int32()}
FOUND = pa.struct(list(KINDS.items()))
FOUND_DDL = "array<struct<rule_no:int,start:int,end:int,n:int,detail:string,line:int,column:int,end_line:int,end_column:int>>"
#: start, end, n and detail, as in checks.FINDINGS; start, end of a span.
Finding, Span = tuple[int, int, int, str], tuple[int, int]


def needed(form: str) -> list[str]:
    """Strings in lower case of which every match holds one; "" if nothing is known."""

    def of(items) -> list[str]:
        sets, run = [], ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(value).lower()
                continue
            if run:
                sets.append([run])
                run = ""
            if name == "SUBPATTERN":
                sets.append(of(value[3]))
            elif name == "BRANCH":
                sets.append([x for branch in value[1] for x in of(branch)])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                sets.append(of(value[2]))
        return max(sets, key=lambda own: (min(map(len, own)), -len(own)), default=[""])

    return of(_parser.parse(form))


def finder(form: str) -> Callable[[str, str], list[Span]]:
    """Spans of a pattern's matches in a text, given that text in lower case."""
    compiled, needs = regex.compile("(?i)" + i_forms(form).replace(r"\s", WHITE)), needed(form)

    def find(text: str, low: str) -> list[Span]:
        for x in needs:
            if x in low:
                return [m.span() for m in compiled.finditer(text)]
        return []

    return find


class Doc:
    """One text as the checkers see it; each part is made when it is first asked for."""

    def __init__(self, text: str | None, finders: dict[str, tuple[str, Callable]]):
        self.text, views = read(text)
        self.visible, self.structural, self.suppression = views[VISIBLE], views[STRUCTURAL], views["suppression"]
        self.spans = {name: [(s["start"], s["end"]) for s in views[name]] for name in ("headings", "bold", "parenthetical")}
        self.finders = finders

    @cached_property
    def low(self) -> dict[str, str]:
        visible = folded(self.visible)
        return {VISIBLE: visible, STRUCTURAL: visible if self.structural == self.visible else folded(self.structural)}

    @cached_property
    def heads(self) -> list[int]:
        return [a for a, _ in self.spans["headings"]]

    @cached_property
    def paragraphs(self) -> list[tuple]:
        """(start, end, text, words up to four, opener)"""
        return paragraphs(self.structural, count=False)

    @cached_property
    def sentences(self) -> list[tuple]:
        """(start, end, text, words, opener)"""
        return [s for p in self.paragraphs for s in sentences(p[2], p[0])]

    def section(self, unit: tuple) -> int:
        """The number of headings that start at or before a unit."""
        return bisect_right(self.heads, unit[0]) if self.heads else 0

    @cached_property
    def n_words(self) -> int:
        return sum(1 for _ in WORDS.finditer(self.visible))

    @cached_property
    def ends(self) -> list[int]:
        """Where lines end."""
        return [m.start() for m in re.finditer("\n", self.text)]

    def hits(self, name: str) -> list[Span]:
        view, find = self.finders[name]
        return find(getattr(self, view), self.low[view])

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column from 1."""
        line = bisect_right(self.ends, offset - 1)
        return line + 1, offset - (self.ends[line - 1] + 1 if line else 0) + 1


def word_indexes(text: str, offsets: list[int]) -> list[int]:
    """For ascending offsets, the index of the last word that starts at or before each (as windows.word_indexes)."""
    out, total, before = [], 0, None
    for o in offsets:
        part = text[before or 0 : o + 1]
        total += sum(1 for _ in WORDS.finditer(part))
        if before is not None and part[:1].isascii() and part[:1].isalnum():
            total -= 1
        out.append(max(total - 1, 0))
        before = o
    return out


def index_clusters(index: list[int], most: int, window: int) -> list[Span]:
    """Disjoint groups [l, r) (as windows.index_clusters)."""
    reset, left, out = 0, -1, []
    for r, at in enumerate(index):
        if left >= 0:
            if at - index[left] <= window:
                continue
            out.append((left, r))
            reset = r
        left = r - most if r - reset >= most and at - index[r - most] <= window else -1
    return [*out, (left, len(index))] if left >= 0 else out


def clusters(doc: Doc, offsets: list[int], options: dict) -> list[tuple[int, int, int]]:
    """(start, last, n): start is the first offset over the budget."""
    most = options["max"]
    if len(offsets) <= most:
        return []
    own = sorted(set(offsets))
    groups = index_clusters(word_indexes(doc.visible, own), most, options["window_words"])
    return [(own[a + most], own[b - 1], b - a) for a, b in groups]


def equal_runs(keys: list, least: int) -> list[tuple[int, int]]:
    """First and last of runs of at least `least` equal neighbours; None equals nothing."""
    out, at = [], 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            if i - at >= least and keys[at] is not None:
                out.append((at, i - 1))
            at = i
    return out


def window_repeats(keys: list, taken: set[int], window: int, least: int) -> list[list[int]]:
    """Members of each group of equal keys within `window` places from a start; they are taken in order and serve once."""
    often = {k for k, n in Counter(keys).items() if k is not None and n >= least}
    out = []
    for i, key in enumerate(keys):
        if key in often and i not in taken:
            own = [j for j in range(i, min(len(keys), i + window)) if keys[j] == key and j not in taken]
            if len(own) >= least:
                out.append(own)
                taken.update(own)
    return out


def density(doc: Doc, offsets: list[int], options: dict) -> Iterator[Finding]:
    return ((a, b + 1, n, "") for a, b, n in clusters(doc, offsets, options))


def to_last_span(doc: Doc, spans: list[Span], options: dict) -> Iterator[Finding]:
    ends = dict(reversed(spans))  # of equal starts the first counts
    return ((a, ends[b], n, "") for a, b, n in clusters(doc, [a for a, _ in spans], options))


def matched(doc: Doc, name: str) -> list[Finding]:
    return [(a, b, 1, doc.visible[a:b]) for a, b in doc.hits(name)]


def negative_parallelism(doc: Doc, options: dict) -> Iterator[Finding]:
    kept, last = [], 0
    for a, b in sorted((s for name in SEARCHES["negative_parallelism"] for s in doc.hits(name)), key=lambda s: (s[0], -s[1])):
        if a >= last:
            kept.append((a, b))
            last = b
    return to_last_span(doc, kept, options)


def no_chain(doc: Doc, options: dict) -> Iterator[Finding]:
    counted = ((a, b, len(NO.findall(detail)), detail) for a, b, _, detail in matched(doc, "no_chain"))
    return (f for f in counted if f[2] >= options["minimum_items"])


def question_density(doc: Doc, options: dict) -> Iterator[Finding]:
    return density(doc, [s[0] for s in doc.sentences if s[2].endswith("?")], options)


def question_answer(doc: Doc, options: dict) -> Iterator[Finding]:
    pairs = zip(doc.sentences, doc.sentences[1:], strict=False)
    turns = [(s[0], t[1]) for s, t in pairs if s[2].endswith("?") and t[3] <= options["answer_max_words"] and not t[2].endswith("?") and doc.section(s) == doc.section(t)]
    return to_last_span(doc, turns, options)


def echoed_clauses(doc: Doc, options: dict) -> Iterator[Finding]:
    least, most = options["minimum_clauses"], options["maximum_clauses"]

    def often(keys: list[str]) -> str | None:
        return next((k for k in dict.fromkeys(keys) if keys.count(k) >= least), None)

    for start, end, text, *_ in doc.sentences:
        if text.count(",") + text.count(";") >= least - 1:
            pieces = [own for p in CLAUSE_SPLIT.split(text) if len(own := WORDS.findall(p)) >= 3]
            if least <= len(pieces) <= most:
                key = often([" ".join(p[:2]).lower() for p in pieces])
                key = often([" ".join(p[-2:]).lower() for p in pieces]) if key is None else key
                if key is not None and not re.search(r"\d", key):
                    yield start, end, len(pieces), key


def tricolon_density(doc: Doc, options: dict) -> Iterator[Finding]:
    def three(text: str) -> bool:
        if text.count(",") != 2 or not LIST_END.search(text):
            return False
        pieces = [p for p in LIST_SPLIT.split(text) if p.strip(" ")]
        return len(pieces) == 3 and all(1 <= len(WORDS.findall(p)) <= 8 for p in pieces)

    return density(doc, [a for a, _ in doc.hits("colon_list")] + [s[0] for s in doc.sentences if three(s[2])], options)


def openers(doc: Doc, units: list[tuple], options: dict, window: int) -> Iterator[Finding]:
    keys = [u[4] and (doc.section(u), u[4]) for u in units] if doc.heads else [u[4] for u in units]
    runs = equal_runs(keys, options["consecutive"])
    taken = {i for a, b in runs for i in range(a, b + 1)}
    groups = [(a, a + 1, b, b - a + 1) for a, b in runs] + [(g[0], g[1], g[-1], len(g)) for g in window_repeats(keys, taken, window, options["window_count"])]
    return ((units[second][0], units[last][1], n, units[first][4]) for first, second, last, n in groups)


def _by_label(doc: Doc, labelled: list[tuple[int, str]], labels: Sequence[str], options: dict) -> Iterator[Finding]:
    if len(labelled) > options["max"]:
        for label in labels:
            for a, b, n in clusters(doc, [at for at, own in labelled if own == label], options):
                yield a, b + len(label), n, label


def transitions(doc: Doc, options: dict) -> Iterator[Finding]:
    text, placed = doc.visible, []
    for a, b in doc.hits("transition"):
        hit = text[a:b]
        lead = LEAD.match(hit)[0]
        begins = a == 0 or text[a - 1] in ".!?"
        if begins or "\n" in lead:
            label = hit[len(lead) :].lower().replace("ı", "i")
            placed.append((a if begins else a + lead.index("\n") + 1, label))
    return _by_label(doc, placed, TRANSITIONS, options)


def loaded_words(doc: Doc, options: dict) -> Iterator[Finding]:
    labelled = [(a, next((name for name, form in LABELS.items() if form.search(doc.visible[a:b])), None)) for a, b in doc.hits("loaded")]
    return _by_label(doc, labelled, list(LOADED), options)


def short_sentence_run(doc: Doc, options: dict) -> Iterator[Finding]:
    own = doc.sentences
    runs = equal_runs([doc.section(s) if s[3] <= options["max_words"] else None for s in own], options["minimum_run"])
    return ((own[a + 1][0], own[b][1], b - a + 1, "") for a, b in runs)


def uniform_sentence_length(doc: Doc, options: dict) -> Iterator[Finding]:
    lengths = [float(s[3]) for s in doc.sentences if s[3] >= 3]
    n = len(lengths)
    if n and n >= options["minimum_sentences"]:
        mean = sum_of(lengths) / n
        squares = sum_of([(x - mean) * (x - mean) for x in lengths]) / n
        cv = math.sqrt(squares) / mean
        if cv < options["maximum_cv"]:
            yield doc.sentences[0][0], doc.sentences[-1][1], n, str(Decimal(repr(cv)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def sum_of(values: list[float]) -> float:
    """From left to right; Python's own sum corrects its rounding."""
    total = 0.0
    for x in values:
        total += x
    return total


def heading_density(doc: Doc, options: dict) -> Iterator[Finding]:
    heads = doc.spans["headings"]
    n = len(heads)
    if n >= options["minimum_headings"] and 0 < doc.n_words < options["min_words_per_heading"] * n:
        yield heads[1 if n > 1 else 0][0], heads[-1][1], n, str(round(doc.n_words / n))


CHECKERS: dict[str, Callable[[Doc, dict], Iterator[Finding]]] = {
    "residue": lambda doc, options: matched(doc, "residue"),
    "negative_parallelism": negative_parallelism,
    "no_chain": no_chain,
    "question_answer": question_answer,
    "question_density": question_density,
    "echoed_clauses": echoed_clauses,
    "tricolon_density": tricolon_density,
    "sentence_openers": lambda doc, options: openers(doc, getattr(doc, SENTENCES), options, options["window_sentences"]),
    "paragraph_openers": lambda doc, options: openers(doc, getattr(doc, PARAGRAPHS), options, options["window_paragraphs"]),
    "transitions": transitions,
    "loaded_words": loaded_words,
    "short_sentence_run": short_sentence_run,
    "uniform_sentence_length": uniform_sentence_length,
    "em_dash_density": lambda doc, options: density(doc, [a for a, _ in doc.hits("em_dash")], options),
    "bold_density": lambda doc, options: density(doc, [a for a, _ in doc.spans["bold"]], options),
    "parenthetical_density": lambda doc, options: density(doc, [a for a, _ in doc.spans["parenthetical"]], options),
    "heading_density": heading_density,
}


def _directive(tool: str) -> regex.Pattern:
    gap = rf"(?:(?!\n){WHITE})"
    form = i_forms(pattern(DIRECTIVE, tool).removeprefix("(?iU)"))
    return regex.compile("(?i)" + form.replace(r"[^\S\n]", gap).replace(r"\s", WHITE))


def scopes(doc: Doc, form: regex.Pattern) -> list[tuple[str, int, int]]:
    """(selector, from, to), as suppress.scopes."""
    if "<!--" not in doc.suppression:
        return []
    own = []
    for m in form.finditer(doc.suppression):
        tokens = list(dict.fromkeys(t for t in regex.split(rf"[{WHITE},]+", m[2] or "") if t))
        every = not tokens or "*" in tokens or "all" in tokens
        own.append((doc.place(m.start())[0], m[1].lower(), every, ["*"] if every else tokens))
    out, ends, end_all = [], {}, (math.inf, FOREVER)
    for i in range(len(own) - 1, -1, -1):
        line, kind, every, tokens = own[i]
        if kind == "enable":
            ends |= {t: (i, line) for t in tokens}
            end_all = (i, line) if every else end_all
        elif kind == "disable":
            out += [(t, line + 1, min(ends.get(t, end_all), end_all)[1]) for t in tokens]
        else:
            out += [(t, at, at) for t in tokens for at in [line + (kind == "disable-next-line")]]
    return out


def selects(selector: str, rule: str) -> bool:
    return selector in ("*", rule) or (selector.endswith(".*") and rule.startswith(selector[:-1]))


class Linter:
    """The active rules, ready to be run on texts."""

    def __init__(self, active: Sequence, tool: str = TOOL):
        self.rules = [(i, a.rule.id, _named(a.rule.id) if a.rule.checker == "phrases" else None, CHECKERS.get(a.rule.checker), a.options) for i, a in enumerate(active)]
        self.finders = {name: (view, finder(form)) for name, (view, form) in searches(active).items()}
        self.directive = _directive(tool)

    def findings(self, text: str | None) -> list[tuple]:
        """The rows of FOUND of one text, less those that its directives suppress."""
        doc, out = Doc(text, self.finders), []
        off = scopes(doc, self.directive)
        for i, rule, phrases, checker, options in self.rules:
            own = [(a, b) for s, a, b in off if selects(s, rule)]
            for start, end, n, detail in matched(doc, phrases) if phrases else checker(doc, options):
                line, column = doc.place(start)
                if not any(a <= line <= b for a, b in own):
                    end_line, end_column = doc.place(max(start, end - 1))
                    out.append((i, start, end, n, detail, line, column, end_line, end_column + 1))
        return out


def found(linter: Linter, texts: list[str | None]) -> pa.Array:
    """FOUND of each text."""
    each = [linter.findings(t) for t in texts]
    columns = list(zip(*[f for own in each for f in own], strict=True)) or [()] * len(KINDS)
    offsets = [0]
    for own in each:
        offsets.append(offsets[-1] + len(own))
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS.values(), strict=True)], fields=list(FOUND))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
