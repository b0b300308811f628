"""Worked cases: short Markdown texts with what each operator must make of them, written down by hand.

A query puts one case after each document's plain text and runs an operator on
the whole; its SQL takes what is written here, moved by what stands before. So
operators that SQL cannot express are held, on whole tables, against answers
that no code of theirs has made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.catalogue import RULES
from quillon.plans.seeds import PLAIN_SQL, plain

GAP = "\n\n"


@dataclass(frozen=True)
class View:
    """What the projection does to a case: pieces blanked everywhere, pieces blanked in `structural` only, and the spans it reports."""

    name: str
    text: str
    hidden: tuple[str, ...] = ()
    unstructured: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    bold: tuple[str, ...] = ()
    asides: tuple[str, ...] = ()
    front: str = ""
    comments: tuple[str, ...] = ()  # hidden, but for directives

    def views(self, part: str) -> tuple[str, str, str]:
        """(visible, structural, suppression) of one part."""
        seen, shape, held = part, part, part
        for piece in (*self.hidden, *self.comments):
            seen = seen.replace(piece, blanked(piece))
        for piece in (*self.unstructured, *self.hidden, *self.comments):
            shape = shape.replace(piece, blanked(piece))
        for piece in self.hidden:
            held = held.replace(piece, blanked(piece))
        marks = str.maketrans("*_`", "   ")
        return seen.translate(marks), shape.translate(marks), held

    def places(self, pieces: tuple[str, ...]) -> list[tuple[bool, int, int]]:
        """(whether before the document's text, start, end) of pieces, counted from their part's start."""
        out = []
        for p in pieces:
            part = self.front if p in self.front else self.text
            out.append((part is self.front and bool(self.front), part.index(p), part.index(p) + len(p)))
        return out


def blanked(piece: str) -> str:
    return "".join(c if c == "\n" else " " for c in piece)


VIEWS = [
    View("front matter", "Text in order to show.", front="---\ntitle: in order to\n---\n\n", hidden=("---\ntitle: in order to\n---",), headings=("title: in order to",)),
    View("fence", "```\nin order to hide\n```\nIn order to win.", hidden=("```\nin order to hide\n```",)),
    View("open fence", "~~~ text\nin order to\n\n``` no end", hidden=("~~~ text\nin order to\n\n``` no end",)),
    View("raw HTML", "<pre>in order to</pre> then in order to <CODE a='1'>x\ny</code> end.", hidden=("<pre>in order to</pre>", "<CODE a='1'>x\ny</code>")),
    View("table", "Name | Size\n--- | ---\nin order | to\n\nIn order to end.", hidden=("Name | Size", "--- | ---", "in order | to")),
    View("setext heading", "Title in order\n=====\n\nText is here now.", hidden=("=====",), unstructured=("Title in order",), headings=("Title in order",)),
    View("excluded blocks", "> in order to\n\n    in order to\n\n* * *\n\nimport x from y\n\n[ref]: note\n\nText stays here now.", hidden=("> in order to", "    in order to", "* * *", "import x from y", "[ref]: note")),
    View("ATX heading", "## Big in order ##\n\nText stays here now.", hidden=("## ",), unstructured=("## Big in order ##",), headings=("## Big in order ##",)),
    View("list items", "- in order to\n2) second item\n\nText stays here now.", hidden=("- ", "2) "), unstructured=("- in order to", "2) second item")),
    View("inline code", "Use `in order to` and ``a ` b`` now, or ` alone.", hidden=("`in order to`", "``a ` b``")),
    View("image", "See ![in order](img.png) right now.", hidden=("![in order](img.png)",)),
    View("link", "See [in order](there/in.md) right now.", hidden=("(there/in.md)",)),
    View("addresses and tags", "See <https://x.y/in> or www.x.y/in and <b>strong</b> text.", hidden=("<https://x.y/in>", "www.x.y/in", "<b>", "</b>")),
    View("math", "We have $x + y$ and \\(a\\) in order, \\$5 too.", hidden=("$x + y$", "\\(a\\)")),
    View("display math", "We have $$x\ny$$ in order to \\[z\\] show.", hidden=("$$x\ny$$", "\\[z\\]")),
    View("comment", "Text <!-- in order\nto --> stays here.", comments=("<!-- in order\nto -->",)),
    View("bold", "Some **bold one** and __two__ of ** three ** here.", bold=("**bold one**", "__two__")),
    View("asides", "Text (an aside here) and (12) and (x) stay.", asides=("(an aside here)",)),
    View("emphasis", "Some *em* and _em_ text.", ()),
    View("nothing", "Plain text stays as it is."),
]

#: Texts, and what stripping strong emphasis leaves of them.
BOLD = [
    ("***x***", "*x*"),
    ("**a** b", "a b"),
    ("`**a**` and **b**", "`**a**` and b"),
    ("2 ** 3 ** 4", "2 ** 3 ** 4"),
    ("foo__bar__baz and __q__", "foo__bar__baz and q"),
    ("__a__ *b*", "a *b*"),
    ("**a\n\nb**", "**a\n\nb**"),
    (r"\**a** and \\**b**", r"\**a** and \\b"),
    ("    **a**", "    **a**"),
    ("```\n**a**\n```\n**b**", "```\n**a**\n```\nb"),
    ("[x](**a**) **b**", "[x](**a**) b"),
    ("<b t='**'> **c**", "<b t='**'> c"),
    ("**a *b* c**", "a *b* c"),
    ("**a** **b", "a **b"),
    ("**\"a\"**b and **c.**", "**\"a\"**b and c."),
    ("****a****", "a"),
    ("<!-- **a** --> **b**", "<!-- **a** --> b"),
    ("> **a**\n> **b**", "> a\n> b"),
    ("* * *\n**a**", "* * *\na"),
]

#: A text and its suppression scopes: selector, first and last line from the text's first one on (None: for ever).
SCOPES = [
    ("<!-- quillon-disable verbosity.filler, phrase.* -->\nhidden\n<!-- quillon-enable verbosity.filler -->\nshown", [("verbosity.filler", 1, 2), ("phrase.*", 1, None)]),
    ("a <!-- quillon-ignore -->\nb <!-- QUILLON-Ignore x.y z.w -->", [("*", 0, 0), ("x.y", 1, 1), ("z.w", 1, 1)]),
    ("<!-- quillon-disable-next-line a.b -->\nx", [("a.b", 1, 1)]),
    ("<!-- quillon-disable all -->\nx\n<!-- quillon-enable -->\n<!-- quillon-disable q.* -->\ny", [("*", 1, 2), ("q.*", 4, None)]),
    ("`<!-- quillon-ignore -->` and <!-- quillon-disabled --> and <!-- quillon-enable x.y -->", []),
]

#: Links: a case's text and (kind, destination, target) of those whose files are missing; there are d0..d9/docs/a.md and docs/b.md.
LINKS = [
    ("See [here](docs/a.md), [there](/docs/b.md#part) and [gone](missing.md).", [("link", "missing.md", "{home}missing.md")]),
    ("See [far](https://example.com/x), [mail](mailto:a@b.c), ![pic](img/p%20q.png) and [up](../docs/b.md).", [("image", "img/p%20q.png", "{home}img/p q.png")]),
    ("See `[code](no.md)` and [angle](<docs/a b.md>) and [title](docs/c.md 'T') and [top](#here).", [("link", "docs/a b.md", "{home}docs/a b.md"), ("link", "docs/c.md", "{home}docs/c.md")]),
    ("See [dir](docs) and [self](?q=1).", []),
    ("See [one][r1], [R1][], ![r1] and [no][zz], `[r1]`.\n\n[r1]: gone/x.md 'T'\n[r2]: docs/a.md", [("link", "gone/x.md", "{home}gone/x.md"), ("link", "gone/x.md", "{home}gone/x.md"), ("image", "gone/x.md", "{home}gone/x.md")]),
]

#: Lines over 20 characters, by the lines' numbers from the case's first one on, with the hook's own directives.
WIDTHS = [
    ("short\nthis line is far too wide\n| this | row | is | a | table | row |", [(1, 25)]),
    ("<!-- quillon-hook-disable markdown-width -->\nthis line is far too wide\n<!-- quillon-hook-enable markdown-width -->\nand this is too wide too", [(3, 24)]),
    ("this line is far too wide <!-- quillon-hook-disable-line -->\nthis line is far too wide <!-- quillon-hook-disable-line other-hook -->", [(1, 71)]),
]


#: Texts and what the strict preset finds in them: rule, severity, first line and column, last line and column, things counted, what it is about.
PROSE = [
    ("As an AI language model I cannot say.\nSee turn0search3.", [("artifact.chatbot-residue", "error", 1, 1, 1, 24, 1, "As an AI language model"), ("artifact.chatbot-residue", "error", 2, 5, 2, 17, 1, "turn0search3")]),
    ("When it comes to tea,\nwe walk in order to rest.", [("verbosity.throat-clearing", "warning", 1, 1, 1, 17, 1, "When it comes to"), ("verbosity.filler", "warning", 2, 9, 2, 20, 1, "in order to")]),
    ("Each and every plan is here.\r\n\r\nIt is worth noting that tea is hot.", [("verbosity.redundant-pair", "warning", 1, 1, 1, 15, 1, "Each and every"), ("phrase.note-to-reader", "warning", 3, 1, 3, 24, 1, "It is worth noting that")]),
    ("They unlock the power of tools and elevate your day.", [("phrase.marketing-language", "warning", 1, 6, 1, 22, 1, "unlock the power"), ("phrase.marketing-language", "warning", 1, 36, 1, 48, 1, "elevate your")]),
    ("It serves as a bridge over an ever-evolving urban landscape.", [("phrase.abstract-role", "warning", 1, 4, 1, 15, 1, "serves as a"), ("phrase.landscape", "warning", 1, 31, 1, 60, 1, "ever-evolving urban landscape")]),
    ("Experts say so. It is widely known.", [("phrase.vague-attribution", "warning", 1, 1, 1, 12, 1, "Experts say"), ("phrase.vague-attribution", "warning", 1, 17, 1, 35, 1, "It is widely known")]),
    ("We want not the map, but the land. You want not the pen, but the hand.", [("rhetoric.negative-parallelism", "warning", 1, 45, 1, 70, 2, "")]),
    ("There are no fees, no ads, no limits here.", [("rhetoric.no-chain", "warning", 1, 11, 1, 42, 3, "no fees, no ads, no limits here")]),
    ("Is it so? Yes. Was it so? No. Then all of them went home again at last.", [("rhetoric.question-answer", "info", 1, 1, 1, 15, 1, ""), ("rhythm.short-sentence-run", "info", 1, 11, 1, 26, 3, "")]),  # "No." may be a number's
    ("Is it so now? Is it not so? Will it be so? We know it was always so.", [("rhetoric.question-density", "info", 1, 29, 1, 30, 3, ""), ("rhythm.short-sentence-run", "info", 1, 15, 1, 69, 4, "")]),
    ("We test the code, we test the docs, we test the plan.", [("rhetoric.echoed-clauses", "warning", 1, 1, 1, 54, 3, "we test")]),
    ("Red, green, and blue. Here, there, and gone. Up, down, and out. That was all we saw there.", [("rhythm.short-sentence-run", "info", 1, 23, 1, 91, 4, ""), ("rhetoric.tricolon-density", "info", 1, 46, 1, 47, 3, "")]),
    ("We go to the sea now. We go to the sun then. We go to the hills too. Then all stop.", [("repetition.sentence-opener", "warning", 1, 23, 1, 69, 3, "we go"), ("rhythm.short-sentence-run", "info", 1, 23, 1, 84, 4, "")]),
    (
        "The cat sat on it.\n\nThe cat ran to it.\n\nThe cat hid in it.",
        [("repetition.paragraph-opener", "warning", 3, 1, 5, 19, 3, "the cat"), ("repetition.sentence-opener", "warning", 3, 1, 5, 19, 3, "the cat"), ("rhythm.short-sentence-run", "info", 3, 1, 5, 19, 3, "")],
    ),
    ("Moreover, it rained. Moreover, it snowed.", [("repetition.transition", "warning", 1, 21, 1, 29, 2, "moreover")]),
    ("They delve here and delve there.", [("repetition.loaded-word", "info", 1, 21, 1, 26, 2, "delve")]),
    ("One two. Three four. Five six. And then all of them went home again at last.", [("rhythm.short-sentence-run", "info", 1, 10, 1, 31, 3, "")]),
    (
        "One two three four five. " * 10,
        [("rhythm.uniform-sentence-length", "info", 1, 1, 1, 250, 10, "0.00"), ("repetition.sentence-opener", "warning", 1, 26, 1, 250, 10, "one two"), ("rhythm.short-sentence-run", "info", 1, 26, 1, 250, 10, "")],
    ),
    ("a — b — c — d — e", [("density.em-dash", "info", 1, 15, 1, 16, 4, "")]),
    ("**b0** **b1** **b2** **b3** **b4** **b5** **b6**", [("density.bold", "warning", 1, 43, 1, 44, 7, "")]),
    ("(aside x) (aside xx) (aside xxx) (aside xxxx) (aside xxxxx) (aside xxxxxx)", [("density.parenthetical", "info", 1, 61, 1, 62, 6, "")]),
    ("# A\n\n# B\n\n# C\n\n# D\n\n# E\n\n# F\n\nword", [("structure.heading-density", "info", 3, 1, 11, 4, 6, "1")]),
    ("<!-- quillon-disable verbosity.* -->\nWe walk in order to rest.\n<!-- quillon-enable -->\nWe walk in order to rest.", [("verbosity.filler", "warning", 4, 9, 4, 20, 1, "in order to")]),
    ("We walk in order to rest. <!-- quillon-ignore -->\n\n`in order to` stays 50%, a: b.", []),
    ("Nothing to see here at all.", []),
]

#: Arguments (preset, fail level), a configuration, what it makes of the rules against their recommended form, and the fail level.
CONFIGS = [
    (("recommended", None), {"preset": "strict", "fail_level": "error", "rules": {"density.bold": {"max": 0, "severity": "error"}, "verbosity.filler": "off"}}, {"density.bold": ("error", "max=0,window_words=500"), "verbosity.filler": ("off", "")}, "error"),
    ((None, "none"), {"rules": {"rhetoric.no-chain": {"minimum_items": 4}, "density.em-dash": "warning", "phrase.landscape": None}}, {"rhetoric.no-chain": ("warning", "minimum_items=4"), "density.em-dash": ("warning", "max=4,window_words=500")}, "none"),
    ((None, None), {}, {}, "warning"),
    (
        (None, None),
        {"preset": "strict", "rules": {"repetition.sentence-opener": {"severity": "info", "consecutive": 4}, "repetition.transition": "off"}},
        {
            "phrase.note-to-reader": ("warning", ""),
            "phrase.marketing-language": ("warning", ""),
            "phrase.abstract-role": ("warning", ""),
            "rhetoric.no-chain": ("warning", "minimum_items=2"),
            "rhetoric.question-answer": ("info", "answer_max_words=5,max=0,window_words=400"),
            "rhetoric.question-density": ("info", "max=2,window_words=500"),
            "rhetoric.tricolon-density": ("info", "max=2,window_words=750"),
            "repetition.sentence-opener": ("info", "consecutive=4,window_count=4,window_sentences=8"),
            "repetition.paragraph-opener": ("warning", "consecutive=3,window_count=3,window_paragraphs=6"),
            "repetition.transition": ("off", "max=1,window_words=500"),
            "repetition.loaded-word": ("info", "max=1,window_words=500"),
            "rhythm.short-sentence-run": ("info", "max_words=6,minimum_run=3"),
            "rhythm.uniform-sentence-length": ("info", "maximum_cv=0.18,minimum_sentences=10"),
            "density.em-dash": ("info", "max=3,window_words=500"),
            "density.bold": ("warning", "max=6,window_words=500"),
            "density.parenthetical": ("info", "max=5,window_words=500"),
            "structure.heading-density": ("info", "min_words_per_heading=70,minimum_headings=6"),
        },
        "warning",
    ),
]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nth(count: int) -> str:
    return f"CAST(doc_id % {count} AS INTEGER)"


def appended(docs: DataFrame, texts: list[str], fronts: list[str] | None = None) -> DataFrame:
    """(doc_id, text): a case's front, the document's plain text and the case."""
    pick = lambda own: F.get(F.array(*[F.lit(t) for t in own]), F.pmod("doc_id", F.lit(len(texts))).cast("int"))
    return plain(docs).select("doc_id", F.concat(pick(fronts or [""] * len(texts)), "text", F.lit(GAP), pick(texts)).alias("text"))


def alone(docs: DataFrame, texts: list[str]) -> DataFrame:
    """(doc_id, text): one case for each document, in place of its text."""
    return docs.select("doc_id", F.get(F.array(*[F.lit(t) for t in texts]), F.pmod("doc_id", F.lit(len(texts))).cast("int")).alias("text"))


def _view_values() -> str:
    rows = []
    for k, v in enumerate(VIEWS):
        (a, b, c), (x, y, z) = v.views(v.front), v.views(v.text)
        rows.append(f"({k}, {', '.join(map(_sql, (v.name, a, x, b, y, c, z)))})")
    return ", ".join(rows)


def _view_spans(of: str) -> str:
    """SQL for the spans of each case, as 'start-end' parted by commas."""
    whens = []
    for k, v in enumerate(VIEWS):
        if pieces := v.places(getattr(v, of)):
            shift = f"{len(v.front)} + length(text) + {len(GAP)}"
            spans = [f"{a} || '-' || {b}" if early else f"({shift} + {a}) || '-' || ({shift} + {b})" for early, a, b in pieces]
            whens.append(f"WHEN {k} THEN {' || chr(44) || '.join(spans)}")
    return f"CASE k {' '.join(whens)} ELSE '' END" if whens else "''"


VIEWS_SQL = f"""WITH d AS (SELECT doc_id, text, {_nth(len(VIEWS))} AS k FROM ({PLAIN_SQL})),
v AS (SELECT * FROM (VALUES {_view_values()}) AS t(k, name, a, x, b, y, c, z))
SELECT doc_id, name, md5(a || text || chr(10) || chr(10) || x) AS visible, md5(b || text || chr(10) || chr(10) || y) AS structural, md5(c || text || chr(10) || chr(10) || z) AS suppression,
    {_view_spans("headings")} AS headings, {_view_spans("bold")} AS bold, {_view_spans("asides")} AS parenthetical FROM d JOIN v USING (k)"""

BOLD_SQL = f"""WITH d AS (SELECT doc_id, text, {_nth(len(BOLD))} AS k FROM ({PLAIN_SQL})),
v AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_sql(want)})' for k, (_, want) in enumerate(BOLD))}) AS t(k, want))
SELECT doc_id, length(text) + 2 + length(want) AS n_chars, md5(text || chr(10) || chr(10) || want) AS text FROM d JOIN v USING (k)"""

_LINES = "length(text) - length(replace(text, chr(10), '')) + 2"


def _listed(rows: list[str], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns}))"


SCOPES_SQL = f"""WITH d AS (SELECT doc_id, {_LINES} + 1 AS base, {_nth(len(SCOPES))} AS k FROM ({PLAIN_SQL})),
v AS {_listed([f"({k}, {_sql(s)}, {a}, {'NULL' if b is None else b})" for k, (_, own) in enumerate(SCOPES) for s, a, b in own], "k, selector, a, b")}
SELECT doc_id, selector, CAST(base + a AS BIGINT) AS "from", CAST(coalesce(base + b, {2**31 - 1}) AS BIGINT) AS "to" FROM d JOIN v USING (k)"""

LINKS_SQL = f"""WITH d AS (SELECT 'd' || (doc_id % 10) || '/' AS home, doc_id, {_nth(len(LINKS))} AS k FROM documents),
v AS {_listed([f"({k}, {_sql(kind)}, {_sql(to)}, {_sql(target)})" for k, (_, own) in enumerate(LINKS) for kind, to, target in own], "k, kind, destination, target")}
SELECT home || doc_id || '.md' AS path, kind, destination, replace(target, '{{home}}', home) AS target FROM d JOIN v USING (k)"""

WIDTHS_SQL = f"""WITH d AS (SELECT doc_id, {_nth(len(WIDTHS))} AS k FROM documents),
v AS {_listed([f"({k}, {line}, {width})" for k, (_, own) in enumerate(WIDTHS) for line, width in own], "k, line, width")}
SELECT doc_id, CAST(line + 1 AS BIGINT) AS line, CAST(width AS BIGINT) AS width FROM d JOIN v USING (k)"""

_TEXTS = ", ".join(f"({k}, {_sql(t)})" for k, (t, _) in enumerate(PROSE))
_FOUND = ", ".join(f"({k}, {', '.join(_sql(x) if isinstance(x, str) else str(x) for x in f)})" for k, (_, own) in enumerate(PROSE) for f in own)
_SAID = ", ".join(f"({', '.join(map(_sql, (r.id, r.summary, r.advice)))})" for r in RULES)
_FINDINGS = f"""d AS (SELECT doc_id, {_nth(len(PROSE))} AS k FROM documents),
v AS (SELECT * FROM (VALUES {_FOUND}) AS t(k, rule, severity, line, "column", end_line, end_column, n, detail)),
s AS (SELECT * FROM (VALUES {_SAID}) AS t(rule, summary, suggestion)),
f AS (SELECT doc_id, k, rule, severity, line, "column", end_line, end_column, n, detail, suggestion,
    summary || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END AS message FROM d JOIN v USING (k) JOIN s USING (rule))"""


def _escaped(value: str) -> str:
    for raw, code in (("'%'", "%25"), ("chr(10)", "%0A"), ("':'", "%3A"), ("','", "%2C")):
        value = f"replace({value}, {raw}, '{code}')"
    return value


FINDINGS_SQL = f"""WITH {_FINDINGS} SELECT doc_id, rule, severity, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", CAST(end_line AS BIGINT) AS end_line, CAST(end_column AS BIGINT) AS end_column,
    CAST(n AS BIGINT) AS n, detail, message, suggestion FROM f"""
SUMMARY_SQL = f"""WITH {_FINDINGS} SELECT count(*) AS findings, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
    count(*) FILTER (WHERE severity = 'info') AS infos FROM f"""
VERDICTS_SQL = f"""WITH {_FINDINGS}, r AS (SELECT doc_id, count(*) AS findings, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(findings, 0) AS findings, CAST(coalesce(worst, -1) AS BIGINT) AS worst, coalesce(worst, -1) >= 1 AS failed FROM documents LEFT JOIN r USING (doc_id)"""
TEXT_SQL = f"""WITH {_FINDINGS}, x AS (SELECT * FROM (VALUES {_TEXTS}) AS t(k, text))
SELECT doc_id || ':' || line || ':' || "column" || ': ' || severity || ' [' || rule || '] ' || message || chr(10) || '  suggestion: ' || suggestion || chr(10) || '  ' ||
    rtrim(string_split(replace(text, chr(13), ''), chr(10))[line]) AS report FROM f JOIN x USING (k)"""
JSON_SQL = f"""WITH {_FINDINGS} SELECT '{{"path":' || doc_id || ',"line":' || line || ',"column":' || "column" || ',"end_line":' || end_line || ',"end_column":' || end_column || ',"severity":' || to_json(severity) ||
    ',"rule":' || to_json(rule) || ',"message":' || to_json(message) || ',"suggestion":' || to_json(suggestion) || '}}' AS report FROM f"""
ANNOTATIONS_SQL = f"""WITH {_FINDINGS} SELECT '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || doc_id || ',line=' || line || ',col=' || "column" || ',endLine=' || end_line ||
    ',endColumn=' || end_column || ',title=quillon/' || rule || '::' || {_escaped("message || ' Suggestion: ' || suggestion")} AS report FROM f"""
CONFIGS_SQL = "SELECT CAST(c AS BIGINT) AS config, fail_level, rule, severity, options FROM (VALUES " + ", ".join(
    f"({c}, {_sql(fail)}, {_sql(rule)}, {_sql(level)}, {_sql(options)})" for c, (_, _, own, fail) in enumerate(CONFIGS) for rule, (level, options) in (own or {"": ("", "")}).items()
) + ") AS t(c, fail_level, rule, severity, options)"
