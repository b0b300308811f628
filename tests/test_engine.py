"""The text engine: golden cases, brute force, and the same answers on a stream."""

import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from quillon.functions.regexops import find_spans, i_forms, mask_matches, without_overlaps
from quillon.functions.windows import equal_runs, index_clusters, window_repeats
from quillon.operators import metrics, segments
from quillon.operators.checks import _spans, searches
from quillon.operators.debold import debolded, strip_bold
from quillon.operators.lint import failed, lint, ordered, summary, verdicts
from quillon.operators.projection import project, projected
from quillon.operators.segments import segmented
from quillon.operators.suppress import scopes, suppressed
from quillon.plans import cases
from quillon.plans.catalogue import BY_ID, RULES, read_config, resolve, settings
from quillon.sources.files import as_annotations, as_json, as_text, read_texts, tracked_files


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


GOLDEN = [
    ("in order to", "verbosity.filler", 1),
    ("in order\nto", "verbosity.filler", 0),
    ("`in order to`", "verbosity.filler", 0),
    ("> in order to", "verbosity.filler", 0),
    ("- in order to", "verbosity.filler", 1),
    ("# in order to", "verbosity.filler", 1),
    ("```\nin order to\n```\nin order to", "verbosity.filler", 1),
    ("```\nin order to", "verbosity.filler", 0),
    ("<pre>in order to</pre> in order to", "verbosity.filler", 1),
    ("<!-- in order to --> in order to", "verbosity.filler", 1),
    ("$in order to$ in order to", "verbosity.filler", 1),
    ("it's important to note that x", "phrase.note-to-reader", 0),
    ("it is important to note that x", "phrase.note-to-reader", 1),
    ("See https://x.com/?utm_source=chatgpt", "artifact.chatbot-residue", 0),
    ("as of my last update and turn0search3", "artifact.chatbot-residue", 2),
    ("no fees, no ads, no limits", "rhetoric.no-chain", 1),
    ("no fees, no ads", "rhetoric.no-chain", 0),
    ("We go now. We go on. We go far. Then stop here.", "repetition.sentence-opener", 1),
    ("We test the code, we test the docs, we test the plan.", "rhetoric.echoed-clauses", 1),
    ("Moreover, a. Moreover, b. Moreover, c stays here.", "repetition.transition", 1),
    ("x moreover y moreover z moreover", "repetition.transition", 0),
    (" ".join(f"**b{i}**" for i in range(11)), "density.bold", 1),
    (" ".join(f"**b{i}**" for i in range(10)), "density.bold", 0),
    (None, "verbosity.filler", 0),
    ("", "verbosity.filler", 0),
]


def test_golden_findings(spark):
    got = lint(frame(spark, [t for t, _, _ in GOLDEN])).groupBy("doc_id", "rule").count().collect()
    counts = {(r[0], r[1]): r[2] for r in got}
    assert [counts.get((i, rule), 0) for i, (_, rule, _) in enumerate(GOLDEN)] == [n for _, _, n in GOLDEN]


STRICT = [
    ("a — b — c — d — e", "density.em-dash", None),
    ("Is it so? Yes. Is it not? No.", "rhetoric.question-answer", None),
    ("Fast, cheap, and good. Red, green, and blue. Here, there, and gone. Up, down, and out.", "rhetoric.tricolon-density", None),
    ("Go on. Go up. Go out. And then all of them went home at last.", "rhythm.short-sentence-run", None),
    (" ".join(["One two three four five."] * 10), "rhythm.uniform-sentence-length", None),
    ("# A\n\n# B\n\n# C\n\n# D\n\n# E\n\n# F\n\nword", "structure.heading-density", None),
    ("delve and delve", "repetition.loaded-word", None),
    (" ".join(f"(aside {'x' * i})" for i in range(1, 8)), "density.parenthetical", None),
]


def test_strict_findings_places_and_sinks(spark, tmp_path):
    docs = frame(spark, [t for t, _, _ in STRICT])
    found = lint(docs, resolve("strict"))
    rows = ordered(found).collect()
    assert {(r.doc_id, r.rule) for r in rows} >= {(i, rule) for i, (_, rule, _) in enumerate(STRICT)}
    heading = next(r for r in rows if r.rule == "structure.heading-density")
    assert (heading.line, heading.column, heading.end_line, heading.n) == (3, 1, 11, 6)
    dash = next(r for r in rows if r.rule == "density.em-dash")
    assert (dash.start, dash.end, dash.n) == (14, 15, 4)
    named = found.withColumnRenamed("doc_id", "path").cache()
    assert all(json.loads(r.report)["rule"] in BY_ID for r in as_json(named).collect())
    assert all(r.report.startswith("::notice file=") or r.report.startswith("::warning file=") for r in as_annotations(named).collect())
    assert all("suggestion: " in r.report for r in as_text(named, excerpts=docs.withColumnRenamed("doc_id", "path")).collect())
    one = summary(named).first()
    assert one.findings == one.errors + one.warnings + one.infos == len(rows)
    assert failed(named, "info") and not failed(named, "none")
    judged = {r.doc_id: r.failed for r in verdicts(docs, found, "error").collect()}
    assert judged == {i: False for i in range(len(STRICT))}
    schema = f"{tmp_path}/in"
    docs.write.parquet(schema)
    from quillon.streaming.lint_stream import document_stream, lint_stream

    lint_stream(document_stream(spark, schema), f"{tmp_path}/out", f"{tmp_path}/check", resolve("strict")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, rows))


def test_segments(spark):
    texts = ["One two three four", "One two three.", "Our systems. They work.", "We saw J. Smith. He left now.", "Café au lait is good.", "---\ntitle: x\n---\nbody text is here.", "A b c d\n\n  e f g h? i!  'J.'\t k.", "x" * 5000 + ". " + "y. " * 300]
    rows = segmented(projected(frame(spark, texts))).collect()
    assert [(len(r.paragraphs), len(r.sentences)) for r in rows[:6]] == [(1, 0), (0, 0), (1, 1), (1, 2), (1, 1), (1, 1)]
    assert rows[4].n_words == 5 and len(rows[5].headings) == 1
    for t, r in zip(texts, rows, strict=True):
        for s in r.sentences:
            assert " ".join(t[s.start : s.end].split()) == s.text


def test_worked_views_and_bold():
    for v in cases.VIEWS:
        got = project(v.front + "word" + cases.GAP + v.text)
        parts = zip(v.views(v.front), v.views(v.text), strict=True)
        assert [got["visible"], got["structural"], got["suppression"]] == [a + "word" + cases.GAP + b for a, b in parts], v.name
        for own, pieces in (("headings", v.headings), ("bold", v.bold), ("parenthetical", v.asides)):
            shift = len(v.front) + len("word" + cases.GAP)
            assert [(s["start"], s["end"]) for s in got[own]] == [(a, b) if early else (shift + a, shift + b) for early, a, b in v.places(pieces)], v.name
    for text, want in cases.BOLD:
        assert strip_bold(text) == want and strip_bold(want) == want


def test_a_long_document_is_segmented_and_searched_once():
    text = "We walk in order to see. " * 40_000
    (whole,) = segments.paragraphs(text)
    assert len(segments.sentences(whole[2], whole[0])) == 40_000
    own = searches(resolve("strict"))
    (spans,) = _spans(regex.compile(own["verbosity_filler"][1]), [text]).to_pylist()
    assert len(spans) == 40_000 and spans[-1]["end"] == len(text) - len(" see. ")


def test_projection_keeps_lengths_and_lines():
    rng = random.Random(1)
    parts = ["```", "~~~", "`", "``", "$", "$$", "\\(", "\\)", "\\[", "\\]", "**", "__", "*", "<!--", "-->", "<pre>", "</pre>", "[a](b)", "![a](b)", "# h", "===", "---", "- x", "> q", "a | b", "--- | ---", "\n", "\n\n", " ", "    ", "word", "é🙂", "https://x.y/z", "(aside)", "\\"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        got = project(text)
        for view in ("visible", "structural", "suppression"):
            assert len(got[view]) == len(text)
            assert [i for i, c in enumerate(got[view]) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
            assert all(a in (b, " ") for a, b in zip(got[view], text, strict=True))
        assert not set("*_`") & set(got["visible"] + got["structural"])


def test_clusters_against_pointers(spark):
    rng = random.Random(2)
    rows, window = [], 9
    for _ in range(300):
        rows.append((sorted(rng.sample(range(60), rng.randint(0, 20))),))
    for most in (0, 1, 3):
        df = spark.createDataFrame(rows, "i array<int>")
        got = [[(g.l, g.r) for g in r.g] for r in df.select(index_clusters(F.col("i"), most, window).alias("g")).collect()]
        for (own,), groups in zip(rows, got, strict=True):
            want, begin, right = [], 0, 0
            while right < len(own):
                first = next(k for k in range(begin, right + 1) if own[right] - own[k] <= window)
                if right - first + 1 > most:
                    end = next((k for k in range(right + 1, len(own)) if own[k] - own[first] > window), len(own))
                    want.append((first, end))
                    begin = right = end
                else:
                    right += 1
            assert groups == want


def test_runs_and_repeats(spark):
    rng = random.Random(3)
    rows = [([rng.choice(["a", "b", None]) for _ in range(rng.randint(0, 25))],) for _ in range(200)]
    df = spark.createDataFrame(rows, "k array<string>")
    runs = equal_runs(F.col("k"), 3)
    taken = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))
    got = df.select(runs.alias("a"), window_repeats(F.col("k"), taken, 6, 3).alias("b")).collect()
    for (keys,), r in zip(rows, got, strict=True):
        want, i, used = [], 0, set()
        while i < len(keys):
            j = i
            while keys[i] is not None and j < len(keys) and keys[j] == keys[i]:
                j += 1
            if j - i >= 3:
                want.append((i, j - 1, j - i))
                used |= set(range(i, j))
            i = max(j, i + 1)
        assert [(x.first, x.last, x.n) for x in r.a] == want
        want = []
        for i, k in enumerate(keys):
            own = [j for j in range(i, min(len(keys), i + 6)) if keys[j] == k and j not in used] if k is not None and i not in used else []
            if len(own) >= 3:
                want.append((own[0], own[1], own[-1], len(own)))
                used |= set(own)
        assert [tuple(x) for x in r.b] == want


def test_regexops(spark):
    df = spark.createDataFrame([("a😀bb a bbb",), ("",), ("xyz",)], "t string")
    spans = [[(s.start, s.end) for s in r[0]] for r in df.select(find_spans(F.col("t"), "b+")).collect()]
    assert spans == [[(2, 4), (7, 10)], [], []]
    assert [r[0] for r in df.select(mask_matches(F.col("t"), "b+")).collect()] == ["a😀   a    ", "", "xyz"]
    many = spark.createDataFrame([([(5, 9), (0, 3), (0, 6), (6, 7), (2, 4)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(s) for s in many.select(without_overlaps(F.col("s"))).first()[0]] == [(0, 6), (6, 7)]
    assert i_forms(r"a\ii[a-i]") == r"a\i[iİı][a-i]"


def test_suppression(spark):
    text = "0\n<!-- quillon-disable a.b, c.* -->\n2 <!-- quillon-ignore x -->\n<!-- quillon-enable a.b -->\n4\n<!-- quillon-disable-next-line -->\n6\n<!-- QUILLON-disable all -->\n8\n<!-- quillon-enable -->\n10"
    rules, lines = ["a.b", "c.d", "x"], text.count("\n") + 1
    df = spark.createDataFrame([(text,)], "t string").select(scopes(F.col("t")).alias("s"))
    df = df.select("s", F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("line")).select("s", "line", F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    got = {(r.line - 1, r.rule) for r in df.where(suppressed(F.col("s"), F.col("line"), F.col("rule"))).collect()}
    want = {(2, "a.b"), (3, "a.b"), (2, "x")} | {(i, "c.d") for i in range(2, 10)} | {(6, r) for r in rules} | {(i, r) for i in (8, 9) for r in rules}
    assert got == want


def test_config(tmp_path):
    assert len(RULES) == 25
    path = tmp_path / "c.json"
    path.write_text('{"preset": "strict", "rules": {"density.bold": {"max": 0, "severity": "error"}, "verbosity.filler": "off", "phrase.landscape": null}}')
    rules, fail = settings(config=read_config(str(path)))
    own = {a.rule.id: a for a in rules}
    assert fail == "warning" and own["density.bold"].options["max"] == 0 and own["density.bold"].severity == "error"
    assert own["verbosity.filler"].severity == "off" and own["rhetoric.no-chain"].options["minimum_items"] == 2
    for bad in ({"x": 1}, {"preset": "z"}, {"rules": {"no.rule": "off"}}, {"rules": []}):
        with pytest.raises(ValueError):
            settings(config=bad)
    for rule, bad in (("density.bold", {"max": -1}), ("density.bold", {"y": 1}), ("density.bold", "loud"), ("density.bold", 3), ("rhythm.uniform-sentence-length", {"maximum_cv": 0}), ("rhetoric.echoed-clauses", {"minimum_clauses": 6}), ("rhythm.short-sentence-run", {"minimum_run": 1})):
        with pytest.raises(ValueError):
            resolve(config={"rules": {rule: bad}})


BOLD = [("***x***", "*x*"), ("**a** b", "a b"), ("`**a**`", "`**a**`"), ("2 ** 3 ** 4", "2 ** 3 ** 4"), ("foo__bar__baz", "foo__bar__baz"), ("__a__ *b*", "a *b*"), ("**a\n\nb**", "**a\n\nb**"), (r"\**a**", r"\**a**"), ("    **a**", "    **a**"), ("```\n**a**\n```\n**b**", "```\n**a**\n```\nb"), ("[x](**a**) **b**", "[x](**a**) b"), ("<b t='**'> **c**", "<b t='**'> c"), ("**a *b* c**", "a *b* c"), ("", "")]


def test_strip_bold(spark):
    for text, want in BOLD:
        assert strip_bold(text) == want, text
        assert strip_bold(want) == want
    got = debolded(frame(spark, [None, *[t for t, _ in BOLD]])).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None, *[w for _, w in BOLD]]


def test_metrics(spark, tmp_path):
    docs = frame(spark, ["a" * 301, "|" + "a" * 301, "a" * 300, None, "<!-- quillon-hook-disable markdown-width -- why -->\n" + "a" * 301 + "\n<!-- quillon-hook-enable -->\n" + "b" * 302 + "\n" + "c" * 303 + " <!-- quillon-hook-disable-line -->\n<!-- quillon-hook-disable other -->\n" + "d" * 304])
    assert sorted(map(tuple, metrics.line_width(docs).collect())) == [(0, 1, 301), (4, 4, 302), (4, 7, 304)]
    sizes = frame(spark, ["a" * 20480, "a" * 20481, None])
    assert [(r.doc_id, r.bytes, r.kb, r.budget_k_tokens) for r in metrics.markdown_size(sizes).collect()] == [(1, 20481, 21, 5)]
    lines = frame(spark, ["a\nb\n", "a\nb\nc", "", None])
    assert sorted(map(tuple, metrics.code_length(lines, 1).collect())) == [(0, 2), (1, 3)]
    entries = [("100644", f"d/f{i}") for i in range(21)] + [("160000", "e/sub")] + [("100644", f"e/f{i}") for i in range(20)] + [("100644", f"r{i}") for i in range(50)]
    listing = spark.createDataFrame([("".join(f"{m} hash 0\t{p}\0" for m, p in entries),)], "value string")
    files = tracked_files(listing)
    assert files.count() == len(entries)
    assert [tuple(r) for r in metrics.directory_counts(files).collect()] == [("d", 21)]
    assert metrics.directory_counts(files, files.where("path like 'e/%'")).collect() == []
    text = "[a](b.md) [c](/r0) [d](../d/f1) ![p](q%20r.png) [u](http://x/y) `[n](no.md)` [h](#top) [e](<g h.md>) [w](b.md 'title')"
    pages = spark.createDataFrame([("e/x.md", text)], "path string, text string")
    missing = {(r.kind, r.destination, r.target) for r in metrics.links_missing(pages, files).collect()}
    assert missing == {("link", "b.md", "e/b.md"), ("image", "q%20r.png", "e/q r.png"), ("link", "g h.md", "e/g h.md")}
    (tmp_path / "one.md").write_text("text\r\nhere")
    assert [r.text for r in read_texts(spark, str(tmp_path)).collect()] == ["text\r\nhere"]


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert "findings" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "line", "width"]
