"""The engine's registered queries, and the SQL that says the same where SQL can.

Each takes (spark, sf_dir) and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.regexops import let, mask_matches
from quillon.functions.windows import equal_runs
from quillon.operators import checks, metrics, segments
from quillon.operators.debold import debolded
from quillon.operators.lint import lint, lint_in_order, rules_table, summary, verdicts
from quillon.operators.projection import projected
from quillon.operators.suppress import scopes
from quillon.plans import cases, seeds
from quillon.plans.catalogue import RULES, resolve, settings
from quillon.sources.files import as_annotations, as_json, as_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _units(spark, sf_dir: str, units: str, *fields: str) -> DataFrame:
    """Units of the plain text of all documents."""
    return segments.units_of(seeds.plain(_docs(spark, sf_dir)), units, *fields)


def line_width(spark, sf_dir):
    return metrics.line_width(_docs(spark, sf_dir)).select("doc_id", F.col("line").cast("long"), F.col("width").cast("long"))


def markdown_size(spark, sf_dir):
    return metrics.markdown_size(_docs(spark, sf_dir)).select("doc_id", "bytes", "kb")


def code_length(spark, sf_dir):
    return metrics.code_length(_docs(spark, sf_dir), max_lines=10).select("doc_id", F.col("lines").cast("long"))


def directory_counts(spark, sf_dir):
    """URLs as paths: pages by directory."""
    files = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://(.*)$", 1).alias("path"), F.lit("100644").alias("mode"))
    return metrics.directory_counts(files, max_files=2)


def word_counts(spark, sf_dir):
    words = segments.words_table(_docs(spark, sf_dir))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def paragraphs(spark, sf_dir):
    return segments.units_table(_units(spark, sf_dir, "paragraphs", "words", "text"), "paragraphs").select("doc_id", F.col("idx").cast("long"), F.col("words").cast("long"), "text")


def sentences(spark, sf_dir):
    return segments.units_table(_units(spark, sf_dir, "sentences", "words", "text"), "sentences").select("doc_id", F.col("idx").cast("long"), F.col("words").cast("long"), "text")


def sentence_variation(spark, sf_dir):
    df = _units(spark, sf_dir, "sentences", "words").select("doc_id", checks.variation(F.col("sentences")).alias("v")).where("v.n >= 10")
    return df.select("doc_id", F.col("v.n").cast("long").alias("n"), F.round("v.mean", 6).alias("mean_words"), F.round("v.cv", 6).alias("cv"))


def short_sentence_runs(spark, sf_dir):
    keys = F.transform("sentences", lambda s: F.when(s["words"] <= 5, s["section"]))
    df = _units(spark, sf_dir, "sentences", "words", "section").select("doc_id", F.explode_outer(equal_runs(keys, 3)).alias("r")).where("r is not null")
    return df.select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.n").cast("long").alias("n"))


def opener_runs(spark, sf_dir):
    df = _units(spark, sf_dir, "sentences", "section", "opener").select("doc_id", let(F.transform("sentences", checks._opener), lambda k: F.transform(equal_runs(k, 2), lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n"), F.get(k, r["first"]).alias("key")))).alias("runs"))
    df = df.select("doc_id", F.explode_outer("runs").alias("r")).where("r is not null")
    return df.select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.n").cast("long").alias("n"), F.regexp_extract("r.key", r"^\d+\|(.*)$", 1).alias("opener"))


def echoed_clauses(spark, sf_dir):
    df = segments.units_of(seeds.seeded_plain(_docs(spark, sf_dir)), "sentences", "start", "end", "text")
    df = df.select("doc_id", F.inline_outer(checks.echoed_clauses({"minimum_clauses": 2, "maximum_clauses": 5}))).where("n is not null")
    return df.select("doc_id", F.col("n").cast("long"), "detail")


def _hits(spark, sf_dir: str, kind: str) -> DataFrame:
    rules = [a for a in resolve("strict") if a.rule.checker == kind]
    found = lint(seeds.seeded_plain(_docs(spark, sf_dir)), rules)
    return found.groupBy("doc_id", "rule", F.lower("detail").alias("phrase")).agg(F.sum("n").cast("long").alias("n"))


def phrase_hits(spark, sf_dir):
    return _hits(spark, sf_dir, "phrases")


def residue(spark, sf_dir):
    return _hits(spark, sf_dir, "residue")


def no_chains(spark, sf_dir):
    return _hits(spark, sf_dir, "no_chain")


def _only(spark, sf_dir: str, *rules: str) -> DataFrame:
    found = lint(seeds.seeded_plain(_docs(spark, sf_dir)), [a for a in resolve("strict") if a.rule.id in rules])
    return found.select("doc_id", "rule", F.col("start").cast("long"), F.col("end").cast("long"), F.col("n").cast("long"), "detail")


def em_dash_density(spark, sf_dir):
    return _only(spark, sf_dir, "density.em-dash").select("doc_id", "n")


def loaded_words(spark, sf_dir):
    return _only(spark, sf_dir, "repetition.loaded-word").select("doc_id", "detail", "n")


def contrasts_questions_lists(spark, sf_dir):
    return _only(spark, sf_dir, "rhetoric.negative-parallelism", "rhetoric.question-answer", "rhetoric.question-density", "rhetoric.tricolon-density", "repetition.transition", "repetition.sentence-opener", "repetition.paragraph-opener")


def mask_html(spark, sf_dir):
    """Comments, then tags, blanked in place."""
    masked = mask_matches(mask_matches(F.col("html"), "(?s)<!--.*?-->"), r"</?[A-Za-z][^>\n]*>")
    return _table(spark, sf_dir, "pages").select("page_id", masked.alias("m")).select("page_id", F.length("m").cast("long").alias("n_chars"), F.md5("m").alias("masked"))


def projection(spark, sf_dir):
    """The views and spans of each document with a worked case of Markdown."""
    df = projected(cases.appended(_docs(spark, sf_dir), [v.text for v in cases.VIEWS], [v.front for v in cases.VIEWS]))
    name = F.get(F.array(*[F.lit(v.name) for v in cases.VIEWS]), F.pmod("doc_id", F.lit(len(cases.VIEWS))).cast("int"))
    spans = [F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c) for c in ("headings", "bold", "parenthetical")]
    return df.select("doc_id", name.alias("name"), *[F.md5(c).alias(c) for c in ("visible", "structural", "suppression")], *spans)


def suppression_scopes(spark, sf_dir):
    df = projected(cases.appended(_docs(spark, sf_dir), [t for t, _ in cases.SCOPES]), wanted=("suppression",))
    df = df.select("doc_id", F.inline_outer(scopes(F.col("suppression")))).where("selector is not null")
    return df.select("doc_id", "selector", F.col("from").cast("long"), F.col("to").cast("long"))


def strip_bold(spark, sf_dir):
    df = debolded(cases.appended(_docs(spark, sf_dir), [t for t, _ in cases.BOLD]))
    return df.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text"))


def hook_directives(spark, sf_dir):
    """Wide lines of one worked case for each document, less those that the hook's directives cover."""
    own = F.get(F.array(*[F.lit(t) for t, _ in cases.WIDTHS]), F.pmod("doc_id", F.lit(len(cases.WIDTHS))).cast("int"))
    df = metrics.line_width(_docs(spark, sf_dir).select("doc_id", own.alias("text")), max_chars=20)
    return df.select("doc_id", F.col("line").cast("long"), F.col("width").cast("long"))


def findings(spark, sf_dir):
    return lint(seeds.seeded(_docs(spark, sf_dir)), resolve("strict"))


def findings_recommended(spark, sf_dir):
    return lint(_docs(spark, sf_dir))


def findings_summary(spark, sf_dir):
    return summary(findings(spark, sf_dir))


def findings_by_rule(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("docs"))


def document_verdicts(spark, sf_dir):
    docs = seeds.seeded(_docs(spark, sf_dir))
    return verdicts(docs, lint(docs))


def _reported(sink: Callable) -> Callable:
    def report(spark, sf_dir):
        docs = seeds.seeded(_docs(spark, sf_dir)).withColumnRenamed("doc_id", "path")
        return sink(lint_in_order(docs, key="path"), in_order=True)

    return report


def links_missing(spark, sf_dir):
    path = F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = cases.appended(_docs(spark, sf_dir), [t for t, _ in cases.LINKS]).select(path.alias("path"), "text")
    there = spark.range(0, 10).select(F.explode(F.array(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/docs/a.md")), F.lit("docs/b.md"))).alias("path"))
    return metrics.links_missing(docs, docs.select("path").union(there))


def rule_catalogue(spark, sf_dir):
    return rules_table(spark).select("id", "recommended", "strict")


def _case_docs(spark, sf_dir) -> DataFrame:
    return cases.alone(_docs(spark, sf_dir), [t for t, _ in cases.PROSE])


def _case_lint(spark, sf_dir) -> DataFrame:
    return lint(_case_docs(spark, sf_dir), resolve("strict"))


def case_findings(spark, sf_dir):
    """All rules on a worked case for each document."""
    found = _case_lint(spark, sf_dir)
    return found.select("doc_id", "rule", "severity", *[F.col(c).cast("long") for c in ("line", "column", "end_line", "end_column", "n")], "detail", "message", "suggestion")


def case_summary(spark, sf_dir):
    return summary(_case_lint(spark, sf_dir))


def case_verdicts(spark, sf_dir):
    return verdicts(_case_docs(spark, sf_dir), _case_lint(spark, sf_dir)).withColumn("worst", F.col("worst").cast("long"))


def case_report_text(spark, sf_dir):
    """With the lines that findings begin in."""
    return as_text(_case_lint(spark, sf_dir), "doc_id", _case_docs(spark, sf_dir))


def case_report_json(spark, sf_dir):
    return as_json(_case_lint(spark, sf_dir), "doc_id")


def case_report_annotations(spark, sf_dir):
    return as_annotations(_case_lint(spark, sf_dir), "doc_id")


def configurations(spark, sf_dir):
    """What worked configurations and arguments change against the recommended rules; no table has any part in it."""
    number = lambda x: str(int(x)) if x == int(x) else str(x)
    rows, plain = [], {a.rule.id: a for a in resolve()}
    for c, ((preset, fail_level), config, _, _) in enumerate(cases.CONFIGS):
        rules, fail = settings(preset, fail_level, config)
        changed = [a for a in rules if (a.severity, a.options) != (plain[a.rule.id].severity, plain[a.rule.id].options)]
        rows += [(c, fail, a.rule.id, a.severity, ",".join(f"{k}={number(v)}" for k, v in sorted(a.options.items()))) for a in changed] or [(c, fail, "", "", "")]
    return spark.createDataFrame(rows, "config long, fail_level string, rule string, severity string, options string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_width, markdown_size, code_length, directory_counts, word_counts, paragraphs, sentences, sentence_variation, short_sentence_runs, opener_runs, echoed_clauses,
        phrase_hits, residue, no_chains, em_dash_density, loaded_words, contrasts_questions_lists, mask_html, projection, suppression_scopes, strip_bold, hook_directives,
        findings, findings_recommended, findings_summary, findings_by_rule, document_verdicts, links_missing, rule_catalogue,
        case_findings, case_summary, case_verdicts, case_report_text, case_report_json, case_report_annotations, configurations,
    )
} | {"report_text": _reported(as_text), "report_json": _reported(as_json), "report_annotations": _reported(as_annotations)}


# What follows is SQL for DuckDB.

W = "[A-Za-z0-9]+(?:[’''][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+)*"
_GUARD = "(?i)(" + "|".join(a[:-1].replace(".", r"\.") for a in segments.ABBREVIATIONS) + r")\."
_INITIAL = r"(^|[^\pL\pN\pM_])([A-Za-z])\."


def _paragraphs(source: str) -> str:
    return rf"""b AS ({source}),
c AS (SELECT doc_id, regexp_extract_all(text, '(?m)(?:^[^\S\n]*\S[^\n]*(?:\n|\z))+') AS ps FROM b),
d AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM c),
par AS (SELECT doc_id, k, regexp_replace(p, '\n$', '') AS text, len(regexp_extract_all(p, '{W}')) AS words FROM d WHERE len(regexp_extract_all(p, '{W}')) >= 4)"""


def _sentences(source: str) -> str:
    return rf"""{_paragraphs(source)},
g AS (SELECT doc_id, k, regexp_replace(regexp_replace(regexp_replace(text, '{_GUARD}', '\1' || chr(1), 'g'), '{_INITIAL}', '\1\2' || chr(1), 'g'), '{_INITIAL}', '\1\2' || chr(1), 'g') AS t FROM par),
h AS (SELECT doc_id, k, regexp_extract_all(t || ' ', '(?s)(.*?[.!?][' || chr(1) || '.!?"''”’)\]]*)\s', 1) AS ss FROM g),
i AS (SELECT doc_id, k, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM h),
m AS (SELECT doc_id, k, j, trim(regexp_replace(replace(s, chr(1), '.'), '\s+', ' ', 'g')) AS text FROM i),
sen AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS idx, len(regexp_extract_all(text, '{W}')) AS words, text FROM m WHERE len(regexp_extract_all(text, '{W}')) > 0)"""


def _runs(keyed: str, least: int) -> str:
    return f"""{keyed},
isl AS (SELECT doc_id, key, idx, idx - row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) AS grp FROM keyed WHERE key IS NOT NULL),
run AS (SELECT doc_id, key, min(idx) AS first, count(*) AS n FROM isl GROUP BY doc_id, key, grp HAVING count(*) >= {least})"""


def _clusters(occurrences: str, most: int, window: int) -> str:
    """Clusters of occ(doc_id, key, pos from 1, widx): greedy, disjoint, by a recursion over the places that fire."""
    return f"""occ AS ({occurrences}),
trig AS (SELECT r.doc_id, r.key, r.pos AS r, (SELECT max(e.pos) FROM occ e WHERE e.doc_id = r.doc_id AND e.key = r.key AND e.widx <= l.widx + {window}) AS e, r.pos - {most} AS l
    FROM occ r JOIN occ l ON l.doc_id = r.doc_id AND l.key = r.key AND l.pos = r.pos - {most} WHERE r.widx - l.widx <= {window}),
cl AS (SELECT doc_id, key, min_by(e, r) AS e, min_by(l, r) AS l FROM trig GROUP BY doc_id, key
    UNION ALL SELECT c.doc_id, c.key, n.e, n.l FROM cl c, LATERAL (SELECT min_by(t.e, t.r) AS e, min_by(t.l, t.r) AS l FROM trig t WHERE t.doc_id = c.doc_id AND t.key = c.key AND t.r >= c.e + 1 + {most}) n WHERE n.e IS NOT NULL)"""


def _marks(pattern: str, key: str) -> str:
    """Occurrences of a pattern with the word each stands in, by splitting the text at it."""
    return rf"""SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id, key ORDER BY k) AS pos, widx FROM (
    SELECT doc_id, k, m, {key} AS key, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS widx FROM (
    SELECT doc_id, k, m, len(regexp_extract_all(piece, '{W}')) AS n FROM (
    SELECT doc_id, unnest(string_split_regex(text, '{pattern}')) AS piece, unnest(list_concat(regexp_extract_all(text, '{pattern}'), [NULL])) AS m, generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS k FROM b))) WHERE m IS NOT NULL"""


def _phrases(rules: list, count: str = "count(*)") -> str:
    parts = [rf"SELECT doc_id, '{id_}' AS rule, unnest(regexp_extract_all(text, '(?i){pattern.replace(chr(39), chr(39) * 2)}')) AS m FROM b" for id_, pattern in rules]
    return f"WITH b AS ({seeds.SEEDED_PLAIN_SQL}), h AS ({' UNION ALL '.join(parts)}) SELECT doc_id, rule, lower(m) AS phrase, CAST({count} AS BIGINT) AS n FROM h GROUP BY doc_id, rule, lower(m)"


_PIECES = rf"list_filter(list_transform(string_split_regex(text, '\s*[,;]\s*(?:(?:and|or)\s+)?'), lambda x: list_transform(regexp_extract_all(x, '{W}'), lambda y: lower(y))), lambda x: len(x) >= 3)"
_MASK = r"array_to_string(list_transform(list_zip(string_split_regex({0}, '{1}'), regexp_extract_all({0}, '{1}')), lambda x: x[1] || coalesce(regexp_replace(x[2], '[^\r\n]', ' ', 'g'), '')), '')"
_LOADED_KEYS = "CASE " + " ".join(f"WHEN regexp_matches(m, '(?i){form}') THEN '{name}'" for name, form in checks.LOADED.items()) + " END"

ORACLES: dict[str, str] = {
    "line_width": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS BIGINT) AS line, length(t) AS width FROM l WHERE length(t) > 300 AND NOT regexp_matches(t, '^\s*\|')""",
    "markdown_size": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(ceil(strlen(text) / 1024) AS BIGINT) AS kb FROM documents WHERE strlen(text) > 20480",
    "code_length": "SELECT * FROM (SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS lines FROM documents) WHERE lines > 10",
    "directory_counts": r"""WITH f AS (SELECT regexp_extract(url, '^[a-z]+://(.*)$', 1) AS path FROM pages)
SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS files FROM f WHERE contains(path, '/') GROUP BY 1 HAVING count(*) > 2""",
    "word_counts": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{W}')) AS word FROM documents) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY word",
    "paragraphs": f"WITH {_paragraphs(seeds.PLAIN_SQL)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, CAST(words AS BIGINT) AS words, text FROM par",
    "sentences": f"WITH {_sentences(seeds.PLAIN_SQL)} SELECT doc_id, idx, CAST(words AS BIGINT) AS words, text FROM sen",
    "sentence_variation": f"WITH {_sentences(seeds.PLAIN_SQL)} SELECT doc_id, count(*) AS n, round(avg(words), 6) AS mean_words, round(stddev_pop(words) / avg(words), 6) AS cv FROM sen WHERE words >= 3 GROUP BY doc_id HAVING count(*) >= 10",
    "short_sentence_runs": f"WITH {_runs(_sentences(seeds.PLAIN_SQL) + ', keyed AS (SELECT doc_id, idx, CASE WHEN words <= 5 THEN 0 END AS key FROM sen)', 3)} SELECT doc_id, first, n FROM run",
    "opener_runs": f"""WITH {_runs(_sentences(seeds.PLAIN_SQL) + f", keyed AS (SELECT doc_id, idx, CASE WHEN words >= 2 THEN replace(lower(regexp_extract_all(text, '{W}')[1] || ' ' || regexp_extract_all(text, '{W}')[2]), '’', '''') END AS key FROM sen)", 2)} SELECT doc_id, first, n, key AS opener FROM run""",
    "echoed_clauses": f"""WITH {_sentences(seeds.SEEDED_PLAIN_SQL)}, e AS (SELECT doc_id, {_PIECES} AS ps FROM sen),
k AS (SELECT doc_id, len(ps) AS n, list_transform(ps, lambda x: x[1] || ' ' || x[2]) AS a, list_transform(ps, lambda x: x[-2] || ' ' || x[-1]) AS z FROM e WHERE len(ps) BETWEEN 2 AND 5),
r AS (SELECT doc_id, n, coalesce(list_filter(a, lambda x: len(list_filter(a, lambda y: y = x)) >= 2)[1], list_filter(z, lambda x: len(list_filter(z, lambda y: y = x)) >= 2)[1]) AS detail FROM k)
SELECT doc_id, n, detail FROM r WHERE detail IS NOT NULL AND NOT regexp_matches(detail, '[0-9]')""",
    "phrase_hits": _phrases([(r.id, "|".join(r.patterns)) for r in RULES if r.patterns]),
    "residue": _phrases([("artifact.chatbot-residue", checks.RESIDUE)]),
    "no_chains": _phrases([("rhetoric.no-chain", checks.NO_CHAIN.replace("++", "+"))], r"sum(len(regexp_extract_all(m, '(?i)\bno\s+')))"),
    "em_dash_density": f"WITH RECURSIVE b AS ({seeds.SEEDED_PLAIN_SQL}), {_clusters(_marks('—', chr(39) + 'x' + chr(39)), 3, 500)} SELECT doc_id, e - l + 1 AS n FROM cl",
    "loaded_words": f"WITH RECURSIVE b AS ({seeds.SEEDED_PLAIN_SQL}), {_clusters(_marks('(?i)' + '|'.join(checks.LOADED.values()), _LOADED_KEYS), 1, 500)} SELECT doc_id, key AS detail, e - l + 1 AS n FROM cl",
    "mask_html": f"WITH a AS (SELECT page_id, {_MASK.format('html', '(?s)<!--.*?-->')} AS h FROM pages), m AS (SELECT page_id, {_MASK.format('h', '</?[A-Za-z][^>' + chr(92) + 'n]*>')} AS m FROM a) SELECT page_id, length(m) AS n_chars, md5(m) AS masked FROM m",
    "rule_catalogue": "SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.recommended}', '{r.strict or r.recommended}')" for r in RULES) + ") AS t(id, recommended, strict)",
    "projection": cases.VIEWS_SQL,
    "suppression_scopes": cases.SCOPES_SQL,
    "strip_bold": cases.BOLD_SQL,
    "hook_directives": cases.WIDTHS_SQL,
    "links_missing": cases.LINKS_SQL,
    "case_findings": cases.FINDINGS_SQL,
    "case_summary": cases.SUMMARY_SQL,
    "case_verdicts": cases.VERDICTS_SQL,
    "case_report_text": cases.TEXT_SQL,
    "case_report_json": cases.JSON_SQL,
    "case_report_annotations": cases.ANNOTATIONS_SQL,
    "configurations": cases.CONFIGS_SQL,
}
