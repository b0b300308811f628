"""Operator 1: quality rules with verdicts by host, in DataFrame functions only.

Each document is measured in its own row (no explode, no shuffle of text).
Failures of any rule are added up by host (the `source` column) with map-side
combining; a host's failure rate is shrunk towards the corpus by a beta prior
whose two parameters are fitted to the hosts' rates by moments. Hosts are
judged against that prior: one whose shrunk rate is over its mean by more than
`SUSPECT` of its standard deviations is suspect, and its documents are held to
half of each soft limit; one that is under the mean by more than `CLEARED` is
cleared, and its documents may break a soft limit. Any other document that
breaks one goes. A document that breaks no halved limit stays, so clean
documents of a suspect host are never lost.

Cases: null text counts as empty (no words, so it fails); null and empty hosts
are one host; very long texts are measured whole in n log n; repeated rows are
judged alike; an empty table gives an empty result and a neutral prior; other
columns pass through `row` whatever their names. Repeated five-word windows
are found by 64-bit hashes of the words within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, packed_row, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Soft limits, in percent: symbols of word characters, repeated lines of lines.
SYMBOL_LIMIT, LINE_LIMIT = 20, 40
#: Standard deviations of the prior over, or under, its mean.
SUSPECT, CLEARED = 2.0, 1.0


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that are found twice or more in the text."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(grams)
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("n"), p.cast("long").alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    some = let(let(hashed, windows), lambda g: F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["h"]))) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(some)


def measured(docs: DataFrame, leave: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs' columns but those left out as `row`, the host, and the measures of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = docs.select(packed_row(docs, leave).alias("row"), host.alias("host"), text.alias("text"))
    df = df.select(
        "row",
        "host",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("by_line"),
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("by_word"),
    )
    df = df.select("row", "host", "word_chars", "n_symbols", "by_line.*", "by_word.*")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("any_failed", base | soft_failed(1))


def soft_failed(divisor: int) -> Column:
    """Whether a document breaks a soft limit divided by divisor."""
    return (divisor * 100 * F.col("n_symbols") > SYMBOL_LIMIT * F.col("word_chars")) | (divisor * 100 * F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines"))


def host_verdicts(rows: DataFrame, suspect: float = SUSPECT, cleared: float = CLEARED) -> DataFrame:
    """Each host's documents, failures, shrunk failure rate, and whether it is suspect or cleared."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("any_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    fit = hosts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("n"), F.var_pop(rate).alias("v")).first()
    mean = (fit["f"] / fit["n"]) if fit["n"] else 0.5
    spread = fit["v"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 10_000.0
    strength = min(max(strength, 1.0), 10_000.0)
    deviation = (mean * (1 - mean) / (strength + 1)) ** 0.5
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumns({"host_rate": shrunk, "host_suspect": shrunk > mean + suspect * deviation, "host_cleared": shrunk < mean - cleared * deviation})


def _stays() -> Column:
    """Whether the method keeps a document that doesn't fail the base rules."""
    suspect, cleared = (F.coalesce(c, F.lit(False)) for c in ("host_suspect", "host_cleared"))
    return ~(soft_failed(1) & ~cleared) & ~(soft_failed(2) & suspect)


def quality_rules(docs: DataFrame, suspect: float = SUSPECT, cleared: float = CLEARED) -> DataFrame:
    """One row per document: row (its other columns), the measures, base_failed, kept and the host's figures.

    The measures are written once, so that text is read once although they are
    aggregated and then joined with the hosts' verdicts. The join is left to
    adaptive execution: it broadcasts the hosts only if they turn out small,
    and splits a hot host's rows otherwise.
    """
    rows = Scratch(docs.sparkSession, "quality").save(measured(docs), "measured")
    hosts = host_verdicts(rows, suspect, cleared).select("host", "host_docs", "host_failed", "host_suspect", "host_cleared")
    return rows.join(hosts, "host", "left").withColumn("kept", ~F.col("base_failed") & _stays())


def good_documents(docs: DataFrame, suspect: float = SUSPECT, cleared: float = CLEARED) -> DataFrame:
    """`row` (all columns, text too) of the documents that quality_rules keeps.

    Only documents near a limit meet their hosts' verdicts, so no other text is shuffled.
    """
    rows = Scratch(docs.sparkSession, "quality").save(measured(docs, ()).withColumn("doubtful", soft_failed(2)), "measured")
    hosts = host_verdicts(rows.select("host", "any_failed"), suspect, cleared).where("host_suspect or host_cleared").select("host", "host_suspect", "host_cleared")
    sound = rows.where("not base_failed and not doubtful").select("row")
    doubtful = rows.where("not base_failed and doubtful").join(hosts, "host", "left")
    return sound.unionByName(doubtful.where(_stays()).select("row"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed", "host_suspect", "host_cleared"]


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("row.doc_id", *MEASURES)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q || ' ' || lead(word, 3) OVER q || ' ' || lead(word, 4) OVER q AS gram
    FROM u WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, i - coalesce(before, i - 5))) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (SELECT t.doc_id, host, len(w) AS n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    100 * n_symbols > {SYMBOL_LIMIT} * word_chars OR 100 * n_dup_lines > {LINE_LIMIT} * n_lines AS soft,
    200 * n_symbols > {SYMBOL_LIMIT} * word_chars OR 200 * n_dup_lines > {LINE_LIMIT} * n_lines AS half FROM m),
h AS (SELECT host, count(*) AS host_docs, count(*) FILTER (WHERE base_failed OR soft) AS host_failed FROM b GROUP BY host),
f AS (SELECT sum(host_failed) / sum(host_docs) AS mean, var_pop(host_failed / host_docs) AS spread FROM h),
s AS (SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 10000.0 END, 1.0), 10000.0) AS strength FROM f),
e AS (SELECT mean, strength, sqrt(mean * (1 - mean) / (strength + 1)) AS deviation FROM s),
v AS (SELECT host, host_docs, host_failed, (host_failed + mean * strength) / (host_docs + strength) AS rate, mean, deviation FROM h, e),
w AS (SELECT host, host_docs, host_failed, rate > mean + {SUSPECT} * deviation AS host_suspect, rate < mean - {CLEARED} * deviation AS host_cleared FROM v)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (soft AND NOT host_cleared) AND NOT (host_suspect AND half) AS kept,
    CAST(host_docs AS BIGINT) AS host_docs, CAST(host_failed AS BIGINT) AS host_failed, host_suspect, host_cleared
FROM b JOIN w USING (host)
"""
