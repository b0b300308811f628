"""Limits on files and lines, counts by directory, and links whose target is missing; native expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.regexops import let
from quillon.operators.suppress import HOOKS, hook_lines

#: Line ends as Python's splitlines knows them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
LINK = r"""!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\([ \t\n]*(<[^<>\n]*>|[^\s()<][^\s()]*(?:\([^\s()]*\)[^\s()]*)*|)(?:[ \t\n]+(?:"[^"]*"|'[^']*'|\([^()]*\)))?[ \t\n]*\)"""
#: A link reference definition, and a use of one: [text][label], [label][] or [label].
DEFINITION = r"(?m)^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:\n[ \t]*)?(<[^<>\n]*>|[^\s<]\S*)[^\n]*$"
REFERENCE = r"!?\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![(\[:])"
CODE = r"(?s)(?<!`)(`++)(?!`).*?(?<!`)\1(?!`)|(?m:^ {0,3}```.*?(?:^ {0,3}```|\z))"


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def split_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, text); a line end at the end of a text begins no line."""
    parts = F.split(_text(), LINE_END, -1)
    kept = let(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    return docs.select(key, F.posexplode(kept).alias("line", "text")).withColumn("line", F.col("line") + 1)


def line_width(docs: DataFrame, max_chars: int = 300, key: str = "doc_id", hook: str = "markdown-width", tool: str = HOOKS) -> DataFrame:
    """(key, line, width) of lines over the limit that are neither table rows nor suppressed.

    Only documents with a directive have their lines shuffled for the running state.
    """
    wide = (F.length("text") > max_chars) & ~F.col("text").rlike(r"(?U)^[\s\x1c-\x1f]*\|")
    out = lambda df: df.select(key, "line", F.length("text").alias("width"))
    marked = _text().contains(f"{tool}-")
    plain = split_lines(docs.where(~marked), key).where(wide)
    return out(plain).unionByName(out(hook_lines(split_lines(docs.where(marked), key), hook, key, tool).where(wide & ~F.col("suppressed"))))


def code_length(docs: DataFrame, max_lines: int = 1000, key: str = "doc_id") -> DataFrame:
    """(key, lines) of texts with more physical lines; an unterminated last line counts."""
    lines = F.regexp_count(_text(), F.lit("\n")) + F.when((_text() == "") | _text().endswith("\n"), 0).otherwise(1)
    return docs.select(key, lines.alias("lines")).where(F.col("lines") > max_lines)


def markdown_size(docs: DataFrame, max_kb: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, bytes, kb, budget_k_tokens) of texts over the limit."""
    df = docs.select(key, F.octet_length(_text()).cast("long").alias("bytes")).where(F.col("bytes") > max_kb * 1024)
    return df.select(key, "bytes", F.ceil(F.col("bytes") / 1024).cast("long").alias("kb"), F.lit(max_kb // 4).alias("budget_k_tokens"))


def directory(path: Column) -> Column:
    """The path's parent, `.` at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def directory_counts(files: DataFrame, changed: DataFrame | None = None, max_files: int = 20) -> DataFrame:
    """(directory, files) over the limit, of files(path, mode); only directories of changed(path), never the root.

    Submodules (mode 160000) aren't files. Counts are combined before the shuffle.
    """
    own = files.where(F.coalesce(F.col("mode"), F.lit("")) != "160000").select(directory(F.col("path")).alias("directory"))
    of = (files if changed is None else changed).select(directory(F.col("path")).alias("directory")).where("directory <> '.'").distinct()
    counts = own.groupBy("directory").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > max_files)
    return counts.join(of, "directory", "left_semi")


def links(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, destination) of links and images outside code, inline ones and those by reference."""
    plain = F.regexp_replace(_text(), CODE, " ")
    none = F.array().cast("array<struct<hit:string,target:string>>")
    inline = F.transform(F.regexp_extract_all(plain, F.lit(LINK), F.lit(0)), lambda h: F.struct(h.alias("hit"), F.regexp_extract(h, LINK, 1).alias("target")))

    def label(raw: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(raw, r"\s+", " ")))

    def by_reference(text: Column) -> Column:
        defined = F.transform(F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(0)), lambda d: F.struct(label(F.regexp_extract(d, DEFINITION, 1)).alias("label"), F.regexp_extract(d, DEFINITION, 2).alias("target")))

        def used(known: Column) -> Column:
            def of(h: Column) -> Column:
                own, other = F.regexp_extract(h, REFERENCE, 1), F.regexp_extract(h, REFERENCE, 2)
                return F.struct(h.alias("hit"), F.get(F.filter(known, lambda d: d["label"] == label(F.when(other != "", other).otherwise(own))), F.lit(0))["target"].alias("target"))

            uses = F.transform(F.regexp_extract_all(F.regexp_replace(text, DEFINITION, ""), F.lit(REFERENCE), F.lit(0)), of)
            return F.filter(uses, lambda u: u["target"].isNotNull())

        return let(defined, used)

    found = F.concat(F.when(_text().contains("]("), inline).otherwise(none), F.when(_text().contains("]:"), let(plain, by_reference)).otherwise(none))
    df = docs.select(key, F.inline(found))
    target = F.regexp_replace("target", r"^<|>$", "")
    return df.select(key, F.when(F.col("hit").startswith("!"), "image").otherwise("link").alias("kind"), F.regexp_replace(target, r"\\([!-/:-@\[-`{-~])", "$1").alias("destination"))


def resolved(base: Column, destination: Column) -> Column:
    """The file that a local destination names, from the root or from base's directory; null for other destinations."""
    local = ~destination.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//")
    bare = F.regexp_replace(destination, r"[?#].*$", "")
    path = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    path = F.coalesce(path, bare)
    home = F.when(F.instr(base, "/") > 0, F.concat(directory(base), F.lit("/"))).otherwise(F.lit(""))
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(home, path))
    parts = F.filter(F.split(whole, "/", -1), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.when(local & (bare != ""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def links_missing(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind, destination, target) of local links to neither a file of files(path) nor a directory that holds one."""
    own = links(docs).withColumn("target", resolved(F.col("path"), F.col("destination"))).where("target is not null and target <> ''")
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("target"))
    return own.join(above.distinct(), "target", "left_anti").select("path", "kind", "destination", "target")
