"""Operator 10: URL filters by a sorted array of digests.

A rule is a host and the start of a path, with a verdict. Rules become a file:
64-bit xxhash keys in order, then the rules' full strings. Executors map that
file into memory; each URL gives as candidates the suffixes of its host, at
label edges, with the starts of its path that are as long as some rule's path;
their keys are found by one vectorised binary search a batch, and a match is
confirmed against the stored string. The longest rule that fits wins, of equally
long ones that with the longer host; so one rule alone wins. A rule list beyond
`most` bytes, or one that is a DataFrame, is not mapped but joined with the
candidates by key, with the same answers.

Cases: null URLs and URLs without `://` have an empty host and path, no rule
and the default verdict; user parts and ports stay in the host; equal rules
count once, block before allow; repeated rows get equal answers; an empty table
gives an empty result; other columns pass through `row` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.llm.common import checkpoint_root, packed_row, sliced, table

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Bytes of a digest file that executors may map; a larger rule list is joined.
MOST = 256 << 20
MAGIC = b"QDIGEST1"


def digest_file(rules: list[tuple[str, str]]) -> bytes:
    """Header, path lengths, sorted keys, verdicts, string offsets and strings."""
    verdicts: dict[str, str] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r} {verdict!r}")
        host, slash, path = rule.partition("/")
        rule = host.translate(LOWER) + slash + path
        verdicts[rule] = "block" if "block" in (verdict, verdicts.get(rule)) else "allow"
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r, v) for r, v in verdicts.items())
    strings = [r.encode() for _, r, _ in rows]
    lengths = sorted({len(r) - r.index("/") for _, r, _ in rows})
    parts = [
        np.array([len(rows), len(lengths)], "<u8"),
        np.array(lengths, "<u8"),
        np.array([k for k, _, _ in rows], "<u8"),
        np.array([v == "block" for _, _, v in rows], "<u8"),
        np.cumsum([0, *map(len, strings)]).astype("<u8"),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts) + b"".join(strings)


LOWER = {c: c + 32 for c in range(65, 91)}


class Digests:
    """A digest file, mapped."""

    def __init__(self, data: np.ndarray):
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a digest file")
        n, lengths = (int(x) for x in data[8:24].view("<u8"))
        at = 24

        def take(count: int) -> np.ndarray:
            nonlocal at
            out = data[at : at + 8 * count].view("<u8")
            at += 8 * count
            return out

        self.lengths = take(lengths).tolist()
        self.keys, self.block, self.offsets = take(n), take(n), take(n + 1)
        self.strings = data[at:]

    @classmethod
    def mapped(cls, path: str) -> Digests:
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, wanted: list[str]) -> np.ndarray:
        """Each string's rule, or -1; keys are probed all at once, strings confirm."""
        raw = [w.encode() for w in wanted]
        keys = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
        i = np.searchsorted(self.keys, keys)
        out = np.full(len(raw), -1)
        for k in np.flatnonzero(self.keys[np.minimum(i, max(0, len(self.keys) - 1))] == keys) if len(self.keys) else ():
            j = int(i[k])
            while j < len(self.keys) and self.keys[j] == keys[k]:  # equal keys of different strings
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == raw[k]:
                    out[k] = j
                    break
                j += 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path; empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def _judged(name: str, default: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Digests.mapped(SparkFiles.get(name))
        for batch in sliced(batches, 4096):
            wanted, owner = [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                starts = [path[:n] for n in rules.lengths if n <= len(path)]
                for suffix in suffixes(host) if starts else ():
                    wanted += [suffix + s for s in starts]
                    owner += [i] * len(starts)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            for k, j in enumerate(rules.find(wanted)):
                if j >= 0 and (rule[owner[k]] is None or len(wanted[k]) > len(rule[owner[k]])):
                    rule[owner[k]], verdict[owner[k]] = wanted[k], "block" if rules.block[j] else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    return run


def _shipped(spark, data: bytes) -> str:
    """Writes the digest file to the shared folder and has Spark hand it to executors; its name."""
    sc = spark.sparkContext
    name = f"quillon-urls-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    sc.addFile(path.toString())
    return name


def joined(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str) -> DataFrame:
    """The same answers by joining candidates with the rules: for lists of any size."""
    spark = df.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "rule string, verdict string")
    cut = F.instr("rule", "/")
    host, path = F.substring("rule", F.lit(1), cut - 1), F.substring("rule", cut, F.length("rule"))
    lower = F.concat(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path)
    rules = rules.select(lower.alias("rule"), (F.length("rule") - cut + 1).alias("n"), "verdict").groupBy("rule", "n").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())  # path lengths of rules: few
    keyed = df.withColumn("at", F.struct("host", "path"))
    places = keyed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    wanted = places.select("host", "path", F.explode(hosts).alias("h"), starts.alias("starts")).where("host <> ''").select("host", "path", "h", F.explode("starts").alias("s"))
    hits = wanted.select("host", "path", F.concat("h", "s").alias("rule")).join(rules, "rule")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.instr("rule", "/"))).alias("best"))
    out = keyed.drop("at").join(best, ["host", "path"], "left")
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, default: str = "allow", most: int = MOST) -> DataFrame:
    """One row per page: row (the other columns), host, path, rule and verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select(packed_row(pages, ("url", "html")).alias("row"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or sum(len(r) + 64 for r, _ in rules) > most:
        return joined(df, rules, default)
    name = _shipped(pages.sparkSession, digest_file(rules))
    out = [df.schema["row"], *[StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]]
    return df.mapInArrow(_judged(name, default), StructType(out))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, verdict)),
m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
    FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""
