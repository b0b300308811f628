"""Operator 2: suffix-array deduplication of repeated byte strings.

Method: blockwise suffix sorting with a difference cover. repeats.py brings
suffixes that may share 200 bytes into one block of bounded size. In a block,
only the suffixes at a difference cover's positions (mod 31) are ranked first,
by prefix doubling; then one suffix bucket at a time is sorted by its first
bytes, and suffixes that tie there are told apart by the precomputed ranks of
the cover samples inside them, so no long string is ever compared. Every
removed byte is one that this index found twice, or one of a further copy with
the 128-bit digest of a text that it found twice.

Cases: null and empty texts have 0 bytes and nothing removed; texts under
200 bytes never lose any; each repeated row counts as a document of its own,
so equal rows of 200 bytes or more lose all; null or repeated doc_id are kept
apart by an inner key; an empty table gives an empty result; other columns
pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quillon.llm.anchors import eights
from quillon.llm.common import Scratch, row_keyed, sliced, table
from quillon.llm.repeats import Block, Windows, by_row, merged, repeated_spans

PERIOD = 31
#: Every difference mod 31 is one of two members of this set.
COVER = np.array([1, 5, 11, 24, 25, 27])
#: Suffixes sorted together.
BUCKET = 1 << 16


@lru_cache(maxsize=1)
def _next_sample() -> np.ndarray:
    return np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 by keys, the first key first; equal keys share a rank.

    Unsigned keys are numbers of 64 bits, signed ones are ranks from -1. One key
    is sorted at a time, as signed numbers, for which numpy is several times
    faster than for unsigned or several keys.
    """
    rank = np.zeros(len(keys[0]), np.int64)
    if not len(rank):
        return rank
    span = 1  # ranks are below it
    for k in keys:
        if k.dtype == np.uint64:
            k, wide = _ranks((k ^ TOP).view(np.int64)), len(k)
        else:
            k, wide = k + 1, int(k.max()) + 2
        if span * wide >= 1 << 62:
            rank, span = _ranks(rank), len(rank)
        rank, span = rank * wide + k, span * wide
    return _ranks(rank)


TOP = np.uint64(1 << 63)


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    s = x[order]
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(text: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Ranks of the cover's samples by their first `length` bytes (-1 elsewhere), and that length.

    Only the samples are sorted: by 31 bytes at first, then by ranks of samples
    that many bytes on, so the length doubles while it fits in a window.
    """
    n, length = len(text), PERIOD
    at = eights(np.concatenate([text, np.zeros(PERIOD, np.uint8)]), ">u8")
    sample = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    sample = sample[sample < n]
    rank = np.full(n, -1, np.int64)
    rank[sample] = _dense(*[at[sample + k].astype(np.uint64) for k in (0, 8, 16, 23)])
    while length * 2 + _next_sample().max() <= window:
        far = sample + length
        second = np.where(far < n, rank[np.minimum(far, n - 1)], -1)
        doubled = _dense(rank[sample], second)
        rank[sample] = doubled
        length *= 2
    return rank, length


@lru_cache(maxsize=8)
def tie_places(window: int, length: int) -> list[np.ndarray]:
    """For each residue, places whose samples' ranks cover a window from the first sample to its last 16 bytes."""
    residue = np.arange(PERIOD)
    is_sample = np.isin((residue[:, None] + np.arange(window)) % PERIOD, COVER)
    before = np.maximum.accumulate(np.where(is_sample, np.arange(window), -1), axis=1)
    last = before[residue, window - length]
    out = [_next_sample()]
    while (out[-1] + length < window - 16).any():
        out.append(np.where(out[-1] + length >= last, np.maximum(last, out[-1]), before[residue, np.minimum(out[-1] + length, window - 1)]))
    return out


def sorted_ties(text: np.ndarray, suffixes: np.ndarray, window: int, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """Groups, in suffix order, of at least two suffixes at equal residues that share `window` bytes.

    Yields arrays of indexes into suffixes, each group's after the other, with the
    group's number as second row. Suffixes are dealt into buckets by their first
    two bytes; buckets are sorted one after the other (small ones together), a
    larger one by its next bytes first.
    """
    if window < PERIOD + 13:
        raise ValueError("window too short for the cover")
    if len(suffixes) < 2:
        return
    rank, length = sample_ranks(text, window)
    places = tie_places(window, length)
    at = eights(text, ">u8")
    lead = at[suffixes].astype(np.uint64)
    order = np.argsort((lead >> np.uint64(48)).astype(np.uint16), kind="stable")
    todo = [(order, 16)]
    while todo:
        own, known = todo.pop()
        if len(own) > bucket and known <= 64:
            head = lead[own] >> np.uint64(64 - known)
            cuts = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(own)]])
            i, parts = 0, []
            while i < len(cuts) - 1:
                j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + bucket, "right")) - 1)
                part = own[cuts[i] : cuts[j]]
                if len(part) > bucket and known < 64:
                    more = min(64, known + 16)
                    part = part[np.argsort(lead[part] >> np.uint64(64 - more), kind="stable")]
                    parts.append((part, more))
                else:
                    parts.append((part, 65))
                i = j
            todo += parts[::-1]
            continue
        start = suffixes[own]
        residue = start % PERIOD
        group = _dense(lead[own], at[start + 8].astype(np.uint64), residue, *[rank[start + p[residue]] for p in places])
        several = np.bincount(group)[group] > 1  # what is alone has no equal, whatever its last bytes
        own, start, group = own[several], start[several], group[several]
        group = _dense(group, *[at[start + window - k].astype(np.uint64) for k in (16, 8)])
        several = np.bincount(group)[group] > 1 if len(group) else several[:0]
        if several.any():
            own, group = own[several], group[several]
            by = np.argsort(group * len(own) + np.arange(len(own)))
            yield np.stack([own[by], group[by]])


def index(block: Block, window: int) -> np.ndarray:
    """Numbers the groups of equal windows of a block; -1 where a window has no equal.

    Contexts are laid out so that anchors stand at residue 0: equal windows lie
    alike around their anchor, so they tie at equal residues.
    """
    room = -(-(block.sizes + PERIOD) // PERIOD) * PERIOD + PERIOD
    base = np.cumsum(room) - room + (-block.lead) % PERIOD
    text = np.zeros(int(room.sum()) + PERIOD, np.uint8)
    text[np.arange(len(block.text)) + np.repeat(base - block.base, block.sizes)] = block.text
    out, numbers = np.full(len(block.row), -1, np.int64), 0
    for own, group in sorted_ties(text, base[block.row] + block.offset, window):
        out[own] = numbers + group
        numbers += int(group.max()) + 1
    return out


def _apply(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches):
        z, row, spans = (batch.column(i) for i in (1, 2, 3))
        kept, total, gone, runs = [], [], [], []
        for x, own in zip(z.to_pylist(), spans.to_pylist(), strict=True):
            raw = unpack.decompress(x) if x is not None else b""
            cuts = merged(own)
            at, parts = 0, []
            for s, e in cuts:
                parts.append(raw[at:s])
                at = e
            kept.append(b"".join([*parts, raw[at:]]))
            total.append(len(raw))
            gone.append(len(raw) - len(kept[-1]))
            runs.append(len(cuts))
        kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([row, kept, *[pa.array(v, pa.int64()) for v in (total, gone, runs)]], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])


def dedup_bytes(docs: DataFrame, window: int = 200, gram: int = 56, hot: int = 256, as_text: bool = False) -> DataFrame:
    """One row per document: row (its other columns), kept (bytes, or a string of its whole characters), n_bytes, n_removed, n_spans."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    keyed, _ = row_keyed(docs, scratch)
    spans = repeated_spans(keyed, Windows("bytes", window, gram, False, hot), index, scratch)
    rows = by_row(keyed, spans)
    out = [StructField("row", rows.schema["row"].dataType), StructField("kept", StringType() if as_text else BinaryType()), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    return rows.mapInArrow(partial(_apply, as_text=as_text), StructType(out))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _doubled(n: int) -> str:
    """SQL that numbers the strings of 2 n bytes by those of n."""
    return f"n{2 * n} AS (SELECT * EXCLUDE m, dense_rank() OVER (ORDER BY n{n}, m) AS n{2 * n} FROM (SELECT *, lead(n{n}, {n}) OVER (PARTITION BY doc_id ORDER BY i) AS m FROM n{n}))"


#: Bytes as pairs of hexadecimal digits; strings of 1, 2, 4 ... 128 bytes are numbered one after the other, and 200 = 128 + 64 + 8.
ORACLE = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS ds FROM documents),
n1 AS (SELECT doc_id, unnest(ds) AS n1, generate_subscripts(ds, 1) AS i FROM t),
{', '.join(_doubled(1 << k) for k in range(7))},
w AS (SELECT doc_id, i, n1 AS digits, n128 AS a, lead(n64, 128) OVER q AS b, lead(n8, 192) OVER q AS c, lead(i, 199) OVER q AS last FROM n128 WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, digits, last IS NOT NULL AND count(*) OVER (PARTITION BY a, b, c, last IS NULL) > 1 AS again FROM w),
r AS (SELECT doc_id, i, digits, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 1 AS gone FROM g),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM r),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(digits, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(ds) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
