"""Operator 3: substring deduplication by prefix-partitioned suffix trees.

Method: suffixes that may share 20 words (brought together by repeats.py) are
split by variable-length prefixes, one word longer wherever a group would not
fit in memory; for each group the suffixes are sorted, which lays out its
subtree's leaves with the words that neighbours have in common, and the
internal nodes 20 words deep give the repeats: leaves are cut at that depth, as
deeper nodes lie below one of these. The earliest leaf below such a node stays.
Words are compared as they are, not by hashes; further copies of a text that
the tree found twice are known by its 128-bit digest.

Cases: null and empty texts have no words; texts under 20 words lose none;
rows are ordered by doc_id (nulls last, then by text), each repeated row being a document of
its own, so the first of equal rows stays; an empty table gives an empty
result; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm.common import Scratch, row_keyed, sliced, table
from quillon.llm.repeats import Block, Windows, by_row, merged, repeated_spans

#: Suffixes in one subtree's group.
GROUP = 1 << 15


def prefix_groups(text: np.ndarray, suffixes: np.ndarray, depth: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(indexes into suffixes, words they are known to share) of groups of at most `most`.

    Small prefixes are packed into one group; a prefix with more suffixes is
    lengthened; only suffixes equal to the full depth may stay in a larger one.
    """
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        own, known = todo.pop()
        if len(own) <= most or known == depth:
            yield own, known
            continue
        word = text[suffixes[own] + known]
        order = np.argsort(word, kind="stable")
        own, word = own[order], word[order]
        cuts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(own)]])
        i = 0
        while i < len(cuts) - 1:
            j = i + 1
            if cuts[j] - cuts[i] > most:
                todo.append((own[cuts[i] : cuts[j]], known + 1))
            else:
                j = max(j, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
                todo.append((own[cuts[i] : cuts[j]], known))
            i = j


def leaves(text: np.ndarray, suffixes: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a group in order, and the words (up to depth) that each shares with the next: a subtree's leaves, laid out."""
    words = [text[suffixes + d] for d in range(known, depth)]
    order = np.lexsort(words[::-1]) if words else np.arange(len(suffixes))
    common = np.full(len(suffixes) - 1, known)
    still = np.ones(len(suffixes) - 1, bool)
    for x in words:
        s = x[order]
        still &= s[1:] == s[:-1]
        common += still
    return order, common


def internal_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf, depth in words) of the internal nodes at least `least` words deep.

    A node of depth d spans leaves whose neighbours all share d words or more,
    and some two neighbours just d. Depths are taken one by one, deepest last.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(least, int(common.max(initial=0)) + 1):
        inside = np.concatenate([[False], common >= d, [False]])
        first = np.flatnonzero(inside[1:] & ~inside[:-1])
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        exact = np.concatenate([[0], np.cumsum(common == d)])
        own = exact[last] > exact[first]
        found.append((first[own], last[own], np.full(int(own.sum()), d)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def deep_nodes(text: np.ndarray, suffixes: np.ndarray, depth: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaves, node) of each group: leaves under an internal node of at least `depth` words."""
    for own, known in prefix_groups(text, suffixes, depth, most):
        if len(own) < 2:
            continue
        order, common = leaves(text, suffixes[own], known, depth)
        first, last, _ = internal_nodes(common, depth)
        if len(first):
            size = last - first + 1
            node = np.repeat(np.arange(len(first)), size)
            at = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + first[node]
            yield own[order[at]], node


def index(block: Block, window: int) -> np.ndarray:
    """Numbers the groups of equal windows of a block; -1 where a window has no equal."""
    out, numbers = np.full(len(block.row), -1, np.int64), 0
    for own, node in deep_nodes(block.text, block.base[block.row] + block.offset, window):
        out[own] = numbers + node
        numbers += int(node.max()) + 1
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches):
        kept, total, gone = [], [], []
        for x, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = unpack.decompress(x).split() if x is not None else []
            at, parts = 0, []
            for s, e in merged(own):
                parts += words[at:s]
                at = e
            parts += words[at:]
            kept.append(b" ".join(parts).decode())
            total.append(len(words))
            gone.append(len(words) - len(parts))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "kept", "n_words", "n_removed"])


def dedup_words(docs: DataFrame, window: int = 20, gram: int = 6, hot: int = 256) -> DataFrame:
    """One row per document: row (its other columns), kept (words joined by a space), n_words, n_removed."""
    scratch = Scratch(docs.sparkSession, "subtrees")
    keyed, _ = row_keyed(docs, scratch)
    spans = repeated_spans(keyed, Windows("words", window, gram, True, hot), index, scratch)
    rows = by_row(keyed, spans)
    out = [StructField("row", rows.schema["row"].dataType), StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    return rows.mapInArrow(_apply, StructType(out))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
q AS (SELECT doc_id, word, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM w),
g AS (SELECT doc_id, word, i, len(seq) = 20 AND row_number() OVER (PARTITION BY array_to_string(seq, ' ') ORDER BY doc_id, i) > 1 AS again FROM q),
r AS (SELECT doc_id, word, i, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM g),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
