"""Python passes over texts whose memory follows a piece of fixed size, not the Arrow batch.

Spark hands over up to 10,000 rows or 64 MB at once, and what Python makes of
them is many times larger; so each batch is worked off and returned in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text worked off at once, and rows; a longer text is a piece of its own.
PIECE, ROWS = 1 << 18, 1000


def pieces(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """From and to of runs of rows of at most PIECE bytes together, or of one row."""
    n = len(columns[0])
    sizes = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + PIECE, "right"))), at + ROWS)
        yield at, to
        at = to


def in_pieces(of: Callable[..., pa.Array], *columns: pa.Array) -> Iterator[pa.Array]:
    """What `of` makes of lists of each piece's values."""
    for a, b in pieces(*columns):
        yield of(*[c[a:b].to_pylist() for c in columns])


def piecewise(of: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """An Arrow UDF of one or more columns that works in pieces.

    It is called nondeterministic since the optimizer would copy it otherwise,
    as into a filter below explode, and run all of it twice.
    """

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from in_pieces(of, batch)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from in_pieces(of, *batch)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else many, kind).asNondeterministic()(*columns)
