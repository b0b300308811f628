"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) of one task, batch by batch, as stars of their components; shortens the rounds."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = p
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                up.setdefault(min(x, y), min(x, y))
        nodes = [n for n in up if root(n) != n]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array([root(n) for n in nodes], np.int64))], names=["hi", "lo"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(hi, lo): each node that is not its component's least, with that least node.

    Every round's edges are a table in the shared folder: lineage stays short
    and a lost executor costs no round. Minima are combined map-side and hot
    nodes are joined, not gathered; minima are tables of their own, so that a hot
    node's join can be split. What is written is counted on the way, which tells
    when a round changes nothing.
    """

    def saved(df: DataFrame, part: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum"))
        out = scratch.save(df, part)
        return out, (seen.get["n"], seen.get["sum"])

    now, mark = saved(edges.toDF("hi", "lo").where("hi <> lo"), f"{name}0")
    last, turn = None, 0
    while mark != last and mark[0]:
        last, turn = mark, turn + 1
        both = now.select("hi", "lo").union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.save(least, f"{name}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = scratch.save(large, f"{name}-large")
        lows = scratch.save(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-lows")
        met = large.join(lows, "hi")
        small = met.select("hi", F.col("m").alias("lo")).union(met.where("lo <> m").select(F.col("lo"), F.col("m"))).toDF("hi", "lo").where("hi <> lo").distinct()
        now, mark = saved(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}", *[f"{name}-{x}" for x in ("least", "large", "lows")])
    return now
