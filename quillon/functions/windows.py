"""Clusters, runs and look-ahead counts over arrays of one document; no shuffle.

Each is a fold over positions that matter, so a document without enough of them
costs a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regexops import let, word_count

GROUPS = "array<struct<start:int,last:int,n:int>>"
RUNS = "array<struct<first:int,second:int,last:int,n:int>>"


def upto(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def word_indexes(text: Column, offsets: Column) -> Column:
    """For ascending offsets, the index of the last word that starts at or before each.

    Words are counted from one offset to the next, so the text is read once; the
    word that an offset stands in is counted with that offset.
    """

    def between(o: Column, i: Column) -> Column:
        before = F.get(offsets, i - 1)
        part = F.substring(text, before + 1, o - before + 1)
        later = word_count(part) - part.rlike("^[A-Za-z0-9]").cast("int")
        return F.when(i == 0, word_count(F.substring(text, F.lit(1), o + 1))).otherwise(later)

    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(F.greatest(acc["sum"] + n - 1, F.lit(0)))).alias("out"))
    return F.aggregate(F.transform(offsets, between), zero, step, lambda acc: acc["out"])


def index_clusters(index: Column, most: int, window: int) -> Column:
    """Disjoint groups [l, r) of ascending indexes: over `most` of them within `window`, then all that still lie within it."""
    n = F.size(index)
    pair = lambda a, b: F.array(F.struct(a.cast("int").alias("l"), b.cast("int").alias("r")))
    zero = F.struct(F.lit(0).alias("reset"), F.lit(-1).alias("l"), F.array().cast("array<struct<l:int,r:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        is_open = acc["l"] >= 0
        at = F.get(index, r)
        holds = is_open & (at - F.get(index, acc["l"]) <= window)
        reset = F.when(is_open, r).otherwise(acc["reset"])
        out = F.when(is_open, F.concat(acc["out"], pair(acc["l"], r))).otherwise(acc["out"])
        fires = (r - reset >= most) & (at - F.get(index, r - most) <= window)
        moved = F.struct(reset.alias("reset"), F.when(fires, r - most).otherwise(F.lit(-1)).alias("l"), out.alias("out"))
        return F.when(holds, acc).otherwise(moved)

    done = lambda acc: F.when(acc["l"] >= 0, F.concat(acc["out"], pair(acc["l"], n))).otherwise(acc["out"])
    return F.aggregate(upto(n), zero, step, done)


def clusters(text: Column, offsets: Column, most: int, window: int) -> Column:
    """GROUPS of offsets, by distance in words of text: start is the first offset over the budget."""

    def groups(own: Column) -> Column:
        found = let(word_indexes(text, own), lambda index: index_clusters(index, most, window))
        return F.transform(found, lambda g: F.struct(F.get(own, g["l"] + most).alias("start"), F.get(own, g["r"] - 1).alias("last"), (g["r"] - g["l"]).alias("n")))

    ordered = F.array_sort(F.array_distinct(offsets))
    return F.when(F.size(offsets) > most, let(ordered, groups)).otherwise(F.array().cast(GROUPS))


def equal_runs(keys: Column, least: int) -> Column:
    """RUNS of at least `least` equal neighbours; null equals nothing."""
    n = F.size(keys)
    starts = F.filter(upto(n), lambda i: (i == 0) | ~F.coalesce(F.get(keys, i) == F.get(keys, i - 1), F.lit(False)))

    def runs(s: Column) -> Column:
        all_ = F.transform(s, lambda a, i: F.struct(a.alias("first"), (a + 1).alias("second"), (F.coalesce(F.get(s, i + 1), n) - 1).alias("last")))
        all_ = F.filter(all_, lambda r: F.get(keys, r["first"]).isNotNull() & (r["last"] - r["first"] + 1 >= least))
        return F.transform(all_, lambda r: F.struct(r["first"].alias("first"), r["second"].alias("second"), r["last"].alias("last"), (r["last"] - r["first"] + 1).alias("n")))

    return F.when(n >= least, let(starts, runs)).otherwise(F.array().cast(RUNS))


def window_repeats(keys: Column, taken: Column, window: int, least: int) -> Column:
    """RUNS of equal keys within `window` places from a start; members are taken in order and serve once.

    taken: places that earlier runs hold. Only starts that could fire, members
    of earlier groups included, enter the fold.
    """
    n = F.size(keys)
    ahead = lambda i: F.filter(F.sequence(i, F.least(n, i + window) - 1), lambda j: F.get(keys, j) == F.get(keys, i))
    likely = F.filter(upto(n), lambda i: F.get(keys, i).isNotNull() & (F.size(ahead(i)) >= least))
    zero = F.struct(taken.alias("taken"), F.array().cast(RUNS).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        def grown(own: Column) -> Column:
            run = F.struct(F.get(own, F.lit(0)).alias("first"), F.get(own, F.lit(1)).alias("second"), F.get(own, F.size(own) - 1).alias("last"), F.size(own).alias("n"))
            more = F.struct(F.concat(acc["taken"], own).alias("taken"), F.concat(acc["out"], F.array(run)).alias("out"))
            return F.when(F.size(own) >= least, more).otherwise(acc)

        free = F.filter(ahead(i), lambda j: ~F.array_contains(acc["taken"], j))
        return F.when(F.array_contains(acc["taken"], i), acc).otherwise(let(free, grown))

    return F.when(n >= least, F.aggregate(likely, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(RUNS))
