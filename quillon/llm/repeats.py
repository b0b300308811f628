"""Repeated windows of symbols over a whole corpus, by content-defined anchors.

Shared by the suffix-array and the suffix-tree deduplication. Anchors propose
who may be equal; the operator's own index decides what is removed. Stages:

1. every document gives its anchors (anchors.py); keys are counted with
   map-side combining, so a key of a third of all rows is no hot task;
2. occurrences of keys seen twice or more are kept, each with the digest (128
   bits) of the bytes of its context, that is of all windows of its anchor.
   Occurrences of a key with the same digest are a class;
3. of each class one context, of several members two, is cut from its text and
   goes to the operator's index, in blocks of whole keys that fit in memory.
   The index says which windows are equal, byte by byte or word by word. Where
   it finds a class's two contexts equal, the class's other members, whose
   digests are the same, follow;
4. a key with more than `hot` classes is dealt over several blocks. Windows
   that are distinct there meet once more: neighbours travel as one row under
   the digest of what all of them cover, and only where that repeats are they
   told apart one by one; of those that repeat two go to the index again. Same
   answer, no cap.

Spans are half-open ranges of symbols (bytes or words) in a row's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillon.llm.anchors import anchors, joined_words, symbols_of, word_codes, word_spans
from quillon.llm.common import INNER, Scratch, packed_row, sliced, text_buffer

RID = f"{INNER}rid"
#: Bytes of contexts that one block of whole keys holds.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Windows:
    kind: str  # bytes or words
    window: int
    gram: int
    keep_first: bool
    hot: int = 256


def digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """128-bit digests of data[lo:hi], as rows of two longs."""
    view = memoryview(data)
    out = [xxhash.xxh3_128_digest(view[a:b], s) for a, b, s in zip(lo.tolist(), hi.tolist(), seeds.tolist(), strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _key_rows(plan: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            symbols, first = symbols_of(plan.kind, *text_buffer(batch.column(0)))
            key = anchors(symbols, first, plan.window, plan.gram)[4]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def _anchor_rows(plan: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            data, first = text_buffer(batch.column(1))
            symbols, size = data, 1
            if plan.kind == "words":
                starts, ends, words = word_spans(data, first)
                symbols, size = word_codes(data, starts, ends), ends - starts
                data, begins = joined_words(data, starts, ends)
                first = words
            doc, s, a, e, key = anchors(symbols, first, plan.window, plan.gram)
            lo, last = first[doc] + s, first[doc] + e + plan.window - 1
            hi = last + 1
            if plan.kind == "words":
                lo, hi = begins[lo], begins[last] + size[last]
            ctx = digests(data, lo, hi, (a - s) << 32 | (e - s))
            rid = np.asarray(batch.column(0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[doc]), pa.array(s), pa.array(key.view(np.int64)), pa.array(ctx[:, 0]), pa.array(ctx[:, 1]), pa.array((e - s).astype(np.int32)), pa.array((a - s).astype(np.int32))],
                names=["rid", "pos", "key", "ctx", "cty", "run", "lead"],
            )

    return run


ANCHOR_SCHEMA = "rid long, pos long, key long, ctx long, cty long, run int, lead int"


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (second column) as zstd frames, so that a shuffle moves less; null stays null."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        out = [None if x is None else z.compress(x.encode()) for x in batch.column(1).to_pylist()]
        columns = list(batch.columns)
        columns[1] = pa.array(out, pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:1], "z", *batch.schema.names[2:]])


def squeezed(keyed: DataFrame, with_row: bool) -> DataFrame:
    row = [packed_row(keyed).alias("row")] if with_row else []
    df = keyed.select(F.col(RID).alias("rid"), F.col("text").cast("string").alias("text"), *row)
    kept = [df.schema["row"]] if with_row else []
    return df.mapInArrow(_squeeze, StructType([df.schema["rid"], StructField("z", BinaryType()), *kept]))


#: What is known of a context that goes to the index; n: its class's members; twin: whether it is its class's second.
FIELDS = ("key", "chunk", "n", "pos", "run", "lead", "ctx", "cty", "twin")
CUT_SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", rid long, body binary"


def _cut(plan: Windows) -> Callable:
    """The listed contexts of each document, as their bytes (words with one space between them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 256):
            lists = batch.column(2)
            count = np.diff(np.asarray(lists.offsets))
            wanted = lists.flatten()
            pos, run = (np.asarray(wanted.field(f), np.int64).tolist() for f in ("pos", "run"))
            body, i = [], 0
            for z, n in zip(batch.column(1).to_pylist(), count.tolist(), strict=True):
                raw = unpack.decompress(z)
                symbols = raw if plan.kind == "bytes" else raw.split()
                for p, r in zip(pos[i : i + n], run[i : i + n], strict=True):
                    own = symbols[p : p + r + plan.window]
                    body.append(own if plan.kind == "bytes" else b" ".join(own))
                i += n
            rid = np.repeat(np.asarray(batch.column(0), np.int64), count)
            yield pa.RecordBatch.from_arrays([*[wanted.field(f).cast(pa.int64()) for f in FIELDS], pa.array(rid), pa.array(body, pa.binary())], names=[*FIELDS, "rid", "body"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict[str, np.ndarray], list[bytes]]]:
    """Rows sorted by key and chunk as blocks of whole chunks: their numbers and their bodies."""
    names = [*FIELDS, "rid"]
    parts: list[np.ndarray] = []
    bodies: list[bytes] = []
    held = 0

    def block(rows: np.ndarray) -> dict[str, np.ndarray]:
        return {k: rows[:, i] for i, k in enumerate(names)}

    for batch in sliced(batches, 2048):
        rows = np.stack([np.asarray(batch.column(i), np.int64) for i in range(len(names))], axis=1)
        body = batch.column(len(names)).to_pylist()
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        begins = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(rows)]]).tolist() if len(rows) else [0]
        for a, b in zip(begins, begins[1:], strict=False):
            if held >= size and (rows[a, :2] != parts[-1][-1, :2]).any():
                yield block(np.concatenate(parts)), bodies
                parts, bodies, held = [], [], 0
            parts.append(rows[a:b])
            bodies += body[a:b]
            held += sum(map(len, body[a:b]))
    if parts:
        yield block(np.concatenate(parts)), bodies


@dataclass
class Block:
    """Contexts of whole keys, as numbers of their symbols, and all their windows."""

    text: np.ndarray  # symbols, one context's after another's
    base: np.ndarray  # where each context's begin
    sizes: np.ndarray
    lead: np.ndarray
    row: np.ndarray  # each window's context
    offset: np.ndarray  # and its place there


def _numbers(bodies: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all bodies and how many each has: bytes as they are, words numbered as they come."""
    if kind == "bytes":
        return np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies], np.int64)
    number: dict[bytes, int] = {}
    words = b" ".join(bodies).split(b" ")
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), np.array([b.count(b" ") + 1 for b in bodies], np.int64)


def _step(plan: Windows) -> int:
    """Windows that start at so many neighbouring places are sent as one piece."""
    return max(2, (plan.window - plan.gram) // 6)


def _byte_places(bodies: list[bytes], kind: str) -> Callable:
    """places(context) gives where each of its symbols begins in its body, and after the last one's end a separator's width."""

    def places(k: int) -> np.ndarray:
        if kind == "bytes":
            return np.arange(len(bodies[k]) + 1)
        raw = np.frombuffer(bodies[k], np.uint8)
        return np.concatenate([[0], np.flatnonzero(raw == 32) + 1, [len(raw) + 1]])

    return places


def _unsettled(own: np.ndarray, block: Block, bodies: list[bytes], cols: dict, n: np.ndarray, plan: Windows) -> pa.RecordBatch | None:
    """The distinct windows (own) of dealt-out keys, one row for each piece: (rid, digest of what all windows of the piece cover, windows)."""
    if not len(own):
        return None
    window, step, gap = plan.window, _step(plan), int(plan.kind == "words")
    r, o = block.row[own], block.offset[own]
    ahead = cols["lead"][r] - o  # symbols from the window's start to the anchor
    piece = ahead // step
    places = _byte_places(bodies, plan.kind)
    cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (piece[1:] != piece[:-1])]))
    marks, shared = [], []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True):
        k = int(r[a])
        at, body = places(k), bodies[k]
        lo = int(cols["lead"][k] - piece[a] * step)
        shared.append(xxhash.xxh3_128_digest(body[at[lo] : at[lo + window - step + 1] - gap] + int(piece[a]).to_bytes(8, "little") + int(cols["key"][k]).to_bytes(8, "little", signed=True)))
        for x, far in zip(o[a:b].tolist(), ahead[a:b].tolist(), strict=True):
            marks.append(xxhash.xxh3_128_digest(body[at[x] : at[x + window] - gap], far))
    both, mark = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (shared, marks))
    windows = pa.StructArray.from_arrays([pa.array(cols["pos"][r] + o), pa.array(mark[:, 0]), pa.array(mark[:, 1]), pa.array(n)], names=["pos", "ctx", "cty", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(own)).astype(np.int32)), windows)
    none = pa.nulls(len(cut), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(cols["rid"][r[cut]]), none, none, pa.array(both[:, 0]), lists], names=_NAMES)


_NAMES = ["key", "ctx", "cty", "rid", "s", "e", "piece", "windows"]
WINDOWS = pa.list_(pa.struct([("pos", pa.int64()), ("ctx", pa.int64()), ("cty", pa.int64()), ("n", pa.int64())]))
#: Rows are a class whose two contexts are equal (key, ctx, cty), or a span (rid, s, e), or a piece (rid, piece, windows).
SETTLED_SCHEMA = "key long, ctx long, cty long, rid long, s long, e long, piece long, windows array<struct<pos: long, ctx: long, cty: long, n: long>>"


def _earliest(group: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether each window is the first of its equals; group: -1 where there are none."""
    order = np.lexsort((pos, rid, group))
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out & (group >= 0)


def _resolved(plan: Windows, index: Callable) -> Callable:
    """index(block, window) numbers the groups of equal windows, -1 where a window has no equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bodies in _blocks(batches, BLOCK):
            text, sizes = _numbers(bodies, plan.kind)
            count = cols["run"] + 1
            row = np.repeat(np.arange(len(count)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            block = Block(text, np.cumsum(sizes) - sizes, sizes, cols["lead"], row, offset)
            group = index(block, plan.window)
            first = _earliest(group, cols["rid"][row], cols["pos"][row] + offset)
            # a class: its second context stands right after its first
            start = np.cumsum(count) - count
            twin = np.flatnonzero(cols["twin"] == 1)
            if len(twin):
                lens = count[twin]
                step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                mine, other = (np.repeat(start[x], lens) + step for x in (twin, twin - 1))
                alike = (group[mine] >= 0) & (group[mine] == group[other])
                sure = twin[np.logical_and.reduceat(alike, np.cumsum(lens) - lens)]
                none = pa.nulls(len(sure), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(cols[c][sure]) for c in ("key", "ctx", "cty")], none, none, none, none, pa.nulls(len(sure), WINDOWS)], names=_NAMES)
            lone = cols["twin"][row] == 0
            open_ = lone & (cols["chunk"][row] >= 0) & ((group < 0) | first)
            own = np.flatnonzero(open_)
            pieces = _unsettled(own, block, bodies, cols, np.where(group[own] >= 0, 2, 1), plan)
            if pieces is not None:
                yield pieces
            hit = lone & (group >= 0) & (~first if plan.keep_first else cols["n"][row] == 1)
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            r, o = row[at], offset[at]
            new = np.ones(len(at), bool)
            new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(at)) - 1
            pos = cols["pos"][r[starts]]
            none = pa.nulls(len(starts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(cols["rid"][r[starts]]), pa.array(pos + o[starts]), pa.array(pos + o[ends] + plan.window), none, pa.nulls(len(starts), WINDOWS)], names=_NAMES)

    return run


def _indexed(texts: DataFrame, classes: DataFrame, plan: Windows, index: Callable) -> DataFrame:
    """What the index says of classes (key, ctx, cty, chunk, n, first, last): rows of SETTLED_SCHEMA."""

    def context(of: str, twin: int):
        at = {f: F.col(f) for f in ("key", "chunk", "n", "ctx", "cty")} | {f: F.col(f"{of}.{f}") for f in ("pos", "run", "lead")} | {"twin": F.lit(twin)}
        return F.struct(F.col(f"{of}.rid").alias("rid"), F.struct(*[at[f].cast("long").alias(f) for f in FIELDS]).alias("x"))

    both = F.when(F.col("n") > 1, F.array(context("first", 0), context("last", 1))).otherwise(F.array(context("first", 0)))
    wanted = classes.select(F.inline(both)).groupBy("rid").agg(F.collect_list("x").alias("wanted"))
    cut = texts.join(wanted, "rid").select("rid", "z", "wanted").mapInArrow(_cut(plan), CUT_SCHEMA)
    order = ["key", "chunk", "ctx", "cty", "twin"]
    return cut.repartition("key", "chunk").sortWithinPartitions(*order).mapInArrow(_resolved(plan, index), SETTLED_SCHEMA)


def repeated_spans(keyed: DataFrame, plan: Windows, index: Callable, scratch: Scratch) -> DataFrame:
    """Rows (rid, s, e): symbols of windows that repeat elsewhere (keep_first: that start earlier)."""
    w = plan.window
    texts = keyed.select(F.col(RID).alias("rid"), F.col("text").cast("string").alias("text"))
    keys = texts.select("text").mapInArrow(_key_rows(plan), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key")
    keys = scratch.save(keys, "keys")  # a table of its own, so that the join's hot keys can be split
    held = scratch.save(texts.mapInArrow(_anchor_rows(plan), ANCHOR_SCHEMA).join(keys, "key"), "occurrences")
    place = F.struct("rid", "pos", "run", "lead")
    classes = held.groupBy("key", "ctx", "cty").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    classes = scratch.save(classes, "classes")
    many = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > plan.hot).select("key", F.expr(f"cast(ceil(m / {plan.hot}) as bigint)").alias("chunks"))
    many = scratch.save(many, "hot")
    chunk = F.coalesce(F.pmod(F.xxhash64("ctx", "cty"), F.col("chunks")), F.lit(-1).cast("long"))
    dealt = classes.join(many, "key", "left").withColumn("chunk", chunk)
    packed = squeezed(keyed, False)
    settled = scratch.save(_indexed(packed, dealt, plan, index), "settled")
    scratch.drop("keys", "hot")

    spans = settled.where("s is not null").select("rid", "s", "e")
    sure = settled.where("key is not null").select("key", "ctx", "cty")
    later = (F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))
    if plan.keep_first:  # all members but the first have an earlier equal
        sure = sure.join(classes.select("key", "ctx", "cty", "first"), ["key", "ctx", "cty"])
    sure = scratch.save(sure, "sure")
    scratch.drop("classes")
    members = held.join(sure, ["key", "ctx", "cty"])
    members = (members.where(later) if plan.keep_first else members).select("rid", F.col("pos").alias("s"), (F.col("pos") + F.col("run") + w).alias("e"))
    spans = spans.unionByName(members)

    rest = settled.where("piece is not null").select("rid", "piece", "windows")
    if not rest.isEmpty():
        alike = scratch.save(rest.groupBy("piece").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("piece"), "alike")
        rest = scratch.save(rest.join(alike, "piece").select("rid", F.explode("windows").alias("x")).select("rid", "x.*"), "windows")
        one = F.struct("rid", "pos", F.lit(0).alias("run"), F.lit(0).alias("lead"))
        met = rest.groupBy("ctx", "cty").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("first"), F.max(one).alias("last")).where("n >= 2")
        met = scratch.save(met.select(F.col("ctx").alias("key"), "*", F.lit(-1).cast("long").alias("chunk")), "met")
        agreed = _indexed(packed, met, plan, index).where("key is not null").select("ctx", "cty")
        agreed = scratch.save(agreed.join(met.select("ctx", "cty", "first"), ["ctx", "cty"]), "agreed")
        own = rest.join(agreed, ["ctx", "cty"]).where(later if plan.keep_first else "n = 1")
        spans = spans.unionByName(own.select("rid", F.col("pos").alias("s"), (F.col("pos") + w).alias("e")))
    spans = scratch.save(spans, "spans")
    scratch.drop("occurrences", "settled", "sure", "alike", "windows", "met", "agreed")
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def by_row(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """(rid, z, row, spans) of every row, for the operator's own last step."""
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return squeezed(keyed, True).join(lists, "rid", "left").select("rid", "z", "row", "spans")
