"""Operator 7: packing by cutting-stock column generation.

Every document's ids are cut into pieces: whole sequences of `size` ids, then
the rest; a rest above 128 ids gives up its last 0..15 ids as a piece of their
own, so that pieces have at most 249 lengths, all exact. The histogram of
lengths is the demand of a cutting-stock program: its linear program is solved
over patterns of lengths, new patterns being priced by an unbounded knapsack
(dynamic programming); patterns are rounded down, and what is left, at most a
few pieces a pattern, is placed first-fit decreasing. Pieces are ranked within
their length, by hashed buckets (as many as a length's rows ask for) whose
counts become offsets, and a piece's length and rank tell its sequence and
place. No step collects or sorts all pieces: the driver sees how many there are
of each length, the executors a table of patterns, both of bounded size.

Ids are those that the tokenizers library gives with the named file at its
default setting, so the string of a special token is that token. They are made
from the file's own vocabulary by a faster library where the file is plain
byte-level BPE (four times fewer CPU seconds; tests hold the ids against the
library's), and by tokenizers itself otherwise.

Cases: null and empty texts are the closing id alone; texts are tokenised
whole; doc_id is never a key of a join, so null or repeated ids and repeated
rows are packed like any other; an empty table gives an empty result; of the
input's columns doc_id and text are used, others don't matter.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import Scratch, sliced, table

SIZE, END = 2048, 1
EXACT, STEP = 128, 16
#: Pieces of one length that are ranked together.
TOGETHER = 20_000


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(i, size) for i in range(0, n - size + 1, size)]
    at, rest = n - n % size, n % size
    tail = rest % STEP if rest > EXACT else 0
    if rest - tail:
        out.append((at, rest - tail))
    if tail:
        out.append((n - tail, tail))
    return out


class Lengths:
    """Linear program of the cutting-stock problem: revised simplex with priced columns."""

    def __init__(self, demand: dict[int, int], size: int):
        self.sizes = np.array(sorted(demand), np.int64)
        self.demand = np.array([demand[s] for s in self.sizes], float)
        self.size = size

    def priced(self, worth: np.ndarray) -> tuple[float, np.ndarray]:
        """The pattern worth most: unbounded knapsack over the capacity."""
        best = np.zeros(self.size + 1)
        taken = np.full(self.size + 1, -1)
        sizes = self.sizes
        for c in range(1, self.size + 1):
            k = int(np.searchsorted(sizes, c, "right"))
            best[c] = best[c - 1]
            if k:
                value = best[c - sizes[:k]] + worth[:k]
                i = int(value.argmax())
                if value[i] > best[c]:
                    best[c], taken[c] = value[i], i
        pattern, c = np.zeros(len(sizes), np.int64), self.size
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                pattern[taken[c]] += 1
                c -= sizes[taken[c]]
        return float(best[self.size]), pattern

    def solve(self, gap: float = 5e-4, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
        """Patterns and how often each is used, to within `gap` of the least number of sequences."""
        m = len(self.sizes)
        columns = [np.eye(m, dtype=np.int64)[i] * (self.size // s) for i, s in enumerate(self.sizes)]
        inverse = np.diag([1 / (self.size // s) for s in self.sizes])
        used = inverse @ self.demand
        for turn in range(rounds):
            worth = inverse.sum(axis=0)  # each pattern costs one sequence
            value, pattern = self.priced(np.maximum(worth, 0))
            if value <= 1 + gap:  # Farley's bound: the optimum is at least used.sum() / value
                break
            step = inverse @ pattern
            rising = step > 1e-9
            ratio = np.where(rising, used / np.where(rising, step, 1), np.inf)
            out = int(ratio.argmin())
            used = used - ratio[out] * step
            used[out] = ratio[out]
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
            columns[out] = pattern
            if turn % 200 == 199:
                inverse = np.linalg.inv(np.stack(columns, axis=1).astype(float))
                used = np.maximum(inverse @ self.demand, 0)
        return [(c, max(0.0, float(x))) for c, x in zip(columns, used, strict=True)]


def first_fit(left: Counter, size: int) -> list[Counter]:
    """Sequences of the pieces left, longest first, into the first that has room."""
    bins: list[Counter] = []
    room = np.zeros(0, np.int64)
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            fits = np.flatnonzero(room >= length)
            if len(fits):
                k = int(fits[0])
            else:
                k, room = len(bins), np.append(room, size)
                bins.append(Counter())
            bins[k][length] += 1
            room[k] -= length
    return bins


def plan(demand: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) and how many sequences use each; all pieces are placed."""
    demand = {s: n for s, n in demand.items() if n}
    out = [({size: 1}, demand.pop(size))] if size in demand else []
    left = Counter(demand)
    if demand:
        program = Lengths(demand, size)
        for pattern, x in sorted(program.solve(), key=lambda c: -c[1]):
            own = {int(s): int(a) for s, a in zip(program.sizes, pattern, strict=True) if a}
            times = min([int(x + 1e-6), *(left[s] // a for s, a in own.items())])
            if times:
                out.append((own, times))
                for s, a in own.items():
                    left[s] -= a * times
        out += [(dict(b), 1) for b in first_fit(+left, size)]
    return out


class Places:
    """Where the pieces of each length and rank go."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        base: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, base[length], pattern[length], sequence, offset))
                base[length] += pattern[length] * times
                offset += length * pattern[length]
            sequence += times
        rows.sort()
        self.length, self.base, self.each, self.sequence, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        self.key = (self.length << 48) + self.base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        k = rank - self.base[i]
        return self.sequence[i] + k // self.each[i], self.offset[i] + k % self.each[i] * length


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a tokenizer file that is plain byte-level BPE whose ids follow its merges; None for any other."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    known = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    extras = [spec.get("normalizer"), *[model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]]
    if not known or any(extras) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get(a + b) for a, b in pairs]
    if None in order or any(a >= b for a, b in zip(order, order[1:], strict=False)):
        return None
    byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a tokenizers file, without the tokens that a post-processor would add."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = plain_ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all") if any(x in text for x in special) else fast.encode_ordinary(text)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for start, length in cuts(len(ids), size):
                    own = ids[start : start + length]
                    rows.append((doc, start, length, zlib.crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (5 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + ([pa.array(list(columns[5]), pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def _placed(places) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (np.asarray(batch.column(names.index(c)), np.int64) for c in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            kept = [i for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(sequence), pa.array(offset)], names=[*[names[i] for i in kept], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, (ids,) sequence_id and offset. Sequence ids run from 0 without gaps."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    schema = PIECES + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # numbered once and written, so that equal rows differ and the numbers stay what they are
    pieces = scratch.save(texts.mapInArrow(_pieces(path, size, with_ids), schema).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 250 lengths
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(demand, size)))
    many = F.create_map(*[F.lit(int(x)) for s, n in demand.items() for x in (s, -(-n // TOGETHER))]) if demand else F.lit(None).cast("map<int,int>")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.element_at(many, F.col("length").cast("int"))))
    counted = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = counted.select("length", "bucket", before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("uid")
    ranked = pieces.withColumn("own", F.row_number().over(order) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own")).select(*[c for c in pieces.columns if c not in ("bucket", "uid")], "rank")
    return ranked.mapInArrow(_placed(places), schema + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
