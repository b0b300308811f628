"""Operator 6: byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash (compress, hash, displace) over the
vocabulary's byte strings resolves whole pre-tokens in one probe that is
confirmed against the stored string; a miss is merged by a heap of adjacent
pairs over a doubly linked list of its bytes, lowest rank first, leftmost on
ties, in n log n even for a pre-token of megabytes; a short one's least pair is
sought in a plain list, which gives the same and costs less. Answers for recent
pre-tokens are kept in a table of bounded size.

Cases: null and empty texts give no ids; texts are encoded whole; strings that
look like special tokens are ordinary text; repeated rows get equal answers; an
empty table gives an empty result; other columns pass through `row` whatever
their names. Decoding gives bytes, since ids may end inside a character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from quillon.llm.common import packed_row, sliced, table

#: Pre-tokens whose ids a worker keeps.
MEMO = 300_000
#: Bytes of a pre-token up to which it is merged in a plain list; no rank is so high.
SHORT, NONE = 32, 1 << 62


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n keys, n slots, one probe."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.groups = n, max(1, (n + 1) // 2)
        buckets: list[list[int]] = [[] for _ in range(self.groups)]
        hashes = [self._hash(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.groups].append(i)
        self.shift = [0] * self.groups  # displacement, or -1 - slot for a lone key
        self.key: list[bytes] = [b""] * n
        self.index = [-1] * n
        free = np.ones(n, bool)
        for g in sorted(range(self.groups), key=lambda g: -len(buckets[g])):
            own = buckets[g]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in own]
                if len(set(slots)) == len(own) and free[slots].all():
                    break
                d += 1
            self.shift[g] = d
            for i, s in zip(own, slots, strict=True):
                self.key[s], self.index[s], free[s] = keys[i], i, False
        left = iter(np.flatnonzero(free).tolist())
        for g, own in enumerate(buckets):
            if len(own) == 1:
                s = next(left)
                self.shift[g], self.key[s], self.index[s], free[s] = -1 - s, keys[own[0]], own[0], False

    @staticmethod
    def _hash(key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 17) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF) * ((h & 0xFFFF) | 1)) % self.n

    def get(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.groups]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.index[s] if self.key[s] == key else -1


class Recent(dict):
    """A table of bounded size of answers for recent pre-tokens; when half is full, what came before is dropped unless used since."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, token: str):
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        got = self.older.get(token)
        if got is None:
            got = self.of(token)
        if len(token) <= 64:
            self[token] = got
        return got


class Coder:
    """Encodes pre-tokens, decodes ids, and knows recent pre-tokens' ids, or their digits and what they decode to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.tier = PerfectHash(keys)
        self.ids = [ranks[k] for k in keys]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("a byte has no rank of its own")
        #: What two neighbours join to, by their ids; a rank is an id.
        self.joint = {(a, b): r for k, r in ranks.items() for i in range(1, len(k)) if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None}
        spaced = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaced.replace("+|", "++|"))  # what ends an alternative gives nothing back
        self.forget()

    def forget(self) -> None:
        self.known = Recent(self.look_up)
        self.shown = Recent(self.show)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "shown")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        n, joint = len(piece), self.joint.get
        if n <= SHORT:
            return self.merge_short(piece)
        ids = list(map(self.single.__getitem__, piece))  # a node is known by its first byte; -1: joined to one before
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := joint(pair, -1)) >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or joint((ids[i], ids[j]), -1) != r:
                continue
            ids[i], ids[j], k, h = r, -1, after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r2 := joint((r, ids[k]), -1)) >= 0:
                    heappush(heap, r2 << 32 | i)
            if h >= 0 and (r2 := joint((ids[h], r), -1)) >= 0:
                heappush(heap, r2 << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        joint = self.joint.get
        ids = [self.single[b] for b in piece]
        ranks = [joint(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]  # of each id with the next; the last has none
        ranks.append(NONE)
        while (r := min(ranks)) < NONE:
            i = ranks.index(r)
            ids[i] = r
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = joint((ids[i - 1], r), NONE)
            if i + 1 < len(ids):
                ranks[i] = joint((r, ids[i + 1]), NONE)
        return tuple(ids)

    def look_up(self, token: str) -> tuple[int, ...]:
        piece = token.encode()
        whole = self.tier.get(piece)
        return (self.ids[whole],) if whole >= 0 else self.merge(piece)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(text)))) if text else []

    def round_trip(self, text: str | None) -> tuple[str, bytes]:
        """The ids of a text, as numbers with commas between, and the bytes that they decode to."""
        tokens = self.pattern.findall(text) if text else []
        shown = list(map(self.shown.__getitem__, tokens))
        return ",".join([digits for digits, _ in shown]), b"".join([raw for _, raw in shown])

    def show(self, token: str) -> tuple[str, bytes]:
        """The digits of a pre-token's ids, and the bytes that these ids decode to."""
        ids = self.look_up(token)
        return ",".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def coder(df: DataFrame, path: str, pattern: str):
    """A coder built once on the driver and broadcast: its size is the vocabulary's, not the input's."""
    return df.sparkSession.sparkContext.broadcast(Coder(load_ranks(path), pattern))


def _mapped(shared, make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Coder = shared.value
        for batch in sliced(batches):
            made = make(c, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], names=[batch.schema.names[0], *made])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(packed_row(docs).alias("row"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """row (the other columns) and ids of each text."""
    df = _rows(docs)
    make = lambda c, texts: {"ids": pa.array([c.encode(t) for t in texts], pa.list_(pa.int32()))}
    return df.mapInArrow(_mapped(coder(df, path, pattern), make), StructType([df.schema["row"], StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """row and the bytes of each row's ids."""
    df = encoded.select("row", "ids")
    make = lambda c, lists: {"bytes": pa.array([c.decode(x or ()) for x in lists], pa.binary())}
    return df.mapInArrow(_mapped(coder(df, path, pattern), make), StructType([df.schema["row"], StructField("bytes", BinaryType())]))


def _digests(c: Coder, texts: list[str | None]) -> dict[str, pa.Array]:
    count, coded, back = [], [], []
    for text in texts:
        ids, raw = c.round_trip(text)
        count.append(ids.count(",") + 1 if ids else 0)
        coded.append(hashlib.sha256(ids.encode()).hexdigest())
        back.append(hashlib.sha256(raw).hexdigest())
    return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(back, pa.string())}


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """row, n_tokens and digests of the ids and of what they decode to; the ids never leave the worker."""
    df = _rows(docs)
    out = [df.schema["row"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return df.mapInArrow(_mapped(coder(df, path, pattern), _digests), StructType(out))


def query(spark, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
