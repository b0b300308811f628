"""Operator 9: media columns from ISO base media containers.

`index` walks nested boxes and decodes the sample tables (stts, stsz, stsc,
stco or co64, stss) of the first track to codec, duration and the keyframes'
byte ranges; it never touches the payload in mdat. `wrap` stores bytes as such
a container, 64 bytes a sample and every sixteenth a sync sample, and
`payload` reads them back through the sample tables.

Cases: null media, truncated or malformed boxes give null fields and an
`error`; null and empty texts are one padded sample; repeated rows get equal
answers; large payloads take 64-bit sizes and offsets; an empty table gives an
empty result; other columns pass through `row` whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.llm.common import packed_row, sliced, table

UNIT, SYNC_EVERY, PER_CHUNK, RATE = 64, 16, 256, 8000
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(data: bytes) -> bytes:
    """A container whose one audio track holds data as 8-bit samples; data is a multiple of 64 bytes."""
    units = len(data) // UNIT
    chunks = -(-units // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHIHH", 1, 8, 0, 0, 0)[:8], struct.pack(">I", RATE << 16))
    sync = range(1, units + 1, SYNC_EVERY)
    runs = [(1, PER_CHUNK if units >= PER_CHUNK else units)]
    if chunks > 1 and units % PER_CHUNK:
        runs.append((chunks, units % PER_CHUNK))

    def moov(start: int) -> bytes:
        wide = start + len(data) >= 1 << 32
        offsets = struct.pack(f">{chunks}{'Q' if wide else 'I'}", *range(start, start + len(data), UNIT * PER_CHUNK))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, n, 1) for c, n in runs]),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(data), 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(data)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(data), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(data) + 8 < 1 << 32 else 16
    start = len(ftyp) + len(moov(0)) + head
    start = len(ftyp) + len(moov(start)) + head
    return ftyp + moov(start) + box(b"mdat", data)


def boxes(data: memoryview, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes in data[lo:hi]."""
    while lo < hi:
        if lo + 8 > hi:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("truncated box header")
            size, body = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        elif size == 0:
            size = hi - lo
        if size < body - lo or lo + size > hi:
            raise ValueError(f"box {kind!r} reaches beyond its parent")
        yield kind, body, lo + size
        lo += size


def _first_track(data: memoryview) -> dict[bytes, tuple[int, int]]:
    found: dict[bytes, tuple[int, int]] = {}

    def walk(lo: int, hi: int, tracks: int) -> int:
        for kind, a, b in boxes(data, lo, hi):
            if kind == b"trak":
                tracks += 1
                if tracks > 1:
                    continue
            if kind in NESTED:
                tracks = walk(a, b, tracks)
            else:
                found.setdefault(kind, (a, b))
        return tracks

    walk(0, len(data), 0)
    return found


class Track:
    """The decoded sample tables of a container's first track."""

    def __init__(self, media: bytes):
        data = memoryview(media)
        at = _first_track(data)
        need = lambda kind: at[kind] if kind in at else _fail(f"no {kind.decode()} box")

        def ints(kind: bytes, skip: int, form: str, n: int, size: int) -> list[tuple]:
            a, b = need(kind)
            if a + skip + n * size > b:
                raise ValueError(f"truncated {kind.decode()} table")
            return list(struct.iter_unpack(">" + form, data[a + skip : a + skip + n * size]))

        def count(kind: bytes, skip: int = 4) -> int:
            return ints(kind, skip, "I", 1, 4)[0][0]

        a, _ = need(b"mdhd")
        if data[a] == 1:
            self.timescale, self.duration = ints(b"mdhd", 20, "IQ", 1, 12)[0]
        else:
            self.timescale, self.duration = ints(b"mdhd", 12, "II", 1, 8)[0]
        a, b = need(b"stsd")
        self.codec = bytes(next(boxes(data, a + 8, b))[0]).decode("latin-1")
        uniform, n = ints(b"stsz", 4, "II", 1, 8)[0]
        sizes = [x for (x,) in ints(b"stsz", 12, "I", n, 4)] if not uniform else None
        self.ticks = sum(c * d for c, d in ints(b"stts", 8, "II", count(b"stts"), 8))
        kind, form, width = (b"co64", "Q", 8) if b"co64" in at else (b"stco", "I", 4)
        chunks = [x for (x,) in ints(kind, 8, form, count(kind), width)]
        runs = ints(b"stsc", 8, "III", count(b"stsc"), 12)
        self.samples: list[tuple[int, int]] = []
        for i, (first, each, _) in enumerate(runs):
            last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
            for c in range(first, last):
                if not 1 <= c <= len(chunks):
                    raise ValueError("stsc names a chunk that is not there")
                offset = chunks[c - 1]
                for _ in range(min(each, n - len(self.samples))):
                    size = uniform or sizes[len(self.samples)]
                    if offset + size > len(media):
                        raise ValueError("a sample lies beyond the file")
                    self.samples.append((offset, offset + size))
                    offset += size
        if len(self.samples) != n:
            raise ValueError("stsc and stco hold too few samples")
        keys = [x for (x,) in ints(b"stss", 8, "I", count(b"stss"), 4)] if b"stss" in at else range(1, n + 1)
        if any(not 1 <= k <= n for k in keys):
            raise ValueError("stss names a sample that is not there")
        self.keyframes = [self.samples[k - 1] for k in keys]


def _fail(why: str):
    raise ValueError(why)


def index(media: bytes | None) -> dict:
    """codec, timescale, duration, n_samples, keyframes [(start, end)] and error of a container."""
    empty = {"codec": None, "timescale": None, "duration": None, "n_samples": None, "keyframes": None, "error": "no media"}
    if media is None:
        return empty
    try:
        t = Track(media)
    except (ValueError, struct.error, StopIteration) as e:
        return empty | {"error": str(e) or "malformed"}
    return {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.samples), "keyframes": [{"start": a, "end": b} for a, b in t.keyframes], "error": None}


def payload(media: bytes) -> bytes:
    """All samples' bytes in order, by the sample tables."""
    return b"".join(media[a:b] for a, b in Track(media).samples)


INDEX_TYPE = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<start: long, end: long>>, error string"
_ARROW_INDEX = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        got = [index(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[k] for g in got], t) for k, t in _ARROW_INDEX]], names=["row", *[k for k, _ in _ARROW_INDEX]])


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """row (the other columns) and the columns of INDEX_TYPE for a binary column of containers."""
    own = df.select(packed_row(df, (column,)).alias("row"), F.col(column).alias("media"))
    fields = StructType.fromDDL(INDEX_TYPE).fields
    return own.mapInArrow(_index_rows, StructType([own.schema["row"], *fields]))


def feature(media: bytes) -> str:
    x = index(media)
    keys = x["keyframes"]
    digest = zlib.crc32(",".join(f"{k['start']}-{k['end']}" for k in keys).encode())
    return f"codec={x['codec']!s};seconds={x['duration'] / x['timescale']:.3f};samples={x['n_samples']};keyframes={len(keys)};first={keys[0]['start']}-{keys[0]['end']};last={keys[-1]['start']}-{keys[-1]['end']};ranges={digest:08x}"


_STORED = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            media = wrap(raw + bytes((-len(raw)) % UNIT or (UNIT if not raw else 0)))
            back = payload(media)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(media)))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in _STORED]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, (_, _, t) in zip(cols, _STORED, strict=True)]], names=["row", *[n for n, _, _ in _STORED]])


def stored_texts(docs: DataFrame) -> DataFrame:
    """row (the other columns) and the figures of each text's container, read back by its tables."""
    df = docs.select(packed_row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    fields = StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in _STORED)).fields
    return df.mapInArrow(_store, StructType([StructField("row", df.schema["row"].dataType), *fields]))


def query(spark, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents")).select("row.doc_id", *[n for n, _, _ in _STORED])
