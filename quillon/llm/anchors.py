"""Content-defined anchors: the leftmost least gram of each window.

Equal windows have their anchor at the same place, so any two equal windows
meet under the same anchor key, and only about 2 / (window - gram) of the
positions have to be shuffled. Grams are hashed by a rolling polynomial, which
only proposes who meets whom: that two places hold the same symbols is decided
by their bytes (repeats.py). All arrays are numpy over a batch of documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
INDEX_BITS = 20
LOW = np.uint64((1 << INDEX_BITS) - 1)
HIGH = np.uint64(((1 << 64) - 1) ^ ((1 << INDEX_BITS) - 1))
#: Symbols taken together; a longer document is cut into pieces that overlap by a window.
SEGMENT = 1 << 18
PIECE = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = PIECE + 4096
    return powers(size if n <= size else 1 << (n - 1).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    if symbols.dtype == np.uint8:
        symbols = BYTE_CODES[symbols]
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's first word (n + 1)."""
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)  # a document's edge parts words
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def eights(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as one number; zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), kind, padded, strides=(1,))


#: Longer words are hashed one at a time.
LONG = 256


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time, each mixed into what came before."""
    at, size = eights(data), ends - starts
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mix((at[starts].astype(np.uint64) & mask[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    own = np.flatnonzero((size > 8) & (size <= LONG))
    k = 8
    while len(own):
        more = at[starts[own] + k].astype(np.uint64) & mask[np.minimum(size[own] - k, 8)]
        out[own] = mix((out[own] ^ more) + np.uint64(0x51ED270B0A1F39C1))
        k += 8
        own = own[size[own] > k]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with one space between words, and where each word begins there."""
    space = SPACES[data]
    out = np.where(space, np.uint8(32), data)
    drop = space.copy()
    drop[1:] &= space[:-1]
    gone = np.flatnonzero(drop)
    return (out[~drop], starts - np.searchsorted(gone, starts)) if len(gone) else (out, starts)


def symbols_of(kind: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch of texts (bytes as they are, words as hashes) and each document's first symbol (n + 1)."""
    if kind == "bytes":
        return data, offsets
    starts, ends, first = word_spans(data, offsets)
    return word_codes(data, starts, ends), first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def _runs(symbols: np.ndarray, edges: np.ndarray, window: int, gram: int):
    n = len(symbols)
    if n < window:
        return None
    inverse = _powers(n)[1]
    sums = prefix_sums(symbols)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    least = sliding_min((grams & HIGH) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    at = (least & LOW).astype(np.int64)
    m = len(at)
    crossing = np.zeros(m + 1, np.int32)
    inner = edges[(edges > 0) & (edges < n)]
    np.add.at(crossing, np.minimum(np.maximum(inner - window + 1, 0), m), 1)
    np.add.at(crossing, np.minimum(inner, m), -1)
    valid = np.cumsum(crossing[:-1]) == 0
    change = np.ones(m + 1, bool)
    change[1:m] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    cuts = np.flatnonzero(change)
    s, e = cuts[:-1], cuts[1:] - 1
    keep = valid[s]
    s, e = s[keep], e[keep]
    a = at[s]
    return s, a, e, grams[a]


def anchors(symbols: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(document, s, a, e, key) arrays of all anchors of a batch.

    The anchor at symbol a of the document is that of the windows that start at
    s..e, its context; key is the gram's hash.
    """
    parts = []
    n, i = len(first) - 1, 0
    while i < n:
        j = i + 1
        if first[j] - first[i] <= SEGMENT:
            j = max(j, int(np.searchsorted(first, first[i] + SEGMENT, "right")) - 1)
            lo, pieces = int(first[i]), [(int(first[i]), int(first[j]))]
        else:
            lo, end = int(first[i]), int(first[j])
            pieces = [(p, min(p + PIECE + window - 1, end)) for p in range(lo, max(lo + 1, end - window + 1), PIECE)]
        for p, q in pieces:
            found = _runs(symbols[p:q], first[i : j + 1] - p, window, gram)
            if found is not None and len(found[0]):
                s = found[0] + p
                doc = np.searchsorted(first, s, "right") - 1
                parts.append((doc, s - first[doc], found[1] + p - first[doc], found[2] + p - first[doc], found[3]))
        i = j
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
