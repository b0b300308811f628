"""Operator 8: near-duplicates by DartMinHash.

A document is the multiset of its five-word shingles, each weighing as often as
it occurs (`weighted=False`: 1 each). Hashed darts, a Poisson process of unit
rate over each element's weight and rank, are thrown into the regions below the
weights; each of 128 coordinates keeps the dart of least rank, so two documents
agree in a coordinate with the probability of their weighted Jaccard
similarity. Only about k ln k + 2k darts are made for a document, whatever its
length. 32 bands of 4 coordinates bring documents together: at similarity 0.8 a
pair is missed by all bands with probability 5e-8.

Documents with equal multisets are one before any pairing. Pairs that meet in a
bucket are held against each other by their signatures first, a byte of each
coordinate: pairs that agree in too few to be similar (a similar pair is missed
so with probability 5e-8 at most) are left out. All others are decided exactly,
on their whole texts. Two rounds only spare work: they link the pairs that
agree most, in each document's largest bucket, then among one document of each
class of a bucket. The last round leaves out nothing but pairs already in one
class: in every bucket with several classes all members of different classes
are compared, those of the largest class in blocks that the others visit, so a
large class costs what its size is, not the square. Where a bucket's candidates
are many, the texts of its members are compared in blocks, by matrix products;
such buckets that share members (the bands of one large group) are compared as
one set, each pair once and not once a band, wherever that is less work. Links
become classes by components.py.

Cases: documents without a word (null, empty) are classes of their own; one of
one to four words is a single shingle; texts are taken whole; repeated rows are
one class; null or repeated doc_id are kept apart by an inner key and class_id
is then that key; an empty table gives an empty result; other columns pass
through `row` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.anchors import mix, symbols_of
from quillon.llm.common import Scratch, give_back, packed_row, row_keyed, sliced, table, text_buffer
from quillon.llm.components import components, local_stars
from quillon.llm.repeats import RID, squeezed

SHINGLE, COORDINATES, BANDS = 5, 128, 32
SIMILAR = 0.8
#: Rows of a block of signatures; partners of a document that one task compares with it.
SPLIT, SALT = 4096, 512
#: Rows, and shingles, of a block of texts.
TEXTS, BLOCK = 2000, 1 << 18
#: Candidates for each row of a cell beyond which its texts are compared in blocks instead of pair by pair.
DENSE = 16
FINEST = 2.0**-4
#: Shingles of documents whose signatures are made together.
TOGETHER = 1 << 17
#: Bytes of texts that are read together to be compared.
BYTES = 1 << 20
#: Pairs of a cell up to which they are compared one by one; rows of a cell compared with all others at once.
FEW, TILE = 64, 128
#: Candidates of a cell that are held before they are cut to a forest.
HELD = 1 << 20
#: Probability at most that the signatures of a similar pair rule it out.
MISSED = 5e-8


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of all five-word windows; of all words where they are fewer."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(n, SHINGLE)
    out = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        out = mix((out ^ codes[k : n - w + 1 + k]) + np.uint64(0x9E3779B97F4A7C15))
    return out


@lru_cache(maxsize=8)
def least_agreement(similar: float, k: int = COORDINATES) -> int:
    """Coordinates in which a similar pair agrees but for MISSED."""
    total = 0.0
    for n in range(k + 1):
        total += comb(k, n) * similar**n * (1 - similar) ** (k - n)
        if total > MISSED:
            return n
    return k


@lru_cache(maxsize=64)
def _poisson(area: float) -> np.ndarray:
    """Cumulative distribution, up to a negligible tail."""
    p, total, out, i = float(np.exp(-area)), 0.0, [], 0
    while total < 1 - 1e-15 and i < 200:
        total += p
        out.append(total)
        i += 1
        p *= area / i
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


def _rank_bands() -> Iterator[tuple[int, float, float]]:
    """(number, from, width): doubling, then of width 16."""
    yield 0, 0.0, FINEST
    i, lo = 1, FINEST
    while True:
        width = min(lo, 16.0)
        yield i, lo, width
        i, lo = i + 1, lo + width


def darts(elements: np.ndarray, weights: np.ndarray, rank_band: tuple[int, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rank, element's index) of the darts of one band of ranks that hit below the weights."""
    number, lo, width = rank_band
    found = []
    layer, own, low, high = 0, np.arange(len(elements)), 0.0, 1.0
    while len(own):  # layers of weight [0, 1), [1, 2), [2, 4) ..., of an area up to 32
        seed = mix(np.array([(number << 16 | layer) * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))
        h = mix(elements[own] ^ seed)
        chunk = high - low
        cdf = _poisson(width * chunk)
        count = np.searchsorted(cdf, _unit(h), "right")
        hit = np.repeat(np.arange(len(own)), count)
        if len(hit):
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(h[hit] ^ mix(nth.astype(np.uint64) + np.uint64(0xA24BAED4963EE407)))
            rank = lo + width * _unit(mix(dart ^ np.uint64(0x9FB21C651E98DF25)))
            height = low + chunk * _unit(mix(dart ^ np.uint64(0xD6E8FEB86659FD93)))
            below = height < weights[own][hit]
            found.append((dart[below], rank[below], own[hit[below]]))
        layer, low, high = layer + 1, high, high + min(high, max(1.0, 32.0 / width))
        own = own[weights[own] > low]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The least dart of each coordinate, of several documents at once.

    elements: distinct hashes, one document's after another's; first: where each
    document's begin (n + 1); none is empty.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    weights = weights.astype(float)
    top = (k * np.log(k) + 2 * k) / np.add.reduceat(weights, first[:-1])
    best, rank_of = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    unfinished = np.ones(n, bool)
    for band in _rank_bands():
        unfinished &= (band[1] < top) | ~np.isfinite(rank_of.reshape(n, k)).all(axis=1)
        if not unfinished.any():
            return best.reshape(n, k)
        own = np.flatnonzero(unfinished[owner])
        ids, ranks, which = darts(elements[own], weights[own], band)
        order = np.argsort(-ranks, kind="stable")  # the last written is the least
        ids, ranks = ids[order], ranks[order]
        slot = owner[own[which[order]]] * k + (mix(ids ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
        new, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
        new[slot], dart[slot] = ranks, ids
        better = new < rank_of
        best[better], rank_of[better] = dart[better], new[better]
    raise AssertionError


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    weights = np.ones(len(elements)) if weights is None else weights
    return signatures(elements, weights, np.array([0, len(elements)]), k)[0]


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Each document's (row's) hash of each band."""
    rows = sig.reshape(len(sig), bands, -1)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for c in range(rows.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, c])
    return h.view(np.int64)


def weighed(codes: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    own, count = np.unique(shingles(codes), return_counts=True)
    return own, (count if weighted else np.ones(len(own), np.int64))


def all_weighed(codes: np.ndarray, first: np.ndarray, weighted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """`weighed` of each document's codes, whose windows are hashed in one go."""
    windows = shingles(codes) if len(codes) >= SHINGLE else codes
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo < SHINGLE:
            out.append(weighed(codes[lo:hi], weighted))
            continue
        own, count = np.unique(windows[lo : hi - SHINGLE + 1], return_counts=True)
        out.append((own, count if weighted else np.ones(len(own), np.int64)))
    return out


def unpacked(packed: list[bytes], weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The weighted set of each packed text; some are read together."""
    unpack = zstandard.ZstdDecompressor()
    held, size = [], 0
    for i, z in enumerate(packed):
        held.append(unpack.decompress(z))
        size += len(held[-1])
        if size >= BYTES or i == len(packed) - 1:
            edges = np.cumsum([0, *map(len, held)])
            yield from all_weighed(*symbols_of("words", np.frombuffer(b"".join(held), np.uint8), edges), weighted)
            held, size = [], 0


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    if len(b[0]) < len(a[0]):
        a, b = b, a
    i = np.searchsorted(b[0], a[0])
    i[i == len(b[0])] = 0
    same = b[0][i] == a[0]
    low = np.minimum(a[1][same], b[1][i[same]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _features(weighted: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            codes, first = symbols_of("words", *text_buffer(batch.column(1)))
            some = np.flatnonzero(np.diff(first))
            i = 0
            while i < len(some):
                j = max(i + 1, int(np.searchsorted(first[some], first[some[i]] + TOGETHER, "right")) - 1)
                lo, hi = first[some[i]], first[some[j - 1] + 1]
                sets = all_weighed(codes[lo:hi], np.append(first[some[i:j]], hi) - lo, weighted)
                elements, weights = (np.concatenate(x) for x in zip(*sets, strict=True))
                edges = np.cumsum([0, *[len(el) for el, _ in sets]])
                both = elements + weights.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                marks = [np.add.reduceat(mix(x), edges[:-1]).view(np.int64) for x in (both, both ^ np.uint64(0x94D049BB133111EB))]
                sig = signatures(elements, weights, edges)
                hashes, marked = band_hashes(sig), [x.tobytes() for x in (mix(sig) >> np.uint64(56)).astype(np.uint8)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(hashes.ravel()))
                rid = np.asarray(batch.column(0), np.int64)[some[i:j]]
                size = np.add.reduceat(weights, edges[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(rid), *map(pa.array, [*marks, size]), lists, pa.array(marked, pa.binary())], names=["rid", "fa", "fb", "size", "bands", "sketch"])
                i = j

    return run


def _hits(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, matrix of which rows of right are similar to them), some rows at a time.

    Shingles of an eighth of the rows or more meet in one matrix product, rarer
    ones by their lists; those of a single row cannot meet.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, col, rows = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    frequent = rows >= max(2, n / 8)
    number = np.cumsum(frequent) - 1
    held = frequent[col]
    dense = np.zeros((n, int(frequent.sum())), np.float32)
    dense[owner[held], number[col[held]]] = 1
    rare = np.flatnonzero(~held & (rows[col] > 1))
    edges = np.searchsorted(owner[rare], np.arange(n + 1))
    to = np.full(n, -1)
    to[right] = np.arange(len(right))
    listed = rare[to[owner[rare]] >= 0]
    listed = listed[np.argsort(col[listed], kind="stable")]
    count = np.bincount(col[listed], minlength=len(rows))
    start = np.cumsum(count) - count
    partners, opposite, size_right = to[owner[listed]], dense[right].T, sizes[right].astype(float)
    for at in range(0, len(left), TILE):
        own = left[at : at + TILE]
        same = dense[own] @ opposite
        flat = same.ravel()
        places = np.concatenate([rare[edges[r] : edges[r + 1]] for r in own])
        line = np.repeat(np.arange(len(own)), edges[own + 1] - edges[own])
        many = count[col[places]]
        ends = np.cumsum(many)
        i = 0
        while i < len(places):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - many[i] + TOGETHER, "right")))
            times = many[i:j]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            np.add.at(flat, np.repeat(line[i:j], times) * len(right) + partners[np.repeat(start[col[places[i:j]]], times) + nth], np.float32(1))
            i = j
        both = same.astype(float)
        yield own, both / (sizes[own].astype(float)[:, None] + size_right - both) >= similar


def _merged(sets: list[np.ndarray], classes: np.ndarray, left: np.ndarray, right: np.ndarray, similar: float) -> np.ndarray:
    """The rows' classes once every row of left is compared with every row of right."""
    label = classes.copy()

    def merge(met: np.ndarray) -> None:
        met = np.unique(met)
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]

    if len(left) * len(right) <= FEW:
        ones = [np.ones(len(x), np.int64) for x in sets]
        for i in left:
            for j in right:
                n, m = len(sets[i]), len(sets[j])
                if label[i] != label[j] and min(n, m) >= similar * max(n, m) and similarity((sets[i], ones[i]), (sets[j], ones[j])) >= similar:
                    merge(label[[i, j]])
        return label
    for own, hit in _hits(sets, left, right, similar):
        for i, line in zip(own, hit, strict=True):
            merge(np.append(label[right[line]], label[i]))
    return label


def _units(own: tuple[np.ndarray, np.ndarray], weighted: bool) -> np.ndarray:
    """A weighted set as a sorted plain one: an element once for each unit of its weight."""
    elements, weights = own
    if not weighted or (weights == 1).all():
        return elements
    more = weights - 1
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([elements, mix(np.repeat(elements, more) ^ mix(nth.astype(np.uint64)))]))


def _compared(similar: float, weighted: bool) -> Callable:
    """Rows (key, a, b, block, class, z) sorted by cell (key, a, b): links of classes that hold similar rows.

    In a cell all rows of block a meet all rows of block b.
    """

    def links(cell: list[tuple]) -> list[tuple[int, int]]:
        classes = np.array([c for _, c, _ in cell])
        if (classes == classes[0]).all():
            return []
        blocks = np.array([x for x, _, _ in cell])
        left, right = (np.flatnonzero(blocks == x) for x in (blocks.min(), blocks.max()))
        label = _merged([x for _, _, x in cell], classes, left, right, similar)
        return list({(int(c), int(x)) for c, x in zip(classes, label, strict=True) if c != x})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cell = None, []
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            *places, packed = (batch.column(i).to_pylist() for i in range(6))
            for key, a, b, block, cls, own in zip(*places, unpacked(packed, weighted), strict=True):
                if (key, a, b) != last:
                    found += links(cell) if cell else []
                    last, cell = (key, a, b), []
                cell.append((block, cls, _units(own, weighted)))
            yield _pairs(found)
        found = links(cell) if cell else []
        cell = []
        give_back()  # the last cell ends after the rows do
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["hi", "lo"])


def _forest(i: np.ndarray, j: np.ndarray, agree: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows (i, j), those of a spanning forest of the labels that agree most."""
    order = np.argsort(agree, kind="stable")
    i, j, agree = i[order], j[order], agree[order]
    kept: list[np.ndarray] = []
    label = np.unique(label, return_inverse=True)[1]
    left = np.arange(len(i))
    while True:
        a, b = label[i[left]], label[j[left]]
        left, a, b = (x[a != b] for x in (left, a, b))
        if not len(left):
            break
        best = np.full(int(label.max()) + 1, -1)
        np.maximum.at(best, a, left)
        np.maximum.at(best, b, left)
        chosen = np.unique(best[best >= 0])
        kept.append(chosen)
        up = np.arange(len(best))
        for x, y in zip(label[i[chosen]].tolist(), label[j[chosen]].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[at], j[at], agree[at]


def _close(sketch: np.ndarray, size: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left, rows of right, agreement) of the pairs of different labels that may be similar."""
    opposite, size_right, label_right = sketch[right], size[right].astype(float), label[right]
    tile = max(1, (1 << 22) // (COORDINATES * max(1, len(right))))
    for at in range(0, len(left), tile):
        own = left[at : at + tile]
        agree = (sketch[own][:, None, :] == opposite[None]).sum(axis=2, dtype=np.uint8)
        mine = size[own].astype(float)[:, None]
        good = (agree >= least) & (label[own][:, None] != label_right) & (np.minimum(mine, size_right) >= similar * np.maximum(mine, size_right))
        x, y = np.nonzero(good)
        yield own[x], right[y], agree[x, y]


CELL = "key long, x long, y long, side int, inner boolean, rid long, class long, size long, sketch binary"
#: A pair of documents to be compared, the one with more partners as hub; or, where a cell has many, a member of a block of texts.
FOUND = "hub long, rid long, key long, size long, class long"
_FOUND = ["hub", "rid", "key", "size", "class"]


def _candidates(similar: float, every: bool) -> Callable:
    """Rows of CELL, sorted by cell (key, x, y): pairs of different classes that may be similar.

    In a cell all rows of side 0 meet those of side 1 and, where it is `inner`, each other.
    """
    least = least_agreement(similar)

    def met(cell: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, _, inner, _, label, size, sketch = cell
        if len(right):
            yield from _close(sketch, size, label, left, right, least, similar)
        if inner[0]:
            for i, j, agree in _close(sketch, size, label, left, left, least, similar):
                yield i[i < j], j[i < j], agree[i < j]

    def of(cell: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, side, _, rid, label, size, _ = cell
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if (label == label[0]).all():
            return
        held, many = [], np.zeros(len(rid), bool)
        n = 0
        for i, j, agree in met(cell, left, right):
            held.append((i, j, agree))
            n += len(i)
            if every and n > DENSE * len(rid):
                for i, j, _ in held:
                    many[i], many[j] = True, True
                held = []
            elif not every and n > HELD:
                held = [_forest(*(np.concatenate(x) for x in zip(*held, strict=True)), label)]
                n = len(held[0][0])
        if not n:
            return
        if many.any():
            own = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(rid[own]), pa.array(key[own]), pa.array(size[own]), pa.array(label[own])], names=_FOUND)
            return
        i, j, agree = (np.concatenate(x) for x in zip(*held, strict=True))
        if not every:
            i, j, _ = _forest(i, j, agree, label)
        degree = np.bincount(np.concatenate([i, j]), minlength=len(rid))
        turn = (degree[j] > degree[i]) | ((degree[j] == degree[i]) & (rid[j] < rid[i]))
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array(rid[j]), none, none, none], names=_FOUND)

    def few(cols: list[np.ndarray], start: np.ndarray, n: int) -> pa.RecordBatch | None:
        """All pairs of the cells of n rows that begin at start."""
        _, _, inner, rid, label, size, sketch = cols
        side = cols[1]
        i, j = (np.concatenate(x) for x in zip(*[(start + a, start + b) for a in range(n) for b in range(a + 1, n)], strict=True))
        use = (label[i] != label[j]) & ((side[i] != side[j]) | (inner[i] & (side[i] == 0)))
        i, j = i[use], j[use]
        a, b = size[i], size[j]
        use = (np.minimum(a, b) >= similar * np.maximum(a, b)) & ((sketch[i] == sketch[j]).sum(axis=1) >= least)
        i, j = i[use], j[use]
        lo, hi = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
        none = pa.nulls(len(i), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), none, none, none], names=_FOUND) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            key, x, y = (np.asarray(batch.column(k), np.int64) for k in range(3))
            side, inner = np.asarray(batch.column(3), np.int64), batch.column(4).to_numpy(zero_copy_only=False)
            rid, label, size = (np.asarray(batch.column(k), np.int64) for k in (5, 6, 7))
            sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            cols = [key, side, inner, rid, label, size, sketch]
            place = np.stack([key, x, y], axis=1)
            begins = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, [len(key)]])
            i = 0
            if last is not None and (place[0] == last).all():
                held.append([c[: begins[1]] for c in cols])
                i = 1
            if held and i < len(begins) - 1:
                yield from of([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            start, count = begins[i:-2], np.diff(begins[i:-1])  # the last may go on in the next batch
            for n in (2, 3):
                if (got := few(cols, start[count == n], n) if (count == n).any() else None) is not None:
                    yield got
            for a, n in zip(start[count > 3].tolist(), count[count > 3].tolist(), strict=True):
                yield from of([c[a : a + n] for c in cols])
            if i < len(begins) - 1:
                held, last = [[c[begins[-2] :] for c in cols]], place[-1]
        if held:
            yield from of([np.concatenate(c) for c in zip(*held, strict=True)])
        held = []
        give_back()

    return run


def _verified(similar: float, weighted: bool) -> Callable:
    """Rows (hub, salt, is_hub, rid, z), a hub before its partners: links (hi, lo) of those similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            hubs, are_hubs, rids, packed = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for hub, is_hub, rid, got in zip(hubs, are_hubs, rids, unpacked(packed, weighted), strict=True):
                if is_hub:
                    own = got
                elif similarity(own, got) >= similar:
                    found.append((max(hub, rid), min(hub, rid)))
            yield _pairs(found)
        give_back()

    return run


class Rounds:
    """Rounds of comparing: buckets in, classes that grow out."""

    def __init__(self, keyed: DataFrame, made: DataFrame, met: DataFrame, scratch: Scratch, similar: float, weighted: bool):
        self.texts, self.made, self.met, self.scratch = squeezed(keyed, False), made, met, scratch
        self.similar, self.weighted = similar, weighted
        self.root: DataFrame | None = None  # (hi, lo)

    def labelled(self) -> DataFrame:
        """met, with the classes so far."""
        if self.root is None:
            return self.met.withColumn("class", F.col("rid"))
        return self.met.join(self.root.withColumnRenamed("hi", "rid"), "rid", "left").select(*self.met.columns, F.coalesce("lo", "rid").alias("class"))

    def compare(self, cells: DataFrame, every: bool, name: str) -> None:
        """Compares what meets in cells (rid, class and a list `at` of key, x, y, side, inner) and merges classes."""
        s = self.scratch
        rows = self.made.select("rid", "size", "sketch").join(cells, "rid").select("rid", "class", "size", "sketch", F.explode("at").alias("at"))
        rows = rows.select("at.key", "at.x", "at.y", "at.side", "at.inner", "rid", "class", "size", "sketch")
        rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")  # side 0 says whether its cell is inner
        found = s.save(rows.mapInArrow(_candidates(self.similar, every), FOUND), f"{name}-found")
        if found.isEmpty():
            return
        pairs = s.save(found.where("hub is not null").select("hub", "rid").distinct(), f"{name}-pairs")
        hubs = s.save(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("long").alias("salts")), f"{name}-hubs")
        salt = F.pmod(F.xxhash64("rid"), F.col("salts"))
        at = [F.struct("hub", salt.alias("salt"), F.lit(False).alias("is_hub")), F.struct("hub", "salt", F.lit(True).alias("is_hub"))]
        partners = pairs.join(hubs, "hub").select("rid", at[0].alias("at"))
        own = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select(F.col("hub").alias("rid"), at[1].alias("at"))
        wanted = partners.unionByName(own).groupBy("rid").agg(F.collect_list("at").alias("at"))
        sent = self.texts.join(wanted, "rid").select("rid", "z", F.explode("at").alias("at")).select("at.hub", "at.salt", "at.is_hub", "rid", "z")
        sent = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
        verified = _verified(self.similar, self.weighted)
        links = sent.mapInArrow(lambda batches: local_stars(verified(batches)), "hi long, lo long")
        dense = found.where("hub is null")
        if every and not dense.isEmpty():
            links = links.unionByName(self.dense(dense.select("rid", "key", "size", "class"), name))
        if self.root is not None:
            links = self.root.unionByName(links)
        self.root = components(links, s, name)
        s.drop(*[f"{name}-{x}" for x in ("found", "pairs", "hubs", "dense", "keys", "sets")])

    def joined(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (rid, key, size, class), keys that share members made one where all its pairs are no more than the keys' own."""
        each = self.scratch.save(rows.distinct(), f"{name}-dense")
        first = each.groupBy("rid").agg(F.min("key").alias("first"))
        keys = each.join(first, "rid").groupBy("key").agg(F.min("first").alias("set"), F.count(F.lit(1)).alias("n"))
        keys = self.scratch.save(keys, f"{name}-keys")
        sets = each.join(keys, "key").groupBy("rid", "class", "size", "set").agg(F.collect_list("key").alias("keys"))
        sets = self.scratch.save(sets, f"{name}-sets")
        as_set = sets.groupBy("set").agg(F.count(F.lit(1)).alias("all"))
        apart = keys.groupBy("set").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
        joined = as_set.join(apart, "set").where(F.col("all").cast("double") * F.col("all") <= F.col("pairs")).select("set", F.lit(True).alias("joined"))
        own = F.when(F.col("joined"), F.array("set")).otherwise(F.col("keys"))
        return sets.join(joined, "set", "left").select("rid", "class", "size", F.explode(own).alias("key"))

    def dense(self, rows: DataFrame, name: str) -> DataFrame:
        """Links among rows (rid, key, size, class), all of whose texts of a key meet block by block."""
        each = self.joined(rows, name)
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TEXTS, F.sum("size") / BLOCK)).cast("long")
        each = each.join(each.groupBy("key").agg(blocks.alias("blocks")), "key")
        at = F.struct("key", "blocks", F.expr("pmod(xxhash64(rid, key), blocks)").alias("block"))
        wanted = each.groupBy("rid", "class").agg(F.collect_set(at).alias("at"))
        own = self.texts.join(wanted, "rid").select("class", "z", F.explode("at").alias("at")).select("class", "z", "at.*")
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        own = own.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "class", "z")
        own = own.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        compared = _compared(self.similar, self.weighted)
        return own.mapInArrow(lambda batches: local_stars(compared(batches)), "hi long, lo long")

    def largest(self) -> None:
        """Links of each document's largest bucket, those that agree most."""
        best = self.met.groupBy("rid").agg(F.max_by(F.struct("key", "n"), F.struct("n", "key")).alias("b"))
        block = F.pmod(F.xxhash64("rid", "b.key"), F.ceil(F.col("b.n") / SPLIT)).cast("long")
        self.compare(best.select("rid", F.col("rid").alias("class"), F.array(_at("b.key", block, F.lit(0), F.lit(0), F.lit(True))).alias("at")), False, "a")

    def leaders(self) -> None:
        """Links among the first documents of the classes of each bucket, those that agree most."""
        each = self.labelled().groupBy("key", "class").agg(F.min("rid").alias("rid"))
        counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = each.join(self.scratch.save(counts, "counts"), "key")
        block = F.pmod(F.xxhash64("rid", "key"), F.ceil(F.col("n") / SPLIT)).cast("long")
        self.compare(rows.groupBy("rid", "class").agg(F.collect_list(_at("key", block, F.lit(0), F.lit(0), F.lit(True))).alias("at")), False, "b")

    def everything(self) -> None:
        """Links of all pairs of different classes."""
        rows = self.scratch.save(self.labelled().select("rid", "key", "class"), "labelled")
        each = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
        big = each.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("most")).where("classes > 1")
        parts = big.select("key", F.col("most.class").alias("most"), F.ceil(F.col("most.n") / SPLIT).alias("ys"), F.ceil((F.col("all") - F.col("most.n")) / SPLIT).alias("xs"))
        rows = rows.join(self.scratch.save(parts, "parts"), "key")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        x, y = F.pmod(F.xxhash64("rid", "key"), F.col("xs")), F.pmod(F.xxhash64("rid", "key"), F.col("ys"))
        of_most = F.transform(upto("xs"), lambda i: _at("key", i, y, F.lit(1), F.lit(False)))
        visits = F.transform(upto("ys"), lambda j: _at("key", x, j, F.lit(0), j == 0))
        others = F.transform(F.filter(upto("xs"), lambda i: i != x), lambda i: _at("key", F.least(x, i), -1 - F.greatest(x, i), (x > i).cast("int"), F.lit(False)))
        at = F.when(F.col("class") == F.col("most"), of_most.cast(_AT)).otherwise(F.concat(visits.cast(_AT), others.cast(_AT)))
        cells = rows.select("rid", "class", F.explode(at).alias("at")).groupBy("rid", "class").agg(F.collect_list("at").alias("at"))
        self.compare(cells, True, "c")


_AT = "array<struct<key:bigint,x:bigint,y:bigint,side:int,inner:boolean>>"


def _at(key, x, y, side, inner):
    key = F.col(key) if isinstance(key, str) else key
    return F.struct(key.alias("key"), x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("int").alias("side"), inner.alias("inner"))


def near_classes(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, (rid, class) of every document with a word)."""
    scratch = Scratch(docs.sparkSession, "near")
    keyed, _ = row_keyed(docs, scratch)
    texts = keyed.select(F.col(RID).alias("rid"), F.col("text").cast("string").alias("text"))
    made = scratch.save(texts.mapInArrow(_features(weighted), "rid long, fa long, fb long, size long, bands array<long>, sketch binary"), "features")
    reps = scratch.save(made.groupBy("fa", "fb").agg(F.min("rid").alias("rep")), "reps")  # a table of its own, so that a hot group's join can be split
    members = scratch.save(made.select("rid", "fa", "fb").join(reps, ["fa", "fb"]).select("rid", "rep"), "members")
    alone = made.join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi")
    rows = alone.select("rid", F.posexplode("bands").alias("band", "key"))
    marks = [F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    met = scratch.save(met.groupBy("x0", "x1", "n").agg(F.min("key").alias("key")).select("key", "n"), "buckets")  # of buckets of the same documents, one
    met = scratch.save(rows.select("rid", "key").join(met, "key"), "met")
    rounds = Rounds(keyed, made, met, scratch, similar, weighted)
    rounds.largest()
    rounds.leaders()
    rounds.everything()
    classes = members.withColumn("class", F.col("rep"))
    if rounds.root is not None:
        classes = members.join(rounds.root.withColumnRenamed("hi", "rep"), "rep", "left").withColumn("class", F.coalesce("lo", "rep"))
    classes = scratch.save(classes.select("rid", "class"), "result")
    scratch.drop("features", "reps", "members", "buckets", "met", "counts", "labelled", "parts")
    return keyed, classes


def near_dups(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> DataFrame:
    """One row per document: row (all columns but text), class_id and is_first (its class's kept one)."""
    keyed, classes = near_classes(docs, similar, weighted)
    out = keyed.select(F.col(RID).alias("rid"), packed_row(keyed).alias("row")).join(classes, "rid", "left")
    cls = F.coalesce("class", "rid")
    return out.select("row", cls.alias("class_id"), (cls == F.col("rid")).alias("is_first"))


def without_near_dups(docs: DataFrame, similar: float = SIMILAR, weighted: bool = True) -> DataFrame:
    """The documents, columns unchanged, less all but the first of each class."""
    keyed, classes = near_classes(docs, similar, weighted)
    gone = classes.where(F.col("class") != F.col("rid")).select(F.col("rid").alias(RID))
    return keyed.join(gone, RID, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents")).select("row.doc_id", "class_id", "is_first")
