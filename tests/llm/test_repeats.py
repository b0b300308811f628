"""Suffix-array and suffix-tree deduplication against brute force, with ties, hot keys and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import anchors, suffix_array, suffix_tree

SCHEMA = "doc_id long, text string, key string, rid long, row string"


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 6))) or "x"
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), "the same line again and again, " * 12
    texts = [None, "", " ", "short", passage, "z" * 700, "z" * 650, line * 3]
    for i in range(40):
        base = text(rng.randint(5, 60))
        if i % 3 == 0:
            base = text(20) + " " + passage + " " + text(20)
        if i % 7 == 0:
            base += " " + line
        texts.append(base)
    texts += [texts[9], texts[9], texts[10] + " tail", texts[11][:-30] + " end " + texts[12]]
    rng.shuffle(texts)
    return [(i, t, "k", 5, "r") for i, t in enumerate(texts)]


def bytes_expected(rows, window):
    seen = Counter(b[i : i + window] for r in rows if (b := (r[1] or "").encode()) for i in range(len(b) - window + 1))
    out = {}
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[r[0]] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def words_expected(rows, window):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = (r[1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = True
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[r[0]] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot", "window", "gram"), [(1, 256, 200, 56), (2, 2, 60, 20)])
def test_bytes(spark, seed, hot, window, gram):
    rows = corpus(seed)
    got = suffix_array.dedup_bytes(spark.createDataFrame(rows, SCHEMA), window, gram, hot)
    got = got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == bytes_expected(rows, window)


@pytest.mark.parametrize(("seed", "hot", "window", "gram"), [(3, 256, 20, 6), (4, 2, 6, 2)])
def test_words(spark, seed, hot, window, gram):
    rows = corpus(seed)
    got = suffix_tree.dedup_words(spark.createDataFrame(rows, SCHEMA), window, gram, hot)
    got = got.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == words_expected(rows, window)


def test_null_and_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(None, a), (None, None), (1, a), (1, a), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_array.dedup_bytes(df).select("row.doc_id", "n_bytes", "n_removed").collect()
    n = len(a)
    assert sorted(map(tuple, got), key=str) == sorted([(None, n, n), (None, 0, 0), (1, n, n), (1, n, n), (2, 1, 0)], key=str)
    got = suffix_tree.dedup_words(df).select("row.doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 60, 60), (None, 0, 0), (1, 60, 0), (1, 60, 60), (2, 1, 0)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.dedup_bytes(df).collect() == []
    assert suffix_tree.dedup_words(df).collect() == []


def test_cover_holds_all_differences():
    c = suffix_array.COVER
    assert {int((a - b) % suffix_array.PERIOD) for a in c for b in c} == set(range(suffix_array.PERIOD))


def test_ranks_are_those_of_one_sort_by_all_keys(monkeypatch):
    """Keys are sorted one at a time, never together; ranks that are too wide to be joined are made dense first."""
    rng = np.random.default_rng(21)
    n = 4000
    wide = rng.choice(rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2) + np.uint64(1), n)  # above and below 2^63
    keys = [wide, rng.integers(-1, 5, n), rng.integers(-1, 1 << 40, 9)[rng.integers(0, 9, n)], rng.integers(-1, 1 << 40, 3)[rng.integers(0, 3, n)], rng.permutation(wide)]
    rows = list(zip(*[k.tolist() for k in keys], strict=True))
    number = {row: i for i, row in enumerate(sorted(set(rows)))}
    want = [number[row] for row in rows]

    def together(*_, **__):
        raise AssertionError("sorts by several keys at once")

    monkeypatch.setattr(np, "lexsort", together)
    assert suffix_array._dense(*keys).tolist() == want
    assert suffix_array._dense(keys[0][:0], keys[1][:0]).tolist() == []
    text = rng.choice(np.frombuffer(b"ab\xff", np.uint8), 600)
    text = np.concatenate([text, text[:300], np.zeros(64, np.uint8)])  # what repeats lies 600 apart: residues differ
    text = np.concatenate([text, np.zeros(-len(text) % suffix_array.PERIOD, np.uint8), text])
    at = np.arange(0, 800)
    at = np.concatenate([at, at + len(text) - 964])
    groups = {}
    for own, group in suffix_array.sorted_ties(text, at, 100):
        for i, g in zip(own.tolist(), group.tolist(), strict=True):
            groups.setdefault(g, set()).add(int(at[i]))
    equal = {}
    for p in at.tolist():
        equal.setdefault((text[p : p + 100].tobytes(), p % suffix_array.PERIOD), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in equal.values() if len(x) > 1) and groups


def test_sorted_ties_by_small_buckets():
    rng = np.random.default_rng(5)
    piece = rng.integers(0, 3, 400).astype(np.uint8)
    text = np.concatenate([piece, piece, rng.integers(0, 3, 84).astype(np.uint8), piece[31:]])  # alike mod 31 in part
    at = np.arange(len(text) - 100)
    found = {}
    for own, group in suffix_array.sorted_ties(text, at, 100, bucket=64):
        for g in np.unique(group):
            found[tuple(sorted(own[group == g].tolist()))] = True
    for group in found:
        assert len({bytes(text[i : i + 100]) for i in group}) == 1
    by = {}
    for i in at.tolist():
        by.setdefault((bytes(text[i : i + 100]), i % 31), []).append(i)
    assert set(found) == {tuple(v) for v in by.values() if len(v) > 1}


def test_deep_nodes_by_small_groups():
    rng = np.random.default_rng(6)
    text = np.concatenate([rng.integers(0, 4, 300), np.full(40, 9)]).astype(np.uint64)
    text = np.concatenate([text, text[50:200], text[10:90]])
    at = np.arange(len(text) - 8)
    got = set()
    for leaves, node in suffix_tree.deep_nodes(text, at, 8, most=5):
        got |= {tuple(sorted(at[leaves[node == k]].tolist())) for k in np.unique(node)}
    by = {}
    for i in at.tolist():
        by.setdefault(text[i : i + 8].tobytes(), []).append(i)
    assert got == {tuple(v) for v in by.values() if len(v) > 1}


def test_long_documents_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 300)
    monkeypatch.setattr(anchors, "PIECE", 500)
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    first = np.array([0, 0, 100, 2600, 2650, 4000])
    doc, s, a, e, key = anchors.anchors(data, first, 100, 30)
    held = Counter()
    for d, lo, hi in zip(doc.tolist(), s.tolist(), e.tolist(), strict=True):
        held.update((d, x) for x in range(lo, hi + 1))
    assert set(held.values()) == {1}
    assert set(held) == {(d, x) for d in range(5) for x in range(max(0, int(first[d + 1] - first[d]) - 99))}


def thue_morse(a: str, b: str, n: int) -> str:
    """Its complement has the same polynomial hash modulo 2^64 from 1,024 places on, whatever the base."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse_stay_apart(spark):
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {thue_morse('a', 'b', 1024)}", "k", 0, "r"), (2, f"{lead} {thue_morse('b', 'a', 1024)}", "k", 0, "r"), (3, f"{thue_morse('a', 'b', 4096)} x", "k", 0, "r"), (4, f"{thue_morse('b', 'a', 4096)} y", "k", 0, "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = suffix_tree.dedup_words(df).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == words_expected(rows, 20)
    got = suffix_array.dedup_bytes(df).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == bytes_expected(rows, 200)
    codes = anchors.symbols_of("words", np.frombuffer(b" ".join(r[1].encode() for r in rows), np.uint8), np.array([0, sum(len(r[1]) + 1 for r in rows) - 1]))[0]
    assert len(set(codes.tolist())) == 19 + 2 + 2 + 2


@pytest.mark.parametrize("hot", [256, 1])
def test_nothing_goes_without_the_index(spark, monkeypatch, hot):
    blind = lambda block, window: np.full(len(block.row), -1, np.int64)
    monkeypatch.setattr(suffix_array, "index", blind)
    monkeypatch.setattr(suffix_tree, "index", blind)
    df = spark.createDataFrame(corpus(9), SCHEMA)
    assert suffix_array.dedup_bytes(df, hot=hot).where("n_removed > 0").count() == 0
    assert suffix_tree.dedup_words(df, hot=hot).where("n_removed > 0").count() == 0


def test_tie_places_cover_every_window():
    for window in (60, 74, 75, 100, 200, 255, 400):
        length = suffix_array.sample_ranks(np.zeros(31, np.uint8), window)[1]
        for residue, at in enumerate(np.stack(suffix_array.tie_places(window, length), axis=1)):
            seen = np.zeros(window, bool)
            seen[:16] = seen[window - 16 :] = True
            for p in at.tolist():
                assert (residue + p) % suffix_array.PERIOD in suffix_array.COVER and 0 <= p <= window - length
                seen[p : p + length] = True
            assert seen.all()


def test_internal_nodes_are_nested_runs():
    common = np.array([3, 5, 5, 2, 4, 0, 3])
    got = sorted(zip(*(x.tolist() for x in suffix_tree.internal_nodes(common, 2)), strict=True))
    assert got == [(0, 3, 3), (0, 5, 2), (1, 3, 5), (4, 5, 4), (6, 7, 3)]
