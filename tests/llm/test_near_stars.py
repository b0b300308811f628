"""Near-duplicate groups whose members are like one text but not like each other."""

import random

import numpy as np
import pytest
from test_corpus import SCHEMA, expected_classes, shingle_set

from quillon.llm import near_dups


def stars(seed, groups, copies, words=200):
    """Texts, each followed by copies with 4 scattered words replaced: of 200 words 0.815 to it, under 0.8 to each other."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        texts.append(" ".join(base))
        for c in range(copies):
            w = list(base)
            for k, at in enumerate(rng.sample(range(2, 32), 1) + rng.sample(range(42, 72), 1) + rng.sample(range(92, 122), 1) + rng.sample(range(142, 172), 1)):
                w[at] = f"g{g}c{c}k{k}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def lost(spark, rows):
    """Classes found beyond those wanted."""
    want = expected_classes(rows)
    got = dict(near_dups.near_dups(spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA)).select("row.doc_id", "class_id").collect())
    extra = len(set(got.values())) - len(set(want.values()))
    assert len(got) == len(rows) and (extra or got == want)
    return extra


def test_star_pairs_are_mostly_unlike():
    rows = stars(1, 1, 40)
    sets = [shingle_set(t) for _, t in rows]
    alike = sum((a & b).total() >= 0.8 * (a | b).total() for i, a in enumerate(sets) for b in sets[:i])
    assert 40 <= alike < 60 and len(set(expected_classes(rows).values())) == 1


def test_stars_of_hundreds(spark):
    assert lost(spark, stars(2, 1, 400)) == 0


def test_without_the_rounds_that_spare_work(spark, monkeypatch):
    monkeypatch.setattr(near_dups.Rounds, "largest", lambda self: None)
    monkeypatch.setattr(near_dups.Rounds, "leaders", lambda self: None)
    assert lost(spark, stars(6, 4, 30)) == 0


def test_candidates_of_cells_in_small_batches():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = []
    for key, n in enumerate([2, 3, 9, 2, 40, 1, 5]):
        base = rng.integers(0, 256, near_dups.COORDINATES).astype(np.uint8)
        for i in range(n):
            own = base.copy()
            own[rng.choice(128, int(rng.integers(0, 40)), replace=False)] ^= 1
            rows.append((key, 0, 0, int(i % 2), key % 2 == 0, len(rows), int(rng.integers(0, 4)) + 100 * key, int(rng.integers(80, 120)), own.tobytes()))
    rows.sort(key=lambda r: r[:4])
    names = ["key", "x", "y", "side", "inner", "rid", "class", "size", "sketch"]
    least = near_dups.least_agreement(0.8)
    want = set()
    for a in rows:
        for b in rows:
            if a[:3] == b[:3] and a[5] < b[5] and a[6] != b[6] and (a[3] != b[3] or (a[3] == 0 and a[4])) and min(a[7], b[7]) >= 0.8 * max(a[7], b[7]):
                if sum(x == y for x, y in zip(a[8], b[8], strict=True)) >= least:
                    want.add((a[5], b[5]))
    for size in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [r for b in near_dups._candidates(0.8, True)(iter(batches)) for r in b.to_pylist()]
        assert sorted(tuple(sorted((r["hub"], r["rid"]))) for r in got) == sorted(want)


@pytest.mark.parametrize("weighted", [False, True])
def test_cells_against_single_comparisons(weighted):
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 90).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = np.unique(np.concatenate([rng.choice(base, 80, replace=False), rng.integers(1, 40, 8).astype(np.uint64)]))
        sets.append((own, rng.integers(1, 4, len(own)) if weighted else np.ones(len(own), np.int64)))
    units = [near_dups._units(x, weighted) for x in sets]
    left, right = np.arange(0, 25), np.arange(25, 60)
    for similar in (0.4, 0.7, 0.75):
        for own, hit in near_dups._hits(units, left, right, similar):
            assert hit.tolist() == [[near_dups.similarity(sets[i], sets[j]) >= similar for j in right] for i in own]


def test_members_of_a_class_are_still_compared(spark):
    assert lost(spark, stars(3, 12, 40)) == 0


def test_split_buckets_are_compared_across_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SPLIT", 20)
    rows = stars(5, 1, 1000, 184)  # each copy is 0.8 to its text, so all are one class
    got = near_dups.near_dups(spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA)).select("class_id").distinct()
    assert got.count() == 1


def test_buckets_of_one_group_are_compared_once(spark):
    from quillon.llm.common import Scratch

    group = [(rid, key, 9, rid) for key in (3, 5, 8, 13) for rid in range(40) if (rid + key) % 7]
    apart = [(rid, 20, 9, rid) for rid in range(100, 110)] + [(rid, 21, 9, rid) for rid in range(109, 119)]
    scratch = Scratch(spark, "test")
    rounds = near_dups.Rounds(spark.createDataFrame([(0, "a")], "__q_rid long, text string"), None, None, scratch, 0.8, True)
    rows = group + apart
    got = rounds.joined(spark.createDataFrame(rows, "rid long, key long, size long, class long"), "t").select("key", "rid").collect()
    scratch.drop("")
    assert sorted(map(tuple, got)) == [(3, rid) for rid in range(40)] + sorted((key, rid) for rid, key, _, _ in apart)


def test_large_group_of_unlike_copies_is_read_once_a_block(spark, monkeypatch):
    """Copies that are less than 0.8 to each other meet in many bands; a text goes once to each block of its set."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        at = rng.sample(range(150), 3)
        rows.append((i, " ".join(f"r{i}k{k}" if k in at else w for k, w in enumerate(base))))
    sent = []
    dense = near_dups.Rounds.joined

    def counted(self, met, name):
        out = dense(self, met, name)
        sent.append((out.count(), out.select("rid").distinct().count()))
        return out

    monkeypatch.setattr(near_dups.Rounds, "joined", counted)
    assert lost(spark, rows) == 0
    assert sent and all(all_rows <= 2 * texts for all_rows, texts in sent)


def joined_by_key(spark, run):
    """Rows that joins by bucket made while run ran."""
    import re

    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList(before, store.executionsCount() - before)
    for i in range(done.size()):
        number = done.apply(i).executionId()
        made, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in [nodes.apply(k) for k in range(nodes.size())]:
            if "Join" in node.name() and re.search(r"\[key#\d+L\], \[key#\d+L\], Inner", node.desc()):
                for k in range(node.metrics().size()):
                    metric = node.metrics().apply(k)
                    if metric.name() == "number of output rows" and made.contains(metric.accumulatorId()):
                        total += int(made.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_joins_by_bucket_grow_as_the_group(spark, monkeypatch):
    """No join by bucket makes more rows than documents stand in buckets, nor is one made twice."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    met, made = [], []
    first = near_dups.Rounds.largest

    def counted(self):
        met.append(self.met.count())
        first(self)

    monkeypatch.setattr(near_dups.Rounds, "largest", counted)
    for n in (240, 480):
        rows = []
        for i in range(n):
            at = rng.sample(range(150), 3)
            rows.append((i, " ".join(f"r{i}k{k}" if k in at else w for k, w in enumerate(base)), "c"))
        made.append(joined_by_key(spark, lambda rows=rows: near_dups.near_dups(spark.createDataFrame(rows, SCHEMA)).count()))
    assert all(n <= 5 * stand for n, stand in zip(made, met, strict=True))  # buckets, leaders, everything, sets and blocks
    assert 0 < met[0] < made[0] and made[1] <= 2.5 * made[0], (made, met)


@pytest.mark.parametrize("weighted", [False, True])
def test_texts_read_together(weighted, monkeypatch):
    import zstandard

    from quillon.llm.anchors import symbols_of

    monkeypatch.setattr(near_dups, "BYTES", 60)
    texts = ["", "a", "a a a a", "a b c d e", "a a a a a a a a", " \n", "x" * 300 + " b c d e f", "a b c d e f g h i j k", "\u00e9 a"]
    got = list(near_dups.unpacked([zstandard.compress(t.encode()) for t in texts], weighted))
    assert len(got) == len(texts)
    for text, (elements, weights) in zip(texts, got, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        want = near_dups.weighed(symbols_of("words", raw, np.array([0, len(raw)]))[0], weighted)
        assert elements.tolist() == want[0].tolist() and weights.tolist() == want[1].tolist()
    assert list(near_dups.unpacked([], weighted)) == []


def test_forest_of_parts_joins_what_all_pairs_join(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, near_dups.COORDINATES).astype(np.uint8)
    rows = []
    for i in range(700):
        own = base.copy()
        own[rng.choice(128, int(rng.integers(0, 60)), replace=False)] ^= 1 + i % 5
        rows.append({"key": 1, "x": 0, "y": 0, "side": 0, "inner": True, "rid": i, "class": i, "size": 100, "sketch": own.tobytes()})

    def classes():
        up = list(range(len(rows)))
        links = [r for b in near_dups._candidates(0.8, False)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
        for r in links:  # each joins two classes
            a, b = up[r["hub"]], up[r["rid"]]
            if a != b:
                up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    whole = classes()
    monkeypatch.setattr(near_dups, "HELD", 50)
    assert classes() == whole and len(set(whole)) < len(rows)
