"""Packing, near-duplicates and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import near_dups, packing

SCHEMA = "doc_id long, text string, class_id string"


def test_plan_places_everything():
    rng = np.random.default_rng(1)
    demand = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 700), 60, replace=False), rng.integers(1, 400, 60), strict=True)}
    patterns = packing.plan(dict(demand))
    placed = {}
    for pattern, times in patterns:
        assert sum(s * a for s, a in pattern.items()) <= packing.SIZE
        for s, a in pattern.items():
            placed[s] = placed.get(s, 0) + a * times
    assert placed == demand
    least = sum(s * n for s, n in demand.items()) / packing.SIZE
    assert sum(t for _, t in patterns) <= 1.03 * least + 2
    assert packing.plan({}) == []


@pytest.mark.parametrize("n", [1, 15, 128, 129, 144, 2047, 2048, 2049, 5000])
def test_cuts(n):
    at = 0
    for start, length in packing.cuts(n):
        assert start == at and 0 < length <= packing.SIZE
        at += length
    assert at == n


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", "same text", "same text", "long " * 6000, "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n <|endoftext|", "\x1c\x85\u00a0 ü"]
    texts += [" ".join(rng.choice(["alpha", "beta", "Gamma", "δ", "12", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "nobody", "c")], SCHEMA)
    got = packing.pack(df, with_ids=True).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    for i, t in [*enumerate(texts), (None, "nobody")]:
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and own[0].doc_tokens == sum(r.length for r in own)
    assert packing.pack(df.limit(0)).collect() == []


def test_ids_are_those_of_the_named_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), packing.encoder(path)
    parts = ["<|endoftext|>", "<|endo", " ", "  ", "\n", "\t", "it's", "I'LL", "1234", "ünï", "漢字", "🙂", "\x85", "\x1c", "\u2003", "…", "word", "Word", "$$", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    assert [own(t) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "plain_ranks", lambda spec: None)
    other = packing.encoder.__wrapped__(path)
    assert [other(t) for t in texts] == [own(t) for t in texts]


def test_packing_by_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 3)
    df = spark.createDataFrame([(i % 4, "same words" if i % 3 else f"other {i} words " * i, "c") for i in range(80)], SCHEMA)
    seen = {}
    for r in packing.pack(df).collect():
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seen) == list(range(len(seen)))
    for own in seen.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE


def shingle_set(text):
    w = (text or "").encode().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)]) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def expected_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "one", "one", "a b c d", "a b c d e", "A b c d e"]
    shared = make(60)
    for g in range(12):
        base = make(rng.randint(30, 200))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        if g % 3 == 0:
            texts.append(" ".join(shared + make(60)))
    chain = make(300)  # each like the next, the first unlike the last
    for k in range(8):
        w = list(chain)
        w[: 12 * k] = make(12 * k) if k == 0 else [f"k{j}" for j in range(12 * k)]
        texts.append(" ".join(w))
    line = make(8)
    texts += [" ".join(line * k) for k in (3, 4, 5, 9, 10, 11)]  # alike as sets, not all as multisets
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "split", "salt", "dense"), [(1, 4096, 512, 16), (2, 2, 1, 16), (3, 3, 2, 0)])
def test_near_classes(spark, monkeypatch, seed, split, salt, dense):
    for name, value in (("SPLIT", split), ("SALT", salt), ("DENSE", dense), ("TEXTS", split)):
        monkeypatch.setattr(near_dups, name, value)
    rows = near_corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = near_dups.near_dups(df).select("row.doc_id", "class_id", "is_first").collect()
    want = expected_classes(rows)
    assert {r[0]: r[1] for r in got} == want
    assert {r[0] for r in got if r[2]} == {i for i, c in want.items() if i == c}
    left = near_dups.without_near_dups(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_near_null_ids_and_empty(spark):
    text = " ".join("abcdefghijklmnop")
    df = spark.createDataFrame([(None, text, "x"), (None, text, "x"), (3, text, "x"), (3, None, "x")], SCHEMA)
    assert near_dups.near_dups(df).select("class_id").distinct().count() == 2
    assert near_dups.without_near_dups(df).count() == 2
    assert near_dups.near_dups(df.limit(0)).collect() == []


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    a = rng.integers(1, 9, 300).astype(float)
    b = a.copy()
    b[:120] = rng.integers(1, 9, 120)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 2048
    agree = (near_dups.signature(elements, a, k) == near_dups.signature(elements, b, k)).mean()
    assert agree == pytest.approx(true, abs=0.05)
    few = near_dups.signature(elements[:2])
    assert len(set(few.tolist())) > 60 and (few == near_dups.signature(elements[:2])).all()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(2000)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    good = [make(100) for _ in range(30)]
    texts = [*good, good[0], good[1] + " more words", "bad", None, *[make(40) + " nastyword " + make(40) for _ in range(12)]]
    texts += [make(50) + " " + passage + " " + make(50) for _ in range(2)]
    docs = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("nastyword" in (t or ""))) for i, t in enumerate(texts) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == columns
            left.append({r.doc_id: r.text for r in now.collect()})
    everyone, toxic = set(range(len(texts))), {i for i, t in enumerate(texts) if "nastyword" in (t or "")}
    assert set(left[0]) == everyone - toxic
    assert set(left[1]) == set(left[0]) - {32, 33}
    assert set(left[2]) == set(left[1]) - {30, 31}
    assert set(left[3]) == set(left[2]) and all(passage not in t for t in left[3].values())
    assert all(left[3][i] == texts[i] for i in range(30))
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == set(left[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(5000)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    a, b, long = make(120), make(120), make(60_000)
    docs = [(None, a, "s"), (None, b, None), (7, a, "s"), (7, make(80), "s"), (8, long, "s"), (9, None, "s"), (9, "", "s"), (9, " \n", None), (10, make(50), ""), (10, make(50), "")]
    schema = "doc_id long, text string, source string"
    labels = spark.createDataFrame([(7, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    for at, rows in (("odd", docs), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{at}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens.keys() == {None, 7, 8, 10}  # the copy of a under no id goes: null ids come last
    assert tokens[8] > 60_000 and all(r.doc_tokens > 1 for r in got)
