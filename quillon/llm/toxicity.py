"""Operator 4: severity of toxicity by cumulative-link ordinal regression.

Features are sparse: which words (lower case) a text has, each with the log
ratio of its shares of toxic and clean documents as its value, the nearer to 0
the less sure that ratio is. One weight vector is shared by all ordered
thresholds: P(grade >= k) = sigmoid(w x - t_k). Labels say only whether a
document is toxic, so training grades are made of them: grade 0 for a clean
document; 1, 2 or 3 for a toxic one by the sum of its words' values above 0,
cut at the sample's terciles. The expected severity is the sum of
P(grade >= k); a document is toxic where P(grade >= 1) reaches one half.

The model is fitted on a bounded sample (a parameter) of labelled rows: those
least by a hash of their ids, toxic and clean alike. All their words are
features, none is left out; the sample bounds what is broadcast.

Cases: null and empty texts have only the bias; texts are read whole; a
document labelled several times is toxic if any label says so; null labels are
not used; without a toxic and a clean label nothing is toxic; repeated rows get
equal answers; an empty table gives an empty result; other columns pass through
unchanged whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator
from sys import intern

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from quillon.llm.common import give_back, packed_row, sliced, table

WORD = regex.compile(r"\p{L}+")
#: Labelled documents of either kind that a model is fitted on.
SAMPLE = 2500
GRADES = 3
#: Standard errors between a word's shares of toxic and clean documents at which it counts half of its log ratio.
SURE = 4.0


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Ordinal:
    """Weights by word and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, clean: list[Collection[str]], toxic: list[Collection[str]], rounds: int = 400, decay: float = 2e-4) -> Ordinal:
        if not clean or not toxic:
            return cls({}, [50.0, 60.0, 70.0])
        a, b = (Counter(w for d in docs for w in d) for docs in (clean, toxic))
        n, m = len(clean), len(toxic)
        vocabulary = sorted(a.keys() | b.keys())
        in_clean, in_toxic = (np.array([c[w] for w in vocabulary], float) for c in (a, b))
        p, q = (in_clean + 0.5) / (n + 1), (in_toxic + 0.5) / (m + 1)
        share = (in_clean + in_toxic + 1) / (n + m + 2)
        sure = ((q - p) ** 2 / (share * (1 - share) * (1 / n + 1 / m)) / SURE**2) ** 2
        value = (np.log(q) - np.log(p)) * sure / (1 + sure)  # a word's feature value; near 0 for one that chance explains
        tells = dict(zip(vocabulary, value.tolist(), strict=True))
        found = np.array([sum(max(0.0, tells[w]) for w in sorted(d)) for d in toxic])
        low, high = np.quantile(found, [1 / 3, 2 / 3])
        grade = np.concatenate([np.zeros(n, np.int64), 1 + (found > low) + (found > high)])
        at = {w: i for i, w in enumerate(vocabulary)}
        docs = [*clean, *toxic]
        rows = np.repeat(np.arange(n + m), [len(d) for d in docs])
        cols = np.fromiter((at[w] for d in docs for w in d), np.int64, len(rows))
        held = value[cols]
        balance = np.concatenate([np.full(n, 0.5 / n), np.full(m, 0.5 / m)])
        theta = np.zeros(len(vocabulary) + GRADES)
        theta[-GRADES:] = [0.0, np.log(1.0), np.log(1.0)]  # first threshold, log gaps between the others
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for turn in range(1, rounds + 1):
            weights, cut = theta[:-GRADES], np.cumsum([theta[-GRADES], *np.exp(theta[1 - GRADES :])])
            score = np.bincount(rows, weights[cols] * held, n + m)
            above = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -40, 40)))
            step = np.concatenate([np.ones((n + m, 1)), above, np.zeros((n + m, 1))], axis=1)
            i = np.arange(n + m)
            p_grade = np.maximum(step[i, grade] - step[i, grade + 1], 1e-9)
            slope = step * (1 - step)
            d_low, d_high = slope[i, grade] / p_grade * balance, slope[i, grade + 1] / p_grade * balance
            g = np.zeros_like(theta)
            g[:-GRADES] = -np.bincount(cols, (d_low - d_high)[rows] * held, len(vocabulary)) + decay * weights
            g_cut = np.zeros(GRADES + 2)
            np.add.at(g_cut, grade, d_low)
            np.add.at(g_cut, grade + 1, -d_high)
            tail = np.cumsum(g_cut[1:-1][::-1])[::-1]  # a threshold moves all above it
            g[-GRADES] = tail[0]
            g[1 - GRADES :] = tail[1:] * np.exp(theta[1 - GRADES :])
            mean = 0.9 * mean + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            theta -= 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
        cut = np.cumsum([theta[-GRADES], *np.exp(theta[1 - GRADES :])])
        return cls({w: float(x * v) for w, x, v in zip(vocabulary, theta, value, strict=False) if x * v}, cut.tolist())

    def above(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, 3."""
        score = sum(map(self.weights.get, self.weights.keys() & words_of(text)))
        return [float(1 / (1 + np.exp(-min(40.0, max(-40.0, score - t))))) for t in self.thresholds]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model from at most `sample` toxic and `sample` clean labelled documents."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).alias("bad"))
    chosen = []
    for bad in (False, True):
        own = marks.where(F.col("bad") == bad)
        chosen.append(own.orderBy(F.xxhash64("id"), "id").limit(sample))
    ids = chosen[0].union(chosen[1])  # bounded by the sample, so it may be broadcast
    text = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    kinds: dict[bool, list[tuple]] = {False: [], True: []}
    own = text.join(F.broadcast(ids), "id").groupBy("id", "bad").agg(F.min("text").alias("text"))  # repeated ids count once
    for r in own.toLocalIterator():  # words of one text at a time, each word held once
        kinds[r["bad"]].append((r["id"], r["text"][:64], tuple(map(intern, sorted(words_of(r["text"]))))))
    clean, toxic = ([words for _, _, words in sorted(kinds[bad])] for bad in (False, True))
    model = Ordinal.fit(clean, toxic)
    del kinds, clean, toxic
    give_back()
    return model


def _scored(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Ordinal = model.value
        for batch in sliced(batches):
            above = np.array([m.above(t) for t in batch.column(1).to_pylist()]).reshape(-1, GRADES)
            bad = above[:, 0] >= 0.5
            grade = (above >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(grade), pa.array(bad)], names=[*batch.schema.names, "severity", "grade", "is_toxic"])

    return run


def score(docs: DataFrame, model: Ordinal, keep_text: bool = False) -> DataFrame:
    """One row per document: row (the other columns), text, severity (0 to 3), grade and is_toxic."""
    df = docs.select(packed_row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    out = [StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("is_toxic", BooleanType())]
    scored = df.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), StructType([*df.schema.fields, *out]))
    return scored if keep_text else scored.drop("text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", "severity", "grade", "is_toxic")
