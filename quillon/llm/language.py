"""Operator 5: language identification by a multilingual mixture.

A document's character trigrams are taken as drawn from a mixture of language
models; expectation-maximisation estimates the proportions, and languages are
dropped from the set, one at a time, while that raises the likelihood less a
penalty for each language (as in the Bayesian information criterion). The
language with the largest proportion is predicted; its proportion is the score.

The models are fitted on a bounded sample (a parameter) of labelled rows,
drawn by a hash of their ids from those whose crc32(doc_id) mod 4 is not 2.
Predictions see the text alone.

Cases: null texts and texts without letters give `und` with score 0; texts are
used whole whatever their length; repeated rows get equal answers; with no
labelled row every text is `und`; an empty table gives an empty result; other
columns pass through `row` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, MapType, StringType, StructField, StructType

from quillon.llm.common import packed_row, sliced, table

BITS = 16
#: Labelled documents a language that the models are fitted on.
SAMPLE = 400
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
UNKNOWN = "und"


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def trigrams(text: str) -> np.ndarray:
    """Hashes of the letter trigrams of a text, words parted by one space."""
    plain = " " + NOT_LETTERS.sub(" ", text).strip().lower() + " "
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], log_odds: np.ndarray):
        self.langs, self.p = langs, np.exp(log_odds)  # p: [bucket, language]

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        langs = sorted({lang for lang, _ in rows})
        counts = np.full((1 << BITS, max(1, len(langs))), 0.1)
        for lang, text in rows:
            counts[:, langs.index(lang)] += np.bincount(trigrams(text), minlength=1 << BITS)
        return cls(langs, np.log(counts / counts.sum(axis=0)))

    def mixture(self, text: str | None, rounds: int = 30) -> dict[str, float]:
        """Languages of the set chosen for a text, with their proportions."""
        if not text or not self.langs or not LETTER.search(text):
            return {}
        own, times = np.unique(trigrams(text), return_counts=True)
        if not len(own):
            return {}
        likely = self.p[own]
        total = times.sum()

        def em(chosen: list[int]) -> tuple[float, np.ndarray]:
            p = likely[:, chosen]
            share = np.full(len(chosen), 1 / len(chosen))
            for _ in range(rounds if len(chosen) > 1 else 1):
                mixed = p @ share
                new = share * ((times / mixed) @ p) / total
                close = np.abs(new - share).max() < 1e-4
                share = new
                if close:
                    break
            return float(times @ np.log(p @ share)), share

        chosen = list(range(len(self.langs)))
        penalty = 0.5 * np.log(total + 1)
        best, share = em(chosen)
        best -= penalty * len(chosen)
        while len(chosen) > 1:
            without = [c for i, c in enumerate(chosen) if i != int(np.argmin(share))]
            fit, new = em(without)
            fit -= penalty * len(without)
            if fit < best:
                break
            chosen, best, share = without, fit, new
        share = share / share.sum()
        return {self.langs[c]: float(min(1.0, s)) for c, s in zip(chosen, share, strict=True)}


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Models from at most `sample` labelled rows of each language, those least by a hash of the id."""
    use = docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    use = use.select(F.col("lang").cast("string").alias("lang"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # ids, however often repeated
    if not counts:
        return Model.fit([])
    edge = F.lit(None).cast("long")
    for lang, n in counts.items():  # about 1.5 times the sample is read
        edge = F.when(F.col("lang") == lang, F.lit(-(1 << 63) + int((1 << 64) * min(1.0, 1.5 * sample / max(1, n))) - 1)).otherwise(edge)
    nth, place = Window.partitionBy("lang", "h").orderBy("text"), Window.partitionBy("lang").orderBy("nth", "h")
    picked = use.where(F.col("h") <= edge).withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= sample)
    picked = picked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample).collect()
    rows: list[tuple[str, str]] = []
    for lang in sorted(counts):
        rows += [(r["lang"], r["text"]) for r in sorted((r for r in picked if r["lang"] == lang), key=lambda r: (r["h"], r["text"]))[:sample]]
    return Model.fit(rows)


def _predict(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in sliced(batches):
            lang, score, mix = [], [], []
            for text in batch.column(2).to_pylist():
                got = m.mixture(text)
                top = max(got, key=lambda k: (got[k], k)) if got else UNKNOWN
                lang.append(top)
                score.append(got.get(top, 0.0))
                mix.append(list(got.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=["row", "held_out", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: row (its other columns), held_out, lang_pred, score, mixture (map).

    The model is broadcast: 65,536 buckets by its languages, whatever the input.
    """
    df = docs.select(packed_row(docs).alias("row"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = StructType([df.schema["row"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", MapType(StringType(), DoubleType()))])
    return df.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("row.doc_id", "held_out", "lang_pred", "score")
