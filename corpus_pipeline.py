"""From raw documents to packed training sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of
documents. Toxic documents go, then those that fail the quality rules, then all
but one of each group of near-duplicates; byte strings of 200 or more that
repeat are cut out of what stays, and the rest is packed.

Cases: a null text is never toxic, fails the quality rules as one without
words, and would be kept, cut and packed as empty by the later stages. Null or
repeated doc_id and repeated rows are rows of their own in every stage, but
equal texts are near-duplicates, of which the one with the least doc_id (nulls
last) stays. Very long texts are taken whole. An empty table gives an empty
result. Columns besides doc_id, text, source and n_chars pass through whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import near_dups, packing, quality, suffix_array, toxicity
from quillon.llm.common import Scratch, table


def _columns(docs: DataFrame, text: Column | None = None) -> list[Column]:
    """docs' columns out of `row`, in their order, with another text where one is given."""
    out = []
    for name in docs.columns:
        if name == "text" and text is not None:
            out.append(text.alias("text"))
        elif name == "n_chars" and text is not None:
            out.append(F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col("row")[name].alias(name))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those judged toxic; columns and texts as they were. Without usable labels all stay."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep_text=True)
    kept = scored.where(~F.col("is_toxic"))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep; columns and texts as they were. Null texts go."""
    return quality.good_documents(docs).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the first; those without words are no one's copies, so all stay."""
    return near_dups.without_near_dups(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go; a character that loses some of its bytes goes whole; n_chars follows. No row goes; null becomes empty."""
    return suffix_array.dedup_bytes(docs, as_text=True).select(*_columns(docs, F.col("kept")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its sequence (see packing.pack); columns are those of the pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    others = list(Scratch.made)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        Scratch.sweep(*others)  # what the stage itself wrote on its way
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
