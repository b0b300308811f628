"""Passes in Python work in pieces, and once for each query."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import batches
from quillon.operators import projection, segments
from quillon.operators.projection import project, triggered
from quillon.plans import cases, seeds

DATA = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def mixed(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    own = seeds.PLAIN + seeds.MARKED + [v.text for v in cases.VIEWS] + [t for t, _ in cases.SCOPES] + [t for t, _ in cases.PROSE]
    odd = ["\n", "\n\n", " ", "\r\n", "word", "é🙂 ", "Moreover, ", "ın order to ", "delve ", "(aside here) ", "**b** ", "Is it so? Yes. ", "Go on. ", "e.g. this. ", "J. Smith. ", " - x", "<!-- quıllon-IGNORE -->", "<!-- quillon-disable a.b -->", "\x1c", "’", "a, b c d, and e. ", "1. x\n", "# h\n"]
    return ["".join(rng.choice(own if rng.random() < 0.3 else odd) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def peak(of, texts: list[str], *more: pa.Array) -> int:
    column = pa.array(texts)
    tracemalloc.start()
    for _ in batches.in_pieces(of, column, *more):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_memory_follows_the_piece_and_not_the_batch():
    text = "We walk up the hill (see it) in order to see **it** all. " * 40
    heads = pa.array([[]] * 600, pa.list_(projection.SPAN))
    for of in (lambda t: segments._read_units(t, "sentences", ("words", "text")), lambda t: segments._read_units(t, "paragraphs", ("words", "text")), lambda t: projection._projected(t, projection.VIEWS)):
        small, large = (peak(of, [text] * n) for n in (125, 600))
        assert large < 1.5 * small
    small, large = (peak(segments._segmented, [text] * n, heads[:n]) for n in (125, 600))
    assert large < 1.5 * small


def test_pieces_hold_all_rows_in_order():
    sizes = [0, 10, batches.PIECE, 3, batches.PIECE * 2, 0, 0, 5]
    own = pa.array([None if n == 10 else "x" * n for n in sizes])
    cuts = list(batches.pieces(own))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(sizes))) and list(batches.pieces(own[:0])) == []
    assert all(b - a == 1 or sum(sizes[a:b]) <= batches.PIECE + 10 for a, b in cuts)
    assert all(b - a <= batches.ROWS for a, b in batches.pieces(pa.nulls(batches.ROWS * 2 + 1, pa.string())))


QUERIES = [
    "sentences",
    "findings",
    "findings_summary",
    "report_json",
    "findings_by_rule",
    "report_annotations",
    "findings_recommended",
    "paragraphs",
    "report_text",
    "document_verdicts",
    "loaded_words",
    "contrasts_questions_lists",
    "opener_runs",
    "sentence_variation",
    "projection",
    "suppression_scopes",
    "strip_bold",
]


@pytest.mark.parametrize("name", QUERIES)
def test_one_pass_in_python_for_each_query(spark, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    kinds = re.findall(r"\], \[pythonUDF\d+#\d+\], (\d+)", plan)
    assert kinds == ["251"] and plan.count("ArrowEvalPython [") == 1  # an Arrow UDF over iterators, so that a batch goes in pieces


def test_trigger_for_python_is_that_of_spark(spark):
    texts = [*mixed(400, 11), "a\x85- x", "import\n", "httpſ://x", "WWW.x", "\x1c- x", "   -", "1. ", "\t", "٣. x", "ımport x"]
    docs = frame(spark, [t.replace("\r\n", "\n") for t in texts])
    want = [r[0] for r in docs.orderBy("doc_id").select(F.col("text").rlike(projection.TRIGGER)).collect()]
    assert [triggered(t.replace("\r\n", "\n")) for t in texts] == want
    assert all(project(t) == projection.plain_views(t) for t in texts if "\r" not in t and not triggered(t))
