"""Lint in one pass in Python has the findings of the expressions that it stands for."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import checks, projection
from quillon.operators.lint import lint, lint_in_order, ordered
from quillon.operators.passes import Linter, finder, found, needed
from quillon.operators.projection import projected
from quillon.operators.segments import located, segmented
from quillon.operators.suppress import scopes, suppressed
from quillon.plans.catalogue import resolve

from test_pieces import frame, mixed, peak

DATA = "/root/testdata/sf0.001"


def by_expressions(docs, rules):
    """Findings by the native expressions of checks, on segmented documents."""
    active = [a for a in rules if a.severity != "off"]
    numbered = lambda i: lambda f: F.struct(F.lit(i).alias("rule_no"), f["start"].alias("start"), f["end"].alias("end"), f["n"].alias("n"), f["detail"].alias("detail"))
    df = checks.with_hits(segmented(projected(docs)), active)
    df = df.select("doc_id", "text", scopes(F.col("suppression")).alias("scopes"), F.concat(*[F.transform(checks.check(a), numbered(i)) for i, a in enumerate(active)]).alias("f"))
    df = df.select("doc_id", "text", "scopes", F.inline_outer("f")).where("rule_no is not null")
    df = located(df.withColumn("rule", F.get(F.array(*[F.lit(a.rule.id) for a in active]), F.col("rule_no"))))
    return df.where(~suppressed(F.col("scopes"), F.col("line"), F.col("rule"))).select("doc_id", "line", "column", "end_line", "end_column", "rule", "start", "end", "n", "detail")


@pytest.mark.parametrize("preset", ["recommended", "strict"])
def test_findings_are_those_of_the_expressions(spark, preset):
    docs = frame(spark, [None, "", *mixed(300, 7)]).repartition(4)
    want = by_expressions(docs, resolve(preset))
    got = lint(docs, resolve(preset)).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len({r[5] for r in rows}) > 12


def test_every_match_holds_a_needed_string():
    assert "" in needed(r"\bdelv(?:e|es)\b|a+b|x?") and needed(r"\ban? ever-[a-z]+\s+(?:world|era)") == [" ever-"]
    find, form = finder(r"\bin order to\b"), checks.searches(resolve("strict"))
    assert find("İn ORDER to", projection.folded("İn ORDER to")) == [(0, 11)]
    for text in mixed(100, 3):
        for _, pattern in form.values():
            assert finder(pattern)(text, projection.folded(text)) == [s for s in finder(f"(?:{pattern})|(?!)")(text, projection.folded(text))]


def test_memory_of_lint_follows_the_piece():
    linter, text = Linter(resolve()), "We walk up the hill (see it) in order to see **it** all. " * 40
    small, large = (peak(lambda t: found(linter, t), [text] * n) for n in (125, 600))
    assert large < 1.5 * small


def test_reports_are_linted_once(spark):
    docs = frame(spark, mixed(200, 9)).repartition(3)
    assert lint_in_order(docs).collect() == ordered(lint(docs)).collect()
    import __spark_entry__

    for name in ("report_text", "report_json", "report_annotations"):
        plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
        above = plan[: plan.index("ArrowEvalPython")]
        assert "Exchange" not in above and "Sort [" in above and ", true" not in above[above.index("Sort [") :].split("\n")[0]
