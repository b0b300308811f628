"""Documents with a snippet each, so that rules which invented prose never breaks have something to find."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No Markdown in these: what SQL computes on the text is what the engine sees.
PLAIN = [
    "We met in order to plan. Each and every plan was read at this point in time.",
    "When it comes to tea, it is important to note that experts say little. Studies show less.",
    "The tool serves as a bridge and plays a pivotal role. It stands as the ultimate guide.",
    "An ever-evolving urban landscape is a rich tapestry. It is widely known.",
    "They unlock the power of tools. A seamless, transformative game-changer will elevate your day.",
    "One — two — three — four — five — six. Delve here, delve there and delve again, delving on.",
    "As an AI language model I cannot browse the internet. See turn0search3 for more.",
    "There are no fees, no ads, no limits. There is no hurry, no rush.",
    "Moreover, it rained. Moreover, it snowed. Moreover, it froze. Then the robust wall, a robust gate and the robust door held.",
    "We test the code, we test the docs, we test the plan. You see the sea, we see the sea, they see the sea.",
    "We go now. We go on. We go far. Then all of us stop here and rest for a long while.",
    "Is it so? Yes. Was it so? No. Will it be so? Maybe. Can it be so? Never. It ended well for everyone.",
    "Fast, cheap, and good. Red, green, and blue. Here, there, and gone. Up, down, and out. That was all we saw.",
    "It is not the map, but rather the land that counts. It is not the pen, but rather the hand that writes.",
    "The house was quiet and the garden lay under snow while the children slept.",
]
#: Markdown, directives and links.
MARKED = [
    "# One\n\nText in order to see.\n\n## Two\n\nMore.\n\n### Three\n\nMore.\n\n# Four\n\n# Five\n\n# Six\n\nEnd of it all.",
    "Some **bold one**, **two**, **three**, **four**, **five**, **six**, **seven** and __eight__ words (an aside here) stay.",
    "```\nin order to\n```\n\nUse `in order to` or $x + y$ and \\(a*b\\) in order to win.\n\n> in order to quote\n\n- in order to list",
    "<!-- quillon-disable verbosity.filler -->\nin order to hide.\n<!-- quillon-enable verbosity.filler -->\nin order to show. <!-- quillon-ignore -->\nin order to report.\n<!-- quillon-disable-next-line verbosity.* -->\nin order to skip.",
    "a | b\n--- | ---\nin order to | x\n\nTitle in order to\n=====\n\n[in order to](http://example.com/in) see ![alt](img.png).",
    "***x*** and **a** b, 2 ** 3 ** 4, foo__bar__baz, `**code**` and **open\n\n**again** (1) (see page two) (and three).",
    "See [here](docs/a.md), [there](/docs/b.md#part), [gone](missing.md), [far](https://example.com/x) and ![pic](img/p%20q.png).",
]
#: Characters that begin Markdown syntax.
SYNTAX = "*_`$<>#|~[]\\()="


def plain(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the characters of Markdown syntax."""
    return docs.select("doc_id", F.regexp_replace("text", f"[{re.escape(SYNTAX)}]++", "").alias("text"))  # a third of translate's time


def _with(docs: DataFrame, snippets: list[str]) -> DataFrame:
    own = F.get(F.array(*[F.lit(s) for s in snippets]), F.pmod("doc_id", F.lit(len(snippets))).cast("int"))
    return docs.select("doc_id", F.concat("text", F.lit("\n\n"), own).alias("text"))


def seeded_plain(docs: DataFrame) -> DataFrame:
    return _with(plain(docs), PLAIN)


def seeded(docs: DataFrame) -> DataFrame:
    return _with(docs, PLAIN + MARKED)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PLAIN_SQL = f"SELECT doc_id, translate(text, {_sql(SYNTAX)}, '') AS text FROM documents"
SEEDED_PLAIN_SQL = f"SELECT doc_id, text || chr(10) || chr(10) || ([{', '.join(map(_sql, PLAIN))}])[CAST(doc_id % {len(PLAIN)} AS INTEGER) + 1] AS text FROM ({PLAIN_SQL})"
