"""The rule catalogue, its presets, and configuration resolved on the driver before any plan is built."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

LEVELS = ("off", "info", "warning", "error")
PRESETS = ("recommended", "strict")
FAIL_LEVELS = ("info", "warning", "error", "none")


@dataclass(frozen=True)
class Rule:
    id: str
    checker: str
    recommended: str
    strict: str | None = None
    options: dict = field(default_factory=dict)
    strict_options: dict = field(default_factory=dict)
    patterns: tuple[str, ...] = ()
    summary: str = ""
    advice: str = ""


# Rule ids, severities, options and patterns.
RULES = [
    Rule("artifact.chatbot-residue", "residue", "error", summary="Leftover of a chat session", advice="Delete it and check the claim next to it."),
    Rule(
        "verbosity.throat-clearing",
        "phrases",
        "warning",
        patterns=(r"\bwhen it comes to\b", r"\bin (?:today's|the modern|an? ever-changing|an? ever-evolving) (?:world|era|landscape)\b", r"\bin the (?:realm|world) of\b", r"\bat its core\b", r"\bthe fact of the matter is\b"),
        summary="Words before the point",
        advice="Begin with the point.",
    ),
    Rule(
        "verbosity.filler",
        "phrases",
        "warning",
        patterns=(r"\bin order to\b", r"\bdue to the fact that\b", r"\bat this point in time\b", r"\bhas the ability to\b|\bis able to\b", r"\ba wide variety of\b"),
        summary="Filler",
        advice="Use the shorter form.",
    ),
    Rule(
        "verbosity.redundant-pair",
        "phrases",
        "warning",
        patterns=(r"\beach and every\b", r"\bvarious different\b", r"\bpast history\b", r"\bfuture plans\b", r"\bcompletely eliminate\b"),
        summary="Two words where one says it",
        advice="Keep one of the words.",
    ),
    Rule(
        "phrase.note-to-reader",
        "phrases",
        "info",
        "warning",
        patterns=(r"\bit (?:is|'s) important to note that\b", r"\bit (?:is|'s) worth noting that\b|\bit should be noted that\b", r"\bthe key takeaway is\b"),
        summary="Note to the reader",
        advice="Just say it.",
    ),
    Rule(
        "phrase.marketing-language",
        "phrases",
        "info",
        "warning",
        patterns=(
            r"\bunlock(?:s|ed|ing)? (?:the )?(?:power|potential|possibilities)\b",
            r"\bseamless(?:ly)?\b",
            r"\bgame[- ]changer\b",
            r"\belevat(?:e|es|ed|ing) (?:your|the)\b",
            r"\btransformative\b",
            r"\bultimate guide\b",
        ),
        summary="Sales talk",
        advice="Name the property that matters.",
    ),
    Rule(
        "phrase.abstract-role",
        "phrases",
        "info",
        "warning",
        patterns=(r"\bserves as (?:a|an|the)\b", r"\bplays? (?:a )?(?:pivotal|crucial|vital|important) role\b", r"\bstands as (?:a|an|the)\b"),
        summary="Role in place of an action",
        advice="Say what it is or does.",
    ),
    Rule(
        "phrase.landscape",
        "phrases",
        "warning",
        patterns=(r"\bever[- ]evolving(?:\s+[A-Za-z-]+){0,2}\s+landscape\b", r"\bin today['’]s(?:\s+[A-Za-z-]+){0,2}\s+landscape\b", r"\b(?:rich|complex|intricate) tapestry\b"),
        summary="Scenery",
        advice="Name the field or the change.",
    ),
    Rule(
        "phrase.vague-attribution",
        "phrases",
        "warning",
        patterns=(r"\bexperts (?:say|argue|believe|agree)\b", r"\bstudies (?:show|suggest|indicate|have shown)\b", r"\bit is widely (?:believed|known|accepted)\b"),
        summary="Source without a name",
        advice="Cite the source.",
    ),
    Rule("rhetoric.negative-parallelism", "negative_parallelism", "warning", options={"max": 1, "window_words": 500}, summary="Contrasts of the kind 'not this, but that'", advice="Say what holds."),
    Rule("rhetoric.no-chain", "no_chain", "warning", options={"minimum_items": 3}, strict_options={"minimum_items": 2}, summary="Chain of 'no'", advice="Say what there is."),
    Rule("rhetoric.question-answer", "question_answer", "off", "info", {"max": 1, "window_words": 400, "answer_max_words": 5}, {"max": 0}, summary="Questions with short answers", advice="Turn one into a statement."),
    Rule("rhetoric.question-density", "question_density", "off", "info", {"max": 3, "window_words": 500}, {"max": 2}, summary="Many questions", advice="Keep the one that carries the text."),
    Rule("rhetoric.echoed-clauses", "echoed_clauses", "warning", options={"minimum_clauses": 3, "maximum_clauses": 5}, summary="Clauses that echo each other", advice="Join the clauses or vary them."),
    Rule("rhetoric.tricolon-density", "tricolon_density", "off", "info", {"max": 3, "window_words": 750}, {"max": 2}, summary="Many lists of three", advice="Vary the number of items."),
    Rule("repetition.sentence-opener", "sentence_openers", "warning", options={"consecutive": 3, "window_sentences": 8, "window_count": 5}, strict_options={"window_count": 4}, summary="Sentences that open alike", advice="Vary the openings."),
    Rule("repetition.paragraph-opener", "paragraph_openers", "warning", options={"consecutive": 3, "window_paragraphs": 6, "window_count": 4}, strict_options={"window_count": 3}, summary="Paragraphs that open alike", advice="Vary the openings."),
    Rule("repetition.transition", "transitions", "warning", options={"max": 2, "window_words": 500}, strict_options={"max": 1}, summary="Transition used often", advice="Drop it where the order is clear."),
    Rule("repetition.loaded-word", "loaded_words", "off", "info", {"max": 2, "window_words": 500}, {"max": 1}, summary="Loaded word used often", advice="Name what you mean."),
    Rule("rhythm.short-sentence-run", "short_sentence_run", "off", "info", {"max_words": 5, "minimum_run": 3}, {"max_words": 6}, summary="Run of short sentences", advice="Join some of them."),
    Rule("rhythm.uniform-sentence-length", "uniform_sentence_length", "off", "info", {"minimum_sentences": 10, "maximum_cv": 0.18}, summary="Sentences of one length", advice="Mix short and long ones."),
    Rule("density.em-dash", "em_dash_density", "off", "info", {"max": 4, "window_words": 500}, {"max": 3}, summary="Many em dashes", advice="Use other marks for some."),
    Rule("density.bold", "bold_density", "warning", options={"max": 10, "window_words": 500}, strict_options={"max": 6}, summary="Much bold type", advice="Keep it for what must stand out."),
    Rule("density.parenthetical", "parenthetical_density", "off", "info", {"max": 6, "window_words": 500}, {"max": 5}, summary="Many asides", advice="Move them into the sentences or drop them."),
    Rule("structure.heading-density", "heading_density", "off", "info", {"minimum_headings": 6, "min_words_per_heading": 70}, summary="Headings over little text", advice="Merge sections."),
]
BY_ID = {r.id: r for r in RULES}


def rank(level: str) -> int:
    """off -1, info 0, warning 1, error 2; anything else is an error."""
    if level not in LEVELS:
        raise ValueError(f"not a severity: {level!r}")
    return LEVELS.index(level) - 1


@dataclass(frozen=True)
class Active:
    """A rule as it is to be run."""

    rule: Rule
    severity: str
    options: dict


def read_config(path: str | None = None) -> dict:
    """The configuration at path; else that of the working directory's .quillon.json; else none."""
    if path is None:
        if not Path(".quillon.json").is_file():
            return {}
        path = ".quillon.json"
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"cannot read config {path}: {e}") from e
    return check_config(data)


def check_config(data: dict) -> dict:
    if not isinstance(data, dict):
        raise ValueError("a config must be a JSON object")
    if extra := sorted(data.keys() - {"preset", "fail_level", "rules"}):
        raise ValueError(f"unknown config keys: {', '.join(extra)}")
    for key, allowed in (("preset", PRESETS), ("fail_level", FAIL_LEVELS)):
        if data.get(key) is not None and data[key] not in allowed:
            raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    rules = data.get("rules", {})
    if not isinstance(rules, dict):
        raise ValueError("rules must be a JSON object")
    if extra := sorted(rules.keys() - BY_ID.keys()):
        raise ValueError(f"unknown rules: {', '.join(extra)}")
    return data


#: Options that name members of a group; a group of one has no second member to report.
AT_LEAST_TWO = {"consecutive", "window_count", "minimum_run"}


def _check_options(rule: Rule, options: dict) -> None:
    for name, value in options.items():
        number = not isinstance(value, bool) and isinstance(value, (int, float))
        if name == "maximum_cv":
            good = number and value > 0
        else:
            good = number and isinstance(value, int) and value >= (0 if name == "max" else 2 if name in AT_LEAST_TWO else 1)
        if not good:
            raise ValueError(f"{rule.id}: {name} may not be {value!r}")
    if options.get("minimum_clauses", 0) > options.get("maximum_clauses", float("inf")):
        raise ValueError(f"{rule.id}: minimum_clauses is over maximum_clauses")


def resolve(preset: str = "recommended", config: dict | None = None) -> list[Active]:
    """All rules with their severities and options; those that are off stay in the list."""
    if preset not in PRESETS:
        raise ValueError(f"not a preset: {preset!r}")
    own = check_config(config or {}).get("rules", {})
    out = []
    for rule in RULES:
        level, options = rule.recommended, dict(rule.options)
        if preset == "strict":
            level, options = rule.strict or level, options | rule.strict_options
        given = own.get(rule.id)
        if isinstance(given, str):
            level = given
        elif isinstance(given, dict):
            level = given.get("severity", level)
            changed = {k: v for k, v in given.items() if k != "severity"}
            if extra := sorted(changed.keys() - rule.options.keys() - rule.strict_options.keys()):
                raise ValueError(f"{rule.id}: unknown options {', '.join(extra)}")
            options |= changed
        elif given is not None:
            raise ValueError(f"{rule.id}: give a severity or an object")
        if level not in LEVELS:
            raise ValueError(f"{rule.id}: not a severity: {level!r}")
        _check_options(rule, options)
        out.append(Active(rule, level, options))
    return out


def settings(preset: str | None = None, fail_level: str | None = None, config: dict | None = None) -> tuple[list[Active], str]:
    """(rules, fail level): arguments go before the config, and that before the defaults."""
    data = check_config(config or {})
    fail = fail_level or data.get("fail_level") or "warning"
    if fail not in FAIL_LEVELS:
        raise ValueError(f"not a fail level: {fail!r}")
    return resolve(preset or data.get("preset") or "recommended", data), fail
