"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a text that rejects it. What a rule costs and how much it rejects is
estimated on a bounded sample; rules then run in the order of rejections per cost, and a document
that one rule rejects is not looked at by the later ones. The order decides which rule is named and
what the cascade costs; it never changes which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.texts import SPACES, id_and_text, let, words_of
from tideline.session import cut_lineage

#: Words in a window of ``n_repeat_words``.
WINDOW = 8
SYMBOLS = "#*$%&|<>"


#: A measure's column by its name.
Measured = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean column over ``text`` and the measures it asks for."""

    name: str
    rejects: Callable[[Measured], Column]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur at least twice, from the windows' hashes in order."""

    def covered(ordered: Column) -> Column:
        repeated = F.filter(
            ordered, lambda s, j: (F.get(ordered, j - 1)["h"] == s["h"]) | (F.get(ordered, j + 1)["h"] == s["h"])
        )
        starts = F.sort_array(F.transform(repeated, lambda s: s["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("bigint"),
                lambda a, x: a + x,
            ),
        )

    in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        let(in_order, covered)
    )


def _window_hashes(words: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) < WINDOW, none).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        ),
    )


def _symbols(text: Column) -> Column:
    left = text
    for symbol in SYMBOLS:
        left = F.replace(left, F.lit(symbol), F.lit(""))
    return F.char_length(text) - F.char_length(left)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


#: The measures that rules may name, as functions of the text and its words.
MEASURES = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w)),
    "n_symbols": lambda text, words: _symbols(text),
    "n_dup_lines": lambda text, words: _dup_lines(text),
    "n_repeat_words": lambda text, words: let(_window_hashes(words), _repeat_words),
}


def measured(docs: DataFrame, names: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """``docs`` with its words split once and the named measures as long columns."""
    with_words = docs.withColumn("_words", words_of(F.col("text")))
    return with_words.select(
        "*", *[MEASURES[n](F.col("text"), F.col("_words")).cast("bigint").alias(n) for n in names]
    ).drop("_words")


def default_rules() -> list[Rule]:
    """The base rules and five more; each is lenient, so that ordinary prose passes."""
    return [
        Rule("few_words", lambda m: m("n_words") < 20),
        Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
        Rule("symbols", lambda m: m("n_symbols") * 20 > m("word_chars")),
        Rule("capitals", lambda m: F.regexp_count("text", F.lit(r"\p{Lu}")) * 10 > F.char_length("text") * 3),
        Rule("repeated_lines", lambda m: m("n_dup_lines") * 2 > F.size(F.split("text", "\n"))),
        Rule("long_words", lambda m: m("word_chars") > m("n_words") * 40),
        Rule("few_letters", lambda m: F.regexp_count("text", F.lit(r"\p{L}")) * 2 < F.char_length("text")),
    ]


def ordered_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 500) -> list[Rule]:
    """``rules`` by rejections per second on at most ``sample_rows`` documents, best first.

    The sample is a bound on the estimate alone; every document goes through the cascade. It is
    written down, so that all rules see the same rows and none of them reach the driver. Each rule
    is timed on its own with the measures it needs, and the time of reading the sample, as the
    cheapest of all passes, is taken off.
    """
    held = cut_lineage(id_and_text(docs).select("text").limit(sample_rows))
    if held.isEmpty():
        return list(rules)
    found = []
    for rule in rules:
        frame = held.agg(F.count_if(rejected_by([rule]).isNotNull()).alias("n"))
        begun = time.perf_counter()
        rejected = frame.first()["n"]
        found.append((time.perf_counter() - begun, rejected, rule))
    least = min(seconds for seconds, _, _ in found)
    return [r for _, _, r in sorted(found, key=lambda x: (-x[1] / (x[0] - least + 0.01), x[2].name))]


def cascade(rules: Sequence[Rule], measure: Measured = F.col) -> Column:
    """The name of the first rule that rejects, else null. A null condition rejects nothing."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.rejects(measure), F.lit(rule.name)).otherwise(first)
    return first


def rejected_by(rules: Sequence[Rule]) -> Column:
    """The cascade straight from ``text``: words are split once, and a measure is worked out where a rule asks for it."""
    return let(words_of(F.col("text")), lambda words: cascade(rules, lambda name: MEASURES[name](F.col("text"), words)))


def quality_table(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: all measures, the base verdict and the cascade's.

    A null or empty text has no words and so fails the base rule. Repeated rows give repeated rows;
    a null ``doc_id`` is kept. Other columns of ``docs`` are not looked at. An empty table gives an
    empty table.
    """
    rules = default_rules() if rules is None else list(rules)
    table = measured(id_and_text(docs)).withColumn("rejected_by", cascade(ordered_rules(docs, rules)))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return table.select(
        "doc_id",
        *MEASURES,
        base.alias("base_failed"),
        (~base & F.col("rejected_by").isNull()).alias("kept"),
        "rejected_by",
    )


def keep_clean(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged.

    Here the cascade saves work: a measure is worked out where a rule asks for it, so a document that
    an earlier rule rejects never pays for the later ones. Columns of ``docs`` keep
    their names, whatever they are called; a null text counts as empty.
    """
    rules = default_rules() if rules is None else list(rules)
    order = ordered_rules(docs, rules)
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    return held.where(rejected_by(order).isNull()).select("row.*")
