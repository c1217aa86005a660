"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has a name and a predicate that is true for a text to reject. ``plan_cascade`` times every rule and
counts its rejections on a bounded random sample, and orders the rules by rejections per second; ``cascade`` folds them
into one nested conditional, so that a text that an early rule rejects never reaches the later, dearer ones. The
verdict does not depend on the order.

The figures that rules use are bound once each, as variables of ``transform`` over one-element arrays: plain
columns would be merged back into every place that uses them.

Defined cases: a null text has no words and is rejected by ``too_few_words``; empty texts likewise; an empty
table gives an empty result; other columns of the input, whatever their names, pass through (``keep``) or are
left out (``verdicts``); repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that plan_cascade looks at (expected number), and how often it runs a rule on each of them.
SAMPLE_ROWS, REPEATS = 400, 2

SPACE = r"\\x20\\x09-\\x0D"

#: name -> SQL over the text t and earlier names.
FIGURES = {
    "bare": "trim(both ' \t\n\x0b\x0c\r' from coalesce(t, ''))",
    "w": f"if(bare = '', cast(array() as array<string>), split(bare, '[{SPACE}]+'))",
    "joined": "array_join(w, '')",
    "lines": f"filter(split(coalesce(t, ''), '\\\\n', -1), l -> trim(both ' \t\n\x0b\x0c\r' from l) <> '')",
    "grams": "case when size(w) >= 3 then transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) else cast(array() as array<bigint>) end",
    "n_grams": "size(grams)",
    "pairs": "case when size(array_distinct(grams)) = n_grams then cast(array() as array<struct<x: bigint, i: int>>) else array_sort(transform(grams, (x, i) -> struct(x as x, i as i))) end",
    "places": "array_sort(transform(filter(pairs, (p, k) -> (k > 0 and pairs[k - 1].x = p.x) or (k < size(pairs) - 1 and pairs[k + 1].x = p.x)), p -> p.i))",
    "n_words": "cast(size(w) as bigint)",
    "word_chars": "cast(length(joined) as bigint)",
    "n_symbols": "cast(length(joined) - length(regexp_replace(joined, '[#*$%&|<>]', '')) as bigint)",
    "n_lines": "cast(size(lines) as bigint)",
    "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
    "n_shouts": "cast(size(filter(w, x -> endswith(x, '!!'))) as bigint)",
    "n_repeat_words": """case when size(places) = 0 then 0L else
        3L + aggregate(sequence(1, size(places)), 0L, (s, k) -> s + if(k < size(places), least(3, places[k] - places[k - 1]), 0)) end""",
}

#: name -> predicate over the figures; true rejects. Integer arithmetic, so every engine agrees.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "shouting": "100 * n_shouts > 30 * n_words",
}
BASE_RULES = ("too_few_words", "repeated_words")
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _needs(sql: str, have: list[str]) -> list[str]:
    """The figures that sql uses, directly or through others, in the order to bind them, without those in have."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        new = {x for x in re.findall(r"\w+", todo.pop()) if x in FIGURES} - found
        found |= new
        todo += [FIGURES[x] for x in new]
    return [x for x in FIGURES if x in found and x not in have]


def _let(names: list[str], body: str) -> str:
    for x in reversed(names):
        body = f"element_at(transform(array({FIGURES[x]}), {x} -> {body}), 1)"
    return body


def _bind(column: str, body: str) -> Column:
    return F.expr(f"element_at(transform(array(`{column}`), t -> {body}), 1)")


def _cascade(order: list[str], rules: dict[str, str], have: tuple[str, ...] = ()) -> str:
    """SQL that is true if no rule rejects; each rule's figures are bound only once the rules before it have passed."""
    have, parts = list(have), []
    for rule in order:
        new = _needs(rules[rule], have)
        parts.append((new, rules[rule]))
        have += new
    body = "true"
    for new, rule in reversed(parts):
        body = _let(new, f"if({rule}, false, {body})")
    return body


def plan_cascade(df: DataFrame, text: str = "text", rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) in the order to run them, by rejections per second on a random sample of the whole table.

    A rule's seconds are those of a query that runs it REPEATS times on each row, less those of one that runs none, so
    that what a query costs by itself does not count. Drawing the sample reads the table once more.
    """
    total = max(df.count(), 1)
    sample = df.select(F.col(f"`{text}`").alias("text")).sample(min(1.0, sample_rows / total), seed=11).repartition(1).persist()
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(rejects: Column) -> tuple[float, int]:
        query = again.agg(F.count_if(rejects).alias("n"))
        query.collect()  # compiled by now
        began = time.perf_counter()
        rejected = query.first()["n"]
        return time.perf_counter() - began, rejected

    try:
        rows = sample.count() * REPEATS
        nothing, _ = timed(F.col("text").isNull())
        found = []
        for name in rules:
            seconds, rejected = timed(~_bind("text", _cascade([name], rules)))
            found.append((name, max(seconds - nothing, 1e-3), rejected / max(rows, 1)))
        return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))
    finally:
        sample.unpersist()


def keep(df: DataFrame, text: str = "text", rules: dict[str, str] = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of df that no rule rejects, with df's columns."""
    return df.where(_bind(text, _cascade(order or [x[0] for x in plan_cascade(df, text, rules)], rules)))


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, str] = RULES, order: list[str] | None = None) -> DataFrame:
    """key, the base figures of every row, base_failed, and kept: false if a base rule or any rule of the cascade rejects."""
    order = order or [x[0] for x in plan_cascade(df, text, rules)]
    base = " or ".join(f"({rules[x]})" for x in BASE_RULES if x in rules) or "false"
    shown = _needs(f"{' '.join(SHOWN)} {base}", [])
    body = _let(shown, f"struct({', '.join(SHOWN)}, {base} as base_failed, if({base}, false, {_cascade(order, rules, tuple(shown))}) as kept)")
    return df.select(F.col(f"`{key}`").alias(key), _bind(text, body).alias("__found")).select(key, "__found.*")
