"""Quality rules combined by weak supervision.

Each rule votes good (1) or bad (0) or abstains (-1). Expectation-maximisation over the counts of the vote
patterns (at most 3 to the number of rules, whatever the corpus size) estimates each rule's two accuracies (how
often it is right on good and on bad documents) and the share of good documents; a document is kept when its
posterior probability of being good is at least one half. The estimates are free: weak priors, worth PRIOR votes,
say which of the two classes is the bad one and decide nothing in a corpus of more documents than that. Documents
that fail the base rules are decided already and take no part in the estimate.
Every expression is JVM-side; the loop on the driver sees the pattern counts only.

Defined cases: a null text has no words, all its counts are zero and it fails the base rules; texts of any length
are measured whole; an empty table gives no rows; repeated rows and ties are judged alike; an even posterior keeps
the document; other columns of the input are carried along if ``carry`` names them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import WORD, stash

ROUNDS = 25
#: Start, and centre of the prior, of a rule's false alarms (bad votes on good documents), of its hits (bad votes on
#: bad ones) and of the share of good documents; votes that a prior is worth.
ALARMS, HITS, GOOD, PRIOR = 0.05, 0.5, 0.8, 10

#: Very common words of four languages. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it with as on by",
    "der die und den von zu das mit ist nicht ein im",
    "le la les de et des du en est que un pour dans",
    "el los las y del una por con para se no su",
)

#: (name, bad if, good if) over the measured columns, in SQL that Spark and DuckDB both read. Integer arithmetic only.
RULES = (
    ("v_word_size", "word_chars < 3 * n_words OR word_chars > 7 * n_words", "word_chars >= 4 * n_words AND word_chars <= 6 * n_words"),
    ("v_symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("v_stop_words", "100 * n_stops < 5 * n_words", "100 * n_stops >= 15 * n_words"),
    ("v_lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    ("v_repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("v_spread", "100 * n_distinct < 30 * n_words", "100 * n_distinct >= 50 * n_words"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice: sort (hash, position), keep equal neighbours, join their covers."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")),
    )

    def cover(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(starts, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def twice(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, j: F.coalesce(x["h"] == F.get(ordered, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, j + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), cover)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), twice)).cast("long")


def measure(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` and the measured columns of each whole text."""
    stops = " ".join(STOP_WORDS).split()
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stops"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    gone = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    of_text = (by_word.alias("w"), by_line.alias("l"), F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), gone("#*$%&|<>").alias("n_symbols"))
    return docs.select(*carry, *of_text).select(*carry, "w.*", "l.*", "word_chars", "n_symbols")


def vote(bad: str, good: str) -> Column:
    return F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END")


def log_odds(votes: tuple[int, ...], alarms: list[float], hits: list[float], good: float) -> float:
    """Of a document with these votes being good."""
    odds = math.log(good / (1 - good))
    for v, a, h in zip(votes, alarms, hits):
        odds += math.log((1 - a) / (1 - h)) if v == 1 else math.log(a / h) if v == 0 else 0.0
    return odds


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[list[float], list[float], float]:
    """(false alarms and hits of each rule, share of good documents) by expectation-maximisation over pattern counts."""
    alarms, hits, good = [ALARMS] * n_rules, [HITS] * n_rules, GOOD
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-log_odds(votes, alarms, hits, good))) for votes, _ in patterns]
        of = lambda j, v, w: sum(n * w(x) for x, (votes, n) in zip(p, patterns) if votes[j] in v)  # noqa: E731, B023
        is_good, is_bad = (lambda x: x), (lambda x: 1 - x)
        alarms = [(of(j, (0,), is_good) + PRIOR * ALARMS) / (of(j, (0, 1), is_good) + PRIOR) for j in range(n_rules)]
        hits = [(of(j, (0,), is_bad) + PRIOR * HITS) / (of(j, (0, 1), is_bad) + PRIOR) for j in range(n_rules)]
        good = (sum(n * x for x, (_, n) in zip(p, patterns)) + PRIOR * GOOD) / (total + PRIOR)
    return alarms, hits, good


def judge(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), log: list | None = None) -> DataFrame:
    """One row per document: ``carry``, the measures, base_failed, the votes, p_good and kept; ``log`` gets the estimates."""
    names = [name for name, _, _ in RULES]
    measured = measure(docs, text, carry)
    if text not in carry:  # rows without their text are small: dealt by size, they fill few files, however many partitions ``docs`` has
        measured = measured.hint("rebalance")
    measured = stash(measured, "quality")
    voted = measured.select("*", *(vote(bad, good).alias(name) for name, bad, good in RULES))
    failed = F.expr(BASE_FAILED)
    counts = voted.where(~failed).groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    patterns = sorted((tuple(r[name] for name in names), r["count"]) for r in counts)
    alarms, hits, good = estimate(patterns, len(names))
    if log is not None:
        log.append((dict(zip(names, zip(alarms, hits))), good))
    odds = F.lit(math.log(good / (1 - good)))
    for name, a, h in zip(names, alarms, hits):
        odds += F.when(F.col(name) == 1, math.log((1 - a) / (1 - h))).when(F.col(name) == 0, math.log(a / h)).otherwise(0.0)
    return voted.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", ~failed & (odds >= 0))
