"""Many keywords in one pass over a text, by an automaton that a Python worker builds once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for i, word in enumerate(words):
        built.add_word(word, i)
    built.make_automaton()
    return built


def found_in(text: str, words: tuple[str, ...]) -> set[int]:
    """Numbers of the words that the text holds anywhere."""
    return {i for _, i in automaton(words).iter(text)} if words else set()


def found_keywords(words: Sequence[str]) -> Callable[[Column], Column]:
    """Numbers of the words that the lower-cased text holds, in order; a null text holds none."""
    all_words = tuple(words)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(found_in(t.lower(), all_words)) if t else [])

    return found


def keyword_counts(groups: dict[str, list[str]]) -> Callable[[Column], Column]:
    """How many different keywords of each group the text holds. Capitals are acronyms and must match as they are."""
    own = [k for words in groups.values() for k in words]
    plain, acronyms = (tuple(dict.fromkeys(k for k in own if k.isupper() == upper)) for upper in (False, True))
    names = list(groups)
    # the groups of each word of either kind
    of_plain, of_acronym = ([[g for g, name in enumerate(names) for k in groups[name] if k == w] for w in words] for words in (plain, acronyms))

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[int]:
            n = [0] * len(names)
            if text:
                for hits, groups_of in ((found_in(text.lower(), plain), of_plain), (found_in(text, acronyms), of_acronym)):
                    for i in hits:
                        for g in groups_of[i]:
                            n[g] += 1
            return n

        return texts.map(one)

    return counts
