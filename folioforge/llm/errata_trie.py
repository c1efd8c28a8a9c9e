"""Spelling variants: words one edit apart, grouped under their commonest form, by merging the subtrees of a trie.

The trie of the distinct words is split into heavy paths: at each branching node the largest child is heavy, every
other child is light, and a word lies below a logarithmic number of light children. At a node each word of a light
child is merged into what the node holds besides, with the child's character skipped (a deletion), replaced by the
heavy one or by a wildcard that the other light children share (a replacement), or with the heavy character put in
front of it (an insertion). Words whose ends coincide are one edit apart, and each pair is met once, at the node where
the two words part. No word is ever compared with a group.

On Spark the words are sorted into ranges of about RANGE_BYTES; a range is a task's part of the trie. A node that lies
in one range is merged there. A node that spans ranges is known to every task from the first and last words of the
ranges (two words a range); its heavy child is the one that spans most borders, and its merged words are joined with
all words by their text. A merged word has at most 90 * (2 * length + 1) partners, so no key of these joins is hot.

Defined cases: a null or empty text has no words; texts and words of any length are taken whole; a null doc_id is the
empty string in the error rule; rows that are repeated count as often as they come; of near words with equal counts
the smallest in code-point order is the form; an empty table gives no rows; only doc_id and the text column are read,
so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import spread, stash, unstash

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, ERROR_EVERY, TIMES = 7, 2, 31, 10
#: Bytes of words in a range, with a fixed part for each word.
RANGE_BYTES, WORD_BYTES = 4 << 20, 16
#: Stands for any character. It is no letter, so no word holds it.
ANY = "*"
LINK, LOOKUP, WILD = 0, 1, 2
MERGED = "kind int, key string, word string, n long, n_near long"


def spelled_words(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, error_every: int | None = ERROR_EVERY) -> DataFrame:
    """(word) for every run of letters of the whole texts that gives a word of ``least_length``, repeats included.

    With ``error_every``, a run whose checksum with its doc_id that number divides loses one character.
    """
    # a run that is too short gives no word, with or without its error
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length("run") == F.length("run")
    run = F.when(plain, F.lower("run")).when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run"))
    found = found.select("id", run.alias("word"))
    if error_every is None:
        return found.select("word")
    sums = found.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    word = F.when(F.col("h") % error_every == 0, cut).otherwise(F.col("word"))
    return sums.select(word.alias("word")).where(F.length("word") >= least_length)


def _better(a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str]:
    """The commoner of two (count, word); of equal counts the smaller word."""
    return a if (-a[0], a[1]) < (-b[0], b[1]) else b


class Range:
    """A sorted run of words with their counts, between the last word before it and the first word after it."""

    def __init__(self, words: list[str], counts: list[int], borders: list[str], before: str | None, after: str | None):
        self.words, self.counts, self.borders = words, counts, borders
        self.place = {w: i for i, w in enumerate(words)}
        self.near = [0] * len(words)
        self.best: list[tuple[int, str] | None] = [None] * len(words)
        self.sent: list[tuple[int, str, int]] = []
        self.left = len(commonprefix([before, words[0]])) if before is not None else -1
        self.right = len(commonprefix([after, words[-1]])) if after is not None else -1

    def meet(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            other = (self.counts[b], self.words[b])
            self.near[a] += 1
            self.best[a] = other if self.best[a] is None else _better(self.best[a], other)

    def ask(self, i: int, target: str) -> None:
        """A link of word i with ``target``, if that is a word; words between the range's ends are in it or nowhere."""
        if self.words[0] <= target <= self.words[-1]:
            if (j := self.place.get(target)) is not None:
                self.meet(i, j)
        else:
            self.sent.append((LOOKUP, target, i))

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[str, int, int]]:
        """(character, first, end) of the children of the node of depth ``depth`` over words lo to hi; '' is the word that ends there."""
        out = []
        while lo < hi:
            char = self.words[lo][depth : depth + 1]
            end = bisect_right(self.words, self.words[lo][:depth] + char + "\U0010ffff", lo, hi) if char else lo + 1
            out.append((char, lo, end))
            lo = end
        return out

    def heavy_across(self, prefix: str) -> str | None:
        """The child of a node across ranges that spans most borders."""
        d = len(prefix)
        spans = Counter(b[d] for b in self.borders if len(b) > d and b.startswith(prefix))
        return min(spans, key=lambda c: (-spans[c], c)) if spans else None

    def merge(self) -> None:
        nodes = [(0, len(self.words), 0)]
        while nodes:
            lo, hi, depth = nodes.pop()
            across = lo == 0 and depth <= self.left or hi == len(self.words) and depth <= self.right
            if not across:
                if hi - lo < 2:
                    continue
                depth = len(commonprefix([self.words[lo], self.words[hi - 1]]))
            parts = self.children(lo, hi, depth)
            prefix = self.words[lo][:depth]
            heavy = self.heavy_across(prefix) if across else max((p for p in parts if p[0]), key=lambda p: p[2] - p[1])[0]
            self.merge_node(parts, depth, heavy, across)
            nodes += [(a, b, depth + 1) for char, a, b in parts if char]

    def merge_node(self, parts: list[tuple[str, int, int]], depth: int, heavy: str | None, across: bool) -> None:
        light = [p for p in parts if p[0] != heavy]
        wild: dict[str, list[int]] = defaultdict(list)
        shared = sum(1 for char, _, _ in light if char) > 1
        for char, lo, hi in light:
            for i in range(lo, hi):
                word = self.words[i]
                prefix, rest = word[:depth], word[depth + 1 :]
                if heavy is not None:
                    self.ask(i, prefix + heavy + word[depth:])
                if not char:
                    continue
                if heavy is not None:
                    self.ask(i, prefix + heavy + rest)
                if rest[:1] != char:  # else the two words part further down
                    self.ask(i, prefix + rest)
                if across:
                    self.sent.append((WILD, prefix + ANY + rest, i))
                elif shared:
                    wild[rest].append(i)
        for same in wild.values():
            for k, i in enumerate(same):  # at most one word a character
                for j in same[:k]:
                    self.meet(i, j)

    def rows(self) -> pd.DataFrame:
        found = [(LINK, b[1], self.words[i], b[0], self.near[i]) for i, b in enumerate(self.best) if b is not None]
        found += [(kind, key, self.words[i], self.counts[i], 0) for kind, key, i in self.sent]
        return pd.DataFrame(found, columns=["kind", "key", "word", "n", "n_near"])


def _merged(ends: list[tuple[int, str, str]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    ranges = [r for r, _, _ in ends]
    borders = [commonprefix([a[2], b[1]]) for a, b in zip(ends, ends[1:])]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k = ranges.index(rows["range"].iloc[0])
        rows = rows.sort_values("word")
        part = Range(rows["word"].tolist(), rows["n"].tolist(), borders, ends[k - 1][2] if k else None, ends[k + 1][1] if k + 1 < len(ends) else None)
        part.merge()
        return part.rows()

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) for every word of (word, n) that has near words: how many, and the commonest with its count."""
    size = words.agg(F.sum(F.octet_length("word") + WORD_BYTES)).first()[0] or 0
    ranged = stash(words.repartitionByRange(1 + size // RANGE_BYTES, "word").withColumn("range", F.spark_partition_id()), "ranges")
    ends = sorted(((r["range"], r["first"], r["last"]) for r in ranged.groupBy("range").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()), key=lambda e: e[1])
    merged = stash(ranged.groupBy("range").applyInPandas(_merged(ends), MERGED), "merged")
    # both ends of a link get it; a link within a range has been counted there
    asked = merged.where(F.col("kind") == LOOKUP).join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    best = lambda n, word: F.struct((-n).alias("less"), word.alias("word"))
    sides = F.array(F.struct(F.col("word"), best(F.col("key_n"), F.col("key")).alias("best")), F.struct(F.col("key").alias("word"), best(F.col("n"), F.col("word")).alias("best")))
    links = asked.select(F.explode(sides).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    group = merged.where(F.col("kind") == WILD).groupBy("key").agg(F.sort_array(F.collect_list(best(F.col("n"), F.col("word")))).alias("all")).where("size(all) > 1")  # at most one word a character
    first, second = F.col("all")[0], F.col("all")[1]
    wild = group.select("all", F.explode("all").alias("own")).select(F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("own.word") == first["word"], second).otherwise(first).alias("best"))
    inside = merged.where(F.col("kind") == LINK).select("word", "n_near", best(F.col("n"), F.col("key")).alias("best"))
    found = inside.unionByName(links).unionByName(wild).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms from each word of (word, form).

    The distance followed doubles in each round. Counts grow TIMES-fold along a chain, so it has fewer than 20 links.
    """
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = now.join(spread(on, "root"), "root", "left")
        after = stash(both.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        unstash(now)
        now = after
        if not now.where("moved").take(1):
            return now.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, form, root, n_near and form_n for each word of (word, n), which are distinct."""
    near = near_words(words)
    form: Column = F.when(F.col("near_n") >= times * F.col("n"), F.col("near"))
    found = stash(words.join(near, "word", "left").select("word", "n", form.alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    roots = follow(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "form", "root", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """The words of the whole texts that come at least ``least_count`` times, with their near words, forms and roots."""
    counts = spelled_words(docs, text).groupBy("word").agg(F.count("*").alias("n"))
    return group_variants(stash(counts.where(F.col("n") >= least_count), "words"))
