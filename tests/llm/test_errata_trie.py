"""Spelling variants against brute force: all pairs, each range size, and the defined cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioforge.llm import errata_trie
from folioforge.llm.errata_trie import group_variants, spelling_variants
from folioforge.llm.queries_spelling import op11_spelling_variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def brute(words):
    """word -> (n, form, root, n_near, form_n); near words found through the texts with one character less."""
    shorter = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shorter.setdefault(v, set()).add(w)
    form, near = {}, {}
    for w, n in words.items():
        met = set().union(*(shorter[v] for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}))
        near[w] = [x for x in met if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, form[w], root, len(near[w]), words[form[w]] if form[w] else None)
    return out


def checked(spark, words):
    got = group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in got.collect()} == brute(words)


@pytest.mark.parametrize("size", [60, 400, 4 << 20])
def test_against_all_pairs(spark, monkeypatch, size):
    """Dense words (few letters, shared beginnings, runs of one letter), in one range or in many."""
    monkeypatch.setattr(errata_trie, "RANGE_BYTES", size)
    rng = random.Random(size)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 6))): rng.choice([2, 9, 25, 300, 4000]) for _ in range(120)}
    words |= {"prefix" + "".join(rng.choices("xyz", k=rng.randint(0, 4))): rng.choice([2, 40, 900]) for _ in range(60)}
    words |= {"a" * k: 10**k for k in range(1, 12)} | {"q" * 3000 + c: 3 for c in ("", "q", "r", "rs", "ss")}
    checked(spark, words)


def test_range_of_one_prefix():
    """A hot prefix that spans ranges is passed along, not merged, where it does not branch."""
    words = sorted("same" * 3 + a + b for a in "abcdef" for b in "uvwxyz")
    borders = [a if a == b else a[: next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)] for a, b in zip(words[5::6], words[6::6])]
    part = errata_trie.Range(words[6:12], [2] * 6, borders, words[5], words[12])
    part.merge()
    assert all(len(key) >= 12 for _, key, _ in part.sent) and len(part.sent) <= 24


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "short words"), (4, "Spelling SPELLING spelling " * 20), (5, "speling spelling"), (6, "speling"), (None, "nothing NOTHING nothings"), (None, "nothing nothings"), (7, "Éléphant éléphant Éléphant"), (8, "straßenbahn straßenbahn " * 3), (8, "tie_abcdefg tie_abcdefh tie_abcdefi " * 3), (9, "x" * 50_000 + " " + "x" * 50_000 + " " + ("x" * 49_999 + " ") * 2)]
    rows += [(100 + i, " ".join(["committee"] * 40)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in spelling_variants(docs).collect()}
    words = counted(rows)
    assert got == brute(words) and any(v[1] == "committee" for v in got.values())
    assert spelling_variants(docs.limit(0)).count() == 0


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in op11_spelling_variants(spark, SF).collect()}
    assert got == brute(counted(rows))
