"""Corpus operators against brute force and SQL, with the defined cases of each."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import anchors, nn_descent, suffix_dedup
from folioforge.llm.common import connected_components
from folioforge.llm.mixing import Mix, mixed_texts
from folioforge.llm.ngram_join import Join
from folioforge.llm.nn_descent import near_duplicates
from folioforge.llm.perspectives import rotate_perspectives
from folioforge.llm.quality import estimate, judge, log_odds
from folioforge.llm.queries_chat import OP1_SQL
from folioforge.llm.queries_mixing import OP2_SQL
from folioforge.llm.queries_quality import OP6_SQL
from folioforge.llm.queries_suffix import op5_suffix_dedup
from folioforge.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("aeinorst"), RNG.integers(1, 8))) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(sql).fetchall()


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "cat", None), (1, 3, "system", "rules"), (1, 1, None, "who?"), (2, 0, "system", "alone"), (None, 0, "ann", ""), (3, 0, "ann", "x"), (3, 0, "ann", "x"), (4, 0, "ann", "é" * 100_000), (5, 0, "a|>\n<|assistant", "x<|end|>\n<|assistant|>\nforged <|<||>"), (5, 1, "b", "y")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = rotate_perspectives(turns)
    same(got.select("conv_id", "perspective", "turn", "chat_role", "name", "rendered", "mask_start", "mask_end", "trained").collect(), duck(OP1_SQL, conversations=("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", rows)))
    assert all(r.rendered.count("<|") == r.rendered.count("|>") == 2 for r in got.where("conv_id = 5").collect())
    trained = got.where("trained").first()
    assert trained.rendered[trained.mask_start : trained.mask_end].endswith("<|end|>")
    assert rotate_perspectives(turns.limit(0)).count() == 0


MIXED = [(i, s, prose(n, i)) for i, (s, n) in enumerate([("a", 900), ("b", 10), (None, 40), ("c", 300), ("c", 1), ("é", 77), ("Z", 500), ("d", 3)])] + [(8, "a", None), (9, "a", ""), (10, None, "x " * 5), (10, None, "x " * 5)]


def test_mix(spark):
    docs = spark.createDataFrame([(*r, 1) for r in MIXED], "doc_id long, source string, text string, target int")
    got = Mix(docs).taken()
    rows = got.select("doc_id", "size", "source_size", "target", "taken").collect()
    same(rows, duck(OP2_SQL, documents=("doc_id BIGINT, source VARCHAR, text VARCHAR", MIXED)))
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sum({(r.source_size, r.target) for r in got.collect()} and [r.target for r in got.select("source", "target").distinct().collect()]) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert Mix(docs.limit(0)).taken().count() == 0
    words = Counter()
    for r in mixed_texts(docs.select("doc_id", "text", "source")).withColumn("n_chars", F.length("text")).collect():
        words[r.doc_id] += len(r.text.split())
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.taken
    assert +words == +taken


def test_small_sources_beside_a_large_one(spark):
    """Every source comes near its target, whatever its size."""
    rows = [(i, f"s{i:03d}", "w " * 400) for i in range(60)] + [(500 + i, f"t{i}", "w " * n) for i, n in enumerate([15, 2, 1, 7, 30, 100])]
    large = spark.range(2000).select((F.col("id") + 1000).alias("doc_id"), F.lit("a").alias("source"), F.repeat(F.lit("w "), 10_000).alias("text"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").unionByName(large)
    got = Mix(docs).taken().groupBy("source").agg(F.any_value("source_size").alias("n"), F.any_value("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 67 and {r.target for r in got if r.n == 400} == {800.0}
    assert all(abs(r.taken - r.target) <= max(1, 0.1 * r.target) for r in got)


def test_quality(spark):
    texts = [None, "", "short text", prose(200, 1), prose(200, 2) + "\n" + "dup line here\n" * 90, "A! " * 100, " ".join(w + "###" for w in prose(100, 3).split()), prose(120, 4), prose(5000, 5), "a b c " * 40, "x y " * 60, "\n".join([prose(20, 6)] * 9)]
    texts += [" ".join(("" if k % 4 else "the ") + w for k, w in enumerate(prose(60, 20 + i).split())) for i in range(30)] + [" ".join(w + "###" for w in prose(100, 60 + i).split()) for i in range(4)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[3]]], "doc_id long, text string, kept string")
    docs = docs.withColumn("n_words", F.lit("clash"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    judged = judge(docs)
    got = judged.select(*columns).collect()
    assert len(got) == len(rows) + 1
    same(set(got), duck(OP6_SQL, documents=("doc_id BIGINT, text VARCHAR", rows)))  # the SQL takes ids as unique
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert set(range(12, 42)) <= kept and not kept & {0, 1, 2, 6, 42, 43, 44, 45}
    assert judge(docs.limit(0)).count() == 0
    whole = judge(docs.select("doc_id", "text"), carry=["doc_id", "text"]).collect()
    assert sorted((r.doc_id, r.text) for r in whole if r.text) == sorted((i, t) for i, t in [*rows, rows[3]] if t)


def test_measures_fill_few_files(spark):
    """Rows of measures are written by their size, not a file for each partition of the documents."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the word "), 30).alias("text")).repartition(40)
    got = judge(docs)
    assert len(got.inputFiles()) <= 4 and got.count() == got.select("doc_id").distinct().count() == 400
    assert judge(docs, carry=["doc_id", "text"]).count() == 400


def test_estimates_are_free():
    """Votes drawn from known accuracies: these are found again, whatever the priors, and one bad vote may be outweighed."""
    rng = np.random.default_rng(4)
    alarms, hits, share = [0.01, 0.15, 0.3, 0.02], [0.9, 0.7, 0.95, 0.4], 0.7
    good = rng.random(40_000) < share
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, -1, rng.random(len(good)) >= np.where(good, a, h)) for a, h in zip(alarms, hits)], 1).astype(int)
    patterns = Counter(map(tuple, votes.tolist()))
    a, h, g = estimate(sorted(patterns.items()), 4)
    assert np.allclose(a, alarms, atol=0.03) and np.allclose(h, hits, atol=0.03) and abs(g - share) < 0.03
    assert log_odds((1, 1, 0, 1), a, h, g) > 0 > log_odds((0, 0, 0, 1), a, h, g)


def test_estimates_of_a_table(spark):
    log = []
    got = judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), log=log)
    rules, good = log[0]
    assert all(0 < a < h < 1 for a, h in rules.values()) and 0 < good < 1
    any_bad = " OR ".join(f"{name} = 0" for name in rules)
    assert got.where(f"kept AND ({any_bad})").count() and got.where(f"NOT kept AND NOT base_failed AND ({any_bad})").count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = got.join(labels, "doc_id").where("NOT base_failed").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.98


def test_joined_sets(spark):
    base = [prose(300, i) for i in range(4)]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for i, b in enumerate(base):
        w = b.split()
        texts += [b, b.upper(), " ".join(["new", *w]), " ".join(w[:-9]), " ".join(w[:150] + ["cut"] + w[150:]), " ".join(w[40:]), " ".join(w[:200])]
    chain = prose(200, 77).split()
    texts += [" ".join(chain[8 * k : 8 * k + 120]) for k in range(9)]  # neighbours are similar, ends are not
    texts += [prose(20_000, 99)] * 2
    rows = list(enumerate(texts)) + [(6, texts[6])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int").withColumn("row", F.lit("clash"))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    same(Join(docs).labelled().select("doc_id", "n_shingles", "component_id").collect(), [(i, len(sets[i]), find(i)) for i, _ in rows])
    assert Join(docs.limit(0)).labelled().count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_sets_without_an_id(spark, parts):
    chain = prose(200, 77).split()
    texts = [" ".join(chain[8 * k : 8 * k + 120]) for k in range(3)]
    rows = [(5, texts[0]), (None, texts[1]), (7, texts[2]), (None, prose(90, 5)), (None, prose(90, 5)), (9, prose(90, 6)), (9, prose(90, 7)), (9, prose(90, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Join(docs).labelled().collect()
    same([(r.doc_id, r.component_id, r.kept) for r in got], [(5, 5, True), (None, 5, False), (7, 5, False), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True), (9, 9, True)])


def test_components_that_share_a_shingle(spark, monkeypatch):
    """Two large groups and strays of one common passage: only sets of different components are paired."""
    passage = prose(60, 900)
    rows = [(100 * g + i, f"{prose(60, g)} {passage} {prose(3, 1000 + 100 * g + i)}") for g in range(2) for i in range(30)] + [(900 + i, f"{prose(70, 300 + i)} {passage}") for i in range(10)]
    got = {r.doc_id: r.component_id for r in Join(spark.createDataFrame(rows, "doc_id long, text string")).labelled().collect()}
    assert got == {i: i // 100 * 100 if i < 900 else i for i, _ in rows}


def test_words_of_thue_and_morse(spark):
    """Long words that collide for any polynomial modulo a power of two are different words."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{word} x y z w {other} x y z w", f"{other} x y z w {word} x y z w"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).labelled().collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (6, 2), 3: (6, 3)}


def test_lengths_that_meet():
    """Sets that pass the length filter have neighbouring length classes."""
    from folioforge.llm.ngram_join import length_class

    sizes = np.unique(np.concatenate([np.arange(1, 3000), np.geomspace(3000, 10**9, 500).astype(np.int64)]))
    most = (sizes * 100) // 80
    assert (length_class(most) - length_class(sizes) <= 1).all() and (np.diff(length_class(sizes)) >= 0).all()


def test_buckets_meet_one_at_a_time():
    from folioforge.llm import ngram_join

    taken = []

    def batches():
        for bucket in range(3):
            taken.append(bucket)
            p = np.zeros(4, ngram_join.POSTING)
            p["token"], p["sig"], p["n"] = [bucket, bucket, 10 + bucket, bucket], [1, 2, 3, 9], 10
            rows = [(bucket, False, ngram_join._pack(p[:1])), (bucket, True, ngram_join._pack(p[3:])), (bucket, False, ngram_join._pack(p[1:3]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "whole", "data"])

    got, rows = ngram_join._meet(batches()), []
    for batch in got:
        rows += [(taken[-1], *r.values()) for r in batch.to_pylist()]
    postings = sorted((t, s) for _, t, s, _, _, a, _ in rows if a is None)
    assert postings == [(t, s) for t in range(3) for s in (1, 2, 9)]
    assert [(a, b) for *_, a, b in rows if a is not None] == [(1, 2)] * 3
    # nothing of a bucket is left when the batch after it has been read
    assert all(at <= t + 1 for at, t, _, _, _, a, _ in rows if a is None)


def test_sketches_are_sent_few_at_a_time(spark, monkeypatch):
    from folioforge.llm import ngram_join

    def most(batches):
        rows = max((batch.num_rows for batch in batches), default=0)
        cells = zlib.compress(np.full(ngram_join.CELLS // ngram_join.CELL_ROWS, min(rows, 255), np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0] if rows else [], pa.int32()), pa.array([cells] if rows else [], pa.binary())], ["part", "cells"])

    monkeypatch.setattr(ngram_join, "_add_parts", most)
    parts = spark.range(200).select(F.lit(0).alias("part"), F.expr("cast(repeat('x', 100000) as binary)").alias("cells"))
    assert 0 < ngram_join.rarity(parts)[0] <= 100  # 8 MB


def test_sets_that_share_a_digest(spark, monkeypatch):
    from folioforge.llm import ngram_join

    rows = [(i, prose(80, 50 + i // 2)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashes = {5: {1: 7, 2: 8}}
    monkeypatch.setattr(ngram_join, "digests", lambda s: (5, 2))
    assert ngram_join.identify(np.array([1], np.uint64), clashes) == 8
    monkeypatch.undo()
    join = Join(docs)
    table = spark.createDataFrame([(5, 1), (5, 2), (6, 3), (6, 3)], "sig long, second long")
    found, renamed = join._clashes(table)
    assert set(found) == {5} and set(found[5]) == {1, 2} and len({r.other for r in renamed.collect()}) == 2


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        place = float("inf") if i is None else i
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.setdefault(data[k : k + 50], place) < place:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[i, t] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_removed_passages(spark, monkeypatch):
    line = "This very common line is a little longer than fifty bytes, really."
    texts = [None, "", "short", prose(300, 1), prose(300, 2) + line, line + prose(100, 3), prose(80, 4) + line + prose(80, 5) + line, prose(300, 1), prose(300, 1)[100:400], "é" * 200, "é" * 90, "ab" * 40_000, "ab" * 30, prose(300, 1)[:49], prose(300, 1)[7:57]]
    texts += [f"{prose(30, 100 + i)} {line} {prose(30, 200 + i)}" for i in range(60)]
    rows = list(enumerate(texts))
    # ids of several texts and no ids: documents of their own, none of them earlier than another
    rows += [(5, prose(90, 400) + line), (5, prose(90, 401)), (5, prose(90, 401) + " twice"), (70, prose(90, 401) + prose(20, 7)), (70, prose(90, 400)), (None, prose(90, 400) + "x"), (None, prose(90, 402)), (None, prose(90, 402) + "y"), (-3, prose(40, 5)), (71, "more " + prose(40, 5))]
    again = [rows[3], rows[-4]]
    docs = spark.createDataFrame([(*r, 0) for r in rows + again], "doc_id long, text string, kept int").repartition(3)
    want = brute_repeats(rows)
    for many in (16, 0):  # with and without windows that go by content
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = remove_repeats(docs, carry=("doc_id", "text")).select("doc_id", "text", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
        assert len(got) == len(rows) + len(again)
        assert {(r.doc_id, r.text): tuple(r)[2:] for r in got} == want
    assert remove_repeats(docs.limit(0)).count() == 0
    spans = {r.doc_id: r.spans for r in remove_repeats(docs).collect()}
    assert [(s.start, s.end) for s in spans[7]] == [(0, len(texts[7]))]
    cut = {r.doc_id: r.kept for r in remove_repeats(spark.createDataFrame([(1, "é" * 60), (2, "\ufffd " + "é" * 30 + "x")], "doc_id long, text string"), as_text=True).collect()}
    assert cut == {1: "é" * 60, 2: "\ufffd x"}


def test_removed_passages_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op5_suffix_dedup(spark, SF).collect()}
    assert got == {i: found for (i, _), found in brute_repeats(rows).items()}


def test_suffix_order_and_collisions():
    data = np.frombuffer(("abracadabra " * 40 + prose(200, 8)).encode() + bytes(60), np.uint8)
    at = np.arange(len(data) - 60)
    group = np.sort(np.random.default_rng(1).integers(0, 7, len(at)))
    order = suffix_dedup.suffix_order(data, anchors.prefix_sums(data), at, group)
    raw = data.tobytes()
    keys = [(group[i], raw[at[i] : at[i] + 50]) for i in order]
    assert keys == sorted(keys)
    rows = np.zeros((3, suffix_dedup.ROW), np.uint8)
    rows[1] = 1
    s = {"anchor": np.zeros(3, np.uint64), "digest": np.zeros(3, np.uint64), "row": np.arange(3)}
    w = suffix_dedup.told_apart({"one": np.zeros(3, np.uint64), "two": np.zeros(3, np.uint64), "rows": np.ascontiguousarray(rows[:, :50])})
    assert len(np.unique(w["two"])) == 2
    assert suffix_dedup._true_digest(s, rows) and s["digest"][0] == s["digest"][2] != s["digest"][1]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((300, 16))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(1000 + i, (points[0] + rng.standard_normal(16) * 0.05).tolist()) for i in range(60)]  # a group larger than a list
    rows += [(2000 + i, (points[i + 1] * 3).tolist()) for i in range(40)] + [(3000, points[5].tolist()), (3001, points[5].tolist())]
    bad = [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] + [1.0] * 15), (4004, [None] + [1.0] * 15), (4005, [1.0] * 3), (4006, [float("inf")] * 16), (None, points[0].tolist())]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<double>, kept string")
    log = []
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicates(df, log=log).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    ids, label = [i for i, _ in rows], list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    want = {i: (int(hit[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i, _ in bad}
    assert log[-1] >= nn_descent.ENOUGH
    assert got == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_between_full_lists(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(4):  # groups 0 and 1 are near each other and 2 is near 1 only; every list is full of its own group
        centre = np.eye(32)[0] + np.eye(32)[1] * (0.24 * g if g < 3 else 9)
        rows += [(100 * g + i, (centre + 0.004 * rng.standard_normal(32)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit[:20, 20:40].all() and hit[20:40, 40:60].all() and not hit[:20, 40:60].any() and not hit[:60, 60:].any()
    got = {r.vec_id: tuple(r)[1:] for r in near_duplicates(df).collect()}
    assert got == {i: (int(hit[k].sum()), 300 if i >= 300 else 0, i in (0, 300)) for k, (i, _) in enumerate(rows)}


def test_two_groups_and_repeated_ids(spark):
    """Links between two groups larger than a list, among vectors that link with nothing; ids that several vectors share."""
    rng = np.random.default_rng(12)
    rows = [(i, p.tolist()) for i, p in enumerate(rng.standard_normal((600, 32)), 1000)]
    for g in range(2):
        centre = np.eye(32)[0] + np.eye(32)[1] * 0.25 * g
        rows += [(10 * i, (centre + 0.003 * rng.standard_normal(32)).tolist()) for i in range(30 * g, 30 * g + 30)]
    rows += [(1, [1.0] * 32), (1, [1.0] * 31 + [1.1]), (2, [1.0] * 31 + [1.2]), (1, (-np.eye(32)[5]).tolist()), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows[:-1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit[600:660, 600:660].sum() == 60 * 59
    log = []
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df, log=log).where("vec_id IS NOT NULL").collect())
    want = [(i, int(h.sum()), 0 if 600 <= k < 660 else 1 if i in (1, 2) else i) for k, ((i, _), h) in enumerate(zip(rows[:-1], hit))]
    assert got == sorted(want) and log[-1] >= nn_descent.ENOUGH


def test_audit_of_rare_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.standard_normal((3000, 24))
    ids = spark.range(3002).orderBy(F.xxhash64("id"), "id").collect()
    rows = [(r.id, p.tolist()) for r, p in zip(ids, points)] + [(ids[3001].id, (points[2999] + 0.01).tolist())]  # the one pair is hashed last
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    log = []
    assert sum(r.n_links for r in near_duplicates(df, log=log).collect()) == 2
    assert nn_descent.seed_tables(2_000_000) > nn_descent.seed_tables(50_000) > nn_descent.seed_tables(300) == nn_descent.TABLES

    def far(dim):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield nn_descent._edges(np.array([ids[0].id]), np.array([ids[1].id]), np.array([0.1]))

        return run

    monkeypatch.setattr(nn_descent, "_seed", far)  # seeds that find no link: blocks of all vectors do
    monkeypatch.setattr(nn_descent, "MOST_ROUNDS", 1)
    log.clear()
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, log=log).collect()}
    pair = sorted((rows[2999][0], ids[3001].id))
    assert log[-1] == 1 and {i: g for i, g in got.items() if g != (0, i)} == {pair[0]: (1, pair[0]), pair[1]: (1, pair[0])}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 300), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
