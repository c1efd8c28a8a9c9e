"""The pipeline against a brute-force version of its stages."""

import hashlib
from collections import Counter, defaultdict

import base64

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from folioforge.llm.queries_bpe import RANKS
from folioforge.llm.queries_mixing import OP2_SQL
from folioforge.llm.queries_quality import OP6_SQL

SF = "/root/testdata/sf0.001"


def sets_of(text):
    w = text.encode().lower().split()
    return frozenset({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))


def components(texts):
    sets = {i: sets_of(t or "") for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def without_repeats(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.setdefault(data[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = bytes(c for c, g in zip(data, gone) if not g), sum(gone), spans
    return out


def test_against_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()}
    texts = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    component, _ = components(texts)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    texts = {i: b.decode(errors="ignore") for i, (b, _, _) in without_repeats(texts).items()}
    texts = {i: t for i, t in texts.items() if t}
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, source[i], t) for i, t in texts.items()])
    taken = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({OP2_SQL}) WHERE taken > 0").fetchall()}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        text = encoder.decode(r.ids)
        assert text in texts[r.doc_id] and r.source == source[r.doc_id]
        assert encoder.encode_ordinary(text) == r.ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        words[r.doc_id] += len(text.encode().split())
    assert words == taken


def test_defined_cases(spark):
    good = " ".join(f"the word{i}" for i in range(120))
    near = good.replace("word119", "other")
    free = " ".join(f"of pages{i} and{i % 7}" for i in range(80)) + " \ufffd"
    rows = [(1, good, "en", "a", 1), (2, near, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "short", "en", "b", 5), (6, "x " * 500, "en", "b", 1)]
    rows += [(7, " ".join(f"le éé{i}" for i in range(200)) + " " + good[:300], "fr", None, 1)] * 2
    rows += [(None, free, "en", "a", 1), (1, " ".join(f"der satz{i}" for i in range(90)), "de", "b", 1)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    ids = defaultdict(list)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        ids[name] = sorted(((r.doc_id or 0) for r in docs.collect()))
        if name == "suffix-array dedup":
            assert free in {r.text for r in docs.collect()}
    assert ids["quality rules"] == [0, 1, 1, 2, 7, 7]
    assert ids["n-gram Jaccard join"] == [0, 1, 1, 7]
    assert ids["suffix-array dedup"] == [0, 1, 1, 7]
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
