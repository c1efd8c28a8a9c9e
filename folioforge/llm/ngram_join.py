"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

The set of a document is its distinct word shingles (``shingles``). Two sets are similar when their Jaccard
similarity is at least ``PERCENT`` hundredths.

1. Equal sets collapse to one, by a 64-bit digest; a second digest tells the sets apart that share the first, and
   these few get other digests. The scan also counts shingles in a sketch of fixed size, which gives
   every shingle a rank: rare first, then by hash. Any such order gives the right pairs; a better one, fewer
   candidates.
2. A set is indexed under the shingles of its prefix, the first n - ceil(t n) + 1 of the order. Postings of a
   scan block meet those of other blocks by shingle.
3. First round: the postings of a list are shuffled, differently for each shingle, and each is paired with its
   neighbour and with the list's first. That is a linear number of pairs however long the list, and different
   partners from every shingle: their components hold all but stray copies of a group.
4. Second round: for the shingles whose postings lie in more than one component, the postings outside of the
   shingle's largest component meet all others: a component is never paired with itself for a stray copy's sake. Links inside a component cannot change the result, so none between different
   components is lost.
5. Every pair passes the length and positional filters before it is made, then the suffix filter (a lower bound
   of the difference from counts of both sets by hash range), and is verified once on the whole sets: the second
   round leaves out what the first has tried. Its postings meet by shingle and length class.

Sets are sets of 64-bit hashes of shingles. A word's hash is a sum of mixed values of its bytes and their places, a
shingle's one of its words, so two shingles share a hash by chance only: once in 2**64 pairs.

Only components are computed: which sets of one component link directly is not.

Defined cases: a null text and a text without words have an empty set, link with nothing and are their own
component; a shorter text than a shingle is one shingle; texts of any length are read whole; repeated rows are
equal sets; rows that share a doc_id are documents of their own; a null doc_id links like any other, and is no
component's name unless the component has no other; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import connected_components, mapped, row_key, spread, stash, unstash, while_writing
from folioforge.llm.shingles import digests, mix, shingle_sets, slices

PERCENT = 80
#: Cells of the count sketch and rows it is sent in: a fixed size, whatever the corpus.
CELLS, CELL_ROWS = 1 << 20, 64
#: Bytes of text whose postings are gathered before they are sent.
BLOCK_BYTES = 16 << 20
#: Hash ranges of the suffix filter.
RANGES = 128

#: Postings bytes of a partition in which buckets meet; logarithm of the length of a class.
MEET_BYTES = 32 << 20
CLASS_STEP = float(np.log(100 / PERCENT))

#: Replacements by first and second digest, of the sets that share a first digest.
Clashes = dict[int, dict[int, int]]

SCANNED = "doc_id long, row long, n long, sig long, second long, hist array<smallint>, part int, cells binary"
POSTED = "bucket int, whole boolean, data binary, a long, b long"
POSTING = [("token", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("pos", "<u4")]


def needed(a, b):
    """The least overlap of two sets of these sizes that makes them similar: ceil(t (a + b) / (1 + t))."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def length_class(n):
    """Steps of 5/4 up to a size: sizes of similar sets lie in the same or in neighbouring classes."""
    return np.floor(np.log(n) / CLASS_STEP + 1e-9).astype(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, size, digest); at the end the task's sketch, in parts."""
    cells = np.zeros(CELLS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("second", pa.int64()), ("hist", pa.list_(pa.int16())), ("part", pa.int32()), ("cells", pa.binary())])
    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for first, run in slices(batch.column("text").to_pylist()):
            sets = shingle_sets(run)
            if sum(map(len, sets)):
                np.add.at(cells, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), 1)
            k = len(run)
            both = [digests(s) if len(s) else (None, None) for s in sets]
            hists = pa.array([histogram(s) if len(s) else None for s in sets], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + k], pa.int64()), pa.array(rows[first : first + k], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*both)), hists, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    if cells.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in cells.reshape(CELL_ROWS, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(CELL_ROWS, pa.int64())] * 5 + [pa.nulls(CELL_ROWS, pa.list_(pa.int16())), pa.array(range(CELL_ROWS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            row = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + row if part in sums else row
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(_levels(x).tobytes(), 6) for x in sums.values()], pa.binary())], ["part", "cells"])


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as steps of a quarter of a doubling."""
    return np.minimum(255, 4 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def rarity(scanned: DataFrame) -> bytes:
    """The level of every cell: CELLS bytes."""
    parts = mapped(scanned.where("part IS NOT NULL").select("part", "cells").repartition(CELL_ROWS, "part"), _add_parts, "part int, cells binary")
    with while_writing(scanned.sparkSession):
        parts = parts.collect()
    levels = np.zeros((CELL_ROWS, CELLS // CELL_ROWS), np.uint8)
    for row in parts:
        levels[row.part] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    return levels.tobytes()


def histogram(hashes: np.ndarray) -> np.ndarray:
    """Members by hash range, each up to 32,767: capped counts still bound the difference from below."""
    return np.minimum(32767, np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=RANGES)).astype(np.int16)


def identify(hashes: np.ndarray, clashes: Clashes) -> int:
    """The digest that stands for a set."""
    one, two = digests(hashes)
    return clashes[one][two] if one in clashes else one


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return overlap(a, b) >= needed(len(a), len(b))


def linear_pairs(p: np.ndarray) -> np.ndarray:
    """Index pairs of postings in ``shuffled`` order: each with the one before it and with its list's first."""
    if len(p) < 2:
        return np.empty((0, 2), np.int64)
    same = p["token"][1:] == p["token"][:-1]
    here = np.flatnonzero(same) + 1
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(p)), 0))
    pairs = np.concatenate([np.stack([here - 1, here], 1), np.stack([head[here], here], 1)])
    a, b = p[pairs[:, 0]], p[pairs[:, 1]]
    return pairs[fits(a, b)]


def shuffled(p: np.ndarray) -> np.ndarray:
    """Postings by token, in an order of each token's own; postings of one set stay together."""
    return p[np.lexsort((p["sig"], mix(p["sig"].astype(np.uint64) ^ p["token"]), p["token"]))]


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length and positional filter of postings of one token."""
    na, nb, pa_, pb = (x.astype(np.int64) for x in (a["n"], b["n"], a["pos"], b["pos"]))
    size = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    return (a["sig"] != b["sig"]) & size & (np.minimum(na - pa_, nb - pb) >= needed(na, nb))


def _distinct(sig_pairs: np.ndarray) -> np.ndarray:
    return np.unique(np.sort(sig_pairs, axis=1), axis=0)


def _forest(pairs: Iterable[tuple[int, int]], sets: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """The components of the similar pairs as stars; a pair that is connected already need not be compared."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y and similar(sets[a], sets[b]):
            above[max(x, y)] = min(x, y)
    return [(root(x), x) for x in list(above) if root(x) != x]


def _post(levels: bytes, n_buckets: int, clashes: Clashes):
    """A scan block's postings, bucketed by token; pairs inside the block are verified at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(levels, np.uint8)
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for _, encoded in slices(batch.column("text").to_pylist()):
                for s in shingle_sets(encoded):
                    if len(s) and (sig := identify(s, clashes)) not in sets:
                        sets[sig] = s
                        size += 8 * len(s)
                if size >= BLOCK_BYTES:
                    yield from _block(sets, rank, n_buckets)
                    sets, size = {}, 0
        if sets:
            yield from _block(sets, rank, n_buckets)

    return run


def _block(sets: dict[int, np.ndarray], rank: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    parts = []
    for sig, s in sets.items():
        k = prefix_length(len(s))
        level = rank[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
        key = (level << np.uint64(56)) | (s >> np.uint64(8))
        order = np.lexsort((s, key))[:k] if len(s) > 1 else np.zeros(1, np.int64)
        p = np.empty(len(order), POSTING)
        p["token"], p["sig"], p["n"], p["pos"] = s[order], sig, len(s), np.arange(len(order))
        parts.append(p)
    p = shuffled(np.concatenate(parts))
    pairs = linear_pairs(p)
    links = _forest(_distinct(np.stack([p["sig"][pairs[:, 0]], p["sig"][pairs[:, 1]]], 1)).tolist(), sets)
    # of a list that is long already here, the ends go to meet other blocks' and the whole waits for the second round
    first = np.concatenate(([True], p["token"][1:] != p["token"][:-1]))
    group = np.cumsum(first) - 1
    count = np.bincount(group)
    last = np.concatenate((first[1:], [True]))
    long = count[group] > 16
    sent = p[~long | first | last]
    bucket = (mix(sent["token"]) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    rows = []
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(sent)]):
        rows.append((int(bucket[a]), False, _pack(sent[a:b]), None, None))
    for a in range(0, int(long.sum()), 20_000):
        some = p[long][a : a + 20_000]
        rows.append((int(some["sig"][0]) % n_buckets, True, _pack(some), None, None))
    rows += [(None, None, None, a, b) for a, b in links]
    kinds = (("bucket", pa.int32()), ("whole", pa.bool_()), ("data", pa.binary()), ("a", pa.int64()), ("b", pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _pack(p: np.ndarray) -> bytes:
    """Postings column by column."""
    return b"".join(np.ascontiguousarray(p[name]).tobytes() for name, _ in POSTING)


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 24
    p, at = np.empty(n, POSTING), 0
    for name, kind in POSTING:
        width = np.dtype(kind).itemsize * n
        p[name] = np.frombuffer(data[at : at + width], kind)
        at += width
    return p


MET = "token long, sig long, n int, pos int, a long, b long"


def _met(p: np.ndarray, ab: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of MET: pairs ``ab`` if given, else postings."""
    names = ["token", "sig", "n", "pos", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    n = len(p) if ab is None else len(ab)
    for i in range(0, n, 50_000):
        k = min(50_000, n - i)
        if ab is None:
            q = p[i : i + k]
            columns = [q["token"].astype(np.int64), q["sig"].astype(np.int64), q["n"].astype(np.int32), q["pos"].astype(np.int32)]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.nulls(k, pa.int64())] * 2
        else:
            arrays = [pa.nulls(k, t) for t in kinds[:4]] + [pa.array(np.ascontiguousarray(ab[i : i + k, j]), pa.int64()) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the postings of shared tokens, and the first round's pairs.

    Rows come sorted by bucket, so one bucket is held at a time; postings that wait for the second round go on at once.
    """
    sent: list[np.ndarray] = []
    now = None
    for batch in batches:
        for bucket, whole, data in zip(*(batch.column(x).to_pylist() for x in ("bucket", "whole", "data"))):
            if bucket != now:
                yield from _meet_bucket(sent)
                sent, now = [], bucket
            if whole:
                yield from _met(_unpack(data))
            else:
                sent.append(_unpack(data))
    yield from _meet_bucket(sent)


def _meet_bucket(sent: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not sent:
        return
    p = shuffled(np.concatenate(sent))
    # copies of a set in several blocks are one posting
    p = p[np.concatenate(([True], (p["token"][1:] != p["token"][:-1]) | (p["sig"][1:] != p["sig"][:-1])))]
    same = p["token"][1:] == p["token"][:-1]
    p = p[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    yield from _met(p)
    pairs = linear_pairs(p)
    if len(pairs):
        yield from _met(p, _distinct(np.stack([p["sig"][pairs[:, 0]], p["sig"][pairs[:, 1]]], 1)))


def _sets_of(clashes: Clashes):
    """The set of each digest, once a task: several rows of one key are equal rows, or the key's rows are not all meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            for first, texts in slices(batch.column("text").to_pylist()):
                sets = {sig: s for sig, s in zip(sigs[first:], shingle_sets(texts)) if len(s) and sig not in seen and identify(s, clashes) == sig}
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["sig", "hashes"])

    return run


def may_be_similar(hist_a: Column, hist_b: Column, total: Column) -> Column:
    """Suffix filter: what two sets differ by in each hash range does not exceed what similar sets of this size may."""
    apart = F.aggregate(F.zip_with(hist_a, hist_b, lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda d, x: d + x)
    return apart <= total - 2 * F.ceil(total * PERCENT / (100 + PERCENT))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Join:
    """The similar documents of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
        self.spark = docs.sparkSession
        scanned = stash(mapped(self.docs, _scan, SCANNED), "scan")
        rows = scanned.where("part IS NULL").select("doc_id", "row", "n", "sig", "second", "hist")
        self.clashes, renamed = self._clashes(rows)
        if self.clashes:
            rows = rows.join(F.broadcast(renamed), ["sig", "second"], "left").withColumn("sig", F.coalesce("other", "sig"))
        #: (doc_id, row, n, sig, hist), sig and hist null for an empty set
        self.scanned = rows.select("doc_id", "row", "n", "sig", "hist")
        self.hists = self.scanned.where("sig IS NOT NULL").groupBy("sig").agg(F.any_value("n").alias("n"), F.any_value("hist").alias("hist"))
        self.levels = rarity(scanned)

    def _clashes(self, rows: DataFrame) -> tuple[Clashes, DataFrame | None]:
        """Sets that share a first digest: some n**2 / 2**65 of n, three of 10**10."""
        both = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("second").alias("least"), F.max("second").alias("most")).where("least != most").select("sig")
        found: Clashes = {}
        for r in rows.select("sig", "second").join(both, "sig").distinct().collect():
            found.setdefault(r.sig, {})[r.second] = int(mix(np.array([r.sig ^ r.second], np.int64).view(np.uint64)).view(np.int64)[0])
        if not found:
            return found, None
        return found, self.spark.createDataFrame([(a, b, c) for a, of in found.items() for b, c in of.items()], "sig long, second long, other long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the distinct ``pairs`` (a, b), a written table; they have passed the suffix filter."""
        ids = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
        reps = self.scanned.where("sig IS NOT NULL").groupBy("sig").agg(F.min("row").alias("row")).join(ids, "sig", "left_semi")
        sets = stash(mapped(self.docs.join(reps, "row").select("sig", "text"), _sets_of(self.clashes), "sig long, hashes binary"), "sets")
        left, right = (sets.select(F.col("sig").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
        links = stash(mapped(pairs.join(left, "a").join(right, "b"), _verify, "a long, b long"), "links")
        unstash(sets)
        return links

    def components(self) -> DataFrame:
        """(sig, component) of the linked sets; a set that links with none has no row."""
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        posting_bytes = self.hists.agg(F.sum(24 * (F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1))).first()[0] or 0
        partitions = max(partitions, -(-posting_bytes // MEET_BYTES))
        n_buckets = max(64, 4 * partitions)
        posted = stash(mapped(self.docs, _post(self.levels, n_buckets, self.clashes), POSTED), "posted")
        inside = posted.where("a IS NOT NULL").select("a", "b")
        buckets = posted.where("bucket IS NOT NULL").select("bucket", "whole", "data").repartition(partitions, "bucket").sortWithinPartitions("bucket")
        met = stash(mapped(buckets, _meet, MET), "met")
        left, right = (self.hists.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("hist").alias(f"hist_{x}")) for x in "ab")
        across = met.where("a IS NOT NULL").select("a", "b").distinct().join(left, "a").join(right, "b")
        across = across.where(may_be_similar(F.col("hist_a"), F.col("hist_b"), F.col("n_a") + F.col("n_b"))).select("a", "b")
        tried = stash(across, "pairs")
        first = stash(inside.union(self._verified(tried)), "links")
        unstash(posted)
        known = stash(connected_components(first), "components")
        postings = met.where("token IS NOT NULL").select("token", "sig", "n", "pos").distinct()
        placed = postings.join(known.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        placed = stash(placed, "placed")
        mixed = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("token")
        several = stash(placed.join(mixed, "token").join(self.hists.select("sig", "hist"), "sig"), "mixed")
        counts = several.groupBy("token", "component").agg(F.count("*").alias("k"))
        largest = counts.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
        # a token's postings meet by length class, so a frequent token is as many keys as there are lengths
        size = F.floor(F.log("n") / CLASS_STEP + 1e-9).cast("int")
        x = several.join(spread(largest, "token"), "token").where(F.col("component") != F.col("largest")).withColumn("size", size).alias("x")
        y = several.withColumn("size", F.explode(F.array(size - 1, size, size + 1))).alias("y")
        room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        total = F.col("x.n") + F.col("y.n")
        fit = (
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.size") == F.col("y.size"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("x.largest")) | (F.col("x.sig") < F.col("y.sig")))
            & (100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n"))
            & ((100 + PERCENT) * room >= PERCENT * total)
            & may_be_similar(F.col("x.hist"), F.col("y.hist"), total)
        )
        found = x.join(y, fit).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
        again = stash(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        later = self._verified(again)
        unstash(tried, again)
        # the later links join whole components: only these are looked at again
        of = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
        ends = later.join(of("a"), "a", "left").join(of("b"), "b", "left")
        joined = stash(connected_components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))), "joined")
        moved = known.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
        moved = moved.select("id", F.coalesce("now", "component").alias("component"))
        return moved.union(joined).groupBy("id").agg(F.min("component").alias("component"))

    def labelled(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, row, kept), a row for each document.

        ``row`` is the row's key of doc_id and text; ``kept`` marks the rows of the group's least id, of several its
        least row key.
        """
        classes = stash(self.components(), "classes")
        known = self.scanned.where("sig IS NOT NULL").join(classes.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        known = stash(known.select("doc_id", "row", "n", "component"), "known")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        least = known.groupBy("component").agg(first)
        some = known.join(spread(least, "component"), "component")
        kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
        some = some.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "row", kept.alias("kept"))
        none = self.scanned.where("sig IS NULL")
        return some.union(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row", F.lit(True).alias("kept")))
