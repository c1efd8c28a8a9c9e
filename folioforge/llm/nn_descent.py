"""Near-duplicate vectors by NN-descent.

1. Equal vectors collapse to one with a weight.
2. Seeds: for each of some sets of random hyperplanes the vectors are sorted by their sign bits and compared
   inside short runs of that order; a vector keeps its best neighbours. The number of sets grows with the table, so
   that a pair at the threshold shares a run in one of them; TABLES sets are made at a time.
3. Descent: every vector lists its neighbours and those it is a neighbour of; all pairs of a list are compared
   (neighbours of neighbours), and what beats a vector's worst neighbour replaces it. A list that is saturated, that
   is, holds links only, is enlarged: it takes in further links up to ENLARGED neighbours. Rounds end when nearly all links
   of sampled vectors, which an audit compares with all vectors, are in the lists, and in the end in the counts.
   The sample grows until LINKED of its vectors have a link, or has QUERIES vectors or all. A round that is not the
   last adds TABLES new sets of seeds; if MOST_ROUNDS are not enough, all vectors are compared in blocks (as in 5).
4. Edges of at least the threshold are checked in double precision and make components.
5. An enlarged list that is saturated again may miss links, also to other components, whose lists are then
   saturated too. The components with such a vector are cut into blocks, each with a centre and a radius; two blocks
   are compared, whatever their components, unless centres and radii rule out a link. Blocks give counts and the
   components they connect, never rows of pairs.

Reverse lists are thinned to LIST slots by hash (a hub's list is never gathered): that bounds a round's work and
not the result, which the audit measures.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components, and those without a vec_id, link with nothing; rows that repeat a vec_id are separate vectors (inside,
vectors have numbers of their own) that share an id; of equally near neighbours those of least number are kept;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import connected_components, spread, stash, unstash

THRESHOLD = 0.95
#: Neighbours kept, slots of a reverse list; neighbours of a list that is enlarged because it holds links only.
LIST, ENLARGED = 12, 48
TABLES, PLANES, RUN = 6, 32, 256
LEAST_ROUNDS, MOST_ROUNDS = 1, 6
#: The audit's first sample, what each further step adds, the linked vectors it is to hold, its most vectors; the recall that ends the rounds.
AUDITED, STEP, LINKED, QUERIES, ENOUGH = 400, 4000, 200, 16_400, 0.98
#: Share of pairs at the threshold that may share no run in any set of seeds.
MISSED = 0.001
#: Vectors of a block of an enlarged list, blocks of a tile in which their centres are compared.
BLOCK, TILE = 2048, 2048
SLACK = 1e-4
#: Angle of a link, rounding included.
REACH = float(np.arccos(THRESHOLD)) + 1e-6


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, scaled to length one in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(v: str, dim: int):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def seed_tables(n: int) -> int:
    """Sets of seeds for n vectors: runs share about log2(n / RUN) sign bits, of which each is equal in a pair at the threshold by its angle."""
    shared = min(PLANES, max(0.0, np.log2(max(n, 1) / RUN)))
    p = (1 - np.arccos(THRESHOLD) / np.pi) ** shared
    return TABLES if p >= 1 else max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-p))))


def _codes(dim: int, batch_no: int = 0):
    """Sign bits in TABLES sets of hyperplanes, others for each ``batch_no``."""
    planes = np.random.default_rng(20 + batch_no).standard_normal((TABLES, dim, PLANES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), dim)
                for t in range(TABLES):
                    bits = (x @ planes[t] > 0) @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(bits), batch.column("id"), batch.column("v")], ["t", "code", "id", "v"])

    return run


def _best(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim) of each row's LIST best columns, and of links up to ENLARGED."""
    np.fill_diagonal(sims, -2)
    k = min(ENLARGED, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(sims, top, 1)
    least = np.partition(near, max(0, k - LIST), axis=1)[:, max(0, k - LIST)]  # of the LIST best
    u, place = np.nonzero((near >= least[:, None]) | (near >= THRESHOLD))
    v = top[u, place]
    return ids[u], ids[v], sims[u, v]


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float64))], ["u", "v", "sim"])


def _seed(dim: int):
    """Compare inside runs of the sorted order; runs meet in half of their length."""

    def pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        return _edges(*_best(ids, x @ x.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, halves = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, ids, x = batch.column("t").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"), dim)
            cuts = np.flatnonzero(np.diff(tables)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(tables)]):
                if tables[a] != at:
                    at, halves = tables[a], []
                for i in range(a, b, RUN // 2):
                    halves = [*halves[-1:], (ids[i : min(b, i + RUN // 2)], x[i : min(b, i + RUN // 2)])]
                    if sum(len(h[0]) for h in halves) > 1:
                        yield pairs(halves)

    return run


def best(edges: DataFrame) -> DataFrame:
    """The LIST best neighbours of each vector; if these are links, further links up to ENLARGED."""
    place = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    one = edges.where("u != v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.withColumn("place", F.row_number().over(place)).where(F.col("place") <= ENLARGED).where((F.col("place") <= LIST) | (F.col("sim") >= THRESHOLD)).drop("place")


def _local_join(dim: int):
    """All pairs of each list; those that beat the worst neighbour of one of their ends. Rows come sorted by list."""

    def joined(w: np.ndarray, ids: np.ndarray, worst: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        size = np.diff(np.append(begin, len(w)))
        for n in np.unique(size):
            if n < 2:
                continue
            some = begin[size == n]
            step = max(1, 200_000 // (n * n))
            for a in range(0, len(some), step):
                rows = some[a : a + step, None] + np.arange(n)
                y = x[rows]
                sims = y @ y.transpose(0, 2, 1)
                i, j = np.triu_indices(n, 1)
                s = sims[:, i, j].ravel()
                left, right = rows[:, i].ravel(), rows[:, j].ravel()
                for p, q in ((left, right), (right, left)):
                    keep = (s > worst[p]) & (ids[p] != ids[q])
                    if keep.any():
                        yield _edges(ids[p[keep]], ids[q[keep]], s[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append((batch.column("w").to_numpy(), batch.column("id").to_numpy(), batch.column("worst").to_numpy(), matrix(batch.column("v"), dim)))
            w, ids, worst, x = (np.concatenate(c) for c in zip(*rest))
            whole = np.searchsorted(w == w[-1], True)  # the last list may go on in the next batch
            yield from joined(w[:whole], ids[:whole], worst[:whole], x[:whole])
            rest = [(w[whole:], ids[whole:], worst[whole:], x[whole:])]
        if rest:
            yield from joined(*rest[0])

    return run


def refine(graph: DataFrame, vectors: DataFrame, dim: int, n_parts: int) -> DataFrame:
    """One round of neighbours of neighbours."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("id"), F.when(F.col("n") < LIST, -1.0).when(F.col("n") < ENLARGED, F.least("worst", F.lit(THRESHOLD - SLACK))).otherwise(F.col("worst")).alias("worst"))
    slot = F.pmod(F.xxhash64("u", "v"), F.lit(LIST))
    back = graph.groupBy(F.col("v").alias("w"), slot.alias("slot")).agg(F.max_by("u", F.struct("sim", "u")).alias("id")).select("w", "id")
    lists = graph.select(F.col("u").alias("w"), F.col("v").alias("id")).union(back).distinct()
    full = lists.join(vectors.select("id", "v").join(worst, "id"), "id").select("w", "id", "worst", "v")
    found = full.repartition(n_parts, "w").sortWithinPartitions("w").mapInArrow(_local_join(dim), "u long, v long, sim double")
    return best(graph.union(found))


def _audit(ids: np.ndarray, sample: np.ndarray, dim: int):
    """(u, n, links): number and weight of the links that each sampled vector has in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, links = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                other, weight = some.column("id").to_numpy(), some.column("weight").to_numpy()
                i, j = np.nonzero(sample @ matrix(some.column("v"), dim).T >= THRESHOLD)
                i, j = i[ids[i] != other[j]], j[ids[i] != other[j]]
                n += np.bincount(i, minlength=len(ids))
                links += np.bincount(i, weights=weight[j], minlength=len(ids)).astype(np.int64)
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(links[some])], ["u", "n", "links"])

    return run


def linked_sample(vectors: DataFrame, dim: int) -> DataFrame:
    """(u, n, links) of the sampled vectors that have links, all their links against all vectors: vectors with the least hashes."""
    spark, n_all, seen, size, found = vectors.sparkSession, vectors.count(), 0, AUDITED, []
    while seen < min(n_all, QUERIES) and len(found) < LINKED:
        rows = vectors.orderBy(F.xxhash64("id"), "id", "v").offset(seen).limit(size).select("id", F.col("v").cast("array<double>").alias("v")).toArrow().combine_chunks()
        if not rows.num_rows:
            break
        ids, sample = rows.column("id").to_numpy().astype(np.int64), matrix(rows.column("v").combine_chunks(), dim)
        true = vectors.select("id", "weight", "v").mapInArrow(_audit(ids, sample, dim), "u long, n long, links long")
        found += [tuple(r) for r in true.groupBy("u").agg(F.sum("n").alias("n"), F.sum("links").alias("links")).collect()]
        seen, size = seen + rows.num_rows, STEP
    return spark.createDataFrame(found, "u long, n long, links long")


def audit(graph: DataFrame, sample: DataFrame) -> float:
    """Recall of the ENLARGED best links of the sampled vectors: links held are links, so numbers tell which are missing."""
    held = graph.where(F.col("sim") >= THRESHOLD).join(F.broadcast(sample.select("u")), "u", "left_semi").groupBy("u").agg(F.count("*").alias("got"))
    least = sample.select("u", F.least("n", F.lit(ENLARGED)).alias("n"))
    total = least.join(held, "u", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("got", F.lit(0))))).first()
    return total[1] / total[0] if total[0] else 1.0


def audit_counts(named: DataFrame, sample: DataFrame) -> float:
    """Share of their links that the sampled vectors have in the counts, on average over vectors."""
    share = sample.join(named.select(F.col("id").alias("u"), F.col("counted").alias("got")), "u", "left")
    mean = share.agg(F.avg(F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("links")))).first()[0]
    return 1.0 if mean is None else mean


def _check(dim: int):
    """Exact cosines of edges, those below the threshold left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = (matrix(batch.column("x"), dim) * matrix(batch.column("y"), dim)).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(s >= THRESHOLD))

    return run


def _balls(dim: int):
    """(x, centre, radius) of a block: all its vectors are within the radius, an angle, of the centre."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v = matrix(table.column("v").combine_chunks(), dim)
        centre = v.sum(0)
        length = np.sqrt(centre @ centre)
        centre = centre / length if length > 1e-6 else v[0]
        radius = np.arccos(np.clip((v @ centre).min(), -1, 1))
        return pa.table({"x": [key[0].as_py()], "v": [centre.tolist()], "radius": [float(radius)]})

    return run


def _facing_balls(dim: int):
    """Pairs of blocks of two tiles, or of one with itself, that may hold a link: triangle inequality of angles."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        x, radius, tile = (table.column(c).to_numpy() for c in ("x", "radius", "tile"))
        centre = matrix(table.column("v").combine_chunks(), dim)
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        near = np.arccos(np.clip(centre[a] @ centre[b].T, -1, 1)) <= radius[a][:, None] + radius[b] + REACH
        p, q = np.nonzero(np.triu(near) if i == j else near)
        return pa.table({"x": x[a[p]], "y": x[b[q]]})

    return run


def _count_block(dim: int):
    """Of two blocks, or of one with itself: (id, links) with the weighted links of each vector, (id, other) with components that a link connects."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        ids, weights, parts, at = (table.column(c).to_numpy() for c in ("id", "weight", "component", "x"))
        v = matrix(table.column("v").combine_chunks(), dim)
        a, b = np.flatnonzero(at == x), np.flatnonzero(at == y)
        hit = v[a] @ v[b].T >= THRESHOLD
        if x == y:
            np.fill_diagonal(hit, False)
            out, links = ids[a], hit @ weights[b]
        else:
            out, links = np.concatenate((ids[a], ids[b])), np.concatenate((hit @ weights[b], hit.T @ weights[a]))
        p, q = np.nonzero(hit & (parts[a][:, None] != parts[b]))
        met = np.unique(np.stack((parts[a[p]], parts[b[q]])), axis=1)
        n, m = len(out), met.shape[1]
        return pa.table({"id": np.concatenate((out, met[0])), "links": np.concatenate((links, np.zeros(m))).astype(np.int64), "other": pa.array([None] * n + met[1].tolist(), pa.int64())})

    return run


def enlarged(parts: DataFrame, degree: DataFrame, vectors: DataFrame, dim: int, every: bool = False) -> DataFrame:
    """(id, links, other) as of ``_count_block``, of all vectors in components with a saturated list, or of ``every`` vector."""
    columns = ["component", "id", "v", "weight", "x"]
    if every:
        blocks = -(-vectors.count() // BLOCK)
        whole = vectors.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        held = stash(whole.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))).select(*columns), "enlarged")
    else:
        full = parts.join(degree.where(F.col("n") >= ENLARGED), "id").select("component").distinct()
        sizes = parts.join(full, "component").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        block = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("blocks")))
        held = stash(parts.join(sizes, "component").withColumn("x", block).join(vectors, "id").select(*columns), "enlarged")
    balls = stash(held.select("x", "v").groupBy("x").applyInArrow(_balls(dim), "x long, v array<double>, radius double"), "balls")
    tiles = max(1, -(-balls.count() // TILE))
    facing = balls.withColumn("tile", F.pmod(F.xxhash64("x"), F.lit(tiles)).cast("int")).withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    facing = facing.withColumn("i", F.least("tile", "face")).withColumn("j", F.greatest("tile", "face"))
    pairs = stash(facing.groupBy("i", "j").applyInArrow(_facing_balls(dim), "x long, y long"), "pairs")
    sides = pairs.select(F.col("x").alias("p"), F.col("y").alias("q"), F.explode(F.array_distinct(F.array("x", "y"))).alias("x"))
    return stash(sides.join(held, "x").groupBy("p", "q").applyInArrow(_count_block(dim), "id long, links long, other long"), "counted")


def seeds(vectors: DataFrame, dim: int, n_parts: int, batch_no: int) -> DataFrame:
    """Edges of TABLES sets of seeds."""
    coded = vectors.select("id", "v").mapInArrow(_codes(dim, batch_no), vectors.select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("code"), "id", "v").schema)
    order = ["t", "code", F.xxhash64("id")]
    return coded.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(_seed(dim), "u long, v long, sim double")


def _replaced(graph: DataFrame | None, edges: DataFrame, whole: bool = False) -> DataFrame:
    """The written graph with more edges, or the edges alone if they are the ``whole`` of it."""
    after = stash(edges if whole else best(edges if graph is None else graph.union(edges)), "graph")
    if graph is not None:
        unstash(graph)
    return after


def counted(graph: DataFrame, vectors: DataFrame, dim: int, every: bool = False) -> DataFrame:
    """(v, id, name, counted, n_links, component) of every vector; counted leaves its own copies out.

    With ``every`` all vectors are compared in blocks, whatever the graph holds.
    """
    near = graph.where(F.col("sim") >= THRESHOLD - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    x, y = (vectors.select(F.col("id").alias(i), F.col("v").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    links = stash(near.join(x, "a").join(y, "b").mapInArrow(_check(dim), "a long, b long"), "links")
    parts = stash(connected_components(links), "parts")
    both = links.union(links.select("b", "a"))
    weights = vectors.select(F.col("id").alias("b"), "weight")
    degree = both.join(weights, "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("links"), F.count("*").alias("n"))

    found = enlarged(parts, degree, vectors, dim, every)
    sums = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("all_links"))
    met = stash(connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "met")
    if every:  # a vector without links in the graph is a component of its own
        parts = vectors.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    parts = parts.join(met.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))

    named = vectors.select("v", "id", "name", "weight").join(degree.select("id", "links"), "id", "left").join(sums, "id", "left").join(parts, "id", "left")
    named = named.withColumn("counted", F.coalesce("all_links", "links", F.lit(0)))
    return stash(named.select("v", "id", "name", "counted", (F.col("counted") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "named")


def near_duplicates(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", log: list | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; ``log`` gets the recall that each round's audit measured."""
    spark = embeddings.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = embeddings.select(F.col(key).alias("member"), F.col(vector).alias("v"))
    lengths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = lambda df: df.select(F.col("member").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("member").alias("component_id"), F.lit(True).alias("kept"))
    if lengths is None:
        return nothing(rows)
    dim = lengths["d"]
    rows = rows.withColumn("good", valid("v", dim) & F.col("member").isNotNull())
    good = rows.where("good")
    distinct = good.groupBy("v").agg(F.min("member").alias("name"), F.count("*").alias("weight"))
    vectors = stash(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")  # numbers that the written table fixes

    sample = stash(linked_sample(vectors, dim), "sample")
    graph, first = None, -(-seed_tables(vectors.count()) // TABLES)
    for batch_no in range(first):
        graph = _replaced(graph, seeds(vectors, dim, n_parts, batch_no))
    for n in range(MOST_ROUNDS + 1):
        recall = audit(graph, sample)
        if log is not None:
            log.append(recall)
        if n >= LEAST_ROUNDS and recall >= ENOUGH:
            named = counted(graph, vectors, dim)
            recall = audit_counts(named, sample)
            if log is not None:
                log.append(recall)
            if recall >= ENOUGH:
                break
        if n == MOST_ROUNDS:  # the graph does not find them: all blocks are compared
            named = counted(graph, vectors, dim, every=True)
            if log is not None:
                log.append(audit_counts(named, sample))
            break
        if n >= LEAST_ROUNDS:
            graph = _replaced(graph, seeds(vectors, dim, n_parts, first + n))
        graph = _replaced(graph, refine(graph, vectors, dim, n_parts), whole=True)

    least = named.groupBy("component").agg(F.min("name").alias("component_id"))
    named = named.join(spread(least, "component"), "component").select("v", "n_links", "component_id")
    some = good.join(named, "v").select(F.col("member").alias(key), F.col("n_links").cast("long"), "component_id", (F.col("member") == F.col("component_id")).alias("kept"))
    unstash(graph)
    return some.unionByName(nothing(rows.where("NOT good")))
