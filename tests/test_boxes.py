"""Boxes by the grid against all pairs, leaders against the loop they stand for, figures of large images."""

import math
import random
import time

from folioforge.operators import geometry

COLUMNS = "doc_id long, page_no int, rect_no int, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(-300, 900), rng.randrange(0, 600, 50)]), rng.uniform(-300, 900)
        rows.append((rng.randrange(3), rng.randrange(1, 3), i, float(x), y, x + rng.choice([0.0, 20.0, 90.0, 700.0]), y + rng.choice([0.0, 10.0, 300.0])))
    return rows


def apart(a, b):
    return math.hypot(max(0, max(a[3], b[3]) - min(a[5], b[5])), max(0, max(a[4], b[4]) - min(a[6], b[6])))


def test_near_pairs(spark):
    rows = boxes(1, 120)
    df = spark.createDataFrame(rows, COLUMNS).withColumnRenamed("rect_no", "place")
    for reach, cell in ((50, 256.0), (50, 40.0), (120, 64.0)):
        got = [tuple(r)[2:] for r in geometry.near_pairs(df, reach, cell).collect()]
        want = [(a[2], b[2]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[:2] == b[:2] and apart(a, b) < reach]
        assert sorted(got) == sorted(want)


def test_leaders(spark):
    rows = boxes(2, 150) + [(9, 1, 200 + i, 45.0 * i, 0.0, 45.0 * i, 0.0) for i in range(12)]  # a chain on one page
    got = {(r.doc_id, r.page_no, r.rect_no): r.group_no for r in geometry.leader_clusters(spark.createDataFrame(rows, COLUMNS)).collect()}
    want = {}
    for page in {r[:2] for r in rows}:
        leaders = []
        for r in sorted((r for r in rows if r[:2] == page), key=lambda r: (r[4], r[3], r[2])):
            near = next((i for i, x in enumerate(leaders) if apart(x, r) < 50), len(leaders))
            if near == len(leaders):
                leaders.append(r)
            want[r[:3]] = near + 1
    assert got == want
    assert geometry.leader_clusters(spark.createDataFrame([], COLUMNS)).count() == 0


def test_large_regions(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 160.0, 150.0), (1, 1, 2, 200.0, 0.0, 400.0, 300.0), (1, 1, 3, 0.0, 0.0, 149.0, 500.0), (1, 2, 4, 450.0, 600.0, 620.0, 800.0), (1, 2, 5, 0.0, 700.0, 150.0, 850.0)]
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 2, 612.0, 792.0)], "doc_id long, page_no int, width double, height double")
    got = sorted(tuple(r)[1:] for r in geometry.large_regions(spark.createDataFrame(rows, COLUMNS), pages).collect())
    assert got == [(1, "figure_1", 0.0, 0.0, 410.0, 310.0), (2, "figure_2", 440.0, 590.0, 612.0, 792.0), (2, "figure_3", 0.0, 690.0, 160.0, 792.0)]


def paired(rows, heads):
    """The loop that ``paired_above`` stands for."""
    out = []
    for page in {r[:2] for r in rows} | {h[:2] for h in heads}:
        free = {r[2]: r for r in rows if r[:2] == page}
        for h in sorted((h for h in heads if h[:2] == page), key=lambda h: h[2]):
            fit = [(abs(h[4] - r[6]), n) for n, r in free.items() if r[6] <= h[4] + 50]
            n = min(fit)[1] if fit else None
            out.append((*page, h[2], n, "matched" if fit else "above"))
            free.pop(n, None)
        out += [(*page, None, n, "alone") for n in free]
    return out


def test_boxes_above_captions(spark):
    rng = random.Random(4)
    rows = [(d, p, n, x0, y0, x1, rng.choice([y1, 100.0, 150.0])) for d, p, n, x0, y0, x1, y1 in boxes(3, 200)]
    heads = [(rng.randrange(4), 1, i, 0.0, rng.choice([rng.uniform(-400, 900), 125.0, 60.0]), 9.0) for i in range(150)]
    captions = spark.createDataFrame(heads, "doc_id long, page_no int, caption_no int, x0 double, y0 double, x1 double")
    got = geometry.paired_above(captions, spark.createDataFrame(rows, COLUMNS)).select("doc_id", "page_no", "caption_no", "rect_no", "kind").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, paired(rows, heads)))


def test_a_long_page_of_captions_is_not_quadratic():
    n = 200_000
    tops = [float(i % 1000) for i in range(n)]
    assert sorted(geometry._nearest(tops, sorted((float(i % 1000), i) for i in range(n)))) == list(range(n))


def test_figures_of_many_pages_in_little_time(spark):
    n = 40_000  # pages; a call for each page took 2 ms of a core
    rows = spark.range(n).selectExpr("id AS doc_id", "1 AS page_no", "CAST(id AS INT) AS rect_no", "0D AS x0", "0D AS y0", "300D AS x1", "250D AS y1")
    heads = spark.range(0, n, 2).selectExpr("id AS doc_id", "1 AS page_no", "7 AS caption_no", "0D AS x0", "if(id % 4 = 0, 260D, 100D) AS y0", "50D AS x1")
    began = time.monotonic()
    counts = {r.kind: r["count"] for r in geometry.figure_regions(heads, rows).groupBy("kind").count().collect()}
    assert counts == {"matched": n // 4, "above": n // 4, "alone": n * 3 // 4}
    assert time.monotonic() - began < 15
