"""Boxes on pages: groups, unions, clips, matches. Pages hold few boxes, so ordered steps run a page at a time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.relational import met
from folioforge.session import written


def touching(rects: DataFrame, margin: float = 20) -> DataFrame:
    """(doc_id, page_no, a, b): pairs of boxes of a page of which the first, grown by a margin, meets the second."""
    x, y = rects.alias("x"), rects.alias("y")
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page_no") == F.col("y.page_no")) & (F.col("x.rect_no") < F.col("y.rect_no"))
    meet = (F.col("x.x0") - margin < F.col("y.x1")) & (F.col("y.x0") < F.col("x.x1") + margin) & (F.col("x.y0") - margin < F.col("y.y1")) & (F.col("y.y0") < F.col("x.y1") + margin)
    return x.join(y, same & meet).select(F.col("x.doc_id").alias("doc_id"), F.col("x.page_no").alias("page_no"), F.col("x.rect_no").alias("a"), F.col("y.rect_no").alias("b"))


def _joined(boxes: list[tuple], margin: float) -> list[int]:
    """The number of each box's connected group, by first box."""
    label = list(range(len(boxes)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i, (ax0, ay0, ax1, ay1) in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            bx0, by0, bx1, by1 = boxes[j]
            if ax0 - margin < bx1 and bx0 < ax1 + margin and ay0 - margin < by1 and by0 < ay1 + margin:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(len(boxes))]
    order = {r: n + 1 for n, r in enumerate(dict.fromkeys(roots))}
    return [order[r] for r in roots]


def group_boxes(rects: DataFrame, margin: float = 20) -> DataFrame:
    """``rects`` with group_no: connected boxes of a page, numbered by their first box.

    Pages come sorted inside partitions and are taken one after the other, without a call for each page.
    """
    columns = ["doc_id", "page_no", "rect_no", "x0", "y0", "x1", "y1"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> list[tuple]:
            return [(*r[:3], g) for r, g in zip(rows, _joined([r[3:] for r in rows], margin))]

        for frame in frames:
            out: list[tuple] = []
            for row in frame[columns].itertuples(index=False, name=None):
                if held and held[0][:2] != row[:2]:
                    out += done(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "rect_no", "group_no"])
        yield pd.DataFrame(done(held), columns=["doc_id", "page_no", "rect_no", "group_no"])

    pages = rects.select(*columns).repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "rect_no")
    numbers = pages.mapInPandas(run, "doc_id long, page_no int, rect_no int, group_no int")
    return rects.join(numbers, ["doc_id", "page_no", "rect_no"])


def union_boxes(grouped: DataFrame, by: list[str]) -> DataFrame:
    return grouped.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def clipped(boxes: DataFrame, width: Column, height: Column, pad: float = 8) -> DataFrame:
    """Boxes grown by a pad inside the page."""
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0.0))
    return boxes.withColumns({"x0": low("x0"), "y0": low("y0"), "x1": F.least(F.col("x1") + pad, width), "y1": F.least(F.col("y1") + pad, height)})


def quality(width: Column, height: Column) -> Column:
    small = F.least(width, height)
    return F.when(small < 200, "low").when(small < 400, "medium").otherwise("high")


def distance(a: list[Column], b: list[Column]) -> Column:
    dx = F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[2], b[2]))
    dy = F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))
    return F.sqrt(dx * dx + dy * dy)


def image_boxes(rects: DataFrame, least: float, sizes: dict[str, float]) -> DataFrame:
    """(doc_id, page_no, rect_no) of images at least so wide and high, and whether they reach each of the named sizes."""
    small = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rects.where(small >= least).select("doc_id", "page_no", "rect_no", *((small >= size).alias(name) for name, size in sizes.items()))


def covers_page(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    return (width >= 0.95 * page_width) & (height >= 0.95 * page_height)


def absolute(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Relative boxes in whole pixels inside the image; empty ones go."""
    at = lambda c, size: F.least(F.greatest((F.col(c) * size).cast("int"), F.lit(0)), size.cast("int"))
    return boxes.withColumns({"x0": at("x0", width), "y0": at("y0", height), "x1": at("x1", width), "y1": at("y1", height)}).where("x1 > x0 AND y1 > y0")


#: Side of the cells of the grid over a page, in the units of the boxes.
CELL = 256.0
PAGE = ["doc_id", "page_no"]


def near_pairs(rects: DataFrame, reach: float, cell: float = CELL) -> DataFrame:
    """(doc_id, page_no, a, b): pairs of boxes of a page, a < b by ``place``, that are less than ``reach`` apart.

    A box lies in every cell that it touches, grown by half of the reach; boxes meet by page and cell, and a pair counts
    in the first cell that both touch. A page with very many boxes is as many keys as it has cells.
    """
    at = lambda c, by: F.floor((F.col(c) + by) / cell).cast("int")
    grown = rects.select(*PAGE, "place", "x0", "y0", "x1", "y1", at("x0", -reach / 2).alias("i0"), at("x1", reach / 2).alias("i1"), at("y0", -reach / 2).alias("j0"), at("y1", reach / 2).alias("j1"))
    cells = grown.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    x, y = cells.alias("x"), cells.alias("y")
    col = lambda t, c: F.col(f"{t}.{c}")
    same = [col("x", c) == col("y", c) for c in (*PAGE, "i", "j")]
    first = (F.col("x.i") == F.greatest("x.i0", "y.i0")) & (F.col("x.j") == F.greatest("x.j0", "y.j0"))
    close = distance([col("x", c) for c in ("x0", "y0", "x1", "y1")], [col("y", c) for c in ("x0", "y0", "x1", "y1")]) < reach
    meet = F.col("x.place") < F.col("y.place")
    for s in same:
        meet = meet & s
    return x.join(y, meet & first & close).select(*(col("x", c).alias(c) for c in PAGE), F.col("x.place").alias("a"), F.col("y.place").alias("b"))


def leader_clusters(rects: DataFrame, reach: float = 50) -> DataFrame:
    """(doc_id, page_no, rect_no, group_no): boxes by their tops, then left sides; one that is near no leader is a leader
    itself, others belong to the first leader that they are near.

    Leaders are found in rounds over the pairs of near boxes: whoever waits for no earlier box is decided. There are as
    many rounds as boxes in the longest chain, and a page is never one task's work.
    """
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "rect_no")
    placed = written(rects.select(*PAGE, "rect_no", "x0", "y0", "x1", "y1").withColumn("place", F.row_number().over(order)), "boxes")
    pairs = written(near_pairs(placed, reach), "near")
    status = placed.select(*PAGE, "place", F.lit(0).alias("status"))  # 0 waits, 1 leads, 2 follows
    while True:
        earlier = pairs.join(status.withColumnsRenamed({"place": "a", "status": "of_a"}), [*PAGE, "a"]).groupBy(*PAGE, F.col("b").alias("place")).agg(F.max((F.col("of_a") == 1).cast("int")).alias("led"), F.max((F.col("of_a") == 0).cast("int")).alias("waits"))
        decided = F.when(F.col("status") > 0, F.col("status")).when(F.col("led") == 1, 2).when(F.col("waits") == 1, 0).otherwise(1)
        status = written(status.join(earlier, [*PAGE, "place"], "left").select(*PAGE, "place", decided.alias("status")), "leaders")
        if not status.where("status = 0").take(1):
            break
    leaders = status.where("status = 1").select(*PAGE, "place")
    joined = pairs.join(leaders.withColumnRenamed("place", "a"), [*PAGE, "a"]).join(status.where("status = 2").withColumnRenamed("place", "b"), [*PAGE, "b"])
    follows = joined.groupBy(*PAGE, F.col("b").alias("place")).agg(F.min("a").alias("leader"))
    both = follows.unionByName(leaders.withColumn("leader", F.col("place")))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("leader"))
    return placed.select(*PAGE, "rect_no", "place").join(both, [*PAGE, "place"]).select(*PAGE, "rect_no", number.alias("group_no"))


def large_regions(rects: DataFrame, pages: DataFrame, least: float = 150, reach: float = 50, pad: float = 10, zoom: float = 2, least_pixels: int = 200) -> DataFrame:
    """(doc_id, page_no, figure_id, x0, y0, x1, y1): where figures are, of pages without captions to go by.

    Images at least ``least`` wide and high are grouped around leaders; a group's box is padded inside its page (pages:
    doc_id, page_no, width, height) and counts if it is drawn large enough. Figures are numbered by page and group.
    """
    large = rects.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    groups = union_boxes(large.join(leader_clusters(large, reach), [*PAGE, "rect_no"]), [*PAGE, "group_no"])
    shown = clipped(groups.join(pages, PAGE), F.col("width"), F.col("height"), pad)
    drawn = shown.where((F.floor((F.col("x1") - F.col("x0")) * zoom) >= least_pixels) & (F.floor((F.col("y1") - F.col("y0")) * zoom) >= least_pixels))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "group_no"))
    return drawn.select(*PAGE, F.concat(F.lit("figure_"), number.cast("string")).alias("figure_id"), "x0", "y0", "x1", "y1")


def merge_in_order(boxes: Column, gap: float = 30) -> Column:
    """Boxes in reading order, each merged into the running union while it lies within the gap: a fold in the JVM."""
    ordered = F.sort_array(F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"))))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        near = (b["y0"] - last["y1"] <= gap) & (b["x0"] - last["x1"] <= gap) & (last["x0"] - b["x1"] <= gap)
        merged = F.struct(F.least(last["y0"], b["y0"]).alias("y0"), F.least(last["x0"], b["x0"]).alias("x0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when((F.size(done) > 0) & near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.array_append(done, b))

    return F.aggregate(ordered, F.array().cast("array<struct<y0:double,x0:double,x1:double,y1:double>>"), step)


def _nearest(tops: list[float | None], boxes: list[tuple[float, int]]) -> list[int | None]:
    """For each top in turn the place of the free box that ends nearest above it, or at most 50 below; boxes by (end, number).

    A box that is taken points to the next one on either side, so a page costs about as much as sorting it.
    """
    ends = [end for end, _ in boxes]
    before, after = list(range(len(boxes) + 1)), list(range(len(boxes) + 1))  # before[i + 1] and after[i] are box i's

    def free(jumps: list[int], i: int) -> int:
        while jumps[i] != i:
            jumps[i] = jumps[jumps[i]]
            i = jumps[i]
        return i

    found: list[int | None] = []
    for top in tops:
        fit: list[tuple[float, int, int]] = []
        if top is not None and top == top:
            i = free(before, bisect_right(ends, top)) - 1
            while i >= 0 and (not fit or abs(top - ends[i]) == fit[0][0]):  # another end may be as far by rounding
                i = free(after, bisect_left(ends, ends[i]))
                fit.append((abs(top - ends[i]), boxes[i][1], i))
                i = free(before, i) - 1
            i, near = free(after, bisect_right(ends, top)), None
            while i < len(ends) and ends[i] <= top + 50 and near in (None, abs(top - ends[i])):
                near = abs(top - ends[i])
                fit.append((near, boxes[i][1], i))
                i = free(after, bisect_right(ends, ends[i]))
        place = min(fit)[2] if fit else None
        if place is not None:
            before[place + 1], after[place] = place, place + 1
        found.append(place)
    return found


def _figures(boxes: list[tuple], heads: list[tuple]) -> list[tuple]:
    """Boxes and captions of a page (page, caption_no, rect_no, x0, y0, x1, y1), each alone or, as a box of a caption, matched."""
    whole = None not in (boxes or heads)[0][:2]  # rows without a document or page have nothing in common
    fit = [b for b in boxes if b[7] is not None and b[7] == b[7]] if whole else []
    places = _nearest([h[5] for h in heads], [(b[7], b[3]) for b in fit])
    taken = {fit[i][3] for i in places if i is not None}
    rows = [(*(h if i is None else fit[i]), h[2], "above" if i is None else "matched") for h, i in zip(heads, places)]
    rows += [(*b, None, "alone") for b in boxes if not whole or b[3] not in taken]
    return [(*r[:2], r[8], *r[3:8], r[9]) for r in rows]


def paired_above(captions: DataFrame, rects: DataFrame) -> DataFrame:
    """Captions and boxes once each: in caption order the free box that ends nearest above (or 50 below) its top.

    kind is ``matched`` (the box, with its caption), ``above`` (a caption without one) or ``alone`` (a box without one).
    """
    corners = ["x0", "y0", "x1", "y1"]
    schema = "doc_id long, page_no int, caption_no int, rect_no int, x0 double, y0 double, x1 double, y1 double, kind string"
    heads = captions.select(*PAGE, "caption_no", *(F.col(c).cast("double").alias(c) for c in corners[:3]))
    boxes = rects.select(*PAGE, "rect_no", *(F.col(c).cast("double").alias(c) for c in corners))
    return met(boxes, heads, PAGE, ["caption_no", "y1", "rect_no"], [*PAGE, "caption_no", "rect_no", *corners], _figures, schema)


def match_above(captions: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page_no, caption_no, rect_no) of ``paired_above`` where a caption has a box."""
    return paired_above(captions, rects).where("kind = 'matched'").select(*PAGE, "caption_no", "rect_no")


def figure_regions(captions: DataFrame, rects: DataFrame) -> DataFrame:
    """Regions of figures: matched boxes, a strip above captions without one, and large boxes without a caption."""
    above = F.col("kind") == "above"
    tall = F.least(F.greatest(F.col("y0") * 0.4, F.lit(100.0)), F.lit(300.0))
    strip = {"x0": F.col("x0") - 30, "y0": F.greatest(F.col("y0") - tall, F.lit(0.0)), "x1": F.col("x1") + 30, "y1": F.col("y0")}
    shown = paired_above(captions, rects).where("kind <> 'alone' OR (x1 - x0 > 200 AND y1 - y0 > 200)")
    return shown.select(*PAGE, "caption_no", "kind", *(F.when(above, c).otherwise(F.col(name)).alias(name) for name, c in strip.items()))
