"""Cell grids: spans of HTML tables, bars in texts, numbers through the corpus."""

from folioforge.operators.grids import page_grids, spread_cells, text_grids


def test_spans():
    table = "<tr><th rowspan=2>A</th><th colspan='2'>B &amp; C</th></tr><tr><td>b<td> c <b>d</b></tr><tr><td>1</td></tr>"
    assert spread_cells(table) == [["A", "B & C", None], [None, "b", "c d"], ["1", None, None]]
    assert spread_cells("<tr><td>x</td><td rowspan=3>y</td></tr><tr></tr><tr><td>z</td></tr>") == [["x", "y"], [None, None], ["z", None]]
    assert spread_cells("<tr></tr>") == spread_cells("") == []


def test_pages(spark):
    one = "<TABLE class=a><tr><td>{}</td></tr></TABLE>"
    rows = [(i, one.format(i) * (i % 3) + "<p>rest</p>") for i in range(30)] + [(50, None), (51, "")]
    got = page_grids(spark.createDataFrame(rows, "page_id long, html string")).collect()
    want = [(i, n) for i in range(30) for n in range(i % 3)]
    assert sorted((r.page_id, r.table_no, r.table_id, r.grid) for r in got) == [(i, n, f"table_{k + 1}", [[str(i)]]) for k, (i, n) in enumerate(want)]


def test_bars(spark):
    text = "intro\n| a | b |\n|---|:-:|\n| 1 | |\n| 2 | x | y |\nmiddle | alone\n\nc|d\ne|f\n"
    got = text_grids(spark.createDataFrame([(2, text), (1, "p | q\nr | s"), (3, None), (4, "|\n|")], "doc_id long, text string")).collect()
    assert sorted((r.table_id, r.doc_id, r.first_line, r.grid) for r in got) == [
        ("table_1", 1, 0, [["p", "q"], ["r", "s"]]),
        ("table_2", 2, 1, [["a", "b", None], ["1", "", None], ["2", "x", "y"], ["middle", "alone", None]]),
        ("table_3", 2, 7, [["c", "d"], ["e", "f"]]),
    ]
