"""Operators on small fixtures and by their properties."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import backend, classify, diagrams, json_tools, reports, sections, text
from folioforge.operators import captions, cost, geometry
from folioforge.operators import relational as rel
from folioforge.sources import files
from folioforge.streaming import run_state


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("model, n_in, n_out, want", [("gemini-3-flash-preview", 1_000_000, 1_000_000, 0.5), ("claude-sonnet-4-5-20250929", 1000, 500, 0.0105), ("unknown", 1000, 0, 0.0001), (None, None, None, 0.0)])
def test_call_cost(spark, model, n_in, n_out, want):
    assert one(spark, cost.call_cost(F.lit(model), F.lit(n_in).cast("long"), F.lit(n_out).cast("long"))) == want


@pytest.mark.parametrize("stored, want", [('["a","b"]', ["a", "b"]), ("a, b,,c", ["a", "b", "c"]), ("solo", ["solo"]), ("", []), (None, []), ('{"x":1}', ['{"x":1}'])])
def test_tags(spark, stored, want):
    assert one(spark, json_tools.parse_tags(F.lit(stored).cast("string"))) == want


@pytest.mark.parametrize("stored, want", [("  ", True), ('{"error":1}', True), ('{"_parse_error":"x"}', True), ('{"a":1}', False), ("not json", False), ("[1]", False)])
def test_error_results(spark, stored, want):
    assert one(spark, json_tools.is_error_result(F.lit(stored))) is want


def test_pages_make_the_whole(spark):
    df = spark.range(45).select("id", (F.col("id") % 7).cast("int").alias("year"), F.lit("t").alias("title"))
    pages = [[r.id for r in rel.page(df, "year", True, n, 20).collect()] for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    assert sum(pages, []) == [r.id for r in df.orderBy("year", "id").collect()]
    with pytest.raises(ValueError):
        rel.page(df, number=0)


def test_inserted_keys_are_dense(spark):
    base = spark.createDataFrame([(7, "a")], "id long, v string")
    got = rel.insert_rows(base, spark.range(100).repartition(5).select("id", F.lit("n").alias("v")))
    assert sorted(r.id for r in got.collect()) == [7, *range(8, 108)]


def test_patch_needs_fields(spark):
    base = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(ValueError):
        rel.patch_rows(base, base.select("id"))


def test_section_cascade(spark):
    docs = spark.createDataFrame(
        [(1, "Abstract\naa\nIntroduction\nbb\nResults and Discussion\ncc"), (2, "0\n1. Gap Study\na\n2. Lens Setup\nb"), (3, "plain prose"), (4, "results " + "x" * 93 + "\nAbstract\nq\nMethods\nw"), (5, None)], "doc_id long, text string"
    )
    got = {(r.doc_id, r.section): r.text for r in sections.split_sections(docs).collect()}
    assert got == {
        (1, "abstract"): "aa", (1, "introduction"): "bb", (1, "results_discussion"): "cc", (2, "gap_study"): "a", (2, "lens_setup"): "b",
        (3, "full_text"): "plain prose", (4, "abstract"): "q", (4, "method"): "w", (5, "full_text"): None,
    }


def test_titles_and_names(spark):
    assert one(spark, text.title(F.lit(None).cast("string"), F.lit("\n  \nMy Title\nx"))) == "My Title"
    assert one(spark, text.doi(F.lit("see 10.1234/abc.def,"))) == "10.1234/abc.def"
    assert one(spark, text.doi(F.lit("see 10.1234/abc.def,"), strip=False)) == "10.1234/abc.def,"
    assert one(spark, text.common_year(F.lit("2019 x 2021 x 2021 x 1985"))) == 2021
    assert one(spark, text.common_year(F.lit("2019 2021"))) == 2019
    assert one(spark, text.year(F.lit("D:20240115"), F.lit("2019"))) == 2024
    assert one(spark, text.word_count(F.lit(" a  b\n c "))) == 3
    assert one(spark, text.saved_percent(F.lit(""), F.lit(""))) is None
    assert one(spark, text.renamed(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x y")))) == ["a", "b"]
    assert one(spark, text.cut_at_sentence(F.lit("a" * 60 + ". " + "b" * 200))) == "a" * 60 + "."


def test_topics(spark):
    docs = spark.createDataFrame([(1, "A laser waveguide"), (2, "excellent work"), (3, "nothing here"), (4, "SEM image"), (5, "the temperature system")], "doc_id int, text string")
    got = {r.doc_id: r.domain for r in classify.classify_topic(docs).collect()}
    assert got == {1: "optics", 2: "bio", 3: "general", 4: "materials", 5: "general"}


def test_caption_matches_use_each_caption_once(spark):
    figures = spark.createDataFrame([(1, i, f"p{1 + i % 3}_fig{i}") for i in range(9)], "doc_id long, seq int, figure_num string")
    found = spark.createDataFrame([(1, 1 + i % 3, i, f"c{i}") for i in range(5)], "doc_id long, page_no int, fig_num int, caption string")
    got = [r.caption for r in captions.match_near_pages(figures, found).collect()]
    assert len(got) == len(set(got)) == 5


def test_caption_references_and_numbers(spark):
    pages = spark.createDataFrame([(1, 3, "As Fig. 2a shows. Nothing. See Figure 4.")], "doc_id long, page_no int, text string")
    assert [(r.number, r.label) for r in captions.references(pages).collect()] == [(2, "A"), (4, "")]
    figures = spark.createDataFrame([(1, "1"), (1, "2")], "doc_id long, number string")
    rows = spark.createDataFrame([(1, "1", "old", 1), (1, "1", "new", 2), (1, "2a", "part", 3)], "doc_id long, number string, caption string, pos int")
    assert {r.number: r.caption for r in captions.match_by_number(figures, rows).collect()} == {"1": "new", "2": "part"}


def test_box_groups_partition_a_page(spark):
    rects = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 60.0, 60.0), (1, 1, 2, 70.0, 0.0, 130.0, 60.0), (1, 1, 3, 400.0, 400.0, 460.0, 460.0)], "doc_id long, page_no int, rect_no int, x0 double, y0 double, x1 double, y1 double")
    assert {r.rect_no: r.group_no for r in geometry.group_boxes(rects).collect()} == {1: 1, 2: 1, 3: 2}
    clip = geometry.clipped(spark.createDataFrame([(5.0, 5.0, 100.0, 100.0)], "x0 double, y0 double, x1 double, y1 double"), F.lit(595.0), F.lit(842.0)).first()
    assert tuple(clip) == (0, 0, 108, 108)


def test_diagrams(spark):
    nodes = F.array(*(F.struct(F.lit(i).alias("id"), F.lit("l").alias("label")) for i in "ABCDEFG"))
    edges = F.array(F.struct(F.lit("A").alias("source"), F.lit("B").alias("target"), F.lit("yes;").alias("label")))
    chart = one(spark, diagrams.flowchart(nodes, edges))
    assert chart.startswith("graph TD\n") and "A -->|yes,| B" in chart
    assert one(spark, diagrams.sequence_diagram(nodes, edges)).count("participant") == 7
    assert one(spark, diagrams.state_diagram(nodes, edges)).endswith("A --> B")
    assert one(spark, diagrams.class_diagram(nodes, edges)).startswith("classDiagram")
    dirty = "```mermaid\n---\ntitle: x\n---\naccTitle: y\ngraph LR\nA[f(x)]\n```"
    assert one(spark, diagrams.quote_labels(diagrams.clean_mermaid(F.lit(dirty)))) == 'graph LR\nA["f(x)"]'


def test_json_markdown(spark):
    assert one(spark, reports.json_markdown(F.lit('{"key_topics": ["a", {"b": 1}], "none": null}'))) == "- **Key Topics:**\n  - a\n  - **B:** 1"


def test_backend_fallback_and_budget(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "FAIL")], "paper_id long, prompt string")
    rows = {r.paper_id: r for r in backend.phase_rows(backend.ask(prompts, [backend.Stub()]), "screening", "2025-01-01 00:00:00").collect()}
    assert rows[1].phase == "screening" and rows[1].cost_usd > 0 and rows[2].phase == "error"


def test_text_files(spark, tmp_path):
    for name, data in (("a.pdf", b"x"), ("b.PDF", b"yy"), ("c.txt", b"z"), ("empty.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    assert sorted(r.length for r in files.documents(spark, str(tmp_path)).collect()) == [1, 2]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "photon.yaml").write_text("name: photon\nrole: optics\n")
    got = files.profiles(spark, str(tmp_path / "p")).select("name", files.missing_fields(F.col("profile"), ["name", "goal"]).alias("m")).first()
    assert tuple(got) == ("photon", ["goal"])


def test_streams(spark, tmp_path):
    events = pd.DataFrame({"paper_id": [1, 1, 2, 1], "phase": ["screening", "recipe", "visual", "recipe"], "cost_usd": [0.1, 0.2, 0.3, 0.2], "ts": pd.to_datetime(["2024-01-01"] * 4)})
    spark.createDataFrame(events).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("paper_id long, phase string, cost_usd double, ts timestamp").parquet(str(tmp_path / "in"))

    def rows(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(once=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(60)
        return sorted(map(tuple, spark.table(name).collect()))

    assert rows(run_state.run_state(stream), "state", "complete") == [(1, 60, 3, 0.5, False), (2, 40, 1, 0.3, False)]
    assert len(rows(run_state.first_completions(stream, "1 hour").select("paper_id", "phase"), "firsts", "append")) == 3


def test_phase_sections_without_an_answer_or_fields(spark):
    from folioforge.functions import phase_markdown as md

    nothing = F.lit(None).cast("string")
    for section, n in ((md.screening_section, 1), (md.visual_section, 2), (md.recipe_section, 3), (md.deep_dive_section, 4)):
        assert one(spark, section(nothing)).endswith(f"\n\n*Phase {n} was not completed.*")
        assert one(spark, section(F.lit("{}"))).startswith(f"## Phase {n}: ")
    assert one(spark, md.live_phase(F.lit("screening"), F.lit("{}"))).count("N/A") == 5
    assert one(spark, md.live_phase(F.lit("other"), F.lit('{"b":1,"a":"é"}'))) == '{\n  "b": 1,\n  "a": "é"\n}'
    assert one(spark, md.live_phase(F.lit("other"), F.lit("no {json"))) == one(spark, md.live_phase(F.lit("visual"), F.lit("no {json"))) == "no {json"
    mixed = F.lit('{"parameters": [{"name": "T", "value": 5}, "plain"], "steps": ["a"]}')
    assert "- **T:** 5 \n- plain" in one(spark, md.live_phase(F.lit("recipe"), mixed))
    assert one(spark, md.cost_section(F.array().cast("array<struct<phase:string,model:string,cost:double,seconds:double,failed:boolean>>"), F.lit(0.0), F.lit(0), F.lit(0))) is None


def test_running_captions_stop_and_the_parts_of_figures(spark):
    docs = spark.createDataFrame([(1, "Fig. 1: first\n  line Figure 2a. second Table 3: grid\n\nrest"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.number, r.caption) for r in captions.running_captions(docs).collect()} == {("1", "first line"), ("2a", "second")}
    assert [(r.number, r.caption) for r in captions.running_captions(docs, captions.TABLES).collect()] == [("3", "grid")]


def test_free_names(spark):
    from folioforge.operators.relational import free_names

    titles = ["Flow", "flow", "Flow 1", "flow 1", "flow 2", "flow", "flow", "flow_1_1", "flow 01", "flow 5"]
    for rows in (titles, titles[::-1]):
        df = spark.createDataFrame([(p, i, t.lower().replace(" ", "_")) for p in (1, 2) for i, t in enumerate(rows)], "paper long, seq long, name string")
        got = free_names(df, "name", ["paper"], "seq").collect()
        assert len(got) == 20 and len({(r.paper, r.name) for r in got}) == 20
        assert {"flow", "flow_1", "flow_2", "flow_3", "flow_4", "flow_6", "flow_1_1", "flow_1_2", "flow_01", "flow_5"} == {r.name for r in got if r.paper == 1}


def test_changes_without_an_order(spark):
    from folioforge.operators.relational import insert_rows, patch_rows, upsert

    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, v string, at int")
    assert {r.v for r in upsert(base, twice, "id", "at").collect()} == {"y", "b"}
    with pytest.raises(Exception, match="several changes"):
        patch_rows(base, twice.drop("at")).collect()
    new = insert_rows(base, spark.range(200).selectExpr("id", "cast(id as string) v").repartition(7).orderBy(F.rand())).collect()
    assert sorted(r.id for r in new) == list(range(1, 203))


def test_costs_with_four_decimals_are_those_of_printf(spark):
    from folioforge.functions.reports import fixed4

    values = [0.0, -0.0, 0.03125, 0.09375, -0.03125, 0.24775, 0.88635, 1234.00005, 1e-300, 0.99995, 9999.99995, -0.00001, 549755813887.99995, 123456789012.12345]
    values += [k / 100000 for k in range(5, 40000, 10)] + [k / 32 for k in range(1, 1000)] + [k * 1.37 for k in range(1000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed4(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in got if r.s != "%.4f" % r.v] == [] and len(got) == len(values)


def test_reports_show_costs_as_their_sql(spark):
    from folioforge.functions import phase_markdown as md

    papers = spark.createDataFrame([(1, "t", "a", 2000, "j", "d")], "id long, title string, authors string, year int, journal string, domain string")
    row = "SELECT 1L AS paper_id, 'recipe' AS phase, 'x' AS result, 'm' AS model_used, 1L AS tokens_in, 2L AS tokens_out, {}D AS cost_usd, now() AS created_at, {} AS id"
    text = md.report(papers, spark.sql(row.format("0.24775", 1) + " UNION ALL " + row.format("0.00005", 2))).first().markdown
    assert "Cost: $0.2477*" in text and f"Cost: ${0.00005:.4f}*" in text and f"**Total Cost:** ${0.2478:.4f}\n" in text


def test_running_captions_of_odd_texts_are_those_of_sql(spark, tmp_path):
    import duckdb

    from folioforge.plans import registry

    texts = [
        "", "   ", None, "\n\n", "\t", "plain", ". dots: first", ": x", "\n\nafter", "Table of things", "figure it out", "Fig. without", "see Figure 3 for", "see fig.\n4", "Fig\x0b5 x", "a\x0bb  c", "a\u0085",
        "a\n", "a\r\n", "a\u2028", "x\u0001y Figure", "\u0001", "one\nSection 12 two", "one\nS\u017f 12 two", "one\n\u212aa\x0b1 two", "one\nab\x0b12 two", "a\u00a0 b \f c", "FIGURES", "ends in Fig", "...", "  lead", "a tabletop\n\nb", "a$b\\\\1",
    ]
    rows = list(enumerate(texts)) + [(None, "no key")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["txt09_running_captions"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute("SELECT doc_id, number, caption FROM (" + registry.oracles()["txt09_running_captions"] + ")").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_captions_near_pages_are_those_of_the_loop_and_take_little_time(spark):
    import random
    import time

    rng = random.Random(5)
    figures = [(rng.choice([1, 2, 3, None]), i, f"p{rng.randrange(1, 8)}_fig{i}") for i in range(120)]
    found = [(rng.choice([1, 2, 4, None]), rng.randrange(1, 8), n, f"c{i}") for i in range(120) for n in [rng.randrange(60)]]
    found = list({r[:3]: r for r in found}.values())
    want = []
    for doc in {f[0] for f in figures}:
        used = set()
        for _, _, name in sorted((f for f in figures if f[0] == doc), key=lambda f: f[1]):
            page = int(name[1 : name.index("_")])
            free = (c for p in (page, page + 1, page - 1) for c in sorted((c for c in found if c[:2] == (doc, p)), key=lambda c: c[2]) if c[2] not in used)
            if c := next(free, None):
                used.add(c[2])
                want.append((doc, name, f"Fig. {c[2]}. {c[3]}"))
    made = captions.match_near_pages(spark.createDataFrame(figures, "doc_id long, seq int, figure_num string"), spark.createDataFrame(found, "doc_id long, page_no int, fig_num int, caption string"))
    assert sorted(map(repr, (tuple(r) for r in made.collect()))) == sorted(map(repr, want))
    n = 40_000  # documents; a call for each took 3 ms of a core or more
    many = spark.range(n).selectExpr("id AS doc_id", "1 AS seq", "'p2_fig1' AS figure_num")
    began = time.monotonic()
    assert captions.match_near_pages(many, spark.range(n).selectExpr("id AS doc_id", "3 AS page_no", "1 AS fig_num", "'c' AS caption")).count() == n
    assert time.monotonic() - began < 15


def test_recipe_cards_read_their_json_once(spark):
    from folioforge.functions import phase_markdown as md

    text = '{"confidence": 0.5, "recipe": {"parameters": {"a": null, "b": {"name": "c", "value": 1, "status": "[RED]"}}}}'
    card = md.recipe_card(F.col("t"), F.lit(None).cast("string"), F.lit(1), F.lit("now"))
    rows = spark.createDataFrame([(text,), ("no json",), (None,)], "t string").select(card.alias("c"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") < 10  # 113 as long as each field read it anew
    want = "# Recipe Card: Untitled Paper\n\n> Paper ID: 1\n> Generated: now\n\n## Parameters\n\n" + md.PARAMETER_HEAD
    want += "| a |  |  |  | :green_circle: EXPLICIT |\n| c | 1 |  |  | :red_circle: MISSING |\n\n## Confidence Metrics\n- Extraction Confidence: 50%\n"
    assert [r.c for r in rows.collect()] == [want, None, None]
