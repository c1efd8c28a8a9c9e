"""Queries over the library: filters, pages, joins, changes, window picks, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions.json_tools import is_error_result, parse_tags
from folioforge.operators import relational as rel
from folioforge.plans.library import LIBRARY_SQL, papers, results
from folioforge.plans.registry import register
from folioforge.schemas import MAIN_PHASES
from folioforge.session import dropped_at_exit, shared_path, table
from folioforge.sources import tables

L = LIBRARY_SQL
TAGS_SQL = """CASE WHEN tags IS NULL OR trim(tags) = '' THEN []::VARCHAR[]
  WHEN json_valid(tags) AND json_type(tags) = 'ARRAY' THEN from_json(tags, '["VARCHAR"]')
  WHEN contains(tags, ',') THEN [trim(t) FOR t IN string_split(tags, ',') IF trim(t) <> ''] ELSE [trim(tags)] END"""


@register("src01_first_row", L + "SELECT id, title, status FROM papers WHERE status = 'completed' ORDER BY id LIMIT 1")
def _(spark, sf):
    return papers(spark, sf).where("status = 'completed'").orderBy("id").limit(1).select("id", "title", "status")


@register("src02_scan", L + "SELECT id, title, domain FROM papers WHERE domain = 'bio'")
def _(spark, sf):
    return papers(spark, sf).where("domain = 'bio'").select("id", "title", "domain")


@register("src03_paper_by_id", L + "SELECT id, title, year, tags FROM papers WHERE id = 42")
def _(spark, sf):
    return papers(spark, sf).where("id = 42").select("id", "title", "year", "tags")


@register("src04_children_in_text_order", "SELECT l_orderkey AS paper_id, concat('p', l_linenumber, '_fig', l_partkey) AS figure_num FROM lineitem WHERE l_orderkey < 40")
def _(spark, sf):
    figures = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("p"), "l_linenumber", F.lit("_fig"), "l_partkey").alias("figure_num"))
    return figures.where("paper_id < 40").orderBy("paper_id", "figure_num")


def _settings(spark, sf, value: str, where: str = "true"):
    """Nations as settings."""
    return table(spark, sf, "nation").where(where).select(F.col("n_name").alias("key"), F.lit(value).alias("value"))


@register("src12_settings_with_defaults", "SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'stored' ELSE 'default' END AS value FROM nation")
def _(spark, sf):
    return rel.fill_missing(_settings(spark, sf, "stored", "n_nationkey % 2 = 0"), _settings(spark, sf, "default"), "key")


@register("src16_paper_with_tags", L + f"SELECT id, array_to_string({TAGS_SQL}, '|') AS tags FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("id", F.array_join(parse_tags(F.col("tags")), "|").alias("tags"))


@register("flt01_status_domain", L + "SELECT id, title FROM papers WHERE status = 'completed' AND domain = 'optics'")
def _(spark, sf):
    return rel.equal_filters(papers(spark, sf), status="completed", domain="optics", year="").select("id", "title")


@register("flt02_substring_search", L + "SELECT id, title FROM papers WHERE title ILIKE '%77%' OR coalesce(authors, '') ILIKE '%77%' OR coalesce(tags, '') ILIKE '%77%' OR coalesce(notes, '') ILIKE '%77%'")
def _(spark, sf):
    return rel.search_text(papers(spark, sf), "77", ["title", "authors", "tags", "notes"]).select("id", "title")


@register("flt02_escaped_wildcards", L + "SELECT id, notes FROM papers WHERE contains(lower(coalesce(notes, '')), '100%_note a')")
def _(spark, sf):
    return rel.search_text(papers(spark, sf), "100%_NOTE a", ["notes"]).select("id", "notes")


@register("flt03_year_and_tag", L + "SELECT id, year, tags FROM papers WHERE year = 2001 AND coalesce(tags, '') ILIKE '%t1%'")
def _(spark, sf):
    return rel.equal_filters(papers(spark, sf), year=2001).where(rel.has_tag(F.col("tags"), "t1")).select("id", "year", "tags")


@register("flt03_year_and_exact_tag", L + f"SELECT id, year FROM papers WHERE year = 2001 AND list_contains({TAGS_SQL}, 't1')")
def _(spark, sf):
    return rel.equal_filters(papers(spark, sf), year=2001).where(rel.has_tag(parse_tags(F.col("tags")), "t1", strict=True)).select("id", "year")


@register("flt04_fallback_search", L + "SELECT id, created_at FROM papers WHERE journal ILIKE '%build%' OR title ILIKE '%build%'")
def _(spark, sf):
    return rel.search_text(papers(spark, sf), "build", ["title", "authors", "journal", "tags", "notes"], newest_by="created_at").select("id", "created_at")


@register("flt05_not_errors", L + "SELECT phase, count(*) AS n FROM results WHERE phase <> 'error' GROUP BY phase")
def _(spark, sf):
    return rel.not_errors(results(spark, sf)).groupBy("phase").agg(F.count("*").alias("n"))


@register("flt06_month_range", L + "SELECT id, created_at FROM results WHERE created_at >= TIMESTAMP '1998-12-01' AND created_at < TIMESTAMP '1999-01-01'")
def _(spark, sf):
    return results(spark, sf).where(rel.month_range("created_at", "1998-12")).select("id", "created_at")


@register("flt07_has_tags", L + "SELECT count(*) AS n FROM papers WHERE tags IS NOT NULL AND tags <> ''")
def _(spark, sf):
    return papers(spark, sf).where("tags IS NOT NULL AND tags <> ''").agg(F.count("*").alias("n"))


@register("flt08_has_year", L + "SELECT count(*) AS n FROM papers WHERE year IS NOT NULL")
def _(spark, sf):
    return papers(spark, sf).where("year IS NOT NULL").agg(F.count("*").alias("n"))


@register("flt09_keys_in", L + "SELECT id, status FROM papers WHERE id IN (3, 5, 8, 13)")
def _(spark, sf):
    return papers(spark, sf).where(F.col("id").isin(3, 5, 8, 13)).select("id", "status")


@register("flt10_compound_key", "SELECT l_orderkey AS paper_id, l_linenumber AS id, l_partkey AS part FROM lineitem WHERE l_linenumber = 2 AND l_orderkey = 7")
def _(spark, sf):
    return table(spark, sf, "lineitem").where("l_linenumber = 2 AND l_orderkey = 7").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"))


@register("flt11_error_results", L + "SELECT id, CASE WHEN trim(result) = '' THEN true WHEN NOT json_valid(result) THEN false ELSE json_exists(result, '$.error') OR json_exists(result, '$._parse_error') END AS is_error FROM results")
def _(spark, sf):
    return results(spark, sf).select("id", is_error_result(F.col("result")).alias("is_error"))


@register("flt12_large_boxes", "SELECT p_partkey AS id FROM part WHERE p_size >= 25 AND p_retailprice >= 950")
def _(spark, sf):
    boxes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") - 925).alias("h"))
    return boxes.where(rel.large_enough("w", "h", 25)).select("id")


@register("srt01_page", L + "SELECT id, title, year FROM papers ORDER BY year ASC NULLS FIRST, id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return rel.page(papers(spark, sf), "year", True, number=3).select("id", "title", "year")


@register("srt01_page_descending", L + "SELECT id, year FROM papers WHERE status = 'error' ORDER BY year DESC NULLS LAST, id LIMIT 50")
def _(spark, sf):
    return rel.page(rel.equal_filters(papers(spark, sf), status="error"), "year", False, size=50).select("id", "year")


@register("srt02_unknown_column_falls_back", L + "SELECT id, created_at FROM papers ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def _(spark, sf):
    return rel.page(papers(spark, sf), "drop table", True).select("id", "created_at")


@register("agg01_total_and_pages", L + "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM papers WHERE domain = 'bio'")
def _(spark, sf):
    return rel.counted(rel.equal_filters(papers(spark, sf), domain="bio"))


@register("jon01_titles_with_orphans", L + "SELECT r.id, coalesce(p.title, 'Paper ' || r.paper_id) AS title FROM results r LEFT JOIN papers p ON p.id = r.paper_id")
def _(spark, sf):
    return rel.with_titles(results(spark, sf), papers(spark, sf)).select("id", "title")


@register("jon02_hits_to_papers", L + "SELECT p.id, p.title, h.n FROM papers p JOIN (SELECT paper_id, count(*) AS n FROM results WHERE phase = 'recipe' GROUP BY paper_id) h ON h.paper_id = p.id")
def _(spark, sf):
    hits = results(spark, sf).where("phase = 'recipe'").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    return papers(spark, sf).join(hits, "id").select("id", "title", "n")


AGENTS = {"optics": "photon", "materials": "crystal", "bio": "helix", "energy": "volt", "quantum": "qubit"}


@register("jon04_agent_lookup", L + "SELECT id, CASE domain WHEN 'optics' THEN 'photon' WHEN 'bio' THEN 'helix' WHEN 'energy' THEN 'volt' WHEN 'quantum' THEN 'qubit' ELSE 'atlas' END AS agent FROM (SELECT id, CASE WHEN domain = 'materials' THEN 'general' ELSE domain END AS domain FROM papers)")
def _(spark, sf):
    domains = papers(spark, sf).withColumn("domain", F.when(F.col("domain") == "materials", "general").otherwise(F.col("domain")))
    return rel.lookup(domains, AGENTS, "domain", "agent", "atlas").select("id", "agent")


@register("jon08_captions_by_ordinal", "WITH t AS (SELECT l_orderkey, item, row_number() OVER (PARTITION BY l_orderkey ORDER BY item) AS i FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS item FROM lineitem)), c AS (SELECT l_orderkey, 'c' || item AS caption, row_number() OVER (PARTITION BY l_orderkey ORDER BY item) AS i FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS item FROM lineitem) WHERE item > 2000000) SELECT t.l_orderkey AS doc_id, t.item, c.caption FROM t LEFT JOIN c USING (l_orderkey, i)")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("item"))
    lines = lines.withColumn("caption", F.concat(F.lit("c"), "item"))
    return rel.ordinal_match(lines.drop("caption"), lines.where("item > 2000000"), ["doc_id"], "item").select("doc_id", "item", "caption")


@register("dml01_insert", L + "SELECT id, title FROM papers WHERE id > 100 UNION ALL SELECT (SELECT max(id) FROM papers) + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def _(spark, sf):
    base = papers(spark, sf).select("id", "title")
    new = table(spark, sf, "region").coalesce(1).sortWithinPartitions("r_regionkey").select(F.lit(0).cast("long").alias("id"), F.col("r_name").alias("title"))
    return rel.insert_rows(base, new).where("id > 100")


@register("dml02_update_where", L + "SELECT id, CASE WHEN status = 'pending' THEN 'completed' ELSE status END AS status FROM papers WHERE domain <> 'energy'")
def _(spark, sf):
    return papers(spark, sf).where("domain <> 'energy'").select("id", F.when(F.col("status") == "pending", "completed").otherwise(F.col("status")).alias("status"))


@register(
    "dml02_stored_changes",
    L + """, u AS (SELECT id, CASE WHEN domain <> 'energy' AND status = 'pending' THEN 'completed' ELSE status END AS status, year FROM papers),
d AS (SELECT * FROM u WHERE id % 11 <> 0 OR year IS NULL), s AS (SELECT id, status FROM d WHERE id % 6 <> 0 UNION ALL SELECT id, 'again' FROM papers WHERE id % 6 = 0)
SELECT id, status, (SELECT count(*) FROM papers WHERE domain <> 'energy' AND status = 'pending') AS updated, (SELECT count(*) FROM papers WHERE id % 11 = 0 AND year IS NOT NULL) AS deleted,
(SELECT count(*) FROM d WHERE id % 6 = 0) AS replaced FROM s""",
)
def _(spark, sf):
    base = papers(spark, sf).select("id", "status", "domain", "year")
    stored = tables.StoredTable(spark, dropped_at_exit(spark, shared_path(spark, "papers")))
    stored.create(base)
    updated = stored.update((F.col("domain") != "energy") & (F.col("status") == "pending"), status=F.lit("completed"))
    deleted = stored.delete((F.col("id") % 11 == 0) & F.col("year").isNotNull())
    replaced, _ = stored.upsert(base.where("id % 6 = 0").withColumn("status", F.lit("again")))
    return stored.rows().select("id", "status", *(F.lit(n).cast("long").alias(name) for name, n in (("updated", updated), ("deleted", deleted), ("replaced", replaced))))


@register("dml03_patch", L + "SELECT id, CASE WHEN id % 10 = 0 THEN 'New ' || id ELSE title END AS title, CASE WHEN id % 10 = 0 AND id % 20 <> 0 THEN 'n' ELSE notes END AS notes FROM papers")
def _(spark, sf):
    base = papers(spark, sf).select("id", "title", "notes")
    patch = base.where("id % 10 = 0").select("id", F.concat(F.lit("New "), "id").alias("title"), F.when(F.col("id") % 20 != 0, "n").alias("notes"))
    return rel.patch_rows(base, patch)


@register("dml04_cascade", L + "SELECT 'papers' AS kind, count(*) AS n FROM papers WHERE id % 3 <> 0 UNION ALL SELECT 'results', count(*) FROM results WHERE NOT (paper_id % 3 = 0 AND paper_id >= 0)")
def _(spark, sf):
    p, r = papers(spark, sf), results(spark, sf)
    left = rel.delete_cascade({"papers": (p, "id"), "results": (r, "paper_id")}, p.where("id % 3 = 0").select(F.col("id").alias("key")))
    one = lambda name: left[name].agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("papers").union(one("results"))


@register("dml05_upsert_settings", "SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM nation UNION ALL SELECT 'region ' || r_name, '1' FROM region")
def _(spark, sf):
    regions = table(spark, sf, "region").select(F.concat(F.lit("region "), "r_name").alias("key"), F.lit("1").alias("value"))
    return rel.upsert(_settings(spark, sf, "old"), _settings(spark, sf, "new", "n_nationkey % 3 = 0").union(regions), "key")


@register("dml06_insert_if_missing", "SELECT n_name AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'mine' WHEN n_nationkey % 4 < 3 THEN 'default' END AS value FROM nation WHERE n_nationkey % 4 < 3")
def _(spark, sf):
    return rel.fill_missing(_settings(spark, sf, "mine", "n_nationkey % 4 = 0"), _settings(spark, sf, "default", "n_nationkey % 4 < 3"), "key")


@register("dml07_rerun_replaces", L + "SELECT paper_id, count(*) AS n FROM (SELECT paper_id FROM results WHERE paper_id % 5 <> 0 UNION ALL SELECT id FROM papers WHERE id % 5 = 0) GROUP BY paper_id")
def _(spark, sf):
    base, p = results(spark, sf).select("paper_id"), papers(spark, sf)
    fresh = p.where("id % 5 = 0").select(F.col("id").alias("paper_id"))
    negative = fresh.select((-F.col("paper_id")).alias("paper_id"))
    return base.join(fresh.union(negative), "paper_id", "left_anti").unionByName(fresh).groupBy("paper_id").agg(F.count("*").alias("n"))


@register("dml09_append_phase_rows", L + "SELECT phase, count(*) AS n FROM (SELECT phase FROM results UNION ALL SELECT 'recipe' FROM papers WHERE status = 'completed') GROUP BY phase")
def _(spark, sf):
    new = papers(spark, sf).where("status = 'completed'").select(F.lit("recipe").alias("phase"))
    return results(spark, sf).select("phase").unionByName(new).groupBy("phase").agg(F.count("*").alias("n"))


@register("dml11_status_transition", L + "SELECT id, CASE WHEN id % 4 = 0 THEN 'completed' WHEN id % 4 = 1 THEN 'error' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2025-01-01' END AS analyzed_at FROM papers")
def _(spark, sf):
    base = papers(spark, sf).select("id", "status", F.lit(None).cast("timestamp_ntz").alias("analyzed_at"))
    changes = base.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "completed").otherwise("error").alias("status"))
    return rel.set_status(base, changes, "2025-01-01 00:00:00")


@register("dml12_name_collisions", "SELECT c_custkey AS id, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS folder_name FROM (SELECT c_custkey, c_mktsegment || '_' || c_nationkey AS name, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)")
def _(spark, sf):
    named = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("folder_name"))
    return rel.without_collisions(named, "folder_name")


@register("win01_latest_per_group", L + "SELECT paper_id, phase, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, phase ORDER BY created_at DESC, id DESC) AS n FROM results) WHERE n = 1")
def _(spark, sf):
    return rel.latest(results(spark, sf), ["paper_id", "phase"], ["created_at", "id"]).select("paper_id", "phase", "id", "created_at")


@register("win02_last_result_by_phase", L + "SELECT paper_id, " + ", ".join(f"arg_max(result, (created_at, id)) FILTER (phase = '{p}') AS {p}" for p in MAIN_PHASES) + " FROM results GROUP BY paper_id")
def _(spark, sf):
    return rel.last_by_phase(results(spark, sf), MAIN_PHASES)


@register("win03_first_occurrence", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    return rel.first_of(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("win06_ordinals", "SELECT o_custkey AS doc_id, o_orderkey AS item, 'table_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS name FROM orders")
def _(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item"), "o_orderdate")
    return rel.numbered(items, ["doc_id"], ["o_orderdate", "item"], "name", "table_").select("doc_id", "item", "name")


@register("win07_chain_edges", "SELECT * FROM (SELECT conv_id, lag(conv_id || '_' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source, conv_id || '_' || turn AS target FROM conversations) WHERE source IS NOT NULL")
def _(spark, sf):
    nodes = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("node"))
    return rel.chain_edges(nodes, ["conv_id"], "turn", "node")


@register("win09_distinct_in_order", "SELECT doc_id, array_to_string(list(word ORDER BY first)[1:10], '|') AS words FROM (SELECT doc_id, word, min(i) AS first FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) GROUP BY doc_id, word) GROUP BY doc_id")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.split("text", " ")), 1, 10), "|").alias("words"))


@register("win11_last_usage", L + "SELECT model_used, max(struct_pack(created_at, id)).id AS id FROM results WHERE model_used IS NOT NULL GROUP BY model_used")
def _(spark, sf):
    return results(spark, sf).where("model_used IS NOT NULL").groupBy("model_used").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@register("set01_union_of_names", "SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region")
def _(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).distinct().orderBy("name")


@register("set02_completed_main_phases", L + "SELECT paper_id, count(DISTINCT phase) AS n FROM results WHERE phase IN ('screening', 'visual', 'recipe', 'deep_dive') GROUP BY paper_id")
def _(spark, sf):
    return results(spark, sf).where(F.col("phase").isin(MAIN_PHASES)).groupBy("paper_id").agg(F.count_distinct("phase").alias("n"))


@register("set03_phases_of_paper", L + "SELECT paper_id, string_agg(phase, ',' ORDER BY phase) AS phases FROM (SELECT DISTINCT paper_id, phase FROM results) GROUP BY paper_id")
def _(spark, sf):
    return results(spark, sf).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("phase")), ",").alias("phases"))


@register("set04_three_way_split", L + "SELECT CASE WHEN phase = 'viz_plan' THEN 'mermaid' WHEN phase = 'visualization' THEN 'image' ELSE 'other' END AS tool, count(*) AS n, sum(id)::BIGINT AS ids FROM results GROUP BY 1")
def _(spark, sf):
    rows = results(spark, sf).select("id", "phase")
    parts = [rows.where("phase = 'viz_plan'").withColumn("tool", F.lit("mermaid")), rows.where("phase = 'visualization'").withColumn("tool", F.lit("image")), rows.where("phase NOT IN ('viz_plan', 'visualization')").withColumn("tool", F.lit("other"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tool").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@register("set05_add_and_remove_tag", L + f"SELECT id, array_to_string([t FOR t IN (CASE WHEN list_contains(w, 'new') THEN w ELSE list_append(w, 'new') END) IF t <> 'x'], '|') AS tags FROM (SELECT id, {TAGS_SQL} AS w FROM papers)")
def _(spark, sf):
    tags = parse_tags(F.col("tags"))
    added = F.when(F.array_contains(tags, "new"), tags).otherwise(F.array_append(tags, F.trim(F.lit(" new "))))
    return papers(spark, sf).select("id", F.array_join(F.array_remove(added, "x"), "|").alias("tags"))


@register("srt04_caps", "SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:5], ',') AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.slice("t.role", 1, 5), ",").alias("roles"))


@register("srt06_spatial_sort", "SELECT c_nationkey AS page, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal, c_custkey) AS boxes FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    boxes = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("c_acctbal", "c_custkey"))).alias("b"))
    return boxes.select("page", F.array_join(F.col("b.c_custkey").cast("array<string>"), ",").alias("boxes"))


@register("prj02_masked_keys", "SELECT doc_id, CASE WHEN w = '' THEN '' WHEN length(w) < 16 THEN '***' ELSE w[1:8] || '...' || w[-4:] END AS masked, length(w) > 0 AS configured FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9]+') AS w FROM documents)")
def _(spark, sf):
    word = F.regexp_extract("text", "[A-Za-z0-9]+", 0)
    masked = F.when(word == "", "").when(F.length(word) < 16, "***").otherwise(F.concat(F.substring(word, 1, 8), F.lit("..."), F.right(word, F.lit(4))))
    return table(spark, sf, "documents").select("doc_id", masked.alias("masked"), (F.length(word) > 0).alias("configured"))


@register("prj03_default_fill", L + "SELECT id, coalesce(nullif(authors, ''), 'unknown') AS authors, coalesce(year, 0) AS year FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("id", F.coalesce(F.nullif("authors", F.lit("")), F.lit("unknown")).alias("authors"), F.coalesce("year", F.lit(0)).alias("year"))
