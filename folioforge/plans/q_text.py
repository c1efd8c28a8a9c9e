"""Queries of text functions: metadata, sections, classification, search, captions, boxes, diagrams, reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import classify, diagrams, json_tools, phase_markdown, reports, sections, text
from folioforge.functions.vocabulary import MERMAID_WORDS, PICTURE_WORDS, ROUTER_WORDS, TOPIC_WORDS
from folioforge.operators import captions, geometry, grids
from folioforge.operators.relational import latest
from folioforge.plans.library import LIBRARY_SQL, papers, results
from folioforge.plans.registry import register
from folioforge.session import dropped_at_exit, shared_path, table
from folioforge.sources import files, text_files

L = LIBRARY_SQL
DOCS = "documents"


@register("txt01_title", "SELECT doc_id, CASE WHEN length(t) > 200 THEN t[1:200] || '...' ELSE coalesce(t, 'Untitled Paper') END AS title FROM (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''][1] AS t FROM documents)")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.title(F.lit(None).cast("string"), F.col("text")).alias("title"))


@register("txt02_title_of_lines", r"WITH l AS (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS ls FROM documents) SELECT doc_id, coalesce([x FOR x IN ls[1:10] IF length(x) > 20 AND NOT regexp_full_match(x, '\d+') AND NOT regexp_matches(x, '(?i)^page\s+\d+') AND NOT (upper(x) = x AND lower(x) <> x)][1], ls[1], 'Unknown Title') AS title FROM l")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.title_of_lines(F.col("text")).alias("title"))


PAPER_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'See 10.1234/abc.' || doc_id || '), Nature Photonics 2019 and 2021, 2021 ' WHEN 1 THEN 'Proceedings of Things. doi:10.55555/x;' || doc_id || ' 1985 1999 ' ELSE '' END || text"


def _papers_text(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("See 10.1234/abc."), "doc_id", F.lit("), Nature Photonics 2019 and 2021, 2021 "))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Proceedings of Things. doi:10.55555/x;"), "doc_id", F.lit(" 1985 1999 "))).otherwise("")
    return table(spark, sf, DOCS).select("doc_id", F.concat(head, "text").alias("text"))


@register("txt03_doi", rf"SELECT doc_id, nullif(regexp_replace(regexp_extract(t, '10\.\d{{4,}}/[^\s]+'), '[.,;)]+$', ''), '') AS doi FROM (SELECT doc_id, {PAPER_TEXT} AS t FROM documents)")
def _(spark, sf):
    return _papers_text(spark, sf).select("doc_id", text.doi(F.col("text")).alias("doi"))


@register("agg20_common_year", rf"WITH y AS (SELECT doc_id, unnest(regexp_extract_all(t[1:3000], '\b(?:19|20)\d{{2}}\b')) AS y, generate_subscripts(regexp_extract_all(t[1:3000], '\b(?:19|20)\d{{2}}\b'), 1) AS i FROM (SELECT doc_id, {PAPER_TEXT} AS t FROM documents)), c AS (SELECT doc_id, y::INT AS y, count(*) AS n, min(i) AS first FROM y WHERE y::INT BETWEEN 1990 AND 2100 GROUP BY ALL) SELECT d.doc_id, (SELECT arg_min(y, (-n, first)) FROM c WHERE c.doc_id = d.doc_id) AS year FROM documents d")
def _(spark, sf):
    return _papers_text(spark, sf).select("doc_id", text.common_year(F.col("text")).alias("year"))


@register("agg21_latest_year", rf"SELECT doc_id, list_max([x::INT FOR x IN regexp_extract_all({PAPER_TEXT}, '\b(?:19|20)\d{{2}}\b')]) AS year FROM documents")
def _(spark, sf):
    return _papers_text(spark, sf).select("doc_id", text.latest_year(F.col("text")).alias("year"))


@register("txt05_journal", rf"SELECT doc_id, coalesce(nullif(trim(regexp_extract(t[1:2000], '(?i)(?:Published in|Journal of|Proceedings of)\s+(.+?)[\.\n]'))[1:100], ''), nullif(trim(regexp_extract(t[1:2000], '(?i)(?:Nature|Science|ACS|IEEE|Optics|Applied|Physical Review)\s*[0-9A-Za-z_]*'))[1:100], '')) AS journal FROM (SELECT doc_id, {PAPER_TEXT} AS t FROM documents)")
def _(spark, sf):
    return _papers_text(spark, sf).select("doc_id", text.journal(F.col("text")).alias("journal"))


_FIRST, _LAST = ["Ada", "Alan", "Grace"], ["Lovelace", "Turing", "Hopper", "Noether"]


def _nth(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


@register("txt06_authors", f"SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 > 0 THEN {_FIRST}[c_custkey % 3 + 1] || ' ' || {_LAST}[c_custkey % 4 + 1] || '|Emmy M. Nash' ELSE '' END AS authors FROM customer")
def _(spark, sf):
    name = F.concat(_nth(_FIRST, F.col("c_custkey") % 3), F.lit(" "), _nth(_LAST, F.col("c_custkey") % 4))
    page = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("A title of words\n"), name, F.lit(", Emmy M. Nash\n"), name, F.lit("\nAbstract\nJohn Backus"))).otherwise("nothing here")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.array_join(text.authors(page), "|").alias("authors"))


SECTIONED = "'front' || chr(10) || 'Abstract' || chr(10) || {a} || chr(10) || 'Introduction' || chr(10) || {b} || chr(10) || 'Results and Discussion' || chr(10) || {c} || chr(10) || 'Conclusions' || chr(10) || {d}"


def _quarters() -> list[Column]:
    """The four quarters of a whole text's letters."""
    flat = F.trim(F.regexp_replace("text", r"[^a-z]+", " "))
    size = F.ceil(F.length(flat) / 4).cast("int")
    return [F.concat(F.lit("p "), F.trim(F.substr(flat, size * i + 1, size))) for i in range(4)]


def _paper_sections(spark, sf):
    """Documents dressed as papers: the quarters of the text under known headers."""
    p = _quarters()
    parts = [F.lit("front\nAbstract\n"), p[0], F.lit("\nIntroduction\n"), p[1], F.lit("\nResults and Discussion\n"), p[2], F.lit("\nConclusions\n"), p[3]]
    return table(spark, sf, DOCS).select("doc_id", F.concat(*parts).alias("text"))


FLAT = "WITH flat AS (SELECT doc_id, f, ((length(f) + 3) // 4)::BIGINT AS n FROM (SELECT doc_id, trim(regexp_replace(text, '[^a-z]+', ' ', 'g')) AS f FROM documents)), parts AS (SELECT doc_id, ['p ' || trim(f[1 + n * i:n * i + n]) FOR i IN [0, 1, 2, 3]] AS p FROM flat) "


@register("txt13_sections", FLAT + "SELECT doc_id, unnest(['abstract', 'introduction', 'results_discussion', 'conclusion']) AS section, unnest([rtrim(x) FOR x IN p]) AS text FROM parts")
def _(spark, sf):
    return sections.split_sections(_paper_sections(spark, sf)).select("doc_id", "section", "text")


@register("txt14_heading_sections", FLAT + "SELECT doc_id, unnest(['gap_study', 'lens_setup']) AS section, unnest([rtrim(p[1]), rtrim(p[3])]) AS text FROM parts")
def _(spark, sf):
    p = _quarters()
    docs = table(spark, sf, DOCS).select("doc_id", F.concat(F.lit("0\n1. Gap Study\n"), p[0], F.lit("\n2. Lens Setup\n"), p[1], F.lit("\n3. Lens Setup\n"), p[2]).alias("text"))
    return sections.by_headings(docs).select("doc_id", "section", "text")


@register("txt15_section_names", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'intro_' || lower(replace(n_name, ' ', '_')) WHEN 1 THEN 'method' ELSE 'summary_of_' || lower(replace(n_name, ' ', '_')) END AS name FROM nation")
def _(spark, sf):
    heading = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("IV. Intro "), "n_name", F.lit("!"))).when(F.col("n_nationkey") % 3 == 1, "2.1 Experimental Procedure").otherwise(F.concat(F.lit("(3) Summary-of "), "n_name"))
    return table(spark, sf, "nation").select("n_nationkey", sections.snake_name(heading, {k: v for k, v in sections.SECTION_PATTERNS.items() if k == "method"}).alias("name"))


@register("txt16_whole_text_fallback", "SELECT doc_id, 'full_text' AS section, length(text) AS n FROM documents WHERE NOT contains(text, chr(10))")
def _(spark, sf):
    docs = table(spark, sf, DOCS).where("NOT contains(text, '\\n')")
    return sections.split_sections(docs).select("doc_id", "section", F.length("text").alias("n"))


@register("txt18_phase_inputs", FLAT + "SELECT doc_id, '=== ABSTRACT ===' || chr(10) || rtrim(p[1]) || chr(10) || chr(10) || '=== CONCLUSION ===' || chr(10) || rtrim(p[4]) AS screening, 'results_discussion' AS visual, '' AS recipe, '=== INTRODUCTION ===' || chr(10) || rtrim(p[2]) || chr(10) || chr(10) || '=== RESULTS & DISCUSSION ===' || chr(10) || rtrim(p[3]) AS deep_dive FROM parts")
def _(spark, sf):
    held = sections.section_map(_paper_sections(spark, sf))
    return held.select("doc_id", *(c.alias(n) for n, c in sections.phase_inputs(F.col("sections")).items()))


@register("agg23_section_words", FLAT + "SELECT doc_id, unnest(['abstract', 'introduction', 'results_discussion', 'conclusion']) AS section, unnest([len([w FOR w IN string_split(x, ' ') IF w <> '']) FOR x IN p]) AS n_words FROM parts")
def _(spark, sf):
    return sections.section_sizes(sections.split_sections(_paper_sections(spark, sf))).select("doc_id", "section", "n_words")


@register("agg24_tokens_saved", FLAT + ", dressed AS (SELECT doc_id, len(string_split(p[1] || ' ' || p[2] || ' ' || p[3] || ' ' || p[4], ' ')) + 7 AS n, len(string_split(p[1] || ' ' || p[4], ' ')) + 6 AS m FROM (SELECT doc_id, [rtrim(x) FOR x IN p] AS p FROM parts)) SELECT doc_id, round((n * 1.3::DOUBLE - m * 1.3::DOUBLE) / (n * 1.3::DOUBLE) * 100, 1) AS saved FROM dressed")
def _(spark, sf):
    docs = _paper_sections(spark, sf).select("doc_id", "text", sections.parts_of(F.col("text")).alias("parts"))
    held = F.map_from_entries(F.transform("parts", lambda p: F.struct(p["section"], p["text"])))
    return docs.select("doc_id", text.saved_percent(F.col("text"), sections.phase_inputs(held)["screening"]).alias("saved"))


@register("txt20_word_counts", "SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::INT AS n_words FROM documents")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@register("txt21_method_excerpt", "SELECT doc_id, CASE WHEN i > 1 THEN t[1:3000] || chr(10) || chr(10) || '...' || chr(10) || chr(10) || t[greatest(1, i - 500):greatest(1, i - 500) + 17999] ELSE t[1:20000] END AS excerpt FROM (SELECT doc_id, t, instr(t, 'methods') AS i FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' methods of work ' || text ELSE 'methods ' || text END AS t FROM documents))")
def _(spark, sf):
    docs = table(spark, sf, DOCS)
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" methods of work "), "text")).otherwise(F.concat(F.lit("methods "), "text"))
    return docs.select("doc_id", text.method_excerpt(t).alias("excerpt"))


@register("txt22_prompt_windows", "SELECT doc_id, text[1:800] AS head, CASE WHEN length(text) <= 700 THEN text ELSE text[1:500] || chr(10) || chr(10) || '...' || chr(10) || chr(10) || text[-200:] END AS ends FROM documents")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.window(F.col("text"), 800).alias("head"), text.window(F.col("text"), 500, 200).alias("ends"))


@register("txt23_safe_names", "SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\-.]', '_', 'g'), '_+', '_', 'g')[1:80] AS name FROM documents")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.safe_name(F.col("text")).alias("name"))


@register("txt24_folder_names", "SELECT doc_id, '2024_' || regexp_replace(regexp_replace(source || ' ' || lang, '[^A-Za-z0-9_\\-.]', '_', 'g'), '_+', '_', 'g')[1:40] || '_' || md5(doc_id::VARCHAR)[1:8] AS folder FROM documents")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.folder_name(F.lit(2024), F.concat_ws(" ", "source", "lang"), F.col("doc_id")).alias("folder"))


def _topic_text(spark, sf):
    add = ["", " laser waveguide", " battery cathode", " excellent protein", " qubit spin", " alloy polymer SEM temperature"]
    tail = F.element_at(F.array(*map(F.lit, add)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, DOCS).select("doc_id", F.concat("text", tail).alias("text"))


TOPIC_SQL = "text || ['', ' laser waveguide', ' battery cathode', ' excellent protein', ' qubit spin', ' alloy polymer SEM temperature'][doc_id % 6 + 1]"
HITS = {d: " + ".join(f"contains({'t' if k.isupper() else 'lower(t)'}, '{k}')::INT" for k in ks) for d, ks in TOPIC_WORDS.items()}


@register("txt27_topic", f"WITH s AS (SELECT doc_id, {', '.join(f'{h} AS {d}' for d, h in HITS.items())} FROM (SELECT doc_id, {TOPIC_SQL} AS t FROM documents)), m AS (SELECT *, greatest({', '.join(HITS)}) AS top FROM s), n AS (SELECT doc_id, CASE WHEN top = 0 THEN 'general' {' '.join(f'WHEN {d} = top THEN ' + chr(39) + d + chr(39) for d in HITS)} END AS domain FROM m) SELECT doc_id, domain, CASE domain WHEN 'optics' THEN 'photon' WHEN 'materials' THEN 'crystal' WHEN 'bio' THEN 'helix' WHEN 'energy' THEN 'volt' WHEN 'quantum' THEN 'qubit' ELSE 'atlas' END AS agent FROM n")
def _(spark, sf):
    return classify.classify_topic(_topic_text(spark, sf)).select("doc_id", "domain", "agent")


@register("txt28_weighted_topic", "SELECT o_orderkey AS doc_id, ['optics', 'unknown', 'ai_ml', 'ee'][(o_orderkey % 4 + 1)::INT] AS domain, [0.6, 0.0, 1.0, 0.4][(o_orderkey % 4 + 1)::INT]::DOUBLE AS confidence FROM orders")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), _nth(["Laser beam", "Excellent work", "A neural network", "On things"], kind).alias("title"), _nth(["laser optics", "of cells", "Deep learning with dropout, softmax and a transformer; the laser", "a transistor"], kind).alias("abstract"))
    return classify.classify_weighted(docs).select("doc_id", "domain", "confidence")


@register(
    "txt29_routing_decision",
    "SELECT o_orderkey AS id, ['bio', 'ee', 'optics', 'optics', 'unknown'][k] AS domain, [0.85, 0.68, 0.9, 0.6, 0.0][k]::DOUBLE AS confidence, ['semantic', 'semantic', 'keyword', 'keyword', 'keyword'][k] AS method, [false, true, false, true, true][k] AS needs_confirmation FROM (SELECT o_orderkey, (o_orderkey % 5 + 1)::INT AS k FROM orders)",
)
def _(spark, sf):
    kind = F.col("o_orderkey") % 5
    answers = [["bio", "bio", "optics", "optics", "unknown"], [0.6, 0.4, 0.9, 0.6, 0.0], [0.5, 0.5, 0.5, 0.3, 0.0], ["bio", "ee", "bio", "ee", "ee"], [0.8, 0.8, 0.99, 0.5, 0.0]]
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), classify.decide(*(_nth(a, kind) for a in answers)).alias("d")).select("id", "d.*")


@register("agg29_domain_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {len(a) + len(b)})" for d, (a, b) in ROUTER_WORDS.items()) + ") t(domain, keyword_count)")
def _(spark, sf):
    return classify.domain_sizes(spark)


@register("txt33_fences", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{\"a\":' || o_custkey || '}' WHEN 1 THEN '{\"a\": ' || o_custkey || '}' WHEN 2 THEN 'plain ' || o_custkey ELSE 'graph LR ' || o_custkey END AS body FROM orders")
def _(spark, sf):
    key, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    body = F.when(kind == 0, F.concat(F.lit('```json\n{"a":'), key, F.lit("}\n```"))).when(kind == 1, F.concat(F.lit('{"a": '), key, F.lit("}"))).when(kind == 2, F.concat(F.lit(" plain "), key, F.lit(" "))).otherwise(F.concat(F.lit("text\n```mermaid\ngraph LR "), key, F.lit("\n```\nmore")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(kind == 3, json_tools.fenced(body, "mermaid")).otherwise(json_tools.without_fence(body)).alias("body"))


@register("txt35_node_ids", "SELECT doc_id, CASE WHEN c = '' THEN 'X' WHEN regexp_matches(c, '^[0-9]') THEN 'N' || c ELSE c END AS node, translate(h, '\";#', ''',') AS label FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g') AS c, text AS h FROM documents)")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", diagrams.node_id(F.col("text")).alias("node"), diagrams.label_text(F.col("text")).alias("label"))


@register("txt36_node_colours", "SELECT p_partkey AS id, CASE WHEN contains(n, 'source') THEN '#e1f5fe' WHEN contains(n, 'lens') THEN '#f3e5f5' WHEN contains(n, 'end') THEN '#efebe9' ELSE '#f5f5f5' END AS colour FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Light Source end' WHEN 1 THEN 'lens' WHEN 2 THEN 'the END' ELSE 'x' END AS l, lower(l) AS n FROM part)")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "Light Source end").when(k == 1, "lens").when(k == 2, "the END").otherwise("x")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), diagrams.node_colour(label).alias("colour"))


@register("txt37_word_wrap", "SELECT c_custkey AS id, 'aa bb|' || lpad((c_custkey % 100000)::VARCHAR, 6, 'c') || '|d' AS lines FROM customer")
def _(spark, sf):
    words = F.concat(F.lit("aa bb "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 6, "c"), F.lit(" d"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(text.wrapped(words, 48), "|").alias("lines"))


@register("txt38_short_labels", "SELECT doc_id, CASE WHEN length(text) > 60 THEN text[1:57] || '...' ELSE text END AS label FROM documents")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", text.shorten(F.col("text"), 60, 57).alias("label"))


@register("txt39_file_names", "SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-1] AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@register("txt40_pretty_keys", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Cost Usd ' || p_size ELSE 'By Model ' || p_size END AS pretty FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.pretty_key(F.concat(F.when(F.col("p_size") % 2 == 0, "cost_usd_").otherwise("by_MODEL_"), F.col("p_size").cast("string"))).alias("pretty"))


@register("src07_pages_joined", "SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return text.pages_text(pages)


@register("src08_changed_texts", "SELECT doc_id, sha256(text)[1:16] AS hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def _(spark, sf):
    docs = table(spark, sf, DOCS)
    cached = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(files.content_hash(F.col("text").cast("binary"))).alias("hash"))
    return files.changed(docs.select("doc_id", F.col("text").cast("binary").alias("content")), cached).select("doc_id", "hash")


@register("jsn01_valid_or_wrapped", L + "SELECT id, CASE WHEN trim(result) = '' OR NOT json_valid(result) THEN 'wrapped' ELSE result END AS result FROM results")
def _(spark, sf):
    wrapped = json_tools.valid_or_wrapped(F.col("result"))
    return results(spark, sf).select("id", F.when(F.get_json_object(wrapped, "$._raw").isNotNull(), "wrapped").otherwise(wrapped).alias("result"))


@register("jsn03_fields_with_aliases", L + "SELECT id, CASE WHEN trim(result) <> '' AND json_valid(result) THEN coalesce(json_extract_string(result, '$.relevance_score'), json_extract_string(result, '$.relevance'), '0') ELSE '0' END AS relevance FROM results")
def _(spark, sf):
    return results(spark, sf).select("id", json_tools.field(F.col("result"), "relevance_score", "relevance", default="0").alias("relevance"))


@register("jsn08_list_salvage", "SELECT o_orderkey AS id, [2, 1, 2, 1, NULL][(o_orderkey % 5 + 1)::INT] AS n FROM orders")
def _(spark, sf):
    answers = ['[{"title":"%"},{"title":"b"}]', '{"visualizations":[{"title":"%"}]}', 'so: [{"title":"%"},{"title":"b"}] done', '{"title":"%"}', "none %"]
    answer = F.replace(_nth(answers, F.col("o_orderkey") % 5), F.lit("%"), F.col("o_orderpriority"))
    found = json_tools.list_of(F.col("t"), "struct<title:string>")
    return table(spark, sf, "orders").select("o_orderkey", answer.alias("t")).select(F.col("o_orderkey").alias("id"), F.when(found.isNotNull(), F.size(found)).alias("n"))


@register("jsn_event_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("mth02_relevance_bucket", "SELECT event_id, CASE WHEN v >= 0.7 THEN 'High' WHEN v >= 0.4 THEN 'Medium' ELSE 'Low' END || ' (' || round(v * 100)::INT || '%)' AS bucket FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS v FROM events)")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", reports.relevance(F.col("event_id") % 100 / F.lit(100.0)).alias("bucket"))


@register("mth03_figure_quality", "SELECT p_partkey AS id, CASE WHEN least(w, h) < 200 THEN 'low' WHEN least(w, h) < 400 THEN 'medium' ELSE 'high' END AS quality FROM (SELECT p_partkey, p_size * 20 AS w, p_retailprice - 600 AS h FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), geometry.quality(F.col("p_size") * 20, F.col("p_retailprice") - 600).alias("quality"))


@register("rpt09_synonyms", "SELECT o_orderkey, w[1] AS word, w[2] AS status, w[3] AS quality FROM (SELECT o_orderkey, [['[GREEN]', 'EXPLICIT', '[GREEN]'], ['estimated', 'INFERRED', 'estimated'], ['good', 'good', 'Good'], [o_orderpriority, o_orderpriority, o_orderpriority]][(o_orderkey % 4 + 1)::INT] AS w FROM orders)")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.coalesce(_nth(["[GREEN]", "estimated", "good", None], F.col("o_orderkey") % 4), "o_orderpriority").alias("word"))
    return df.select("o_orderkey", "word", reports.status_name(F.col("word")).alias("status"), reports.quality_name(F.col("word")).alias("quality"))


_SUMMARY = "json_extract_string(result, '$.summary')"
_TOPICS = "chr(10) || chr(10) || '**Key Topics:**' || chr(10) || '- a' || chr(10) || '- b'"
#: A result as the report shows it: the results are blank, no JSON, errors or summaries with two topics.
SHOWN = f"""CASE WHEN o6 < 2 THEN result
WHEN phase = 'screening' THEN '**Domain:** N/A' || chr(10) || '**Relevance Score:** N/A' || chr(10) || '**Methodology:** N/A' || chr(10) || '**Complexity:** N/A' || chr(10) || chr(10) || '**Summary:** ' || coalesce({_SUMMARY}, 'N/A') || CASE WHEN o6 > 3 THEN {_TOPICS} ELSE '' END
WHEN phase = 'visual' THEN '**Figures:** 0' || chr(10) || '**Tables:** 0' || chr(10) || '**Equations:** 0' || chr(10) || chr(10) || '**Quality:** N/A'
WHEN phase = 'recipe' THEN '**Title:** N/A' || chr(10) || '**Objective:** N/A' || chr(10) || '**Confidence:** N/A' || chr(10) || '**Reproducibility:** N/A'
WHEN phase = 'deep_dive' THEN chr(10) || chr(10) || chr(10) || '**Novelty:** N/A'
WHEN o6 = 2 THEN '{{' || chr(10) || '  "error": "e"' || chr(10) || '}}'
WHEN o6 = 3 THEN '{{' || chr(10) || '  "_parse_error": "p",' || chr(10) || '  "x": 1' || chr(10) || '}}'
ELSE '{{' || chr(10) || '  "summary": "' || {_SUMMARY} || '",' || chr(10) || '  "relevance": ' || regexp_extract(result, 'relevance": ([0-9.]+)', 1)::DOUBLE::VARCHAR || ',' || chr(10) || '  "key_topics": [' || chr(10) || '    "a",' || chr(10) || '    "b"' || chr(10) || '  ]' || chr(10) || '}}' END"""


REPORTS_SQL = L + """SELECT p.id AS paper_id, '# Analysis Report: ' || title || chr(10) || chr(10) || '**Authors:** ' || coalesce(authors, 'N/A') || chr(10) || '**Year:** ' || coalesce(year::VARCHAR, 'N/A') || chr(10) || '**Journal:** ' || journal || chr(10) || '**Domain:** ' || domain || chr(10) || chr(10) || body || chr(10)
|| '## Cost Summary' || chr(10) || chr(10) || '- **Total Cost:** $' || printf('%.4f', cost) || chr(10) || '- **Total Tokens In:** ' || format('{:,}', i) || chr(10) || '- **Total Tokens Out:** ' || format('{:,}', o) AS markdown
FROM papers p JOIN (SELECT paper_id, string_agg('## ' || CASE phase WHEN 'screening' THEN 'Phase 1: Screening' WHEN 'visual' THEN 'Phase 2: Visual Verification' WHEN 'recipe' THEN 'Phase 3: Recipe Extraction' WHEN 'deep_dive' THEN 'Phase 4: Deep Dive Analysis' WHEN 'viz_plan' THEN 'Viz Plan' ELSE 'Visualization' END || chr(10) || chr(10) || '*Model: ' || coalesce(model_used, 'N/A') || ' | Tokens: ' || format('{:,}', tokens_in) || ' in / ' || format('{:,}', tokens_out) || ' out | Cost: $' || printf('%.4f', cost_usd) || '*' || chr(10) || chr(10) || """ + SHOWN + """ || chr(10), chr(10) ORDER BY created_at, id) AS body,
sum(cost_usd::DECIMAL(20, 8))::DOUBLE AS cost, sum(tokens_in)::BIGINT AS i, sum(tokens_out)::BIGINT AS o FROM (SELECT *, id % 6 AS o6 FROM results) WHERE phase <> 'error' GROUP BY paper_id) r ON r.paper_id = p.id"""


@register("rpt01_reports", REPORTS_SQL)
def _(spark, sf):
    return phase_markdown.report(papers(spark, sf), results(spark, sf))


@register("snk01_written_reports", f"SELECT 'paper_' || paper_id || '/analysis.md' AS file, sha256(markdown) AS digest FROM ({REPORTS_SQL})")
def _(spark, sf):
    written = phase_markdown.report(papers(spark, sf), results(spark, sf)).select(F.concat(F.lit("paper_"), F.col("paper_id").cast("string"), F.lit("/analysis.md")).alias("file"), F.col("markdown").alias("content"))
    path = dropped_at_exit(spark, shared_path(spark, "reports"))
    text_files.register(spark)
    written.write.format("text_files").option("path", path).mode("append").save()
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("digest"))


RECIPE = '{"materials":["m1","m2"],"equipment":["e1"],"parameters":[{"name":"T","value":"5","unit":"K","notes":"a,b"}],"steps":["s1"],"critical_notes":[]}'


@register("snk02_recipe_csv", "SELECT p_partkey, unnest(['Material,1,' || p_brand, 'Material,2,m2', 'Equipment,1,e1', 'Parameter,T,\"' || p_size || ' K (a,b)\"', 'Step,1,s1']) AS line FROM part")
def _(spark, sf):
    from folioforge.schemas import RECIPE as schema

    filled = F.replace(F.replace(F.lit(RECIPE), F.lit('"m1"'), F.concat(F.lit('"'), "p_brand", F.lit('"'))), F.lit('"5"'), F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"')))
    recipes = table(spark, sf, "part").select("p_partkey", F.from_json(filled, schema).alias("recipe"))
    return reports.recipe_rows(recipes, "p_partkey").select("p_partkey", reports.csv_line(F.col("section"), F.col("name"), F.col("value")).alias("line"))


@register("arr02_steps_exploded", "SELECT doc_id, unnest(string_split(text, chr(10))) AS step, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents")
def _(spark, sf):
    steps = table(spark, sf, DOCS).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "step"))
    return steps.select("doc_id", "step", (F.col("i") + 1).alias("n"))


@register("viz01_renderer", "SELECT o_orderkey AS id, ['mermaid', 'paperbanana', 'mermaid', 'paperbanana'][(o_orderkey % 4 + 1)::INT] AS target FROM orders")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), classify.renderer(_nth(["timeline", "", "", "physical_setup"], kind), _nth(["photo of bench", "photo of bench setup", "", "protocol step"], kind)).alias("target"))


@register("viz01_renderer_of_texts", f"SELECT doc_id, CASE WHEN b > a THEN 'paperbanana' ELSE 'mermaid' END AS target FROM (SELECT doc_id, {' + '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})::INT' for w in MERMAID_WORDS)} AS a, {' + '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})::INT' for w in PICTURE_WORDS)} AS b FROM documents)")
def _(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", classify.renderer(F.lit(""), F.col("text")).alias("target"))


@register("viz02_step_chains", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, len(s)::INT AS n_nodes, CASE WHEN len(s) > 0 THEN 'A' END AS first_id, (len(s) - 1)::INT AS n_edges FROM s")
def _(spark, sf):
    nodes = diagrams.step_nodes(F.split("text", "\n"))
    held = table(spark, sf, DOCS).select("doc_id", nodes.alias("n"))
    return held.select("doc_id", F.size("n").alias("n_nodes"), F.get("n", F.lit(0))["id"].alias("first_id"), F.size(diagrams.chain(F.col("n"))).alias("n_edges"))


@register("viz05_flowchart", "SELECT n_nationkey AS id, 'graph LR' || chr(10) || '    A[laser]' || chr(10) || '    N1_x[b' || n_nationkey || ']' || chr(10) || '    A --> N1_x' || chr(10) || chr(10) || '    style A fill:#e1f5fe' || chr(10) || '    style N1_x fill:#f5f5f5' AS mermaid FROM nation")
def _(spark, sf):
    node = lambda i, label: F.struct(F.lit(i).alias("id"), label.alias("label"))
    nodes = F.array(node("A", F.lit("laser")), node("1-x", F.concat(F.lit("b"), F.col("n_nationkey").cast("string"))))
    none = F.array().cast("array<struct<source:string,target:string,label:string>>")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), diagrams.flowchart(nodes, none).alias("mermaid"))


@register("viz08_letter_ids", "SELECT n_nationkey AS i, CASE WHEN n_nationkey + 3 < 26 THEN chr(65 + n_nationkey + 3) ELSE 'N' || (n_nationkey + 3) END AS id FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), diagrams.letter_id(F.col("n_nationkey") + 3).alias("id"))


@register("txt07_caption_definitions", "SELECT c_custkey AS doc_id, 2 AS page_no, n AS fig_num, CASE n WHEN 1 THEN 'Setup of ' || c_mktsegment ELSE 'A long caption ' || c_custkey END AS caption FROM customer, (VALUES (1), (2)) v(n)")
def _(spark, sf):
    first = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("see Fig. 1 for").alias("text"))
    body = F.concat(F.lit("x\nFig. 1. Setup of "), "c_mktsegment", F.lit("\nFigure 2:\nA long caption "), F.col("c_custkey").cast("string"), F.lit("\nFig. 1: again and again"))
    return captions.definitions(first.union(table(spark, sf, "customer").select("c_custkey", F.lit(2), body)))


@register("txt10_structured_caption", "SELECT p_partkey, 'Setup' AS title, 'A=' || p_type || '|B=Detector ' || p_size AS parts FROM part")
def _(spark, sf):
    caption = F.concat(F.lit("Setup. (A) "), "p_type", F.lit(". (B) Detector "), F.col("p_size").cast("string"), F.lit(";"))
    df = table(spark, sf, "part").select("p_partkey", captions.structured(caption).alias("s"))
    return df.select("p_partkey", "s.title", F.array_join(F.transform("s.sub_captions", lambda x: F.concat(x["label"], F.lit("="), x["text"])), "|").alias("parts"))


@register("jon05_captions_near_pages", "SELECT c_custkey AS doc_id, 'p2_fig1' AS figure_num, 'Fig. 1. ' || c_mktsegment AS caption FROM customer UNION ALL SELECT c_custkey, 'p2_fig2', 'Fig. 2. b' FROM customer WHERE c_custkey % 2 = 1")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    figures = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(f"p2_fig{n}").alias("figure_num")) for n in (1, 2)))).alias("f")).select("doc_id", "f.*")
    found = rows.select("doc_id", F.lit(2).alias("page_no"), F.lit(1).alias("fig_num"), F.col("c_mktsegment").alias("caption")).union(rows.where("doc_id % 2 = 1").select("doc_id", F.lit(3), F.lit(2), F.lit("b")))
    return captions.match_near_pages(figures, found)


def _boxes(spark, sf):
    """Orders as boxes on pages of a few boxes each."""
    o = table(spark, sf, "orders")
    x, y = (F.col("o_orderkey") * 37 % 500).cast("double"), (F.col("o_orderkey") * 91 % 700).cast("double")
    return o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("o_orderkey").cast("int").alias("rect_no"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 60).alias("y1"))


BOXES_SQL = "WITH RECURSIVE b AS (SELECT o_custkey AS doc_id, o_orderkey AS n, (o_orderkey * 37 % 500)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0 FROM orders), e AS (SELECT p.doc_id, p.n AS a, q.n AS b FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.n <> q.n AND abs(p.x0 - q.x0) < 80 AND abs(p.y0 - q.y0) < 80)"


@register(
    "src09_cell_grids",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
p AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM l WHERE contains(line, '|')),
c AS (SELECT doc_id, run, k, [trim(x, ' ') FOR x IN string_split(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '|')] AS cells FROM p WHERE NOT regexp_matches(line, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$')),
t AS (SELECT doc_id, min(k) AS first_line, count(*) AS n_rows, max(len(cells)) AS width, string_agg(array_to_string(cells, ' / ') || repeat(' / ', 0), chr(10) ORDER BY k) AS body FROM c GROUP BY doc_id, run HAVING count(*) >= 2 AND max(len(cells)) > 1)
SELECT doc_id, 'table_' || row_number() OVER (ORDER BY doc_id, first_line) AS table_id, first_line::INT AS first_line, n_rows::INT AS n_rows, width::INT AS width, body FROM t""",
)
def _(spark, sf):
    found = grids.text_grids(table(spark, sf, DOCS))
    body = F.array_join(F.transform("grid", lambda r: F.array_join(r, " / ")), "\n")  # nulls of short rows are left out
    return found.select("doc_id", "table_id", "first_line", F.size("grid").alias("n_rows"), F.size(F.col("grid")[0]).alias("width"), body.alias("body"))


@register("jon11_touching_boxes", BOXES_SQL + " SELECT doc_id, a::INT AS a, b::INT AS b FROM e WHERE a < b")
def _(spark, sf):
    return geometry.touching(_boxes(spark, sf)).select("doc_id", "a", "b")


@register("geo01_box_groups", BOXES_SQL + ", r AS (SELECT doc_id, n, n AS m FROM b UNION SELECT r.doc_id, e.b, r.m FROM r JOIN e ON e.doc_id = r.doc_id AND e.a = r.n), g AS (SELECT doc_id, n, min(m) AS m FROM r GROUP BY ALL) SELECT doc_id, n::INT AS rect_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY m)::INT AS group_no FROM g")
def _(spark, sf):
    return geometry.group_boxes(_boxes(spark, sf)).select("doc_id", "rect_no", "group_no")


@register("geo02_clips", "SELECT o_custkey AS doc_id, greatest(min(o_orderkey * 37 % 500) - 8, 0)::DOUBLE AS x0, greatest(min(o_orderkey * 91 % 700) - 8, 0)::DOUBLE AS y0, least(max(o_orderkey * 37 % 500) + 68, 540)::DOUBLE AS x1, least(max(o_orderkey * 91 % 700) + 68, 740)::DOUBLE AS y1 FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return geometry.clipped(geometry.union_boxes(_boxes(spark, sf), ["doc_id"]), F.lit(540.0), F.lit(740.0)).select("doc_id", "x0", "y0", "x1", "y1")


@register("geo04_distances", "SELECT p.n::INT AS a, q.n::INT AS b, round(sqrt(greatest(0, abs(p.x0 - q.x0) - 60) ** 2 + greatest(0, abs(p.y0 - q.y0) - 60) ** 2), 6) AS d FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.n < q.n".join([BOXES_SQL + " ", ""]))
def _(spark, sf):
    x, y = _boxes(spark, sf).alias("x"), _boxes(spark, sf).alias("y")
    four = lambda t: [F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")]
    both = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.rect_no") < F.col("y.rect_no")))
    return both.select(F.col("x.rect_no").alias("a"), F.col("y.rect_no").alias("b"), F.round(geometry.distance(four("x"), four("y")), 6).alias("d"))


@register("geo07_absolute_boxes", "WITH b AS (SELECT o_orderkey AS id, (o_orderkey % 10) / 10::DOUBLE AS x0, (o_orderkey % 7) / 10::DOUBLE AS y0, (o_orderkey % 13) / 10::DOUBLE AS x1, 1::DOUBLE AS y1 FROM orders), p AS (SELECT id, least(trunc(x0 * 200), 200)::INT AS x0, least(trunc(y0 * 100), 100)::INT AS y0, least(trunc(x1 * 200), 200)::INT AS x1, least(trunc(y1 * 100), 100)::INT AS y1 FROM b) SELECT * FROM p WHERE x1 > x0 AND y1 > y0")
def _(spark, sf):
    tenth = lambda n: (F.col("o_orderkey") % n) / F.lit(10.0)
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tenth(10).alias("x0"), tenth(7).alias("y0"), tenth(13).alias("x1"), F.lit(1.0).alias("y1"))
    return geometry.absolute(df, F.lit(200), F.lit(100))


def clusters_sql(boxes: str) -> str:
    """Steps of a recursive query: boxes (doc_id, page_no, n, x0, y0, x1, y1) in order, each with its leader."""
    apart = "sqrt(greatest(0, greatest(l.x0, o.x0) - least(l.x1, o.x1)) ** 2 + greatest(0, greatest(l.y0, o.y0) - least(l.y1, o.y1)) ** 2)"
    return f"""WITH RECURSIVE box AS ({boxes}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, n) AS k FROM box),
walk AS (
  SELECT DISTINCT doc_id, page_no, 0::BIGINT AS k, [{{'k': 0::BIGINT, 'x0': 0::DOUBLE, 'y0': 0::DOUBLE, 'x1': 0::DOUBLE, 'y1': 0::DOUBLE}}][2:] AS leaders, 0::BIGINT AS leader FROM box
  UNION ALL
  SELECT doc_id, page_no, k, CASE WHEN near IS NULL THEN list_append(leaders, own) ELSE leaders END, coalesce(near, k)
  FROM (SELECT o.doc_id, o.page_no, o.k, w.leaders, {{'k': o.k, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}} AS own, list_min([l.k FOR l IN w.leaders IF {apart} < 50]) AS near FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page_no = w.page_no AND o.k = w.k + 1)
),
grouped AS (SELECT o.*, dense_rank() OVER (PARTITION BY o.doc_id, o.page_no ORDER BY w.leader) AS group_no FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.page_no = w.page_no AND o.k = w.k)"""


@register("geo03_leader_clusters", clusters_sql("SELECT o_custkey AS doc_id, 1 AS page_no, o_orderkey AS n, (o_orderkey * 37 % 500)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0, x0 + 60 AS x1, y0 + 60 AS y1 FROM orders") + " SELECT doc_id, page_no, n::INT AS rect_no, group_no::INT AS group_no FROM grouped")
def _(spark, sf):
    return geometry.leader_clusters(_boxes(spark, sf))


#: Images of different sizes on two pages a document.
_IMAGES = "SELECT o_custkey AS doc_id, CAST(o_orderkey % 2 + 1 AS INT) AS page_no, CAST(o_orderkey AS INT) AS n, CAST(o_orderkey * 37 % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 91 % 700 AS DOUBLE) AS y0, CAST(o_orderkey * 37 % 500 + 60 + o_orderkey * 13 % 240 AS DOUBLE) AS x1, CAST(o_orderkey * 91 % 700 + 60 + o_orderkey * 29 % 240 AS DOUBLE) AS y1 FROM orders"


def _images(spark, sf):
    return spark.sql(_IMAGES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")).withColumnRenamed("n", "rect_no")


@register(
    "geo08_large_regions",
    clusters_sql(f"SELECT * FROM ({_IMAGES}) WHERE x1 - x0 >= 150 AND y1 - y0 >= 150") + """, r AS (SELECT doc_id, page_no, group_no, greatest(min(x0) - 10, 0) AS x0, greatest(min(y0) - 10, 0) AS y0, least(max(x1) + 10, 612) AS x1, least(max(y1) + 10, 792) AS y1 FROM grouped GROUP BY ALL)
SELECT doc_id, page_no, 'figure_' || row_number() OVER (PARTITION BY doc_id ORDER BY page_no, group_no) AS figure_id, x0, y0, x1, y1 FROM r WHERE floor((x1 - x0) * 2) >= 200 AND floor((y1 - y0) * 2) >= 200""",
)
def _(spark, sf):
    images = _images(spark, sf)
    pages = images.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return geometry.large_regions(images, pages)


@register("src10_image_boxes", f"SELECT doc_id, page_no, n AS rect_no, least(x1 - x0, y1 - y0) >= 100 AS shown, least(x1 - x0, y1 - y0) >= 150 AS large FROM ({_IMAGES}) WHERE x1 - x0 >= 80 AND y1 - y0 >= 80")
def _(spark, sf):
    return geometry.image_boxes(_images(spark, sf), 80, {"shown": 100, "large": 150})


@register("geo05_figure_regions")
def _(spark, sf):
    boxes = _boxes(spark, sf)
    heads = boxes.where("rect_no % 2 = 0").select("doc_id", "page_no", F.col("rect_no").alias("caption_no"), "x0", (F.col("y0") + 70).alias("y0"), "x1")
    return geometry.figure_regions(heads, boxes.where("rect_no % 3 <> 0"))


@register(
    "win08_merged_boxes",
    """WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, (o_orderkey * 37 % 500)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 91 % 700, o_orderkey * 37 % 500) AS k FROM orders),
m AS (
  SELECT doc_id, k, x0, y0, x0 + 60 AS x1, y0 + 60 AS y1, 1 AS merged FROM o WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN near THEN least(x0, ox) ELSE ox END, CASE WHEN near THEN least(y0, oy) ELSE oy END, CASE WHEN near THEN greatest(x1, ox + 60) ELSE ox + 60 END, CASE WHEN near THEN greatest(y1, oy + 60) ELSE oy + 60 END, merged + (NOT near)::INT
  FROM (SELECT m.doc_id, o.k, m.x0, m.y0, m.x1, m.y1, m.merged, o.x0 AS ox, o.y0 AS oy, o.y0 - m.y1 <= 30 AND o.x0 - m.x1 <= 30 AND m.x0 - (o.x0 + 60) <= 30 AS near FROM m JOIN o ON o.doc_id = m.doc_id AND o.k = m.k + 1)
)
SELECT doc_id, max(k)::INT AS n, max(merged)::INT AS merged FROM m GROUP BY doc_id""",
)
def _(spark, sf):
    pages = _boxes(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
    return pages.select("doc_id", F.size("b").alias("n"), F.size(geometry.merge_in_order(F.col("b"))).alias("merged"))


@register("rpt13_summary_inputs", L + "SELECT paper_id, count(*) AS phases FROM (SELECT DISTINCT paper_id, phase FROM results WHERE phase <> 'error') GROUP BY paper_id")
def _(spark, sf):
    return latest(results(spark, sf).where("phase <> 'error'"), ["paper_id", "phase"], ["created_at", "id"]).groupBy("paper_id").agg(F.count("*").alias("phases"))
