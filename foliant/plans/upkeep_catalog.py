"""Named queries over sources, curation, pages, seeds and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import folds, text
from foliant.operators import answers, collate, curation, entities, layout, mutate, pages, search, seeds, stats
from foliant.plans.catalog import _BOX_SQL, _MENTION_SQL, FOLD, HIT, _boxes, _entities, _mentions, _wiki
from foliant.plans.registry import query
from foliant.plans.search_plan import Planner
from foliant.sources import bibtex, corpus, ocr, texts
from foliant.sources.corpus import table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"

# --- sources -----------------------------------------------------------------------


@query(rf"""WITH {_D}, r AS (SELECT doc_id, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS l FROM d)
SELECT doc_id, i::INT AS line_num, regexp_replace(l[i], '\s+$', '') AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM r)""", model=False)
def markdown_lines(spark, sf):
    return texts.markdown_lines(_documents(spark, sf)).select("doc_id", F.col("line_num").cast("int").alias("line_num"), "text")


_MARKED = "'# ' || source || chr(10) || '1. > ' || text || chr(10) || chr(10) || '- **' || source || '** `x`' || chr(10) || '2) two' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'end__'"


@query(rf"""WITH {_D}, p AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_MARKED}, '\n\s*\n'), lambda p: trim(regexp_replace(regexp_replace(regexp_replace(p, '(?m)^[ \t]*(?:#{{1,6}}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)+', '', 'g'), '\*\*|`', '', 'g'), '\s*\n\s*', ' ', 'g'))), lambda p: p <> '') AS l FROM d)
SELECT doc_id, i::INT AS block_num, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p)""", model=False)
def native_paragraphs(spark, sf):
    d = _documents(spark, sf)
    c = F.concat(F.lit("# "), "source", F.lit("\n1. > "), "text", F.lit("\n\n- **"), "source", F.lit("** `x`\n2) two\n\n \n\nend__"))
    return texts.native_lines(d.select("doc_id", F.lit(1).alias("page_num"), c.alias("text"))).select("doc_id", F.col("block_num").cast("int").alias("block_num"), "text")


def _responses(spark, sf):
    """Recognition answers in the three shapes, by id."""
    d = _documents(spark, sf)
    block = lambda label, content: F.struct(F.lit(label).alias("block_label"), content.alias("block_content"), F.array(*[F.lit(float(x)) for x in (0, 0, 100, 20)]).alias("block_bbox"))
    page = F.struct(
        F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"),
        F.array(block("header", F.col("source")), block("text", F.col("text")), block("text", F.lit("  ")), block("table", F.to_json(F.struct(F.col("source").alias("html")))), block("text", F.coalesce("lang", F.lit("")))).alias("parsing_res_list"),
    )
    shapes = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(page))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("result")))).otherwise(F.to_json(F.struct(F.array(F.struct(page.alias("prunedResult"))).alias("layoutParsingResults"))))
    return d.select("doc_id", shapes.alias("response"))


@query(f"""WITH {_D}, b AS (SELECT doc_id, unnest([trim(text), source, coalesce(lang, '')]) AS text, unnest([1, 2, 3]) AS i, unnest(['text', 'table', 'text']) AS block_label FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS block_num, text, block_label FROM b WHERE trim(text) <> ''""", model=False)
def recognised_lines(spark, sf):
    return ocr.lines(ocr.pages(_responses(spark, sf))).select("doc_id", "block_num", "text", "block_label")


@query(f"""WITH {_D} SELECT doc_id, 0 AS pos, 'title' AS block_label, source AS text FROM d UNION ALL SELECT doc_id, 1, 'text', trim(regexp_replace(text, '[^a-z ]', '', 'g')) FROM d""", model=False)
def grounding_blocks(spark, sf):
    body = F.regexp_replace("text", "[^a-z ]", "")
    markup = F.concat(F.lit("![title+](1, 2, 3, 4) ## **"), "source", F.lit("**\n![](10,20,30.5,40) "), body)
    return ocr.grounding(_documents(spark, sf).select("doc_id", markup.alias("markup"))).select("doc_id", "pos", "block_label", "text")


@query(f"""WITH {_D} SELECT doc_id, 0 AS pos, 'title' AS block_label, source AS text, 0.1 AS x0 FROM d WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 1, 'text', coalesce(lang, ''), 5.0 FROM d WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 0, 'text', source, NULL FROM d WHERE doc_id % 3 = 2""", model=False)
def layout_elements(spark, sf):
    d = _documents(spark, sf)
    el = F.array(
        F.to_json(F.struct(F.lit("title").alias("type"), F.col("source").alias("content"), F.array(F.lit(10), F.lit(20), F.lit(30), F.lit(40)).alias("bbox"), F.lit(100).alias("width"), F.lit(200).alias("height"))),
        F.to_json(F.struct(F.lit("text").alias("label"), F.coalesce("lang", F.lit("")).alias("md"), F.array(F.lit(5), F.lit(6), F.lit(7), F.lit(8)).alias("box"))),
    )
    flat = F.concat(F.lit("["), F.array_join(el, ","), F.lit("]"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"layout_details":'), flat, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"layout_details":['), flat, F.lit("]}"))).otherwise(F.to_json(F.struct(F.col("source").alias("md_results"))))
    return ocr.layout_details(d.select("doc_id", body.alias("response"))).select("doc_id", "pos", "block_label", "text", F.col("bbox")[0].alias("x0"))


@query("""SELECT '@article' AS type, 'k' || p_partkey AS cite_key, 'author=' || p_brand || '|note=' || p_type || '|size=' || p_size || '|title=' || p_name || ' {x}' AS fields FROM part""", model=False)
def bibtex_entries(spark, sf):
    p = table(spark, sf, "part")
    t = F.concat(F.lit("% head\n@string{a = {b}}\n@Article(k"), "p_partkey", F.lit(",\n  Title = {"), "p_name", F.lit(" {x}},\n author = \""), "p_brand", F.lit("\",\n empty = {},\n Size = "), "p_size", F.lit(",\n note = {"), "p_type", F.lit("}\n)\n@misc{open, a = {"))
    e = bibtex.read_bibtex(p.select(t.alias("value")))
    pairs = F.array_sort(F.transform("fields", lambda f: F.concat(f["k"], F.lit("="), f["v"])))
    return e.select("type", "cite_key", F.array_join(pairs, "|").alias("fields"))


@query(f"""WITH {_D} SELECT lang AS kind, trim(w) AS term FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM d WHERE lang IS NOT NULL) WHERE trim(w) <> '' GROUP BY ALL""", model=False)
def vocabulary_terms(spark, sf):
    t = _documents(spark, sf).filter("lang IS NOT NULL").select(F.col("lang").alias("kind"), F.explode(F.split("text", " ")).alias("raw")).select("kind", F.trim("raw").alias("term")).filter("term <> ''")
    return pages.vocabulary_of(t)


@query(rf"""WITH {_D} SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^#{{1,6}}[\t\n\v\f\r ]*', '', 'g'), '\*\*|__|\*', '', 'g') AS plain FROM d""", model=False)
def transcript_texts(spark, sf):
    return _documents(spark, sf).select("doc_id", texts.transcript_text(F.col("text")).alias("plain"))


@query(", n AS (SELECT DISTINCT doc_id FROM blocks) SELECT id, '---' || chr(10) || 'title: ' || replace(to_json(title), chr(92) || '/', '/') || chr(10) || 'year: ' || to_json(bib_year) || chr(10) || '---' || chr(10) AS head FROM docs WHERE title IS NOT NULL")
def front_matter(spark, sf):
    d = corpus.documents(spark, sf).filter("title IS NOT NULL")
    return d.select("id", texts.front_matter({"title": F.col("title"), "note": F.lit(None).cast("string"), "year": F.col("bib_year")}).alias("head"))


@query("SELECT doc_id, page_num, string_agg(CASE WHEN block_label = 'text' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY block_num, line_num) AS text FROM lines WHERE block_label NOT IN ('header', 'footer') GROUP BY doc_id, page_num")
def plain_pages(spark, sf):
    l = corpus.lines(spark, sf).withColumn("block_label", F.when(F.col("block_label") == "text", "title").otherwise(F.col("block_label")))
    return ocr.plain_text(l)


@query("SELECT doc_id, count(*) AS pages, count(DISTINCT page_num) AS numbers, sum(len)::BIGINT AS chars FROM (SELECT doc_id, page_num, sum(length(text)) AS len FROM lines GROUP BY ALL) GROUP BY doc_id")
def document_content(spark, sf):
    c = texts.document_content(corpus.lines(spark, sf))
    chars = F.aggregate(F.flatten(F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: F.transform(b["lines"], lambda l: F.length(l["text"])))))), F.lit(0).cast("long"), lambda s, x: s + x)
    return c.select("doc_id", F.size("pages").cast("long").alias("pages"), F.size(F.array_distinct(F.transform("pages", lambda p: p["page_num"]))).cast("long").alias("numbers"), chars.alias("chars"))


# --- text functions ------------------------------------------------------------------


@query(f"""SELECT id, CASE WHEN strpos(lower(title), 'e') > 0 THEN substr(title, greatest(strpos(lower(title), 'e') - 4, 1), 10 - greatest(4 - strpos(lower(title), 'e') + 1, 0)) ELSE substr(title, 1, 10) END AS cut FROM docs""")
def snippets(spark, sf):
    return corpus.documents(spark, sf).select("id", text.snippet(F.col("title"), "e", 4, 6).alias("cut"))


@query("""SELECT o_orderkey, t AS bib_type, CASE WHEN t IN ('@article', '@mastersthesis', '@phdthesis', '@inproceedings') THEN 'paper' WHEN t IN ('@book') THEN 'book' ELSE 'other' END AS kind FROM
(SELECT o_orderkey, ['@article', '@mastersthesis', '@phdthesis', '@inproceedings', '@online', '@online', '@book', ''][1 + o_orderkey % 8] AS t FROM orders)""", model=False)
def bib_types(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("Article", "thesis", "@Thesis", "@conference", "electronic", " @WWW ", "book", ""))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    sub = F.when(F.col("o_orderkey") % 8 == 1, "MathesIS: mathesis")
    o = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), sub.alias("sub"))
    t = bibtex.bib_type(F.col("raw"), F.col("sub"))
    return o.select("o_orderkey", t.alias("bib_type"), bibtex.doc_kind(t).alias("kind"))


_CN = "['', '一', '二', '三', '四', '五', '六', '七', '八', '九']"
_CN_SQL = f"CASE WHEN n >= 100 THEN {_CN}[1 + n // 100] || '百' ELSE '' END || CASE WHEN n // 10 % 10 > 1 THEN {_CN}[1 + n // 10 % 10] || '十' WHEN n // 10 % 10 = 1 THEN '十' ELSE '' END || {_CN}[1 + n % 10]"


def _numerals(spark, sf):
    """Numbers from 1 to 999 and the same in Chinese, by order."""
    n = (F.col("o_orderkey") % 999 + 1).cast("int")
    digits = F.array(*map(F.lit, "_一二三四五六七八九"))
    digit = lambda d: F.when(d == 0, "").otherwise(F.element_at(digits, (d + 1).cast("int")))
    tens = F.floor(n / 10) % 10
    word = F.concat(F.when(n >= 100, F.concat(digit(F.floor(n / 100)), F.lit("百"))).otherwise(""), F.when(tens > 1, F.concat(digit(tens), F.lit("十"))).when(tens == 1, "十").otherwise(""), digit(n % 10))
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n"), word.alias("word"))


@query("SELECT o_orderkey, (o_orderkey % 999 + 1)::INT AS n, (o_orderkey % 999 + 1)::INT AS read FROM orders", model=False)
def chinese_numbers(spark, sf):
    return _numerals(spark, sf).select("o_orderkey", "n", bibtex.chinese_number(F.col("word")).alias("read"))


@query(f"""SELECT o_orderkey, CASE WHEN n <= 99 THEN 'v' || n ELSE '' END AS volume FROM (SELECT o_orderkey, (o_orderkey % 999 + 1) AS n FROM orders)""", model=False)
def volume_tokens(spark, sf):
    """Half of the volumes stand in a field, the others in the title, in turn in each of its patterns."""
    x = _numerals(spark, sf)
    k = F.col("o_orderkey") % 6
    none = F.lit(None).cast("string")
    title = F.when(k == 3, F.concat(F.lit("史料 第"), "word", F.lit("卷"))).when(k == 4, F.concat(F.lit("文集册 "), "n")).when(k == 5, F.concat(F.lit("史（"), "word", F.lit("）")))
    return x.select("o_orderkey", bibtex.volume_token(F.when(k == 0, F.col("word")), F.when(k.isin(1, 2), F.col("n").cast("string")).otherwise(none), title).alias("volume"))


_KEYS = """k AS (SELECT id, collection, 'k' || (id % 40) || 'wang' AS base FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY collection, base ORDER BY id) AS n FROM k)"""


@query(f", {_KEYS} SELECT id, base || CASE WHEN n = 1 THEN '' WHEN n <= 26 THEN chr(96 + n::INT) ELSE '-' || substr(sha1('doc_' || id || '.md'), 1, 4) END AS cite_key FROM r")
def distinct_cite_keys(spark, sf):
    d = corpus.documents(spark, sf).withColumn("base", F.concat(F.lit("k"), F.col("id") % 40, F.lit("wang")))
    return bibtex.distinct_cite_keys(d).select("id", "cite_key")


@query(rf"""WITH {_D}, w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: trim(x, '.,;:!?()[]«»"''–—')), lambda x: x <> '') AS c FROM d)
SELECT doc_id, len(list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])))::INT AS pairs FROM w""", model=False)
def page_word_pairs(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size(folds.page_words(F.col("text"))["pairs"]).alias("pairs"))


@query(rf"""WITH {_D} SELECT doc_id, substr(regexp_replace(text, '[\pP\pS\pZ\pC]', '', 'g'), 11, 20) AS part FROM d""", model=False)
def page_slices(spark, sf):
    return _documents(spark, sf).select("doc_id", text.slice_page(F.col("text"), F.lit(10), F.lit(30)).alias("part"))


@query(", f AS (SELECT id, CASE id % 4 WHEN 0 THEN ['primary', tag] WHEN 1 THEN [tag] WHEN 2 THEN ['primary'] ELSE [] END AS t FROM docs) SELECT id, list_contains(t, 'primary')::INT AS is_primary, list_contains(t, 'secondary')::INT AS is_secondary, list_contains(t, 'reference')::INT AS is_reference FROM f")
def source_flags(spark, sf):
    d = corpus.documents(spark, sf)
    raw = F.when(F.col("id") % 4 == 0, F.to_json(F.array_union(F.array(F.lit("primary")), "source_tags"))).when(F.col("id") % 4 == 1, F.to_json("source_tags")).when(F.col("id") % 4 == 2, "no list").otherwise("[]")
    return d.select("id", F.inline(F.array(text.source_flags(raw))))


@query(f"""WITH {_D} SELECT doc_id, nullif({TRIM.format("' ' || text")}, '') AS field, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM d""", model=False)
def clean_fields(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("source"))).otherwise(F.concat(F.lit("["), "source"))
    return _documents(spark, sf).select("doc_id", text.clean_field(F.concat(F.lit(" "), "text")).alias("field"), text.json_fields(raw)["source"].alias("source"))


@query("SELECT doc_id, page_num, block_num, string_agg(trim(text), ' ' ORDER BY line_num) AS merged FROM lines GROUP BY ALL")
def merged_parts(spark, sf):
    g = corpus.lines(spark, sf).groupBy(search.KEY).agg(F.array_sort(F.collect_list(F.struct("line_num", "text"))).alias("r"))
    return g.select(*search.KEY, folds.merge_parts(F.concat(F.transform("r", lambda r: r["text"]), F.array(F.lit("  "))), " ").alias("merged"))


# --- entities and curation ----------------------------------------------------------


def _seed_words(spark, sf):
    return _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "surface"))


@query(rf"""WITH {_D}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS surface, unnest(range(len(string_split(text, ' ')))) AS pos FROM d),
n AS (SELECT *, regexp_replace(surface, '[ \t\n\x0b\f\r]+', '', 'g') AS norm FROM w) SELECT doc_id, norm, min(pos)::INT AS pos FROM n WHERE norm <> '' GROUP BY ALL""", model=False)
def distinct_seeds(spark, sf):
    return entities.distinct_seeds(_seed_words(spark, sf)).select("doc_id", "norm", "pos")


def _people(spark, sf):
    s = table(spark, sf, "supplier")
    alias = F.concat(F.lit("alias "), (F.col("s_suppkey") % 7).cast("string"))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical"), F.array(alias, F.lit("both")).alias("aliases"), F.create_map(F.lit("src"), F.col("s_nationkey").cast("string"), F.concat(F.lit("own"), F.col("s_suppkey") % 3), F.lit("x")).alias("ext_ids"))


def _seen(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), F.lit(1).alias("block_num"), F.lit("s").alias("surface"))


_PEOPLE_SQL = "SELECT s_suppkey AS id, s_name AS canonical, ['alias ' || (s_suppkey % 7), 'both'] AS aliases FROM supplier"


@query(f"""WITH e AS ({_PEOPLE_SQL}) SELECT id, canonical, array_to_string(CASE WHEN id = 1 THEN list_distinct_ordered ELSE aliases END, '|') AS aliases FROM
(SELECT e.*, (SELECT ['alias 1', 'both', canonical, 'alias 2'] FROM e WHERE id = 2) AS list_distinct_ordered FROM e WHERE id <> 2)""", model=False)
def entity_merge(spark, sf):
    e, _ = entities.merge_entity(_people(spark, sf), _seen(spark, sf), 2, 1)
    return e.select("id", "canonical", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT CASE WHEN l_suppkey = 2 THEN 1 ELSE l_suppkey END AS entity_id, l_orderkey AS doc_id, l_linenumber AS page_num FROM lineitem GROUP BY ALL", model=False)
def entity_merge_mentions(spark, sf):
    _, m = entities.merge_entity(_people(spark, sf), _seen(spark, sf), 2, 1)
    return m.select("entity_id", "doc_id", "page_num")


@query("SELECT s_suppkey AS id, array_to_string(list_sort(map_keys(CASE WHEN s_suppkey = 1 THEN MAP {'src': '', 'own1': 'x', 'own2': 'x'} ELSE MAP {'src': '', 'own' || (s_suppkey % 3): 'x'} END)), '|') AS keys, s_nationkey::VARCHAR AS src FROM supplier WHERE s_suppkey <> 2", model=False)
def entity_merge_ids(spark, sf):
    e, _ = entities.merge_entity(_people(spark, sf), _seen(spark, sf), 2, 1)
    return e.select("id", F.array_join(F.array_sort(F.map_keys("ext_ids")), "|").alias("keys"), F.col("ext_ids")["src"].alias("src"))


@query(f", {_MENTION_SQL} SELECT entity_id, doc_id, page_num, block_num, surface, title, filename FROM men LEFT JOIN docs ON docs.id = doc_id AND docs.id % 5 <> 0")
def mentions_with_titles(spark, sf):
    d = corpus.documents(spark, sf).filter("id % 5 <> 0")
    return curation.mentions_of(_mentions(spark, sf), d).select("entity_id", "doc_id", "page_num", "block_num", "surface", "title", "filename")


@query(f", {_MENTION_SQL}, b AS (SELECT *, {FLAT.format('replace(index_text, chr(10), $$$$)')} AS t FROM blocks) SELECT men.entity_id, men.doc_id, men.page_num, men.block_num, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS excerpt FROM men JOIN b ON b.doc_id = men.doc_id AND b.page_num = men.page_num AND b.block_num = men.block_num")
def mention_excerpts(spark, sf):
    e = _entities(spark, sf).withColumn("category", F.lit(None).cast("string"))
    return pages.document_mentions(_mentions(spark, sf), e, corpus.lines(spark, sf)).select("entity_id", "doc_id", "page_num", "block_num", "excerpt")


@query(f", {_MENTION_SQL} SELECT entity_id, doc_id, page_num, block_num, surface, doc_id % 4 <> 0 AS valid FROM men")
def mentions_invalidated(spark, sf):
    m = _mentions(spark, sf).withColumn("id", F.xxhash64("entity_id", "doc_id", "page_num", "block_num"))
    return curation.set_valid(m, m.filter("doc_id % 4 = 0").select("id")).select("entity_id", "doc_id", "page_num", "block_num", "surface", "valid")


@query(f", {_MENTION_SQL} SELECT entity_id, doc_id, page_num, block_num, surface, contains(regexp_replace(replace(index_text, 'in', ''), '[ \\t\\n\\x0b\\f\\r]+', '', 'g'), surface) AS anchor_ok FROM men JOIN blocks USING (doc_id, page_num, block_num)")
def mentions_still_anchored(spark, sf):
    """After an edit of all texts some surfaces still stand, and some don't."""
    edited = corpus.blocks(spark, sf).withColumn("index_text", F.replace("index_text", F.lit("in"), F.lit("")))
    return entities.still_anchored(_mentions(spark, sf), edited).select("entity_id", "doc_id", "page_num", "block_num", "surface", "anchor_ok")


@query("SELECT l.doc_id, l.page_num, min_by(l.block_num, l.id) AS block_num FROM lines l WHERE contains(text, 'tion') GROUP BY ALL UNION ALL SELECT doc_id, page_num, 99 FROM (SELECT doc_id, page_num, bool_or(contains(text, 'tion')) AS any_ FROM lines GROUP BY ALL) WHERE NOT any_")
def mentions_reanchored(spark, sf):
    l = corpus.lines(spark, sf)
    m = l.select("doc_id", "page_num").distinct().select(F.xxhash64("doc_id", "page_num").alias("id"), "doc_id", "page_num", F.lit(99).alias("block_num"), F.lit("tion").alias("surface"))
    return entities.reanchor(m, l).select("doc_id", "page_num", "block_num")


def _misses(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("q"), "o_orderkey").alias("query"), F.col("o_orderdate").alias("last_seen"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("resolved"), F.lit(None).cast("string").alias("note"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY (o_orderkey % 3 = 0)::INT, o_orderdate DESC, o_orderkey DESC LIMIT 1000", model=False)
def misses_open(spark, sf):
    return stats.open_items(_misses(spark, sf), "last_seen", resolved=True, limit=5000).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE (o_orderkey % 3 = 0)::INT END AS resolved, CASE WHEN o_orderkey % 10 = 0 THEN 'seen' END AS note FROM orders", model=False)
def misses_resolved(spark, sf):
    m = _misses(spark, sf)
    c = m.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "seen").alias("note"))
    return curation.resolve_items(m, c).select("id", "resolved", "note")


@query("""WITH e AS (SELECT s_suppkey AS id, s_name AS canonical FROM supplier), c AS (SELECT o_orderkey AS miss, 'q' || o_orderkey AS q, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 40)::VARCHAR WHEN 1 THEN 'Supplier#' || lpad((o_orderkey % 20)::VARCHAR, 9, '0') ELSE 'new ' || (o_orderkey % 4) END AS want FROM orders),
m AS (SELECT c.*, coalesce(e1.id, e2.id) AS known FROM c LEFT JOIN e e1 ON e1.id = try_cast(c.want AS BIGINT) LEFT JOIN e e2 ON e2.canonical = c.want),
n AS (SELECT want, row_number() OVER (ORDER BY want) + (SELECT max(id) FROM e) AS id FROM (SELECT DISTINCT want FROM m WHERE known IS NULL)),
r AS (SELECT m.*, coalesce(known, n.id) AS eid FROM m LEFT JOIN n ON n.want = m.want),
a AS (SELECT id, canonical, ['alias ' || (id % 7), 'both'] AS aliases FROM e UNION ALL SELECT id, want, [] FROM n)
SELECT a.id, a.canonical, array_to_string(aliases || coalesce((SELECT list(DISTINCT q ORDER BY q) FROM r WHERE eid = a.id), []), '|') AS aliases FROM a""", model=False)
def miss_aliases(spark, sf):
    m = _misses(spark, sf)
    want = F.when(F.col("id") % 3 == 0, (F.col("id") % 40).cast("string")).when(F.col("id") % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 20).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new "), F.col("id") % 4))
    e, _, _ = curation.miss_to_alias(_people(spark, sf), m, m.select("id", want.alias("entity")))
    return e.select("id", "canonical", F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Tang' ELSE 'old' END AS era, CASE WHEN s_suppkey % 3 = 0 THEN (600 + s_suppkey)::VARCHAR END AS year_start FROM supplier""", model=False)
def entity_constraints(spark, sf):
    e = _people(spark, sf).withColumn("props", F.create_map(F.lit("era"), F.lit("old")))
    k = F.col("id")
    c = e.select(k.alias("entity_id"), F.when(k % 2 == 0, " Tang ").alias("era"), F.lit(" ").alias("scope"), F.when(k % 3 == 0, (600 + k).cast("string")).otherwise("soon").alias("year_start"), F.lit(None).cast("string").alias("year_end"))
    out, _ = curation.with_constraints(e, c)
    return out.select("id", F.col("props")["era"].alias("era"), F.try_element_at("props", F.lit("year_start")).alias("year_start"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 3 AND 700 >= 600 + s_suppkey AND (s_suppkey % 4 <> 0 OR s_suppkey >= 50)", model=False)
def entities_by_year(spark, sf):
    from foliant.operators.side_hits import filtered_entities

    k = F.col("id")
    none = F.lit(None).cast("string")
    props = F.map_filter(F.create_map(F.lit("year_start"), F.when(k % 4 != 3, (600 + k).cast("string")).otherwise(none), F.lit("year_end"), F.when(k % 4 == 0, (650 + k).cast("string")).otherwise(none)), lambda _, v: v.isNotNull())
    return filtered_entities(_people(spark, sf).withColumn("props", props), year=700).select("id")


@query("SELECT o_orderkey AS id, o_custkey AS entity_id, c_name AS canonical FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0", model=False)
def reports_with_names(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"))
    e = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical"))
    return curation.reports_of(r, e).select("id", "entity_id", "canonical")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'other' ELSE 'wrong' END AS kind FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)", model=False)
def reports_added(spark, sf):
    o = table(spark, sf, "orders")
    new = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("wrong").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("resolved"))
    return curation.add_reports(new.filter("false"), new, table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))).select("id", "kind")


def _revisions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 == 0, "seen").otherwise(" ").alias("basis"), (F.col("o_orderkey") % 2).cast("int").alias("in_pkg"))


@query("SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS needs_basis FROM orders ORDER BY o_orderkey DESC LIMIT 1000", model=False)
def revisions_listed(spark, sf):
    return curation.revisions_of(_revisions(spark, sf), limit=9999).select("id", "needs_basis")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'page 3' WHEN o_orderkey % 4 = 0 THEN 'seen' ELSE ' ' END AS basis, CASE WHEN o_orderkey % 3 = 0 THEN 1 - o_orderkey % 2 ELSE o_orderkey % 2 END::INT AS in_pkg FROM orders", model=False)
def revisions_changed(spark, sf):
    r = _revisions(spark, sf)
    return curation.toggle_packaged(curation.set_basis(r, r.filter("id % 7 = 0").select("id", F.lit(" page 3 ").alias("basis"))), r.filter("id % 3 = 0")).select("id", "basis", "in_pkg")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 11 <> 0", model=False)
def purge_missing(spark, sf):
    d = corpus.documents(spark, sf).withColumn("original_virtual", F.lit(False))
    listing = d.filter("id % 11 <> 0").select("collection", F.col("filename").alias("name"))
    return curation.purge_missing({"documents": d}, listing, confirmed=True)["documents"].select("id")


@query("SELECT c_custkey AS doc_id, count(o_orderkey) AS revisions, count(o_orderkey) = 0 AND c_custkey % 2 = 0 AS safe FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", model=False)
def safe_to_extract(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    l = c.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "t").otherwise(" ").alias("trans"), F.lit(None).cast("string").alias("gloss"))
    return curation.safe_to_extract(c, l, table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"))).select("doc_id", "revisions", "safe")


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'A new title' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN NULL ELSE author END AS author, CASE id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'zh' ELSE lang END AS lang, CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END AS tri_rows FROM docs""")
def metadata_updates(spark, sf):
    d = corpus.documents(spark, sf).withColumns({"tri_rows": F.lit(1), "linked_pdf": F.lit(None).cast("string"), "bib_type": F.lit("@book"), "bib_data": F.create_map(F.lit("title"), F.col("title"))})
    k = F.col("id")
    data = F.when(k % 3 == 0, F.create_map(F.lit("title"), F.lit(" A new title "), F.lit("author"), F.lit(" "), F.lit("year"), F.col("bib_year")))
    c = d.select("id", F.when(k % 4 == 0, " ENG").when(k % 4 == 1, "").when(k % 4 == 2, "no/lang").alias("lang"), F.when(k % 5 == 0, 3).when(k % 5 == 1, 2).alias("tri_rows"), data.alias("bib_data"))
    return curation.update_metadata(d, c).select("id", "title", "author", "lang", "tri_rows")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, m + pos, 'user', 'again ' || pos FROM (SELECT conv_id, max(turn) AS m, unnest([1, 2]) AS pos FROM conversations GROUP BY conv_id)", model=False)
def chat_turns_added(spark, sf):
    c = table(spark, sf, "conversations")
    new = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).select("conv_id", F.lit("user").alias("role"), F.concat(F.lit("again "), "pos").alias("text"), "pos")
    return curation.add_turns(c, new)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'human' ELSE 'ai' END AS origin, nullif('note ' || o_orderkey, '') AS note FROM orders WHERE o_orderkey % 4 < 2", model=False)
def notes_kept(spark, sf):
    k = F.col("id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    coords = F.when(k % 4 == 0, '{"x": 0.5, "y": 0.25, "w": 0.5005, "h": 0.1}').when(k % 4 == 1, "[[0.1, 0.2], [0.3, 0.4]]").when(k % 4 == 2, '{"x": 0.5, "y": 0.25, "w": 0.6, "h": 0.1}').otherwise("[[0.1, 0.2]]")
    n = o.select("id", F.when(k % 2 == 0, "rect").otherwise("pen").alias("kind"), coords.alias("coords"), F.concat(F.lit(" note "), "id").alias("note"), F.lit(" ").alias("clip_text"), F.when(k % 3 == 0, "me").otherwise("ai").alias("origin"))
    return curation.put_notes(n.filter("false"), n).select("id", "origin", "note")


# --- pages, layout, collation --------------------------------------------------------


@query("SELECT DISTINCT doc_id, page_num FROM lines")
def distinct_pages(spark, sf):
    return stats.distinct_pages(corpus.lines(spark, sf))


@query(", v AS (SELECT *, bool_or(block_label = 'header') OVER (PARTITION BY doc_id, page_num) AS up FROM lines WHERE NOT (page_num % 2 = 0 AND block_label = 'header')) SELECT doc_id, page_num, block_num, line_num FROM v WHERE CASE WHEN up THEN block_label = 'header' ELSE block_label <> 'footer' END")
def usable_lines(spark, sf):
    """Headers stand for vertical text here, and even pages have none."""
    l = corpus.lines(spark, sf).filter("NOT (page_num % 2 = 0 AND block_label = 'header')")
    l = l.withColumn("block_label", F.when(F.col("block_label") == "header", "vertical_text").otherwise(F.col("block_label")))
    return collate.usable_lines(l).select(*search.KEY, "line_num")


@query(r", t AS (SELECT id, doc_id, page_num, sum(length(regexp_replace(text, '[\pP\pS\pZ\pC]', '', 'g'))) OVER (PARTITION BY doc_id, page_num ORDER BY block_num, line_num) AS e FROM lines WHERE block_label <> 'footer') SELECT doc_id, page_num, min(id) FILTER (e > 25) AS line_id FROM t GROUP BY ALL HAVING max(e) > 25")
def line_at_place(spark, sf):
    s = collate.page_sequence(corpus.lines(spark, sf)).withColumn("at", F.array(F.lit(25), F.lit(10_000_000)))
    return s.select("doc_id", "page_num", F.explode(collate.line_ids_at("at", "ends")).alias("line_id"))


@query("SELECT c_custkey AS transcript_id, count(o_orderkey) AS confirmed_pages FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 2 = 0 GROUP BY c_custkey", model=False)
def confirmed_pages(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("transcript_id"))
    return collate.confirmed_pages(t, table(spark, sf, "orders").select(F.col("o_custkey").alias("transcript_id"), (F.col("o_orderkey") % 2 == 0).alias("confirmed")))


@query("SELECT doc_id, page_num, block_num, line_num, CASE WHEN page_num = 1 THEN replace(text, 'e', 'E') ELSE text END AS text FROM lines")
def pages_replaced(spark, sf):
    l = corpus.lines(spark, sf)
    return mutate.replace_pages(l, l.filter("page_num = 1").withColumn("text", F.replace("text", F.lit("e"), F.lit("E")))).select(*search.KEY, "line_num", "text")


@query(", m AS (SELECT doc_id, page_num, max(block_num) AS m FROM lines GROUP BY ALL) SELECT doc_id, page_num, block_num, line_num FROM lines UNION ALL SELECT l.doc_id, l.page_num, block_num + m.m, line_num FROM lines l JOIN m ON m.doc_id = l.doc_id AND m.page_num = l.page_num WHERE block_label = 'header'")
def blocks_appended(spark, sf):
    l = corpus.lines(spark, sf)
    return mutate.append_blocks(l, l.filter("block_label = 'header'")).select(*search.KEY, "line_num")


@query(f"WITH {_BOX_SQL} SELECT doc_id, max(x1) AS page_w, max(y1) AS page_h FROM b GROUP BY doc_id", model=False)
def page_sizes(spark, sf):
    b = _boxes(spark, sf).withColumns({"page_w": F.lit(None).cast("double"), "page_h": F.lit(None).cast("double")})
    return layout.page_size(b).select("doc_id", "page_w", "page_h")


@query(f"""WITH {_BOX_SQL}, p AS (SELECT doc_id, 1000 + doc_id % 7 AS w, 900 + doc_id % 5 AS h FROM b GROUP BY doc_id),
n AS (SELECT p.doc_id, region_idx, least(greatest(round_even(rx0::DOUBLE * (w::DOUBLE / 1000), 0), 0), w) AS x0, least(greatest(round_even(ry0::DOUBLE * (h::DOUBLE / 1000), 0), 0), h) AS y0, least(greatest(round_even(rx1::DOUBLE * (w::DOUBLE / 1000), 0), 0), w) AS x1, least(greatest(round_even(ry1::DOUBLE * (h::DOUBLE / 1000), 0), 0), h) AS y1 FROM p, r)
SELECT doc_id, region_idx, x0::INT AS x0, y1::INT AS y1 FROM n WHERE x1 > x0 AND y1 > y0""", model=False)
def regions_scaled(spark, sf):
    one = spark.createDataFrame([(0, "h", [0.0, 0.0, 400.0, 500.0]), (1, "v_rtl", [300.0, 200.0, 900.0, 1000.0]), (2, "v_ltr", [0.0, 500.0, 300.0, 1000.0])], "region_idx int, direction string, bbox array<double>")
    p = _boxes(spark, sf).select("doc_id").distinct().select(F.col("doc_id").alias("page_num"), (1000 + F.col("doc_id") % 7).alias("page_w"), (900 + F.col("doc_id") % 5).alias("page_h"))
    return layout.apply_template(one, 1000.0, 1000.0, p).select(F.col("page_num").alias("doc_id"), "region_idx", F.col("bbox")[0].alias("x0"), F.col("bbox")[3].alias("y1"))


@query(f"""WITH {_BOX_SQL}, u AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b), v AS (SELECT *, count(*) OVER p AS n, sum(((w / greatest(h, 1e-9) < 0.45) AND h >= 0.12 * 1000)::INT) OVER p AS votes, list_sort(list(h) OVER p) AS hs FROM u WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, block_num, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN votes > n / 2.0 THEN -(x0 + x1) / 2 ELSE floor(((y0 + y1) / 2) / greatest(hs[1 + n // 2] / 2, 1e-9)) END, CASE WHEN votes > n / 2.0 THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END, block_num) AS position FROM v""", model=False)
def line_positions(spark, sf):
    l = _boxes(spark, sf).withColumns({"page": F.col("doc_id"), "id": F.col("block_num")})
    return layout.line_order(l).select("doc_id", "block_num", F.col("position").cast("long").alias("position"))


@query(f"WITH {_BOX_SQL} SELECT doc_id, block_num, x0 * 2 AS x0, y1 / 2 AS y1 FROM b", model=False)
def boxes_rescaled(spark, sf):
    b = layout.rescale(F.col("bbox"), F.lit(2.0), F.lit(0.5))
    return _boxes(spark, sf).select("doc_id", "block_num", b[0].alias("x0"), b[3].alias("y1"))


@query(", n AS (SELECT doc_id, page_num, count(DISTINCT block_num) AS blocks, count(*) AS n FROM lines GROUP BY ALL), p AS (SELECT id AS doc_id, unnest(range(1, page_count + 1))::INT AS page_num FROM docs) SELECT p.doc_id, p.page_num, coalesce(blocks, 0)::INT AS blocks, coalesce(n, 0)::INT AS lines FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.page_num = p.page_num")
def page_models(spark, sf):
    none = spark.createDataFrame([], "doc_id long, kind string, status string, content string")
    e = _entities(spark, sf).withColumn("category", F.lit(None).cast("string"))
    m = pages.page_model(corpus.documents(spark, sf), corpus.lines(spark, sf), _mentions(spark, sf), e, none)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return m.select("doc_id", "page_num", F.greatest(F.lit(0), n(F.col("blocks"))).alias("blocks"), F.greatest(F.lit(0), n(F.flatten(F.transform("blocks", lambda b: b["lines"])))).alias("lines"))


@query("SELECT doc_id, page_num, block_num, line_num, CASE WHEN line_num % 2 = 1 THEN text ELSE replace(text, 'e', 'E') END AS trans, line_num % 2 = 0 AS draft FROM lines WHERE trim(text) <> ''")
def autofilled_lines(spark, sf):
    l = corpus.lines(spark, sf).withColumn("trans", F.when(F.col("line_num") % 2 == 1, F.col("text")))
    asked = pages.autofill_requests(l, ["trans"])
    out, _ = pages.apply_autofill(l, asked.select("ids", F.concat(F.lit("Here: "), F.replace("request", F.lit("e"), F.lit("E"))).alias("answer")), "trans")
    return out.select(*search.KEY, "line_num", "trans", "draft")


# --- seeds ------------------------------------------------------------------------------


@query(r""", k AS (SELECT id AS doc_id, collection || '; kw' || (id % 5) || ', ' || collection AS kw FROM docs WHERE id % 2 = 0), t AS (SELECT doc_id, unnest(list_filter(string_split_regex(kw, '[，,；;、/|\s]+'), lambda x: x <> '')) AS surface FROM k)
SELECT DISTINCT doc_id, surface, 'bib:keywords' AS source FROM t WHERE doc_id % 3 <> 0 UNION ALL SELECT id, unnest(['card ' || id, 'entry']), unnest(['card:keywords', 'card:index']) FROM docs WHERE id % 3 = 0""")
def authoritative_seeds(spark, sf):
    d = corpus.documents(spark, sf)
    kw = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("keywords"), F.concat("collection", F.lit("; kw"), F.col("id") % 5, F.lit(", "), "collection")))
    docs = d.select("id", F.lit("other").alias("doc_kind"), kw.alias("bib_data"))
    content = F.concat(F.lit('{"keywords": ["card '), "id", F.lit('", " "], "index": [{"term": " entry ", "page_num": "4"}, "entry", {"page_num": 2}]}'))
    cards = d.filter("id % 3 = 0").select(F.col("id").alias("doc_id"), F.lit("entity_source").alias("kind"), content.alias("content"))
    return seeds.authoritative_seeds(docs, corpus.blocks(spark, sf), cards).select("doc_id", "surface", "source")


@query("SELECT doc_id, w AS surface, 2::INT AS page_num FROM (SELECT id AS doc_id, unnest(['alpha', 'beta ' || (id % 9)]) AS w FROM docs)")
def index_seeds(spark, sf):
    body = F.concat(F.lit("alpha ...... 12, 14\n3, 5-7\nbeta "), F.col("id") % 9, F.lit("  ... 4\nx\nalpha, 9"))
    pages_ = F.array(F.struct(F.lit(1).alias("page_num"), F.lit("not yet").alias("index_text")), F.struct(F.lit(1).alias("page_num"), F.lit(" INDEX ").alias("index_text")), F.struct(F.lit(2).alias("page_num"), body.alias("index_text")))
    b = corpus.documents(spark, sf).select(F.col("id").alias("doc_id"), F.posexplode(pages_).alias("block_num", "x")).select("doc_id", "x.page_num", "block_num", "x.index_text")
    docs = corpus.documents(spark, sf).select("id", F.lit("book").alias("doc_kind"), F.lit(None).cast("map<string,string>").alias("bib_data"))
    none = spark.createDataFrame([], "doc_id long, kind string, content string")
    s = seeds.authoritative_seeds(docs, b, none)
    return s.select("doc_id", F.when(F.col("surface") == "beta", F.concat(F.lit("beta "), F.col("doc_id") % 9)).otherwise(F.col("surface")).alias("surface"), "page_num")


# --- answers ---------------------------------------------------------------------------


#: An entity whose two names are searched together.
_EXPANDED = [(2, "hation", ["tion"])]


def _shelf(spark, sf) -> answers.Shelf:
    none = lambda s: spark.createDataFrame([], s)
    e = spark.createDataFrame(_EXPANDED, "id long, canonical string, aliases array<string>")
    return answers.Shelf(
        corpus.index(spark, sf), corpus.documents(spark, sf), corpus.lines(spark, sf), none("id long, doc_id long, title string, content string"), _wiki(spark, sf), e, entities.entity_names(e),
        none("entity_id long, doc_id long, page_num int, block_num int, valid boolean"), none("id long, doc_id long, note string, clip_text string, updated_at timestamp"),
    )


@query(f", h AS (SELECT doc_id, page_num, block_num FROM blocks WHERE {HIT.format('esos')}) SELECT h.doc_id, h.page_num, h.block_num, min(l.id) AS line_id, any_value(title) AS title, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 100000 AS has_more FROM h JOIN lines l ON l.doc_id = h.doc_id AND l.page_num = h.page_num AND l.block_num = h.block_num JOIN docs ON docs.id = h.doc_id GROUP BY ALL")
def answer_page(spark, sf):
    return answers.page_of_hits(_shelf(spark, sf), "esos", limit=100_000)["results"].select(*search.KEY, "line_id", "title", "total", "has_more")


@query(f", h AS (SELECT doc_id FROM blocks WHERE {HIT.format('hation')} OR {HIT.format('tion')}), g AS (SELECT doc_id, count(*) AS hits FROM h GROUP BY doc_id) SELECT doc_id, hits, (SELECT sum(hits)::BIGINT FROM g) AS total_blocks, (SELECT count(*) FROM g) AS total_docs, FALSE AS groups_truncated FROM g")
def answer_groups(spark, sf):
    """The query names an entity with one more name, which is searched too."""
    return answers.page_of_groups(_shelf(spark, sf), "hation", limit=1_000_000)["groups"].select("doc_id", "hits", "total_blocks", "total_docs", "groups_truncated")


@query(f", h AS (SELECT doc_id FROM blocks WHERE {HIT.format('hation')} OR {HIT.format('tion')}) SELECT 'hation' AS query, count(DISTINCT doc_id) AS total_docs, TRUE AS expanded, 1::BIGINT AS entity_hits, (SELECT least(10, count(*)) FROM pages WHERE contains({FOLD.format('url')}, 'hation') OR contains({FOLD.format('html')}, 'hation')) AS wiki_hits, 0::BIGINT AS card_hits FROM h")
def answer_event(spark, sf):
    return answers.page_of_groups(_shelf(spark, sf), "hation")["event"].drop("clicked")


@query(f", h AS (SELECT page_num, block_num FROM blocks WHERE doc_id = 24 AND {HIT.format('tion')}) SELECT h.page_num, h.block_num, min(l.id) AS line_id, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 300 AS truncated FROM h JOIN lines l ON l.doc_id = 24 AND l.page_num = h.page_num AND l.block_num = h.block_num GROUP BY ALL")
def answer_document(spark, sf):
    shelf = _shelf(spark, sf)
    shelf = shelf._replace(entities=shelf.entities.filter("false"), names=shelf.names.filter("false"))
    return answers.hits_in_document(shelf, 24, "tion").select("page_num", "block_num", "line_id", "total", "truncated")


@query("SELECT event_id AS id, event_type = 'click' OR event_id % 10 = 0 AS clicked FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 5000", model=False)
def search_events_kept(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "click").alias("clicked"))
    clicks = e.filter("id % 10 = 0").select(F.col("id").alias("event_id")).union(e.filter("id % 20 = 0").select("id"))
    return stats.retained(stats.with_clicks(e, clicks))


@query(f"SELECT doc_id, page_num, block_num FROM blocks WHERE {HIT.format('tion')}")
def search_segmented(spark, sf):
    """Blocks that are indexed and searched with one and the same cut of words."""
    planner = Planner(cut=lambda run: [run[i : i + 2] for i in range(0, len(run), 2)])
    b = corpus.blocks_of(corpus.lines(spark, sf), planner)
    return search.search(b, corpus.documents(spark, sf), corpus.lines(spark, sf), "tion", planner, ranked=False).select(search.KEY)
