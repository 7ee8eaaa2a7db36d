"""Named queries on what comes and goes with a shelf: packages, files, revisions, cards and notes found, regions, flags, trees of headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import folds, text
from foliant.operators import collate, curation, mutate, pages, side_hits, stats
from foliant.plans.catalog import FOLD, _BOX_SQL, _boxes, _entities, _MENTION_SQL, _mentions, _regions
from foliant.plans.registry import SQL, query
from foliant.plans.search_plan import Planner
from foliant.sources import corpus, package, texts
from foliant.sources.corpus import table

# --- texts ----------------------------------------------------------------------------


@query("SELECT doc_id, page_num, block_num, coalesce(string_agg(CASE WHEN line_num % 2 = 1 THEN 'T ' || text ELSE text END, ' ' ORDER BY line_num) FILTER (NOT (id % 30000 = 0)), '') AS trans FROM lines GROUP BY doc_id, page_num, block_num")
def translated_blocks(spark, sf):
    """Blocks of lines with translations, some of them blank."""
    trans = F.when(F.col("id") % 30000 == 0, " ").when(F.col("line_num") % 2 == 1, F.concat(F.lit("T "), "text")).otherwise(F.col("text"))
    return corpus.blocks_of(corpus.lines(spark, sf).withColumn("trans", trans)).select("doc_id", "page_num", "block_num", "trans")


@query("SELECT doc_id, text AS plain FROM documents", model=False)
def marks_stripped(spark, sf):
    """Marks around every word with a capital, and what stripping them leaves."""
    marked = F.regexp_replace("text", r"([A-Z]\w*)", "<mark>$1</mark>")
    return table(spark, sf, "documents").select("doc_id", text.strip_marks(marked).alias("plain"))


@query(r"SELECT id, CASE WHEN id % 7 = 0 THEN 3.0 / 5 WHEN id % 7 = 1 THEN 0.0 ELSE 0.125 END AS share, id % 7 <> 1 AND id % 5 = 0 AS is_number FROM docs")
def strange_characters(spark, sf):
    """Shares of control characters, and texts that are page numbers but for punctuation, of made texts of every document."""
    k = F.col("id")
    strange = F.when(k % 7 == 0, F.lit("a\x01\x02b\x03")).when(k % 7 == 1, F.lit("")).otherwise(F.lit("ab\tc\n\x05de"))
    number = F.when(k % 7 == 1, "").when(k % 5 == 0, F.concat(F.lit("- 第".replace("第", "")), k.cast("string"), F.lit(" · 十"))).otherwise(F.concat(k.cast("string"), F.lit("x")))
    return corpus.documents(spark, sf).select("id", text.weird_share(strange).cast("double").alias("share"), text.is_page_number(number).alias("is_number"))


@query("SELECT doc_id, id AS line_id, CASE WHEN id % 20000 = 0 THEN CASE WHEN id % 30000 = 0 THEN 'weird,diff' ELSE 'diff' END ELSE CASE WHEN id % 30000 = 0 THEN 'weird' END END AS suspect FROM lines")
def lines_flagged(spark, sf):
    """A flag set on some lines and taken from the others, twice over."""
    l = corpus.lines(spark, sf)
    had = F.when((F.col("id") % 30000 == 0) & (F.col("id") % 20000 != 0), "diff,weird").when(F.col("id") % 30000 == 0, "weird").when(F.col("line_num") == 2, "diff")
    l = l.withColumn("suspect", had)
    marked = l.filter("id % 20000 = 0").select(F.col("id").alias("line_id"))
    done = collate.flag_lines(collate.flag_lines(l, marked), marked)
    return done.select("doc_id", F.col("id").alias("line_id"), "suspect")


_TREE = "'[{\"title\": \"' || coalesce(lang, '') || '\", \"page\": ' || doc_id % 90 || ', \"children\": [{\"title\": \" ' || source || ' \", \"children\": [{\"title\": \"x\", \"page\": \"no\", \"children\": [{\"title\": \"too deep\"}]}]}, {\"title\": \"\"}]}]'"


def _trees(spark, sf):
    head = F.concat(F.lit('[{"title": "'), F.coalesce("lang", F.lit("")), F.lit('", "page": '), (F.col("doc_id") % 90).cast("string"))
    tail = F.concat(F.lit(', "children": [{"title": " '), F.col("source"), F.lit(' ", "children": [{"title": "x", "page": "no", "children": [{"title": "too deep"}]}]}, {"title": ""}]}]'))
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "{bad").otherwise(F.concat(head, tail)).alias("content"))


@query("""SELECT doc_id, pos::INT AS pos, level::INT AS level, title, page::INT AS page FROM (SELECT doc_id, 0 AS pos, 1 AS level, lang AS title, doc_id % 90 AS page FROM documents WHERE doc_id % 8 <> 0 AND coalesce(lang, '') <> ''
UNION ALL SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN 0 ELSE 1 END, 2, source, NULL FROM documents WHERE doc_id % 8 <> 0 UNION ALL SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN 1 ELSE 2 END, 3, 'x', NULL FROM documents WHERE doc_id % 8 <> 0)""", model=False)
def headings_flattened(spark, sf):
    return _trees(spark, sf).select("doc_id", F.posexplode(folds.toc("content")).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 0 OR coalesce(lang, '') = '' THEN 0 ELSE 3 END AS nodes, CASE WHEN doc_id % 8 = 0 OR coalesce(lang, '') = '' THEN '[]' ELSE
'[{"title": "' || lang || '", "page": ' || doc_id % 90 || ', "children": [{"title": "' || source || '", "page": null, "children": [{"title": "x", "page": null, "children": []}]}]}]' END AS tree FROM documents""", model=False)
def headings_cleaned(spark, sf):
    return _trees(spark, sf).select("doc_id", folds.toc_tree("content").alias("t")).select("doc_id", "t.nodes", F.col("t.toc").alias("tree"))


# --- found beside blocks ----------------------------------------------------------------

_CARDS = "c AS (SELECT page_id AS id, page_id % 50 AS doc_id, regexp_extract(url, '[^/]*$') AS title, html AS content FROM pages)"


def _cards(spark, sf):
    p = table(spark, sf, "pages")
    own = p.select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("doc_id"), F.regexp_extract("url", "[^/]*$", 0).alias("title"), F.col("html").alias("content"))
    cards = own.withColumns({"status": F.when(F.col("id") % 3 == 0, "draft").otherwise("reviewed"), "kind": F.when(F.col("id") % 4 == 0, "meta").when(F.col("id") % 4 == 1, "toc").otherwise("entity")})
    docs = spark.range(40).select("id", F.concat(F.lit("title "), "id").alias("title"))
    return cards, docs


@query(f"""WITH {_CARDS}, r AS (SELECT * FROM c WHERE id % 3 <> 0 AND id % 4 <> 0 AND doc_id < 40), h AS (SELECT *, contains(lower(title || ' ' || content), 'tion') AS first FROM r WHERE contains(lower(title || ' ' || content), 'tion'))
SELECT id, doc_id, title FROM h ORDER BY id LIMIT 20""", model=False)
def cards_found(spark, sf):
    """Reviewed cards of known documents that a search finds, best first."""
    cards, docs = _cards(spark, sf)
    return side_hits.card_hits(mutate.cards_to_index(cards, docs).drop("doc_title"), Planner(), "tion").select("id", "doc_id", "title")


@query(f"""WITH {_CARDS} SELECT id FROM c WHERE contains({FOLD.format('title')}, 'ti') OR contains({FOLD.format('content')}, 'ti') ORDER BY id LIMIT 20""", model=False)
def cards_found_by_short_words(spark, sf):
    """A short word finds cards by their title or content."""
    cards, _ = _cards(spark, sf)
    return side_hits.card_hits(cards, Planner(), "TI").select("id")


_NOTES = "n AS (SELECT conv_id * 100 + turn AS id, conv_id AS doc_id, text AS note, CASE WHEN turn % 2 = 0 THEN 'seen ' || text END AS clip_text, turn FROM conversations)"


@query(f"""WITH {_NOTES} SELECT n.id, doc_id, 'title ' || doc_id AS doc_title FROM n WHERE doc_id % 10 <> 0 AND (contains(lower(note), 'the') OR contains(lower(coalesce(clip_text, '')), 'the')) ORDER BY turn DESC, n.id DESC LIMIT 200""", model=False)
def notes_found(spark, sf):
    """Notes and clipped texts of known documents that hold a word, newest first."""
    c = table(spark, sf, "conversations")
    n = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("note"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("seen "), "text")).alias("clip_text"), F.col("turn").alias("updated_at"))
    docs = c.select("conv_id").distinct().filter("conv_id % 10 <> 0").select(F.col("conv_id").alias("id"), F.concat(F.lit("title "), "conv_id").alias("title"))
    return side_hits.annotation_hits(n, docs, Planner(), "the", top=500).select("id", "doc_id", "doc_title")


@query("SELECT id, title, (SELECT count(*) FROM docs) AS total FROM docs ORDER BY id DESC LIMIT 20")
def newest_documents(spark, sf):
    return stats.docs_page(corpus.documents(spark, sf), sort="id", descending=True).select("id", "title", "total")


@query("SELECT id AS doc_id, least(2, page_count)::INT AS page_num FROM docs")
def second_pages(spark, sf):
    """The page model held to page 2, or to the last one of a shorter document."""
    none = spark.createDataFrame([], "doc_id long, kind string, status string, content string")
    e = spark.createDataFrame([], "id long, canonical string, category string")
    m = spark.createDataFrame([], "entity_id long, doc_id long, page_num int, block_num int, surface string, valid boolean")
    return pages.page_model(corpus.documents(spark, sf), corpus.lines(spark, sf), m, e, none, page=2).select("doc_id", "page_num")


@query(f", {_MENTION_SQL} SELECT ent.id::BIGINT AS id, canonical, count(men.entity_id) FILTER (doc_id % 4 <> 0) AS mentions, min(doc_id) FILTER (doc_id % 4 <> 0) AS first_doc FROM ent LEFT JOIN men ON men.entity_id = ent.id GROUP BY ALL")
def registry_exported(spark, sf):
    """The registry as JSON, a text for each entity, read back."""
    e = _entities(spark, sf).withColumns({"category": F.lit(None).cast("string"), "ext_ids": F.lit(None).cast("map<string,string>"), "props": F.lit(None).cast("map<string,string>")})
    j = texts.registry_json(e, _mentions(spark, sf).withColumn("valid", F.col("doc_id") % 4 != 0))
    x = j.select("id", F.from_json("entity", "struct<canonical:string,mentions:array<struct<doc_id:long>>>").alias("x"))
    return x.select("id", "x.canonical", F.size("x.mentions").cast("long").alias("mentions"), F.array_min("x.mentions.doc_id").alias("first_doc"))


# --- packages and files --------------------------------------------------------------------


def _shelf(spark, sf):
    d = corpus.documents(spark, sf)
    o = table(spark, sf, "orders")
    log = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1500).alias("doc_id"), (F.col("o_orderkey") % 2).cast("int").alias("in_pkg"))
    return {"documents": d, "revision_log": log}


_LOG = "log AS (SELECT o_orderkey AS id, o_custkey % 1500 AS doc_id, o_orderkey % 2 AS in_pkg FROM orders)"


@query(f", {_LOG} SELECT docs.id AS doc_id, cite_key, count(log.id) AS base_version FROM docs LEFT JOIN log ON log.doc_id = docs.id GROUP BY ALL")
def base_versions(spark, sf):
    """Revisions of each document of a package."""
    return mutate.manifest(_shelf(spark, sf)).select("doc_id", "cite_key", "base_version")


@query(f", {_LOG} SELECT log.id, doc_id FROM log JOIN docs ON docs.id = doc_id WHERE in_pkg = 1 AND lang = 'en'")
def changeset_rows(spark, sf):
    """What a changeset of the English documents takes along."""
    t = _shelf(spark, sf)
    return mutate.package(t, t["documents"].filter("lang = 'en'"), changeset=True)["revision_log"].select("id", "doc_id")


@query("""SELECT collection, count(*) FILTER (k = 'doc') AS docs, count(*) FILTER (k = 'doc' AND id % 3 <> 0) AS found, count(*) FILTER (k = 'doc' AND id % 3 = 0 AND id % 2 = 1) AS missing, count(*) FILTER (k = 'doc' AND id % 2 = 0) AS virtual, count(*) FILTER (k = 'file') AS orphans
FROM (SELECT collection, id, 'doc' AS k FROM docs UNION ALL SELECT collection, id, 'file' FROM docs WHERE id % 5 = 0 AND id % 3 <> 0) GROUP BY collection""")
def files_examined(spark, sf):
    """Files there and missing, virtual documents, and files that no document names, by collection."""
    d = corpus.documents(spark, sf).withColumn("original_virtual", F.col("id") % 2 == 0)
    files = d.filter("id % 3 <> 0").select("collection", "filename", "id")
    listing = files.drop("id").union(files.filter("id % 5 = 0").select("collection", F.concat(F.lit("stray-"), "filename")))
    return stats.integrity(d, listing)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'linked/' || id WHEN id % 4 = 0 THEN 'named/' || id END AS path FROM docs")
def files_attached(spark, sf):
    """A file for each document: that of its linked name before that of its file name."""
    d = corpus.documents(spark, sf).withColumn("linked_pdf", F.when(F.col("id") % 6 != 1, F.concat(F.lit("l"), "id", F.lit(".pdf"))))
    files = d.filter("id % 3 = 0").select(F.concat(F.lit("l"), "id", F.lit(".pdf")).alias("name"), F.concat(F.lit("linked/"), "id").alias("path")).union(d.filter("id % 4 = 0").select("filename", F.concat(F.lit("named/"), "id")))
    return mutate.attach_files(d, files).select("id", "path")


@query("""SELECT 'lines' AS "table", doc_id, count(*) AS rows FROM lines WHERE doc_id IN (SELECT id FROM docs WHERE lang = 'fr') GROUP BY doc_id UNION ALL SELECT 'blocks', doc_id, count(*) FROM blocks WHERE doc_id IN (SELECT id FROM docs WHERE lang = 'fr') GROUP BY doc_id""")
def rows_of_no_document(spark, sf):
    """Lines and blocks of documents that are gone: the French ones."""
    d = corpus.documents(spark, sf).filter("coalesce(lang, '') <> 'fr'")
    return package.orphans({"documents": d, "lines": corpus.lines(spark, sf), "blocks": corpus.blocks(spark, sf)})


@query(""", have AS (SELECT * FROM docs WHERE lang = 'en'), top AS (SELECT coalesce(max(id), 0) AS top FROM have)
SELECT id AS old_id, id AS new_id, filename FROM have UNION ALL SELECT id, (SELECT top FROM top) + row_number() OVER (ORDER BY id), CASE WHEN lang = 'en' THEN replace(filename, '.md', '_imported.md') ELSE filename END FROM docs""")
def documents_forced_in(spark, sf):
    """All documents come to a shelf that has the English ones: with new ids, and new names where the name is there."""
    d = corpus.documents(spark, sf)
    have = d.filter("lang = 'en'").withColumn("old", F.col("id"))
    merged, _ = mutate.import_documents(have, d.withColumn("old", F.col("id")), force=True)
    return merged.select(F.col("old").alias("old_id"), F.col("id").alias("new_id"), "filename")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 THEN 'card' END AS publisher, CASE WHEN o_orderkey % 2 = 0 THEN 'note ' || o_custkey END AS note, CASE WHEN o_orderkey % 5 = 0 THEN 'a summary' END AS summary FROM orders""", model=False)
def old_cards_migrated(spark, sf):
    """Cards of metadata and summaries go into the data of orders; what these have stays."""
    o = table(spark, sf, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("publisher"), F.lit("own"))).alias("bib_data"))
    meta = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("meta").alias("kind"), F.to_json(F.create_map(F.lit("publisher"), F.lit("card"), F.lit("note"), F.concat(F.lit("note "), "o_custkey"), F.lit("empty"), F.lit(""))).alias("content"))
    summary = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("summary").alias("kind"), F.lit('{"summary": "a summary"}').alias("content"))
    toc = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("toc").alias("kind"), F.lit('{"note": "a heading"}').alias("content"))
    d, _ = curation.migrate_cards(docs, meta.union(summary).union(toc))
    own = lambda k: F.try_element_at("bib_data", F.lit(k)).alias(k)
    return d.select("id", own("publisher"), own("note"), own("summary"))


# --- regions ----------------------------------------------------------------------------------


@query(f"WITH {_BOX_SQL}, g AS (SELECT doc_id, count(*) AS n FROM b WHERE block_num % 3 <> 0 GROUP BY doc_id) SELECT doc_id, coalesce(n, 1) AS regions FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN g USING (doc_id)", model=False)
def regions_saved(spark, sf):
    """Boxes of line items as regions of their pages: those without an area are left out, and a page without any keeps what it has."""
    new = _boxes(spark, sf).withColumn("region_idx", F.col("block_num")).withColumn("bbox", F.when(F.col("block_num") % 3 == 0, F.array(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[0], F.col("bbox")[3])).otherwise(F.col("bbox")))
    new = new.select("doc_id", "page_num", "region_idx", "bbox")
    have = new.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.lit(0).alias("region_idx"), F.array(*[F.lit(x) for x in (0.0, 0.0, 9.0, 9.0)]).alias("bbox"))
    return pages.save_regions(have, new).groupBy("doc_id").agg(F.count("*").alias("regions"))


def _page_lines(spark, sf):
    return _boxes(spark, sf).select("doc_id", "page_num", "block_num", F.lit(1).alias("line_num"), F.concat(F.lit("b"), "block_num").alias("text"))


@query(f"SELECT doc_id, 'b' || block_num AS text, new_block::INT AS block_num FROM ({SQL['reading_order']})", model=False)
def pages_reordered(spark, sf):
    """Lines of all pages with the block numbers that reading by regions gives."""
    return pages.reorder_page(_page_lines(spark, sf), _boxes(spark, sf), _regions(spark, sf)).select("doc_id", "text", "block_num")


@query(f"SELECT doc_id, 'b' || block_num AS text, row_number() OVER (PARTITION BY doc_id ORDER BY new_block)::INT AS block_num FROM ({SQL['reading_order']}) o JOIN ({SQL['region_assign']}) a USING (doc_id, block_num)", model=False)
def regions_recognised(spark, sf):
    """Recognised blocks that lie in a region, in place of the lines of their pages."""
    blocks = _boxes(spark, sf).withColumn("text", F.concat(F.lit("b"), "block_num"))
    old = _page_lines(spark, sf).withColumn("text", F.lit("old"))
    new = pages.recognised_regions(old, blocks, _regions(spark, sf))
    return new.filter("text <> 'old'").select("doc_id", "text", "block_num")
