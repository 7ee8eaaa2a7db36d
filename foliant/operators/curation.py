"""Corrections by hand, as new versions of tables: metadata, entities, misses, reports, notes, revisions, clearing up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import clean_field, source_flags
from foliant.operators.layout import valid_rect
from foliant.operators.mutate import merge_maps, remove_documents, upsert
from foliant.sources import bibtex
from foliant.sources.scratch import numbered, written
from foliant.streaming.intake import vanished

NOTE_KINDS = ("rect", "text", "pen")


# --- metadata ---------------------------------------------------------------------


def update_metadata(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after ``changes`` (id, and any of source_tags, lang, tri_rows, linked_pdf, bib_type, bib_data): null leaves a field as it is.

    An empty ``linked_pdf`` or ``lang`` takes the field back; values that aren't allowed
    change nothing. Where the bibliographic data change, title and author follow them, and
    the cite key is made anew: it stays if it is what the data give, else it is the first
    free one of the collection.
    """
    new = lambda c: F.col(f"_{c}") if f"_{c}" in cols else F.lit(None).cast(docs.schema[c].dataType)
    c = changes.select(F.col("id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in changes.columns if k != "id"])
    cols = set(c.columns)
    both = docs.join(c, F.col("id") == F.col("_id"), "left")
    pdf, lang = F.trim(new("linked_pdf")), F.lower(F.trim(new("lang")))
    good_pdf = pdf.startswith("files/") & ~F.contains(pdf, F.lit("..")) & ~F.contains(pdf, F.lit("\\"))
    tags = F.filter(F.transform(new("source_tags"), lambda t: F.trim(t)), lambda t: t != "")
    touched = new("bib_type").isNotNull() | new("bib_data").isNotNull()
    both = both.withColumns(
        {
            "linked_pdf": F.when(pdf == "", None).when(good_pdf, pdf).otherwise(F.col("linked_pdf")),
            "lang": F.when(lang == "", "zh").when(lang.rlike("^[a-z0-9-]+$"), lang).otherwise(F.col("lang")),
            "tri_rows": F.when(new("tri_rows").isin(1, 3, 4), new("tri_rows")).otherwise(F.col("tri_rows")),
            "source_tags": F.when(F.size(tags) > 0, tags).otherwise(F.col("source_tags")),
            "bib_type": F.coalesce(new("bib_type"), F.col("bib_type")),
            "bib_data": F.coalesce(new("bib_data"), F.col("bib_data")),
            "_touched": touched,
        }
    )
    own = lambda k: F.try_element_at("bib_data", F.lit(k))
    both = both.withColumns({"title": F.when(touched, clean_field(own("title"))).otherwise(F.col("title")), "author": F.when(touched, clean_field(own("author"))).otherwise(F.col("author"))})
    both = both.drop(*cols)
    base = bibtex.cite_key_base(own("author"), own("year"), own("date"), own("title"), own("volume"), own("number"))
    todo = both.filter("_touched").withColumn("_base", base)
    rest = both.filter("NOT coalesce(_touched, false)").drop("_touched")
    keep = todo.filter("cite_key = _base").drop("_touched", "_base")
    again = todo.filter("cite_key IS NULL OR cite_key <> _base")
    keyed = bibtex.distinct_cite_keys(again, "_base", "filename", existing=rest.unionByName(keep).filter("cite_key IS NOT NULL").select("collection", "cite_key"))
    return rest.unionByName(keep).unionByName(keyed.drop("_touched", "_base").select(docs.columns))


def with_flags(docs: DataFrame, tags_json: str = "tags_json") -> DataFrame:
    """Documents with the three flags of their tags."""
    return docs.withColumn("_f", source_flags(F.col(tags_json))).select(*docs.columns, "_f.*")


def migrate_cards(docs: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards of the kinds ``meta`` and ``summary`` go into the documents' data (what is there stays), and out of the cards."""
    old = cards.filter(F.col("kind").isin("meta", "summary")).select("doc_id", F.from_json("content", "map<string,string>").alias("m")).filter("m IS NOT NULL")
    flat = old.select("doc_id", F.explode("m").alias("k", "v")).filter("v <> ''").groupBy("doc_id", "k").agg(F.min("v").alias("v"))
    one = flat.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_old"))
    d = docs.join(one, F.col("id") == F.col("doc_id"), "left").drop("doc_id")
    return d.withColumn("bib_data", F.when(F.col("_old").isNotNull(), merge_maps(F.col("bib_data"), F.col("_old"))).otherwise(F.col("bib_data"))).drop("_old"), cards.filter(~F.col("kind").isin("meta", "summary"))


# --- entities ----------------------------------------------------------------------


def mentions_of(mentions: DataFrame, docs: DataFrame, entity_id: int | None = None) -> DataFrame:
    """Mentions with title and file name of their document, where it is known, in order of place."""
    d = docs.select(F.col("id").alias("doc_id"), "title", "filename")
    m = mentions if entity_id is None else mentions.filter(F.col("entity_id") == entity_id)
    return m.join(d, "doc_id", "left").orderBy("doc_id", "page_num", "block_num")


def reports_of(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Reports with the name of their entity, where it is known."""
    return reports.join(entities.select(F.col("id").alias("entity_id"), "canonical"), "entity_id", "left")


def set_valid(mentions: DataFrame, ids: DataFrame, valid: bool = False) -> DataFrame:
    """Mentions of which those of ``ids`` (id) count or don't count any more."""
    chosen = ids.select(F.col("id").alias("_of")).distinct()
    return mentions.join(chosen, F.col("id") == F.col("_of"), "left").withColumn("valid", F.when(F.col("_of").isNotNull(), F.lit(valid)).otherwise(F.col("valid"))).drop("_of")


def allowed_additions(additions: DataFrame, entities: DataFrame) -> DataFrame:
    """Additions (entity_id, kind, value, evidence) of known entities: aliases, and properties and links with evidence."""
    shown = F.coalesce(F.trim("evidence"), F.lit("")) != ""
    good = (F.col("kind") == "alias") | (F.col("kind").isin("prop", "link") & shown)
    return additions.filter(good).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def with_aliases(entities: DataFrame, additions: DataFrame) -> DataFrame:
    """Entities with the aliases that are added to them, after their own, none twice."""
    new = additions.filter("kind = 'alias' AND trim(value) <> ''").groupBy("entity_id").agg(F.array_sort(F.collect_set(F.trim("value"))).alias("_new"))
    none = F.array().cast("array<string>")
    e = entities.join(new, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
    added = F.filter(F.coalesce("_new", none), lambda a: a != F.col("canonical"))
    return e.withColumn("aliases", F.array_union(F.coalesce("aliases", none), added)).drop("_new")


def with_constraints(entities: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with era, scope, year_start and year_end (texts by entity_id) in their properties, and an addition that records each change.

    Null or blank values and years that aren't whole numbers change nothing.
    """
    names = ("era", "scope", "year_start", "year_end")
    value = lambda k: F.trim(F.col(k)) if k in names[:2] else F.trim(F.col(k)).try_cast("int").cast("string")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in names]), lambda p: p["value"].isNotNull() & (p["value"] != ""))
    c = constraints.select("entity_id", F.map_from_entries(pairs).alias("_c")).filter(F.size("_c") > 0).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    e = entities.join(c, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
    own = F.coalesce("props", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys("_c"), k)), F.col("_c"))
    log = c.select("entity_id", F.lit("prop").alias("kind"), F.to_json("_c").alias("value"), F.lit("constraint").alias("evidence"))
    return e.withColumn("props", F.when(F.col("_c").isNotNull(), merged).otherwise(F.col("props"))).drop("_c"), log


def add_reports(reports: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Reports and new ones on known entities; a missing kind is ``other``, a missing source ``web``."""
    good = new.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    filled = good.withColumns({"kind": F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("other")), "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("web")), "resolved": F.lit(0)})
    return reports.unionByName(filled, allowMissingColumns=True)


def resolve_items(rows: DataFrame, chosen: DataFrame, resolved: int = 1) -> DataFrame:
    """Misses or reports of which those of ``chosen`` (id, and perhaps note) are resolved or open again; a note replaces the old one."""
    c = chosen.select(F.col("id").alias("_of"), *([F.col("note").alias("_note")] if "note" in chosen.columns else []))
    both = rows.join(c, F.col("id") == F.col("_of"), "left").withColumn("resolved", F.when(F.col("_of").isNotNull(), F.lit(resolved)).otherwise(F.col("resolved")))
    if "note" in chosen.columns:
        both = both.withColumn("note", F.coalesce("_note", "note"))
    return both.select(rows.columns)


def drop_items(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(chosen.select("id"), "id", "left_anti")


def miss_to_alias(entities: DataFrame, misses: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id of a miss, entity: an id or a name) -> entities, additions and misses afterwards.

    The miss's query becomes an alias of the entity with that id, canonical name or
    alias (the least id); where there is none, an entity of that name comes into being.
    """
    want = chosen.select(F.col("id").alias("miss"), F.trim("entity").alias("want")).filter("want <> ''").join(misses.select(F.col("id").alias("miss"), "query"), "miss")
    names = entities.select(F.col("id").alias("eid"), F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("want"))
    by_name = want.filter("NOT want RLIKE '^[0-9]+$'").join(names, "want").groupBy("miss").agg(F.min("eid").alias("by_name"))
    by_id = want.filter("want RLIKE '^[0-9]+$'").join(entities.select(F.col("id").alias("by_id")), F.col("want").cast("long") == F.col("by_id")).select("miss", "by_id")
    w = want.join(by_name, "miss", "left").join(by_id, "miss", "left").withColumn("eid", F.coalesce("by_id", "by_name"))
    fresh = numbered(w.filter("eid IS NULL").select("want").distinct(), ["want"])
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = written(fresh.join(F.broadcast(top)).select("want", (F.col("n") + F.col("_top")).alias("new_id")), "new-entities")  # one row by construction
    w = w.join(fresh, "want", "left").withColumn("entity_id", F.coalesce("eid", "new_id"))
    made = fresh.select(F.col("new_id").alias("id"), F.col("want").alias("canonical"), F.array().cast("array<string>").alias("aliases"), F.lit("manual").alias("origin"))
    alias = w.select("entity_id", F.lit("alias").alias("kind"), F.col("query").alias("value"), F.concat(F.lit("miss "), F.col("miss")).alias("evidence"))
    born = w.filter("new_id IS NOT NULL").select("entity_id", F.lit("entity_new").alias("kind"), F.to_json(F.struct(F.col("want").alias("canonical"), F.col("query").alias("alias"))).alias("value"), F.concat(F.lit("miss "), F.col("miss")).alias("evidence"))
    everyone = with_aliases(entities.unionByName(made, allowMissingColumns=True), alias)
    names = everyone.select(F.col("id").alias("entity_id"), "canonical")
    notes = w.join(names, "entity_id").select(F.col("miss").alias("id"), F.concat(F.lit("alias of "), "canonical").alias("note"))
    return everyone, born.unionByName(alias), resolve_items(misses, notes)


# --- notes and talk -------------------------------------------------------------------


def valid_notes(notes: DataFrame) -> DataFrame:
    """Notes (kind, coords as JSON, ...) that can be kept: strokes of two points or more, else a rectangle in the unit square.

    Rectangles are held to the square; blank notes and clips are null, an unknown origin is ``human``.
    """
    points = F.from_json("coords", "array<array<double>>")
    r = F.from_json("coords", "struct<x:double,y:double,w:double,h:double>")
    rect = valid_rect(r["x"], r["y"], r["w"], r["h"])
    good = F.when(F.col("kind") == "pen", F.size(points) >= 2).otherwise(rect.isNotNull())
    n = notes.filter(F.col("kind").isin(*NOTE_KINDS) & F.coalesce(good, F.lit(False)))
    return n.withColumns(
        {
            "coords": F.when(F.col("kind") == "pen", F.col("coords")).otherwise(F.to_json(rect)),
            "note": clean_field(F.col("note")), "clip_text": clean_field(F.col("clip_text")),
            "origin": F.when(F.col("origin").isin("human", "ai"), F.col("origin")).otherwise("human"),
        }
    )


def put_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with new ones and new versions of those that are there, by id."""
    return upsert(notes, valid_notes(new), ["id"])


def add_turns(chat: DataFrame, new: DataFrame) -> DataFrame:
    """Talk with new turns (conv_id, role, text, in order of ``pos``) after the last of their conversation."""
    last = chat.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    moved = new.withColumn("_n", n).join(last, "conv_id", "left").withColumn("turn", F.coalesce("_last", F.lit(-1)) + F.col("_n")).drop("_last", "_n", "pos")
    return chat.unionByName(moved, allowMissingColumns=True)


# --- revisions -------------------------------------------------------------------------


def revisions_of(log: DataFrame, doc_id: int | None = None, limit: int = 200) -> DataFrame:
    """Revisions, newest first, with whether their basis is still missing; at most 1000."""
    own = log if doc_id is None else log.filter(F.col("doc_id") == doc_id)
    return own.withColumn("needs_basis", F.coalesce(F.trim("basis"), F.lit("")) == "").orderBy(F.desc("id")).limit(min(max(limit, 1), 1000))


def set_basis(log: DataFrame, basis: DataFrame) -> DataFrame:
    """Revisions with the basis that ``basis`` (id, basis) gives, trimmed."""
    b = basis.select(F.col("id").alias("_of"), F.trim(F.col("basis")).alias("_b"))
    return log.join(b, F.col("id") == F.col("_of"), "left").withColumn("basis", F.coalesce("_b", "basis")).select(log.columns)


def toggle_packaged(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Revisions of which those of ``ids`` change whether they go into a change package."""
    t = ids.select(F.col("id").alias("_of")).distinct()
    return log.join(t, F.col("id") == F.col("_of"), "left").withColumn("in_pkg", F.when(F.col("_of").isNotNull(), 1 - F.coalesce("in_pkg", F.lit(0))).otherwise(F.col("in_pkg"))).select(log.columns)


# --- clearing up -------------------------------------------------------------------------


class TooMany(ValueError):
    """So many files are gone that the folder itself may be."""


def purge_missing(tables: dict[str, DataFrame], listing: DataFrame, confirmed: bool = False, most: int = 100) -> dict[str, DataFrame]:
    """All tables without the documents whose file is gone; more than ``most`` of them must be confirmed."""
    gone = vanished(listing, tables["documents"]).select("id")
    if not confirmed and (n := gone.limit(most + 1).count()) > most:
        raise TooMany(f"at least {n} files are missing")
    return remove_documents(tables, gone)


def safe_to_extract(docs: DataFrame, lines: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per document: rows with a translation or gloss, revisions, and whether a new extraction would lose none."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    work = lines.groupBy("doc_id").agg(F.count_if(full("trans") | full("gloss")).alias("worked_rows"))
    log = revisions.groupBy("doc_id").agg(F.count("*").alias("revisions"))
    d = docs.select(F.col("id").alias("doc_id")).join(work, "doc_id", "left").join(log, "doc_id", "left").fillna(0, ["worked_rows", "revisions"])
    return d.withColumn("safe", (F.col("worked_rows") == 0) & (F.col("revisions") == 0))
