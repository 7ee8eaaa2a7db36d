"""Changes as new versions of tables: edits, tags, upserts, removal, packages and merging.

Every function takes DataFrames and returns DataFrames. Deleting is an anti join,
updating a keyed replacement, inserting-or-ignoring an anti join before a union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from foliant.sources.scratch import numbered, started, written

KEY = ["doc_id", "page_num", "block_num"]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same key; later columns are added as nulls. ``new`` has a key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key and not new.schema[c].dataType.typeName().startswith("map")] or key)
    once = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return old.unionByName(once.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def remove_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents (column ``id``) and without any row that belongs to them."""
    gone = ids.select(F.col("id").alias("_gone"))
    return {name: t.join(gone, F.col("id" if name == "documents" else "doc_id") == F.col("_gone"), "left_anti") for name, t in tables.items()}


def set_tags(tags: Column, change: list[str], how: str) -> Column:
    """set, add (in order, without doubles) or remove (nothing left: primary)."""
    new = F.array(*map(F.lit, change)) if change else F.array().cast("array<string>")
    old = F.coalesce(tags, F.array().cast("array<string>"))
    if how == "set":
        return F.array_distinct(new)
    if how == "add":
        return F.array_union(old, new)
    left = F.array_except(old, new)
    return F.when(F.size(left) == 0, F.array(F.lit("primary"))).otherwise(left)


def edit_lines(lines: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, new_text) -> lines with the texts, their flags cleared; and a log row for each change. Blocks are derived again."""
    both = lines.join(edits, "id", "left").withColumn("_changed", F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text")))
    changed = F.col("_changed")
    log = both.filter(changed).select(*KEY, F.col("text").alias("old_value"), F.col("new_text").alias("new_value"))
    new = both.withColumn("text", F.when(changed, F.col("new_text")).otherwise(F.col("text")))
    if "suspect" in lines.columns:
        new = new.withColumn("suspect", F.when(~changed, F.col("suspect")))
    return new.drop("new_text", "_changed"), log


def page_edit_log(old: DataFrame, new: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Blocks of a page against their new version by position: a log row for each layer that changed, with the layer's mark."""
    a, b = old.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in layers]), new.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in layers])
    both = a.join(b, KEY, "full")
    rows = F.array(*[F.struct(F.lit(mark).alias("mark"), F.coalesce(f"_old_{c}", F.lit("")).alias("o"), F.coalesce(f"_new_{c}", F.lit("")).alias("n")) for c, mark in layers.items()])
    r = both.select(*KEY, F.explode(rows).alias("x")).filter("x.o <> x.n")
    return r.select(*KEY, F.concat("x.mark", "x.o").alias("old_value"), F.concat("x.mark", "x.n").alias("new_value"))


#: Layers of a page beside its text, with their marks in the log; labels that a page's new blocks don't take over.
LAYERS, NOT_CARRIED = {"translit": "[转] ", "gloss": "[对] ", "trans": "[译] "}, ["number", "footer", "doc_title"]


def edit_pages(lines: DataFrame, new: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages written anew -> lines, and a log row for each change.

    new: doc_id, page_num, pos (1, 2, ...), text[, translit, gloss, trans]; a block each, as one
    line. ``pages`` (doc_id, page_num) are those to write, where some get no block. Old lines
    in their order and new blocks meet by position: what is on one side alone is logged
    as a text that came or went, else each layer that differs is, with its mark. New lines
    take the label of the page's first text block, and keep the flags (``draft_flags``,
    a map by layer) of the layers that didn't change.
    """
    page = ["doc_id", "page_num"]
    layers = [c for c in LAYERS if c in lines.columns]
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cell = lambda c: F.nullif(F.trim(c), F.lit("")) if c in new.columns else F.lit(None).cast("string")
    new = new.select(*page, F.col("pos").cast("int").alias("pos"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\n+|\n+$", "").alias("text"), *[cell(c).alias(c) for c in layers])
    new = written(new, "new-pages", packed=True)  # read several times; a union of rows that share a partitioning must not be zipped with lines
    given, pages = pages is not None, (new if pages is None else pages).select(*page).distinct()
    flags = "draft_flags" in lines.columns
    # Old lines and new blocks each move once to their page, which has them in lists.
    line = F.struct("block_num", "line_num", "id", "text", *layers, *([F.map_entries("draft_flags").alias("flags")] if flags else []))
    was = lines.join(pages, page, "left_semi").groupBy(*page).agg(F.array_sort(F.collect_list(line)).alias("_was"))
    now = new.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("pos", "text", *layers))).alias("_now"))
    kind = now.schema["_now"].dataType.elementType
    met = F.transform("_now", lambda n: F.struct(n["pos"].alias("pos"), n.alias("n"), F.get("_was", n["pos"] - 1).alias("o")))
    gone = F.array_except(F.sequence(F.lit(1), F.size("_was")), F.coalesce(F.transform("_now", lambda n: n["pos"]), F.array().cast("array<int>")))
    gone = F.transform(gone, lambda i: F.struct(i.alias("pos"), F.lit(None).cast(kind).alias("n"), F.element_at("_was", i).alias("o")))
    entry = lambda mark, a, b: F.when(a != b, F.struct(F.concat(F.lit(mark), a).alias("old_value"), F.concat(F.lit(mark), b).alias("new_value")))
    one_side = F.col("x.n").isNull() | F.col("x.o").isNull()
    text = F.struct(blank("x.o.text").alias("old_value"), blank("x.n.text").alias("new_value"))
    changes = F.when(one_side, F.array(text)).otherwise(F.array_compact(F.array(entry("", blank("x.o.text"), blank("x.n.text")), *[entry(m, blank(f"x.o.{c}"), blank(f"x.n.{c}")) for c, m in LAYERS.items() if c in layers])))
    none = F.array().cast(ArrayType(StructType().add("pos", IntegerType()).add("n", kind).add("o", was.schema["_was"].dataType.elementType)))
    both = now.join(was, page, "full").select(*page, F.explode(F.concat(F.coalesce(met, none), F.coalesce(gone, none))).alias("x"))
    log = both.select(*page, F.col("x.pos").alias("block_num"), F.explode(changes).alias("c")).select(*page, "block_num", "c.old_value", "c.new_value")
    carried = lines.filter(F.col("block_label").isNotNull() & ~F.col("block_label").isin(NOT_CARRIED)).groupBy(*page).agg(F.min_by("block_label", "id").alias("block_label"))
    carried = carried.join(pages, page, "left_semi") if given else carried
    # Pages are numbered, not lines: a page's lines go on from where it starts.
    starts = started(new.groupBy(*page).agg(F.count("*").alias("_rows")), page, "_rows", "_start").drop("_rows")
    rows = (now.join(was, page, "left") if flags else now).join(starts, page, "left").join(carried, page, "left")
    rows = rows.select(*page, "_start", "block_label", *(["_was"] if flags else []), F.posexplode("_now").alias("_n", "n"))
    if flags:
        rows = rows.withColumn("o", F.get("_was", F.col("n.pos") - 1))
        kept = F.map_filter(F.map_from_entries("o.flags"), lambda k, _: ~F.array_contains(F.array_compact(F.array(F.lit(""), *[F.when(blank(f"o.{c}") != blank(f"n.{c}"), F.lit(c)) for c in layers])), k))
        rows = rows.withColumn("draft_flags", F.when(F.size(kept) > 0, kept))
    top = lines.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = rows.join(F.broadcast(top))  # one row by construction
    rows = rows.withColumns({"id": (F.col("_top") + F.col("_start") + F.col("_n") + 1).cast(lines.schema["id"].dataType), "block_num": F.col("n.pos"), "line_num": F.lit(1), "text": F.col("n.text")} | {c: F.col(f"n.{c}") for c in layers})
    rows = rows.select(*[c for c in lines.columns if c in rows.columns])
    return _other_pages(lines, pages).unionByName(rows, allowMissingColumns=True), log


def _other_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of all pages but these; lines meet the shorter list, of pages that go or of pages that stay."""
    page = ["doc_id", "page_num"]
    stay = written(lines.select(*page).distinct().join(pages, page, "left_anti"), "pages-that-stay").withColumnsRenamed({c: f"_{c}" for c in page})
    if stay.count() > pages.count():
        return lines.join(pages, page, "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("page_num").eqNullSafe(F.col("_page_num"))
    return lines.join(stay, same, "left_semi").select(*page, *[c for c in lines.columns if c not in page])


def replace_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the pages that ``new`` has, replaced."""
    return old.join(new.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti").unionByName(new, allowMissingColumns=True)


def append_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New blocks numbered on from the last of their page."""
    last = old.groupBy("doc_id", "page_num").agg(F.max("block_num").alias("_last"))
    moved = new.join(last, ["doc_id", "page_num"], "left").withColumn("block_num", F.col("block_num") + F.coalesce("_last", F.lit(0))).drop("_last")
    return old.unionByName(moved, allowMissingColumns=True)


def dense_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of each page numbered 1, 2, ... after some went."""
    w = Window.partitionBy("doc_id", "page_num").orderBy("block_num")
    return lines.withColumn("block_num", F.dense_rank().over(w))


def package(tables: dict[str, DataFrame], ids: DataFrame, changeset: bool = False) -> dict[str, DataFrame]:
    """Rows of the documents, or of a changeset their packaged revisions alone."""
    own = ids.select(F.col("id").alias("_own"))
    take = {"documents", "revision_log"} if changeset else set(tables)
    out = {n: t.join(own, F.col("id" if n == "documents" else "doc_id") == F.col("_own"), "left_semi") for n, t in tables.items() if n in take}
    if changeset:
        out["revision_log"] = out["revision_log"].filter("in_pkg = 1")
    return out


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Base version (number of revisions) of each packaged document."""
    n = tables["revision_log"].groupBy("doc_id").agg(F.count("*").alias("base_version"))
    return tables["documents"].select(F.col("id").alias("doc_id"), "cite_key", "filename").join(n, "doc_id", "left").fillna(0, ["base_version"])


def newcomers(have: DataFrame, come: DataFrame) -> DataFrame:
    """Rows of ``come`` that get in, one after the other in id order: whose cite key or file name is there already stays out.

    Each round lets in the rows that are first of all that are left with their key
    and with their file name, and drops those that these keep out. Rows that share
    neither with others, i.e. nearly all, are through after one round.
    """
    free = lambda t, taken: t.join(taken.filter("cite_key <> ''").select("cite_key"), "cite_key", "left_anti").join(taken.filter("filename <> ''").select("filename"), "filename", "left_anti")
    left, taken, done = come.select("id", "cite_key", "filename"), have.select("cite_key", "filename"), None
    while True:
        left = written(free(left, taken), "newcomers")
        firsts = lambda c: left.filter(f"{c} <> ''").groupBy(c).agg(F.min("id").alias(f"_{c}"))  # noqa: E731, B023
        ranked = left.join(firsts("cite_key"), "cite_key", "left").join(firsts("filename"), "filename", "left")
        taken = written(ranked.filter("coalesce(_cite_key, id) = id AND coalesce(_filename, id) = id").select("id", "cite_key", "filename"), "let-in")
        done = taken if done is None else done.union(taken)
        if not taken.take(1):
            return come.join(done.select("id"), "id", "left_semi")
        left = left.join(taken.select("id"), "id", "left_anti")


def import_documents(have: DataFrame, come: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged documents and the map old_id -> new_id. A document whose cite key or file name is there is skipped.

    New ids go on from the largest, in the order of old ids. With ``force`` all come
    in: a file name that is there gets ``_imported`` before its ending.
    """
    new = come if force else newcomers(have, come)
    if force:
        there = have.filter("filename IS NOT NULL").select(F.col("filename").alias("_there")).distinct()
        again = F.regexp_replace("filename", r"^(.*?)(\.[^.]*)?$", "$1_imported$2")
        new = new.join(there, F.col("filename") == F.col("_there"), "left").withColumn("filename", F.when(F.col("_there").isNotNull(), again).otherwise(F.col("filename"))).drop("_there")
    top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = numbered(new.select("id"), ["id"]).join(F.broadcast(top)).select(F.col("id").alias("old_id"), (F.col("top") + F.col("n")).alias("new_id"))  # one row by construction
    moved = new.join(ids, F.col("id") == F.col("old_id")).withColumn("id", F.col("new_id")).drop("old_id", "new_id")
    return have.unionByName(moved, allowMissingColumns=True), ids


def import_children(have: DataFrame, come: DataFrame, ids: DataFrame) -> DataFrame:
    """Child rows of imported documents, with their new document ids; ids of their own go on from the largest, in their order."""
    moved = come.join(ids, F.col("doc_id") == F.col("old_id")).withColumn("doc_id", F.col("new_id")).drop("old_id", "new_id")
    if "id" in come.columns and "id" in have.columns:
        top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
        moved = numbered(moved, ["id"], "_n").join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast(come.schema["id"].dataType)).drop("_n", "_top")  # one row by construction
    return have.unionByName(moved, allowMissingColumns=True)


def attach_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """A file for each document: by its linked name first, then by its file name."""
    f = files.select(F.col("name"), F.col("path"))
    want = docs.select("id", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("linked_pdf").alias("name")), F.struct(F.lit(2).alias("p"), F.col("filename").alias("name")))).alias("w")).select("id", "w.p", "w.name")
    best = want.join(f, "name").groupBy("id").agg(F.min_by("path", F.struct("p", "path")).alias("path"))
    return docs.join(best, "id", "left")


def cards_to_index(cards: DataFrame, docs: DataFrame) -> DataFrame:
    """Reviewed table-of-contents and entity cards of known documents: what is searched."""
    own = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"))
    return cards.filter((F.col("status") == "reviewed") & F.col("kind").isin("toc", "entity")).join(own, "doc_id")


def merge_maps(dst: Column, src: Column) -> Column:
    """Both maps; the first one's values win."""
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(dst, empty)
    return F.map_concat(F.map_filter(F.coalesce(src, empty), lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
