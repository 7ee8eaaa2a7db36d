"""Counts and listings: collections, documents, page states, search use, staleness, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collection_stats(docs: DataFrame, blocks: DataFrame, lines: DataFrame, total: bool = False) -> DataFrame:
    """Documents, pages, blocks and lines of each collection; with ``total`` also over all, as a null collection."""
    per = lambda t, name: t.groupBy("doc_id").agg(F.count("*").alias(name))
    d = docs.join(per(blocks, "b").withColumnRenamed("doc_id", "id"), "id", "left").join(per(lines, "l").withColumnRenamed("doc_id", "id"), "id", "left")
    g = d.rollup("collection") if total else d.groupBy("collection")
    return g.agg(
        F.count("*").alias("docs"), F.sum("page_count").alias("pages"), F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("l"), F.lit(0)).alias("lines"),
        F.count_if(F.col("doc_type") == "ocr").alias("ocr_docs"), F.count_if(F.col("doc_type").isNull() | (F.col("doc_type") == "born-digital")).alias("born_digital_docs"),
    )


def tag_histogram(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("source_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("docs"))


def page_states(states: DataFrame) -> DataFrame:
    """Pages done, pages in error and the sorted numbers of these, by document."""
    bad = F.col("status") == "error"
    return states.groupBy("doc_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(bad).alias("errors"), F.array_sort(F.collect_list(F.when(bad, F.col("page_num")))).alias("error_pages"))


def docs_page(docs: DataFrame, tag: str | None = None, text: str | None = None, bib_type: str | None = None, year: str | None = None, sort: str = "id", descending: bool = False, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of a filtered listing, with the number of all rows; only listed columns can sort it."""
    d = docs
    if tag:
        d = d.filter(F.array_contains("source_tags", tag))
    if text:
        d = d.filter(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("author"), F.lit(text.lower())))
    if bib_type:
        d = d.filter(F.col("bib_type") == bib_type)
    if year:
        d = d.filter(F.substring(F.coalesce("bib_date", "bib_year"), 1, 4) == year)
    key = F.col(sort if sort in ("id", "title", "author", "bib_year", "cite_key", "page_count", "created_at") else "id")
    total = d.agg(F.count("*").alias("total"))
    rows = d.orderBy(key.desc() if descending else key.asc(), "id").offset((max(1, page) - 1) * limit).limit(limit)
    return rows.join(F.broadcast(total))  # one row by construction


def search_use(events: DataFrame, last: int = 2000) -> DataFrame:
    """Use of the latest searches: how many, without a hit, clicked; click rates over all, with and without an entity hit; the difference of the last two.

    Rates are rounded to four places, and null where there is nothing to count; the difference is one of rounded rates.
    """
    e = events.orderBy(F.desc("id")).limit(last)
    rate = lambda c: F.bround(F.avg(F.when(c, F.col("clicked").cast("double"))), 4)
    own, none = F.col("entity_hits") > 0, F.col("entity_hits") == 0
    a = e.agg(
        F.count("*").alias("searches"), F.count_if(F.col("total_docs") == 0).alias("zero_hit"), F.count_if(F.col("clicked")).alias("clicked"), rate(F.lit(True)).alias("ctr"),
        F.count_if(own).alias("with_entity"), rate(own).alias("ctr_with_entity"), rate(none).alias("ctr_without_entity"), F.count_if(F.col("expanded")).alias("expanded"),
    )
    return a.withColumn("entity_lift", F.bround(F.col("ctr_with_entity") - F.col("ctr_without_entity"), 4))


def with_clicks(events: DataFrame, clicks: DataFrame) -> DataFrame:
    """Search events of which those that ``clicks`` (event_id) names count as clicked; once is enough."""
    c = clicks.select(F.col("event_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    return events.join(c, "id", "left").withColumn("clicked", F.coalesce("clicked", F.lit(False)) | F.col("_c").isNotNull()).drop("_c")


def retained(events: DataFrame, keep: int = 5000) -> DataFrame:
    """Events with an id among the last ``keep`` numbers."""
    top = events.agg(F.max("id").alias("_top"))
    return events.join(F.broadcast(top)).filter(F.col("id") > F.col("_top") - keep).drop("_top")  # one row by construction


def open_items(rows: DataFrame, newest: str, resolved: bool = False, limit: int = 200) -> DataFrame:
    """Misses or reports: those not yet resolved, or all with these first; newest first; at most 1000."""
    some = rows if resolved else rows.filter("resolved = 0")
    return some.orderBy("resolved", F.desc(newest), F.desc("id")).limit(max(1, min(limit, 1000)))


def distinct_pages(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page_num").distinct()


def search_misses(events: DataFrame) -> DataFrame:
    """Queries without a hit: how often, first and last time."""
    return events.filter("total_docs = 0").groupBy("query").agg(F.count("*").alias("hits"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))


def missing_translation(lines: DataFrame) -> DataFrame:
    """Lines without translation and their characters, by document, most first."""
    blank = F.coalesce(F.trim("trans"), F.lit("")) == ""
    g = lines.groupBy("doc_id").agg(F.count_if(blank).alias("missing_rows"), F.coalesce(F.sum(F.when(blank, F.length("text"))), F.lit(0)).alias("missing_chars"))
    return g.filter("missing_rows > 0").orderBy(F.desc("missing_chars"), "doc_id")


def stale(status: DataFrame, revisions: DataFrame) -> DataFrame:
    """Compiled pages whose document has more revisions now than when they were compiled."""
    now = revisions.groupBy("doc_id").agg(F.count("*").alias("revisions"))
    return status.join(now, "doc_id", "left").select("doc_id", "base_edits", F.coalesce("revisions", F.lit(0)).alias("revisions"), (F.coalesce("revisions", F.lit(0)) > F.col("base_edits")).alias("stale"))


def latest(rows: DataFrame, keep: int = 5000, id_col: str = "id") -> DataFrame:
    """The last ``keep`` rows of a log."""
    return rows.orderBy(F.desc(id_col)).limit(keep)


def chat_tail(chat: DataFrame, turns: int = 12, most_chars: int = 8000) -> DataFrame:
    """Of each conversation the newest turns, at most ``turns``, back to the first that would overflow."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = chat.withColumns({"back": F.row_number().over(w), "chars": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return t.filter((F.col("back") <= turns) & (F.col("chars") <= most_chars)).select("conv_id", "turn", "role", "text")


def quota_pools(docs: DataFrame, quotas: dict[str, float], most_jobs: int = 100_000) -> dict[int, str]:
    """Documents, longest first, each to the pool with the least share of its quota: a fold over a list of jobs on the driver.

    A longer list than ``most_jobs`` is refused: take the documents of one run.
    """
    jobs = docs.orderBy(F.desc("missing_chars"), "doc_id").select("doc_id", "missing_chars").limit(most_jobs + 1).collect()
    if len(jobs) > most_jobs:
        raise ValueError(f"over {most_jobs} jobs")
    used, out = dict.fromkeys(quotas, 0.0), {}
    for r in jobs:
        pool = min(quotas, key=lambda k: (used[k] / quotas[k], k))
        used[pool] += r.missing_chars
        out[r.doc_id] = pool
    return out


def integrity(docs: DataFrame, listing: DataFrame) -> DataFrame:
    """Per collection: documents, files found, files missing, virtual documents, files that no document names."""
    files = listing.select("collection", "filename", F.lit(1).alias("there")).distinct()
    both = docs.select("collection", "filename", "original_virtual").join(files, ["collection", "filename"], "full")
    virtual = F.coalesce("original_virtual", F.lit(False))
    known = F.col("original_virtual").isNotNull()
    return both.groupBy("collection").agg(F.count_if(known).alias("docs"), F.count_if(known & F.col("there").isNotNull()).alias("found"), F.count_if(known & F.col("there").isNull() & ~virtual).alias("missing"), F.count_if(virtual).alias("virtual"), F.count_if(~known).alias("orphans"))


def same_name_elsewhere(docs: DataFrame) -> DataFrame:
    """File names that several collections have."""
    return docs.groupBy("filename").agg(F.array_sort(F.collect_set("collection")).alias("collections")).filter(F.size("collections") > 1)


def pending_ocr(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """PDFs that aren't recognised yet, but for native ones that have a line."""
    d = docs.filter((F.coalesce("doc_type", F.lit("")) != "ocr") & F.lower("filename").endswith(".pdf"))
    native = lines.select(F.col("doc_id").alias("id")).distinct().withColumn("has_line", F.lit(True))
    return d.join(native, "id", "left").filter(~((F.col("doc_type") == "pdf_native") & F.coalesce("has_line", F.lit(False)))).drop("has_line")


def has_text(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""
