"""Entities: names, resolution of surfaces, mentions, neighbours, audit and merging."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foliant.functions.text import repeats_itself
from foliant.sources.scratch import numbered, written

NORM = r"\s+"


def entity_names(entities: DataFrame) -> DataFrame:
    """One row for each canonical name and alias."""
    names = F.filter(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))), lambda n: F.trim(n) != "")
    return entities.select(F.col("id").alias("entity_id"), F.explode(names).alias("name"))


def distinct_seeds(seeds: DataFrame) -> DataFrame:
    """The first of seeds whose surfaces are equal without white space, in document order."""
    norm = F.regexp_replace("surface", NORM, "")
    w = Window.partitionBy("doc_id", "norm").orderBy("pos")
    return seeds.withColumn("norm", norm).filter("norm <> ''").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def resolve(surfaces: DataFrame, entities: DataFrame) -> DataFrame:
    """surface -> entity: a canonical name first, else an alias (the least entity id), else null."""
    norm = lambda c: F.regexp_replace(c, NORM, "")
    s = surfaces.select("surface", norm("surface").alias("norm")).distinct()
    canon = entities.groupBy(norm("canonical").alias("norm")).agg(F.min("id").alias("by_name"))
    alias = entities.select("id", F.explode("aliases").alias("a")).groupBy(norm("a").alias("norm")).agg(F.min("id").alias("by_alias"))
    return s.join(canon, "norm", "left").join(alias, "norm", "left").select("surface", F.coalesce("by_name", "by_alias").alias("entity_id"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("none").alias("how"))


def with_new_entities(resolved: DataFrame, first_seen: DataFrame, top_id: int) -> DataFrame:
    """Surfaces that nothing resolves get ids after ``top_id``, in order of first (doc_id, pos); ranges are numbered each by itself."""
    new = resolved.filter("entity_id IS NULL").join(first_seen, "surface").groupBy("surface").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    ids = numbered(new.select("surface", "at.doc_id", "at.pos"), ["doc_id", "pos", "surface"], "new_id")
    ids = ids.select("surface", (F.col("new_id") + top_id).alias("new_id"))
    return resolved.join(ids, "surface", "left").select("surface", F.coalesce("entity_id", "new_id").alias("entity_id"), "how")


#: Pages of a document whose blocks one automaton walks; names of an automaton that goes to all tasks, by characters.
PAGES_AT_ONCE, MOST_CHARS = 64, 8_000_000


def _automaton(surfaces: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in surfaces:
        a.add_word(s, s)
    a.make_automaton()
    return a


def _walk(automaton: ahocorasick.Automaton, text: str | None) -> list[str]:
    """Surfaces that stand in a text, once each."""
    return sorted({s for _, s in automaton.iter(text)}) if text and len(automaton) else []


def _first(hits: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("doc_id", "s").orderBy("page_num", "block_num")
    return hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def places_in_document(seeds: DataFrame, blocks: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, s) and blocks -> doc_id, s, page_num, block_num: the first ``most`` blocks of the seed's document that hold it.

    One automaton of a document's seeds walks its blocks once; a long document is
    dealt in stretches of ``PAGES_AT_ONCE`` pages, each with all its seeds. Texts and
    seeds are without white space, and seeds of one character are left out.
    """
    cell = F.floor(F.col("page_num") / PAGES_AT_ONCE).cast("int").alias("cell")
    text = blocks.select("doc_id", cell, "page_num", "block_num", F.regexp_replace("index_text", NORM, "").alias("t"))
    own = seeds.filter(F.length("s") >= 2).select("doc_id", "s").distinct()
    own = own.join(blocks.select("doc_id", cell).distinct(), "doc_id")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                d, names, texts = (batch.column(c)[at].as_py() for c in range(3))
                automaton, found, count = _automaton(names), [], Counter()
                for x in texts:  # in order of pages and blocks
                    for s in _walk(automaton, x["t"]):
                        count[s] += 1
                        if count[s] <= most:
                            found.append((d, s, x["page_num"], x["block_num"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found), shape)], schema=shape)

    shape = pa.schema([("doc_id", pa.int64()), ("s", pa.string()), ("page_num", pa.int32()), ("block_num", pa.int32())])
    names = own.groupBy("doc_id", "cell").agg(F.collect_list("s").alias("names"))
    texts = text.groupBy("doc_id", "cell").agg(F.array_sort(F.collect_list(F.struct("page_num", "block_num", "t"))).alias("texts"))
    hits = names.join(texts, ["doc_id", "cell"]).select("doc_id", "names", "texts").mapInArrow(walk, "doc_id long, s string, page_num int, block_num int")
    return _first(hits, most)


def anchor_mentions(seeds: DataFrame, blocks: DataFrame, most: int = 20) -> DataFrame:
    """Blocks of the seed's document that hold its surface (two characters or more), the first ``most``; else one row without a block."""
    own = seeds.select("doc_id", "surface", F.regexp_replace("surface", NORM, "").alias("s")).distinct()
    hits = places_in_document(own, blocks, most)
    return own.join(hits, ["doc_id", "s"], "left").select("doc_id", "surface", "page_num", "block_num")


def places_of_names(names: DataFrame, blocks: DataFrame, most: int = 20) -> DataFrame:
    """(surface and perhaps more) and blocks -> surface, doc_id, page_num, block_num and what names have more: of each document, the first ``most`` blocks that hold the name (two characters or more).

    All names make one automaton that goes to all tasks, up to ``MOST_CHARS`` characters; more names go
    by hash into several, each of which walks the blocks once. Places move as numbers of names, once; their
    rows are told from what all tasks have.
    """
    keep = [c for c in names.columns if c != "surface"]
    own = names.select("surface", F.regexp_replace("surface", NORM, "").alias("s"), *keep).filter(F.length("s") >= 2).distinct()
    own = written(own, "names")
    rounds = -(-(own.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]) // MOST_CHARS)
    text, found = blocks.select("doc_id", "page_num", "block_num", F.regexp_replace("index_text", NORM, "").alias("t")), None
    shape = own.select("surface", *keep).schema
    for n in range(rounds):
        part = own.filter(F.pmod(F.xxhash64("s"), F.lit(rounds)) == n) if rounds > 1 else own
        rows: dict[str, list[dict]] = {}
        for r in part.collect():
            rows.setdefault(r.s, []).append({c: r[c] for c in shape.names})
        shared = names.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(rows)))
        told = names.sparkSession.sparkContext.broadcast(list(rows.values()))
        hits = text.mapInArrow(_held(shared, most), StructType([*text.drop("t").schema, StructField("s", IntegerType())]))
        hits = _first(hits.repartition("doc_id"), most)  # a document's places stay together
        some = hits.select("doc_id", "page_num", "block_num", F.explode(_told(told, shape)("s")).alias("x")).select("x.*", "doc_id", "page_num", "block_num")
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = own.drop("s").limit(0).join(text.select("doc_id", "page_num", "block_num").limit(0))
    return found.select("surface", "doc_id", "page_num", "block_num", *keep)


def _told(told: Broadcast, shape: StructType) -> Callable[[str], Column]:
    """The rows of names by number."""
    kind = ArrayType(shape)

    @F.arrow_udf(kind)
    def rows(numbers: pa.Array) -> pa.Array:
        return pa.array([told.value[k] for k in numbers.to_pylist()], to_arrow_type(kind))

    return rows


def _held(shared: Broadcast, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """Blocks (doc_id, page_num, block_num, t) -> their places by number of name; while blocks of a document come in order, those after the first ``most`` stay out."""

    def run(batches):
        automaton = _kept_automaton(shared)
        doc, last, count = None, None, Counter()
        for b in batches:
            rows, found = [], []
            for at, (d, page, block, t) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                place = None if page is None or block is None else (page, block)
                if d != doc or place is None or last is None or place < last:
                    count.clear()
                doc, last = d, place
                for k in sorted({k for _, k in automaton.iter(t)}) if t and len(automaton) else ():
                    count[k] += 1
                    if count[k] <= most:
                        rows.append(at)
                        found.append(k)
            some = b.select(["doc_id", "page_num", "block_num"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.int32())], [*some.schema.names, "s"])

    return run


_KEPT: dict[str, ahocorasick.Automaton] = {}


def _kept_automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast (name, surfaces), built once a Python worker; only the last one is kept."""
    name, surfaces = shared.value
    if name not in _KEPT:
        _KEPT.clear()
        a = ahocorasick.Automaton()
        for k, s in enumerate(surfaces):
            a.add_word(s, k)
        a.make_automaton()
        _KEPT[name] = a
    return _KEPT[name]


def compiled(docs: DataFrame, seeds: DataFrame, entities: DataFrame, mentions: DataFrame, blocks: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions after some documents were compiled anew: their mentions are replaced, those of others stay.

    seeds: doc_id, pos, surface, page_num, block_num, of the documents to compile. Of
    equal seeds of a document the first counts. Surfaces that no entity has become
    entities. A seed that knows its block keeps it; others are anchored in the texts,
    and stay at their page where nothing is found. A document without seeds loses its mentions.
    """
    own = written(distinct_seeds(seeds.join(docs.select("doc_id"), "doc_id", "left_semi")), "seeds")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    who = written(with_new_entities(resolve(own.select("surface"), entities), own.select("surface", "doc_id", "pos"), top), "resolved")
    new = who.filter(F.col("entity_id") > top).select(F.col("entity_id").alias("id"), F.col("surface").alias("canonical"))
    lost = own.filter("coalesce(block_num, 0) = 0").select("doc_id", F.col("norm").alias("s"))
    hits = places_in_document(lost, blocks, most).select("doc_id", F.col("s").alias("norm"), F.col("page_num").alias("p"), F.col("block_num").alias("b"))
    rows = own.join(hits, ["doc_id", "norm"], "left").join(who.select("surface", "entity_id"), "surface")
    rows = rows.select("entity_id", "doc_id", F.coalesce("p", "page_num").alias("page_num"), F.coalesce("b", "block_num").alias("block_num"), "surface", F.lit(True).alias("valid"))
    rest = mentions.join(docs.select("doc_id"), "doc_id", "left_anti")
    return entities.unionByName(new, allowMissingColumns=True), rest.unionByName(rows, allowMissingColumns=True)


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    n = mentions.filter("valid").groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return entities.select(F.col("id").alias("entity_id"), "canonical").join(n, "entity_id", "left").fillna(0, ["mentions"])


#: Counts that a task of ``neighbours`` holds at once, pairs that it adds up at once, codes in a packed row of pages, and packed rows that it takes at once.
MOST_COUNTS, MOST_PAIRS, PACKED, AT_ONCE = 1 << 25, 1 << 19, 1 << 14, 64


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Lists of codes -> rows of many lists: their sizes and their codes as bytes, which are read without a step a code."""
    for b in batches:
        sizes = b.column("codes").value_lengths().to_numpy(zero_copy_only=False)
        codes = b.column("codes").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        row = (ends - 1) // PACKED  # a list of more codes has a row of its own or ends one
        cuts = [0, *(np.flatnonzero(np.diff(row)) + 1), len(sizes)] if len(sizes) else []
        for at, to in zip(cuts, cuts[1:]):
            some = codes[ends[at] - sizes[at] : ends[to - 1]]
            yield pa.record_batch({"sizes": pa.array([sizes[at:to].astype(np.int32).tobytes()], pa.binary()), "codes": pa.array([some.astype(np.int32).tobytes()], pa.binary())})


def _added(counts: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> None:
    """Adds one at (row, code) for each row and all codes of its page, which begin at its start; pairs are made a stretch at a time."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
        n = sizes[at:to]
        place = np.arange(n.sum()) + np.repeat(starts[at:to] - np.cumsum(n) + n, n)
        np.add.at(counts.reshape(-1), np.repeat(rows[at:to] * counts.shape[1], n) + codes[place], 1)
        at = to


def _best_of_cell(cells: int, names: int, top: int) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """Packed rows with the number of one cell -> code, other, pages: the first ``top`` others of each code of the cell, which has codes in a row."""
    width = -(-names // cells)

    def joined(column: pa.Array) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in column])

    def run(batches):
        _KEPT.clear()  # a worker that has found names before makes room
        counts = None
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                if counts is None:
                    first = b.column("cell")[0].as_py() * width
                    counts = np.zeros((max(0, min(width, names - first)), names), np.int32)
                sizes, codes = (joined(b.column(c).slice(at, AT_ONCE)) for c in ("sizes", "codes"))
                own = np.flatnonzero((codes >= first) & (codes < first + width))
                own = own[np.argsort(codes[own], kind="stable")]  # one row of the matrix after the other
                ends = np.cumsum(sizes, dtype=np.int64)
                page = np.searchsorted(ends, own, "right")
                _added(counts, codes[own].astype(np.int64) - first, (ends - sizes)[page], sizes[page].astype(np.int64), codes)
        for r, own in enumerate([] if counts is None else counts):
            own[first + r] = 0
            other = np.flatnonzero(own)
            if len(other) > top:
                other = other[own[other] >= np.partition(own[other], -top)[-top]]
            other = other[np.lexsort((other, -own[other]))[:top]]
            if len(other):
                yield pa.record_batch({"code": pa.array(np.full(len(other), first + r), pa.int64()), "other_code": pa.array(other, pa.int64()), "pages": pa.array(own[other], pa.int64())})

    return run


def neighbours(mentions: DataFrame, entity_id: int | None = None, top: int = 30) -> DataFrame:
    """Entities on the same pages, by number of shared pages; of one entity, or of each.

    Of each, pairs are never rows: entities are dealt into cells, and the task of a cell counts in a matrix of its
    entities by all, of ``MOST_COUNTS`` or a single row. A page's list is written once: each cell reads all lists, and none is sent.
    """
    m = mentions.filter("valid").select("entity_id", "doc_id", "page_num")
    if entity_id is not None:
        m = m.distinct()
        pairs = m.filter(F.col("entity_id") == entity_id).join(m.withColumnRenamed("entity_id", "other"), ["doc_id", "page_num"]).filter("entity_id <> other").groupBy("entity_id", "other").agg(F.count("*").alias("pages"))
        w = Window.partitionBy("entity_id").orderBy(F.desc("pages"), "other")
        return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).drop("rn")
    m = written(m, "on-pages")
    spark = mentions.sparkSession
    ids = numbered(m.select("entity_id").distinct(), ["entity_id"], "code").withColumn("code", F.col("code") - 1)
    names = max(1, ids.count())
    cells = min(names, max(-(-names * names // MOST_COUNTS), spark.sparkContext.defaultParallelism))
    pages = m.join(ids, "entity_id").groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_set(F.col("code").cast("int"))).alias("codes")).filter(F.size("codes") > 1)
    pages = written(pages.select("codes").mapInArrow(_packed, "sizes binary, codes binary"), "page-entities")
    # One task a cell, each with all pages one after the other: the product of one part with as many as there are cells.
    dealt = pages.coalesce(1).hint("shuffle_replicate_nl").crossJoin(spark.range(0, cells, 1, cells).select(F.col("id").cast("int").alias("cell")))
    found = dealt.mapInArrow(_best_of_cell(cells, names, top), "code long, other_code long, pages long")
    other = ids.select(F.col("entity_id").alias("other"), F.col("code").alias("other_code"))
    return found.join(ids, "code").join(other, "other_code").select("entity_id", "other", "pages")


def still_anchored(mentions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether each mention's surface still stands in its block."""
    # White space goes from a text once, not once a mention.
    b = blocks.select("doc_id", "page_num", "block_num", F.regexp_replace("index_text", NORM, "").alias("_bare"))
    return mentions.join(b, ["doc_id", "page_num", "block_num"], "left").withColumn("anchor_ok", F.coalesce(F.contains("_bare", F.regexp_replace("surface", NORM, "")), F.lit(False))).drop("_bare")


def reanchor(mentions: DataFrame, lines: DataFrame) -> DataFrame:
    """Moves each mention to the first line of its page that holds the surface; others stay."""
    hit = mentions.select("id", "doc_id", "page_num", "surface").join(lines.select("doc_id", "page_num", F.col("block_num").alias("b"), F.col("id").alias("line"), "text"), ["doc_id", "page_num"]).filter(F.contains("text", F.col("surface")))
    first = hit.groupBy("id").agg(F.min_by("b", "line").alias("found"))
    return mentions.join(first, "id", "left").withColumn("block_num", F.coalesce("found", "block_num")).drop("found")


def _bare(c: str) -> Column:
    return F.regexp_replace(c, NORM, "")


def audit_repeats(entities: DataFrame) -> DataFrame:
    """Names, without white space, in which a stretch of two characters or more stands twice in a row."""
    return entities.filter(repeats_itself(_bare("canonical"))).select("id", "canonical")


def audit_alias_is_name(entities: DataFrame) -> DataFrame:
    """Aliases that are another entity's canonical name but for white space; of entities with one name the least id counts."""
    a = entities.select(F.col("id").alias("alias_of"), F.explode("aliases").alias("name")).withColumn("k", _bare("name")).distinct()
    names = entities.groupBy(_bare("canonical").alias("k")).agg(F.min("id").alias("named"))
    return a.join(names, "k").filter("alias_of <> named").select("alias_of", "named", "name")


def audit_contained(entities: DataFrame) -> DataFrame:
    """Names inside longer names, without white space (2 to 24 characters, at most 6 shorter).

    An outer name is cut into all its parts that are that long, and parts meet names
    by equality: no start or gram that many names share brings all of them together.
    """
    e = entities.select("id", "canonical", _bare("canonical").alias("n"))
    inner = e.filter(F.length("n").between(2, 24)).select(F.col("id").alias("inner_id"), F.col("canonical").alias("inner_name"), "n")
    size = F.length("n")
    sizes = F.sequence(F.greatest(F.lit(2), size - 6), F.least(F.lit(24), size - 1))
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring("n", i, k))))
    outer = e.filter(size.between(3, 30)).select(F.col("id").alias("outer_id"), F.col("canonical").alias("outer_name"), F.explode(F.array_distinct(parts)).alias("n"))
    return inner.join(outer, "n").select("inner_id", "outer_id", "inner_name", "outer_name")


def merge_entity(entities: DataFrame, mentions: DataFrame, src: int, dst: int) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions after ``src`` went into ``dst``: aliases and external ids united, dst's own first."""
    s = entities.filter(F.col("id") == src).select(F.col("canonical").alias("sc"), F.col("aliases").alias("sa"), F.col("ext_ids").alias("se"))
    e = entities.filter(F.col("id") != src).join(F.broadcast(s), F.col("id") == dst, "left")  # at most one row
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    aliases = F.array_distinct(F.filter(F.concat(F.coalesce("aliases", none), F.array("sc"), F.coalesce("sa", none)), lambda a: a.isNotNull() & (a != F.col("canonical"))))
    own = F.coalesce("ext_ids", empty)
    ext = F.map_concat(F.map_filter(F.coalesce("se", empty), lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    moved = F.when(F.col("id") == dst, aliases).otherwise(F.col("aliases"))
    e = e.withColumns({"aliases": moved, "ext_ids": F.when(F.col("id") == dst, ext).otherwise(F.col("ext_ids"))}).drop("sc", "sa", "se")
    m = mentions.withColumn("entity_id", F.when(F.col("entity_id") == src, dst).otherwise(F.col("entity_id")))
    w = Window.partitionBy("entity_id", "doc_id", "page_num", "block_num", "surface").orderBy("id")
    return e, m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
