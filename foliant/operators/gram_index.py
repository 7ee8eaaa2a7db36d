"""A written index of character grams behind the search, kept up by segments.

An index is a folder of tables that Spark writes and reads:

* ``blocks``: texts of a segment, dealt into parts by document and group of pages
  (partition columns ``segment``, ``part``), numbered inside a part, with ``run``, the
  thousand-odd blocks that a row of postings speaks of;
* ``grams``: for each gram and run the numbers of the blocks that hold it, the
  highest number of places in one of them and the least length, by hash of the gram
  (partition columns ``segment``, ``bucket``), sorted by gram, so that a query reads a
  few row groups of its grams' buckets. Numbers are ascending; Parquet stores them as
  deltas;
* ``marks``: blocks that are gone, by segment, part and number;
* ``manifest``: one small file a version, which names the segments and marks in force with
  the number of blocks and their length. A version is published by one rename-free
  write; readers keep the version that they opened.

Three-character grams are of the texts in lower case, for phrases; grams of one and two
characters are of texts with A-Z folded, for short words. A query looks up how often
its grams stand, reads their postings, intersects them run by run from the
rarest, and holds what is left against the texts, but for phrases that are a gram
themselves. Candidates are sent to all tasks only if their number, known before, is
small; the texts read are those of parts with candidates. For the best k of a phrase,
bounds of a run's scores (most places, least length) decide which runs are read.

Edits never change a written file: they add a segment and marks, touching the buckets
of the grams of changed blocks alone. ``compacted`` merges small or much-marked segments
into one, and ``upgraded`` rebuilds the grams of segments of an older format.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import ascii_fold
from foliant.operators import search
from foliant.plans.search_plan import Pattern, SearchPlan, pattern_grams
from foliant.sources import versions
from foliant.sources.scratch import written

#: Version of what is written for a block.
FORMAT = 2
#: Blocks of a run; characters of a part and of a bucket of a segment; pages that stay together.
RUN, PART_CHARS, BUCKET_CHARS, PAGES = 1024, 1 << 26, 1 << 25, 64
#: Files of a bucket of a segment at least.
WAYS = 2
#: Candidates that are sent to all tasks at most.
FEW = 1 << 20
#: Grams of a phrase that are looked up at most; the check on texts makes up for the others.
MOST_GRAMS = 12

PLACE = ["segment", "part", "no"]
BLOCK = "doc_id long, page_num int, block_num int, index_text string, trans string, block_label string, labels array<string>"
BLOCKS_AS_WRITTEN = f"{BLOCK}, no int, run int, length int, segment string, part int"
GRAMS_AS_WRITTEN = "gram string, part int, run int, n int, nos array<int>, most int, least int, segment string, bucket int"
#: Numbers of a posting list ascend: written as deltas.
DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def bucket_of(gram: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(gram), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def part_of(doc_id: Column, page_num: Column, parts: int | Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.floor(page_num / PAGES).cast("long")), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


# --- writing ---------------------------------------------------------------------


def _codes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts end to end, and the text of each; null is empty."""
    texts = [t or "" for t in texts.to_pylist()]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return code, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _grams(columns: list[pa.ChunkedArray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, block and places, by gram and block, over all columns of the blocks."""
    found = []
    for c in columns:
        code, of = _codes(c)
        n = max(0, len(code) - size + 1)
        gram = np.zeros(n, np.int64)
        for k in range(size):
            gram = (gram << 21) | code[k : n + k]
        own = of[:n] == of[size - 1 :] if n else np.zeros(0, bool)
        found.append((gram[own], of[:n][own]))
    gram, of = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((of, gram))
    gram, of = gram[order], of[order]
    cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return gram[cut], of[cut], np.diff(np.append(cut, len(gram)))


def _text(gram: int, size: int) -> str:
    return "".join(chr((gram >> (21 * k)) & 0x1FFFFF) for k in reversed(range(size)))


def _postings(table: pa.Table) -> pa.Table:
    """Rows of a run of blocks -> its postings."""
    no, length = table.column("no").to_numpy(), table.column("length").to_numpy()
    out = []
    for size, columns in ((1, ["folded", "folded_trans"]), (2, ["folded", "folded_trans"]), (3, ["lower", "lower_trans"])):
        gram, of, places = _grams([table.column(c) for c in columns], size)
        if not len(gram):
            continue
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        nos = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(no[of], pa.int32()))
        names = pa.array([_text(g, size).encode("utf-8", "surrogatepass") for g in gram[first].tolist()], pa.binary())
        n = np.diff(np.append(first, len(gram)))
        out.append(pa.table({
            "gram": names.cast(pa.string()), "part": pa.array(np.full(len(first), table.column("part")[0].as_py()), pa.int32()), "run": pa.array(np.full(len(first), table.column("run")[0].as_py()), pa.int32()),
            "n": pa.array(n, pa.int32()), "nos": nos, "most": pa.array(np.maximum.reduceat(places, first), pa.int32()), "least": pa.array(np.minimum.reduceat(length[of], first), pa.int32()),
        }))
    shape = pa.schema([("gram", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("n", pa.int32()), ("nos", pa.list_(pa.int32())), ("most", pa.int32()), ("least", pa.int32())])
    return pa.concat_tables(out) if out else shape.empty_table()


def _write_grams(spark: SparkSession, root: str, segment: dict) -> None:
    b = spark.read.schema(BLOCKS_AS_WRITTEN).option("basePath", f"{root}/blocks").parquet(f"{root}/blocks/segment={segment['id']}")
    cols = {"lower": F.lower("index_text"), "lower_trans": F.lower("trans"), "folded": ascii_fold(F.col("index_text")), "folded_trans": ascii_fold(F.col("trans"))}
    # A part is dealt to one task, which takes its runs one by one; the order of numbers is the order of the rows. Texts travel once, and are folded there.
    rows = b.select("part", "run", "no", "length", "index_text", "trans").repartition(segment["parts"], "part").sortWithinPartitions("part", "run", "no")
    rows = rows.select("part", "run", "no", "length", *[c.alias(k) for k, c in cols.items()])
    found = rows.groupBy("part", "run").applyInArrow(lambda t: _postings(t.sort_by("no")), "gram string, part int, run int, n int, nos array<int>, most int, least int")
    found = found.withColumn("bucket", bucket_of(F.col("gram"), segment["buckets"]))
    # Common grams have a row a run: by part they go to several files of their bucket. No ranges: to sample them would make all postings twice.
    ways = max(WAYS, -(-segment["files"] // segment["buckets"]))
    way = F.col("bucket") * ways + F.pmod(F.xxhash64("gram", "part"), F.lit(ways)).cast("int")
    found = found.repartitionById(segment["buckets"] * ways, way).sortWithinPartitions("bucket", "gram", "part", "run")
    found.write.partitionBy("bucket").options(**DELTAS).parquet(f"{root}/{grams_folder(segment)}/segment={segment['id']}")


def grams_folder(segment: dict) -> str:
    return "grams" if segment["format"] == 1 else f"grams-{segment['format']}"


def _segment(blocks: DataFrame, root: str) -> dict | None:
    """Writes blocks and their grams; None if there are none."""
    spark, cores = blocks.sparkSession, blocks.sparkSession.sparkContext.defaultParallelism
    kinds = dict(c.split() for c in BLOCK.split(", "))
    names = list(kinds)
    b = blocks.withColumn("labels", F.array("block_label")) if "labels" not in blocks.columns and "block_label" in blocks.columns else blocks
    b = b.select(*[(F.col(c) if c in b.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    b = b.withColumn("length", search.gram_length().cast("int"))
    size = b.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    if not size.n:
        return None
    parts = int(min(max(-(-size.length // PART_CHARS), min(cores, -(-size.n // RUN))), 1 << 16))
    buckets = int(min(max(-(-size.length // BUCKET_CHARS), 4), 4096))
    segment = {"id": uuid.uuid4().hex[:12], "format": FORMAT, "parts": max(1, parts), "buckets": buckets, "files": max(buckets, min(cores, parts)), "blocks": size.n, "length": int(size.length)}
    # A partition is a part, in the order of its numbers: a block's number is its place in the partition, which no window has to hold.
    b = b.withColumn("part", part_of(F.col("doc_id"), F.col("page_num"), segment["parts"])).repartitionById(segment["parts"], F.col("part")).sortWithinPartitions("doc_id", "page_num", "block_num")
    b = b.withColumn("no", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int"))
    b = b.withColumn("run", F.floor(F.col("no") / RUN).cast("int")).select(*names, "no", "run", "length", "part")
    b.write.partitionBy("part").option("maxRecordsPerFile", 64 * RUN).parquet(f"{root}/blocks/segment={segment['id']}")
    _write_grams(spark, root, segment)
    return segment


# --- what a version has ------------------------------------------------------------


@dataclass
class GramIndex:
    """One version of an index. Edits return the next version; a version once opened never changes."""

    spark: SparkSession
    root: str
    version: int
    segments: list[dict]
    marks: list[str] = field(default_factory=list)
    _kept: dict = field(default_factory=dict, repr=False)
    #: Of the last call of ``best``: runs that were read, and runs that can hold the query at most.
    runs_read: int = 0
    runs_there: int = 0

    # --- versions

    @classmethod
    def built(cls, blocks: DataFrame, root: str) -> GramIndex:
        """The first version, of blocks as ``corpus.blocks_of`` gives them."""
        segment = _segment(blocks, root)
        return cls(blocks.sparkSession, root, 0, [])._published([segment] if segment else [], [])

    @classmethod
    def opened(cls, spark: SparkSession, root: str, version: int | None = None) -> GramIndex:
        """The latest version that was published in full, or a given one."""
        version, told = versions.read(spark, root, version)
        return cls(spark, root, version, told["segments"], told["marks"])

    def _published(self, segments: list[dict], marks: list[str]) -> GramIndex:
        """The next version; fails if another writer has published it."""
        after = replace(self, version=self.version + 1, segments=segments, marks=marks, _kept={})
        versions.publish(self.spark, self.root, after.version, {"segments": segments, "marks": marks})
        return after

    # --- tables

    def _table(self, name: str, schema: str, paths: Iterable[str]) -> DataFrame:
        if name not in self._kept:
            paths = list(paths)
            read = self.spark.read.schema(schema)
            self._kept[name] = read.option("basePath", f"{self.root}/{name.split(':')[0]}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self._kept[name]

    def written_blocks(self) -> DataFrame:
        return self._table("blocks", BLOCKS_AS_WRITTEN, [f"{self.root}/blocks/segment={s['id']}" for s in self.segments])

    def gone(self) -> DataFrame | None:
        """Marked places, where there are any."""
        return self._table("marks", "segment string, part int, no int", [f"{self.root}/marks/{m}" for m in self.marks]) if self.marks else None

    def _live(self, places: DataFrame) -> DataFrame:
        gone = self.gone()
        return places if gone is None else places.join(gone, PLACE, "left_anti")

    def blocks(self) -> DataFrame:
        """All blocks that aren't marked."""
        return self._live(self.written_blocks()).drop("run", "length", *PLACE)

    def totals(self) -> tuple[int, int]:
        """Blocks and their gram lengths; the manifest has those of segments, the marks' are taken off once."""
        if "totals" not in self._kept:
            n, length = sum(s["blocks"] for s in self.segments), sum(s["length"] for s in self.segments)
            if self.marks:
                off = self.written_blocks().select(*PLACE, "length").join(self.gone(), PLACE, "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
                n, length = n - off.n, length - off.l
            self._kept["totals"] = n, length
        return self._kept["totals"]

    def postings(self, grams: Iterable[str]) -> DataFrame:
        """Postings of some grams: of each segment, the buckets of these grams alone."""
        grams, out, kind = sorted(set(grams)), None, lambda s: (s["format"], s["buckets"])
        for (_, buckets), own in itertools.groupby(sorted(self.segments, key=kind), key=kind):
            own = list(own)
            folder = grams_folder(own[0])
            t = self._table(f"{folder}:{buckets}", GRAMS_AS_WRITTEN, [f"{self.root}/{folder}/segment={s['id']}" for s in own])
            t = t.filter(F.col("bucket").isin([bucket_of(F.lit(g), buckets) for g in grams]) & F.col("gram").isin(grams))
            out = t if out is None else out.unionAll(t)
        return self.spark.createDataFrame([], GRAMS_AS_WRITTEN) if out is None else out

    # --- reading

    def counts(self, grams: Iterable[str]) -> dict[str, int]:
        """Blocks that hold each gram, marked ones among them; looked up once a version."""
        return {g: n for g, (n, _) in self._looked_up(grams).items()}

    def _looked_up(self, grams: Iterable[str]) -> dict[str, tuple[int, int]]:
        """Blocks and runs that hold each gram."""
        known = self._kept.setdefault("counts", {})
        if new := sorted(set(grams) - known.keys()):
            found = self.postings(new).groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("runs")).collect()
            known |= dict.fromkeys(new, (0, 0)) | {r.gram: (r.n, r.runs) for r in found}
        return {g: known[g] for g in grams}

    def _places(self, wanted: list[list[Want]], runs: DataFrame | None = None) -> DataFrame:
        """Places (segment, part, no) that hold all grams of some want of each group."""
        rows = self.postings(g for group in wanted for w in group for g in w.grams())
        if runs is not None:
            rows = rows.join(F.broadcast(runs), ["segment", "part", "run"], "left_semi")  # runs of a round, some hundred
        rows = rows.groupBy("segment", "part", "run").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "nos"))).alias("entries"))
        nos = search._all_of([search._any_of([w.held() for w in group]) for group in wanted])
        return rows.select("segment", "part", F.explode(nos).alias("no"))

    def _candidates(self, wanted: list[list[Want]], runs: DataFrame | None = None) -> DataFrame:
        """Blocks as written at the places of ``wanted``; the places are sent to all tasks where they are few."""
        wanted = [group for group in wanted if all(w.places for w in group)]  # a phrase without grams rules nothing out
        if not wanted:
            return self._live(self.written_blocks())
        most = min((sum(w.most(self.counts(w.grams())) for w in group) for group in wanted), default=0)
        if not most:
            return self.written_blocks().limit(0)
        places = self._live(self._places(wanted, runs))
        return self.written_blocks().join(F.broadcast(places) if most <= FEW else places, PLACE)

    def hits(self, plan: SearchPlan, ranked: bool = True) -> DataFrame:
        """Blocks of a plan, with ``rank`` where it is asked for: the rows of a search over ``blocks()``."""
        plain = self._plain(plan)
        if plan.empty or not (ranked and plan.scored):
            found = self._candidates(wants(plan)) if not plan.empty else self.written_blocks().limit(0)
            hits = found if plain else found.filter(search.matches(plan))
            hits = hits.withColumn("rank", F.lit(0.0)) if ranked else hits
        else:
            # Every phrase is counted over the whole index, so blocks of any of them are looked at.
            found = self._candidates([[w for group in wants(plan, phrases_only=True) for w in group]])
            hits = search.with_rank(found, plan, self.totals())
        return hits.drop("run", "length", *PLACE)

    def _plain(self, plan: SearchPlan) -> bool:
        """Whether grams alone tell what matches."""
        return not any(isinstance(p, Pattern) or len(p.lower()) != 3 for p in plan.scored)

    def best(self, plan: SearchPlan, k: int, filters=None, first: int = 64) -> DataFrame:
        """KEY of the k best blocks in order, with their place ``nth``: the first rows of ``hits`` by rank and key.

        Runs are read from the highest bound of their scores down, ``first`` of them and
        then twice as many each time, until the k-th score is above all bounds that are
        left. Where no more than ``first`` runs hold the query, these are read without
        bounds. Where the frequency of a phrase isn't known before texts are read (several
        phrases, of which one isn't a gram), or no phrase is scored, all hits are ranked.
        ``filters`` maps blocks to those that may be found.
        """
        filters = filters or (lambda x: x)
        by = [F.asc("rank"), *search.KEY]
        numbered = lambda rows: self.spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "doc_id long, page_num int, block_num int, nth int")
        self.runs_read = self.runs_there = 0
        known = len(plan.scored) == 1 or self._plain(plan) and not self.marks
        wanted, scored = wants(plan), wants(plan, phrases_only=True)
        if plan.empty or not plan.scored or not known or not all(w.places for g in wanted for w in g):
            rows = filters(self.hits(plan)).orderBy(*by).limit(k).select(*search.KEY).collect()
            return numbered([tuple(r) for r in rows])
        n, length = self.totals()
        if not n:
            return numbered([])
        average = length / n
        # One phrase alone: its frequency changes no order.
        weights = {w.phrase: 1.0 if len(plan.scored) == 1 else search.idf(n, self.counts(w.grams())[w.phrase.lower()]) for g in scored for w in g}

        def ranked(runs: DataFrame | None) -> list[tuple]:
            found = self._candidates(wanted, runs)
            found = found if self._plain(plan) else found.filter(search.matches(plan))
            score = search._sum([weights[p] * search.term_score(p, average) for p in plan.scored])
            return [tuple(r) for r in filters(found.withColumn("rank", -score)).orderBy(*by).limit(k).select("rank", *search.KEY).collect()]

        looked_up = self._looked_up({g for group in wanted for w in group for g in w.grams()})
        self.runs_there = self.runs_read = min(sum(min(sum(looked_up[g][1] for g in p) for p in w.places) for w in group) for group in wanted)
        if self.runs_there <= first:
            return numbered([r[1:] for r in ranked(None)])
        rows = self.postings(looked_up).groupBy("segment", "part", "run").agg(F.collect_list(F.struct("gram", "most", "least")).alias("entries"))
        possible = search._all([search._any([w.present() for w in group]) for group in wanted])
        bound = search._sum([weights[w.phrase] * w.bound(average) for group in scored for w in group])
        bounds = written(rows.filter(possible).select("segment", "part", "run", bound.alias("bound")), "run-bounds")
        best: list[tuple] = []  # (-score, key), ascending
        width, after, self.runs_read = first, None, 0
        while True:
            turn = bounds if after is None else bounds.filter((F.col("bound") < after[0]) | (F.col("bound") == after[0]) & (F.struct("segment", "part", "run") > F.struct(*map(F.lit, after[1:]))))
            runs = turn.orderBy(F.desc("bound"), "segment", "part", "run").limit(width).collect()
            if len(best) == k:
                runs = [r for r in runs if r.bound * (1 + 1e-9) >= -best[-1][0]]
            if not runs:
                break
            self.runs_read += len(runs)
            after = (runs[-1].bound, runs[-1].segment, runs[-1].part, runs[-1].run)
            these = self.spark.createDataFrame([(r.segment, r.part, r.run) for r in runs], "segment string, part int, run int")
            best = sorted(best + ranked(these))[:k]
            width *= 2
        return numbered([b[1:] for b in best])

    # --- upkeep

    def _marked(self, gone: DataFrame) -> str | None:
        """Writes marks for the places of documents, pages or blocks, as far as ``gone`` has these columns."""
        on = [c for c in search.KEY if c in gone.columns]
        live = self._live(self.written_blocks().select(*PLACE, *search.KEY))
        if "page_num" in on and self.segments:  # the part follows from the page: other parts aren't read
            each = F.explode(F.array(*[F.struct(F.lit(s["id"]).alias("segment"), F.lit(s["parts"]).alias("parts")) for s in self.segments]))
            gone = gone.select(*on, each.alias("s")).select(*on, "s.segment", part_of(F.col("doc_id"), F.col("page_num"), F.col("s.parts")).alias("part"))
            on = [*on, "segment", "part"]
        places = written(live.join(gone.select(*on).distinct(), on, "left_semi").select(*PLACE), "marked-places")
        if places.isEmpty():
            return None
        name = uuid.uuid4().hex[:12]
        places.write.parquet(f"{self.root}/marks/{name}")
        return name

    def changed(self, new: DataFrame | None = None, gone: DataFrame | None = None) -> GramIndex:
        """The version without the documents, pages or blocks of ``gone`` (doc_id[, page_num[, block_num]]) and with the blocks ``new``."""
        mark = self._marked(gone) if gone is not None and self.segments else None
        segment = _segment(new, self.root) if new is not None else None
        return self._published(self.segments + [segment] * (segment is not None), self.marks + [mark] * (mark is not None))

    def edited(self, blocks: DataFrame) -> GramIndex:
        """The version in which these blocks stand in place of those of the same key."""
        blocks = written(blocks, "edited-blocks")
        return self.changed(blocks, blocks.select(*search.KEY))

    def removed(self, docs: DataFrame) -> GramIndex:
        """The version without the documents (doc_id)."""
        return self.changed(gone=docs.select("doc_id"))

    def compacted(self, least: int | None = None, most_marked: float = 0.25) -> GramIndex:
        """The version with segments of fewer than ``least`` blocks (an eighth of all, if not given), or with too many marks, in one."""
        least = self.totals()[0] // 8 if least is None else least
        gone = self.gone()
        off = {r.segment: r["count"] for r in gone.groupBy("segment").count().collect()} if gone is not None else {}
        old = [s for s in self.segments if s["blocks"] < least or off.get(s["id"], 0) > most_marked * s["blocks"]]
        if len(old) < 2 and not any(off.get(s["id"]) for s in old):
            return self
        rest = [s for s in self.segments if s not in old]
        some = replace(self, segments=old, _kept={})
        segment, marks = _segment(some.blocks(), self.root), []
        if any(off.get(s["id"]) for s in rest):
            marks = [uuid.uuid4().hex[:12]]
            gone.filter(F.col("segment").isin([s["id"] for s in rest])).write.parquet(f"{self.root}/marks/{marks[0]}")
        return self._published(rest + [segment] * (segment is not None), marks)

    def upgraded(self) -> GramIndex:
        """The version in which all segments have grams of the present format; texts stay as they are."""
        if all(s["format"] == FORMAT for s in self.segments):
            return self
        new = [s if s["format"] == FORMAT else s | {"format": FORMAT} for s in self.segments]
        for s, was in zip(new, self.segments):
            if s is not was:
                _write_grams(self.spark, self.root, s)
        return self._published(new, self.marks)


# --- what a query wants of the index -------------------------------------------------


@dataclass(frozen=True)
class Want:
    """A phrase or short word: at each of some places of it, the grams that can stand there."""

    phrase: str
    places: tuple[tuple[str, ...], ...]

    def grams(self) -> list[str]:
        return sorted({g for p in self.places for g in p})

    def most(self, counts: dict[str, int]) -> int:
        """Blocks that can hold it."""
        return min(sum(counts[g] for g in p) for p in self.places)

    def _own(self, grams: tuple[str, ...]) -> Column:
        return F.filter("entries", lambda e: e["gram"].isin(list(grams)))

    def held(self) -> Column:
        """Numbers of the blocks of a run that hold a gram of each place; entries are sorted, the rarest first."""
        none = F.array().cast("array<int>")
        if all(len(p) == 1 for p in self.places):
            own = self._own(tuple(g for p in self.places for g in p))
            rest = F.aggregate(F.slice(own, 2, len(self.grams())), F.get(own, 0)["nos"], lambda nos, e: F.array_intersect(nos, e["nos"]))
            return F.when(F.size(own) == len(self.grams()), rest).otherwise(none)
        return search._all_of([F.array_distinct(F.flatten(F.transform(self._own(p), lambda e: e["nos"]))) for p in self.places])

    def present(self) -> Column:
        return search._all([F.size(self._own(p)) > 0 for p in self.places])

    def bound(self, average: float) -> Column:
        """What its score can be in a run at most, but for its weight; 0 where a place has no gram."""
        most = [F.array_max(F.transform(self._own(p), lambda e: e["most"])) if len(p) == 1 else F.aggregate(self._own(p), F.lit(0), lambda s, e: s + e["most"]) for p in self.places]
        least = [F.array_min(F.transform(self._own(p), lambda e: e["least"])) for p in self.places]
        f, length = (F.least(*most) if len(most) > 1 else most[0]), (F.greatest(*least) if len(least) > 1 else least[0])
        return F.when(self.present(), search.saturated(f.cast("double"), length, average)).otherwise(F.lit(0.0))


def wants(plan: SearchPlan, phrases_only: bool = False) -> list[list[Want]]:
    """AND over groups, OR inside."""
    phrases = [plan.any_name] if plan.any_name else list(plan.phrases)
    groups = [[Want(p, _spread(pattern_grams(p))) for p in g] for g in phrases]
    return groups if phrases_only or plan.any_name else groups + [[Want(w, ((w.translate(_FOLD),),)) for w in g] for g in plan.short]


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spread(places: list[tuple[str, ...]]) -> tuple[tuple[str, ...], ...]:
    """Places of a long phrase, spread over it, the last among them."""
    if len(places) <= MOST_GRAMS:
        return tuple(places)
    step = (len(places) - 1) / (MOST_GRAMS - 1)
    return tuple(places[round(i * step)] for i in range(MOST_GRAMS))
