"""How far the sources of a language are apart in their words: dense tiles, partial sums, merged heaps.

1. Each task counts its terms by (language, source, term), in numpy, and gives out
   one row for each: the shuffle gets partial counts, never places in texts. A hot
   source is as many rows as it has different terms in a task.
2. One shuffle by (language, term) adds them up. A language keeps the terms that at least
   ``min_docs`` of its documents hold. The kept terms are dealt by hash into blocks, so that the matrix of a block, sources by
   terms, has at most ``TILE`` cells.
3. A block is a dense int64 matrix of counts with one more row for the whole
   language. All pairs of its rows are compared by broadcasting; what leaves the
   block is a sum for each pair and the best ``top`` terms of each source.
4. Sums are added over the blocks, and the heaps of a source are merged.

With N the places of kept terms in a source (or language) and V the kept terms, the term has
p = 1 + floor(10^9 (count + 1) / (N + V)). Of p against q the value is
floor((p - q)^2 / q). Part ``pair`` sums it over all kept terms of the language, for
each source against each other one. Part ``term`` has it for terms of the source
with p above the p of the language, the ``top`` highest. All arithmetic is exact
while a language has fewer than 9 * 10^15 places; beyond it an error is raised.

Null texts, languages and sources are empty strings, a language and a source like
any other. Terms are runs of ASCII letters and characters past ASCII, A-Z lower-cased; a task
holds two terms as one if 64 bits of their hashes and their lengths agree. A source without
terms has its pairs; a language with one source none. Each row is a document of its
own, also where it repeats an id: ids aren't read, and neither are other columns. An empty
table gives no rows. A very long text is one unit of work of some hundred bytes of memory for
each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import chunks, materialize, strings, text_buffer
from foliant.llm.lexical_search import IN_TERM, terms_of

#: Cells of a tile; different (source, term) counts that a task holds.
TILE, HELD = 1 << 19, 1 << 20
SCALE = 1_000_000_000
LETTERS = IN_TERM.copy()
LETTERS[0x30:0x3A] = False


class _Counts:
    """Counts by (group, term) of a task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.words: dict[int, bytes] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, group: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, buf: np.ndarray) -> None:
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        for x, f in zip(uniq.tolist(), first.tolist()):
            if x not in self.words:
                self.words[x] = buf[start[f] : end[f]].tobytes().lower()
        cell, n = np.unique(doc * np.int64(len(uniq)) + back, return_counts=True)  # a term of a document
        key, back2 = np.unique(group[cell // len(uniq)] * np.int64(len(uniq)) + cell % len(uniq), return_inverse=True)
        part = np.zeros((4, len(key)), np.int64)
        part[0], part[1] = key // len(uniq), uniq[key % len(uniq)].view(np.int64)
        np.add.at(part[2], back2, n)
        np.add.at(part[3], back2, 1)
        self.parts.append(part)
        self.size += len(key)

    def merge(self) -> None:
        p = np.concatenate(self.parts, 1)
        p = p[:, np.lexsort((p[1], p[0]))]
        cut = np.flatnonzero(np.concatenate([[True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])]))
        self.parts = [np.stack([p[0, cut], p[1, cut], np.add.reduceat(p[2], cut), np.add.reduceat(p[3], cut)])]
        self.size = len(cut)

    def rows(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self.merge()
        g, h, n, docs = self.parts[0]
        langs, sources = (pa.array(c, pa.string()) for c in zip(*self.groups))
        words = [self.words[x] for x in h.view(np.uint64).tolist()]
        out = [langs.take(pa.array(g)), sources.take(pa.array(g)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)]
        self.words, self.parts, self.size = {}, [], 0
        return pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (places), docs; one partial row for each task that has the term."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            pairs = list(zip(strings(batch.column(1)), strings(batch.column(2))))
            group = np.array([counts.groups.setdefault(p, len(counts.groups)) for p in pairs], np.int64)
            for i, j in chunks(off):
                own = buf[off[i] : off[j]]
                h, doc, s, e = terms_of(own, off[i : j + 1] - off[i], LETTERS)
                if len(h):
                    counts.add(group[i:j], h, doc, s, e, own)
                if counts.size > HELD:
                    counts.merge()
                    if counts.size > HELD // 2:
                        yield counts.rows()
        if (last := counts.rows()) is not None:
            yield last

    cols = [F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    return docs.select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), three digits at a time, so that nothing overflows."""
    rest, out = count + 1, np.zeros(np.broadcast(count, whole).shape, np.int64)
    over = rest // whole  # 1 at most, for a term that is all there is
    rest = rest - over * whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + over * SCALE + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile(cells: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """Partial pair sums (part 0) and best terms (part 1) of a block of terms of one language."""
    groups = groups.sort_values("source", ignore_index=True)
    lang, v, whole = groups["lang"].iloc[0], int(groups["v"].iloc[0]), int(groups["lang_n"].iloc[0])
    if whole + v > 9 * 10**15:
        raise OverflowError("more than 9 * 10^15 places of a language")
    sources = groups["source"].to_numpy()
    row = pd.Index(sources).get_indexer(cells["source"])
    names, col = np.unique(cells["term"].to_numpy(object), return_inverse=True) if len(cells) else (np.zeros(0, object), np.zeros(0, np.int64))
    counts = np.zeros((len(sources), len(names)), np.int64)
    counts[row, col] = cells["n"].to_numpy(np.int64)
    n = groups["n"].to_numpy(np.int64)[:, None]
    if v:
        p, q = share(counts, n + v), share(counts.sum(0), np.int64(whole + v))
    else:
        p, q = counts, counts.sum(0) + 1
    a, b, value = [], [], []
    step = max(1, TILE // max(1, p.size))  # sources against all others at once
    for lo in range(0, len(sources), step):
        sums = apart(p[lo : lo + step, None, :], np.maximum(p, 1)[None]).sum(2) if v else np.zeros((len(p[lo : lo + step]), len(sources)), np.int64)
        i, j = np.divmod(np.arange(sums.size), len(sources))
        other = i + lo != j
        a.append(i[other] + lo)
        b.append(j[other])
        value.append(sums.ravel()[other])
    a, b, value = np.concatenate(a), np.concatenate(b), np.concatenate(value)
    pairs = pd.DataFrame({"lang": lang, "source": sources[a], "part": 0, "item": sources[b], "value": value})
    gain = np.where((counts > 0) & (p > q), apart(p, np.maximum(q, 1)), -1)
    best = [pairs]
    for i in range(len(sources)):
        at = np.flatnonzero(gain[i] >= 0)
        at = at[np.lexsort((at, -gain[i, at]))][:top]  # the names ascend
        best.append(pd.DataFrame({"lang": lang, "source": sources[i], "part": 1, "item": names[at], "value": gain[i, at]}))
    return pd.concat(best, ignore_index=True)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, tile: int = TILE) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    # Tasks have summed up what is theirs: one shuffle by language and term brings all of a term together, for its counts, its documents and what is kept.
    parts = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    terms = materialize(terms.filter(F.col("in_docs") >= min_docs).select("lang", "term", "cells"), "kept-terms")
    kept = terms.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    # One row for each source: its places, and what its language has.
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = materialize(groups, "sources")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("sources"))
    langs = langs.join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = materialize(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / tile)).cast("int")), "languages")
    rows = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "source", "n", "lang_n", "v")
    cells = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")

    shape = "lang string, source string, part int, item string, value long"
    parts = cells.groupBy("lang", "block").cogroup(rows.groupBy("lang", "block")).applyInPandas(lambda c, g: _tile(c, g, top), shape)
    parts = materialize(parts, "divergence-tiles")
    pairs = parts.filter("part = 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = parts.filter("part = 1").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionAll(terms.withColumn("rank", place).filter(F.col("rank") <= top))
