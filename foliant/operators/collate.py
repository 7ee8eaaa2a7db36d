"""Collation: alignment of two transcriptions, clusters of divergence, mapping a transcript to pages."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import PAGENO_CHARS, normalise

#: Fixed values of the method.
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.5
LEAST_AGREEMENT, CLUSTER_GAP, ANCHOR, LOW_CONFIDENCE = 0.60, 3, 8, 0.5


#: Cells of the score tables that a task holds at once; rows that are kept of a pair with more, a level.
CELLS, BANDS = 1 << 23, 16
#: Diagonals beside those of the corners in a pair's first band, and characters of texts that are compared at once.
FIRST_BAND, CHARS_AT_ONCE = 8, 1 << 22


def align_many(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Global alignments of pairs of code point arrays, as index pairs with -1 for a gap; of equal steps back, left wins over up over diagonal.

    All pairs go row by row together. A row's steps to the right are a running
    maximum, as every one of them costs the same.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    rows, width, count = int(n.max(initial=0)), int(m.max(initial=0)), len(a)
    x, y = np.full((count, rows), -1, np.int64), np.full((count, width), -2, np.int64)
    for k in range(count):
        x[k, : n[k]], y[k, : m[k]] = a[k], b[k]
    right = np.arange(width + 1, dtype=np.float32) * np.float32(GAP)
    score = np.empty((rows + 1, count, width + 1), np.float32)
    score[0] = right
    for i in range(rows):
        step = np.where(x[:, i, None] == y, np.float32(MATCH), np.float32(MISMATCH))
        score[i + 1, :, 0] = GAP * (i + 1)
        score[i + 1, :, 1:] = np.maximum(score[i, :, :-1] + step, score[i, :, 1:] + np.float32(GAP))
        score[i + 1] = np.maximum.accumulate(score[i + 1] - right, 1) + right
    i, j, k = n.copy(), m.copy(), np.flatnonzero((n > 0) | (m > 0))
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(k):
        p, q = i[k], j[k]
        here = score[p, k, q]
        left = (q > 0) & (here == score[p, k, np.maximum(q - 1, 0)] + np.float32(GAP))
        up = ~left & (p > 0) & (here == score[np.maximum(p - 1, 0), k, q] + np.float32(GAP))
        i[k] -= ~left
        j[k] -= ~up
        steps.append((k, np.where(left, -1, p - 1), np.where(up, -1, q - 1)))
        k = k[(i[k] > 0) | (j[k] > 0)]
    return _ways(steps, count)


def _ways(steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Steps back of all pairs at once -> each pair's way from its start."""
    if not steps:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * count
    own, ai, bj = (np.concatenate(s)[::-1] for s in zip(*steps))
    order = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[order], np.arange(count + 1))
    return [(ai[order[lo:hi]], bj[order[lo:hi]]) for lo, hi in zip(cut[:-1], cut[1:])]


def align_band(a: list[np.ndarray], b: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Scores and alignments of pairs by ways on the diagonals (place in b less place in a) from ``low`` to ``high``, on which each pair begins and ends."""
    n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    rows, width, count, gap = int(n.max()), high - low + 1, len(a), np.float32(GAP)
    x, y = np.full((count, rows), -1, np.int64), np.full((count, max(rows, int(m.max())) + width), -2, np.int64)
    for k in range(count):
        x[k, : n[k]], y[k, -low : m[k] - low] = a[k], b[k]
    right = np.arange(width, dtype=np.float32) * gap
    score = np.full((rows + 1, count, width), -np.inf, np.float32)
    score[0, :, -low:] = right[: width + low]
    for i in range(rows):
        new = score[i] + np.where(x[:, i, None] == y[:, i : i + width], np.float32(MATCH), np.float32(MISMATCH))
        new[:, :-1] = np.maximum(new[:, :-1], score[i, :, 1:] + gap)
        score[i + 1] = np.maximum.accumulate(new - right, 1) + right
    i, q, k = n.copy(), m - n - low, np.flatnonzero((n > 0) | (m > 0))
    found, steps = score[n, np.arange(count), q], []
    while len(k):
        p, c = i[k], q[k]
        j, here = p + low + c, score[p, k, c]
        left = (j > 0) & (c > 0) & (here == score[p, k, np.maximum(c - 1, 0)] + gap)
        up = ~left & (p > 0) & (c + 1 < width) & (here == score[np.maximum(p - 1, 0), k, np.minimum(c + 1, width - 1)] + gap)
        i[k] -= ~left
        q[k] += up.astype(np.int64) - left
        steps.append((k, np.where(left, -1, p - 1), np.where(up, -1, j - 1)))
        k = k[(i[k] > 0) | (i[k] + low + q[k] > 0)]
    return found, _ways(steps, count)


def _gapless(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Pairs of one length whose unequal places share no character: no other way has as many matches, so that none is as good."""
    n = np.array([len(x) for x in a], np.int64)
    even = np.flatnonzero(n == [len(y) for y in b])
    good = np.zeros(len(a), bool)
    good[even] = True
    if n[even].sum():
        x, y = (np.concatenate([t[k] for k in even]).astype(np.int64) for t in (a, b))
        at = np.flatnonzero(x != y)
        own = np.repeat(even, n[even])[at] << 32
        good[np.intersect1d(own | x[at], own | y[at]) >> 32] = False
    return good


def align_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """The alignments of ``align_many``, by groups of pairs of any length: numbers of the pairs, and their ways.

    A way with M matches and G gaps has the score 3 M - (n + m) / 2 - G, and M is at most the
    number of characters that both texts have. A known way's score so bounds the gaps of
    all that are as good, and with them their diagonals: a band that has these has all
    best ways, and the way back is the same as in the whole table. Bands begin narrow, and their score
    says how wide they must be.
    """
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    straight = _gapless(a, b)
    if straight.any():
        some = np.flatnonzero(straight).tolist()
        yield some, [(w := np.arange(n[k]), w) for k in some]
    rest = np.flatnonzero(~straight).tolist()
    common = {k: sum((Counter(a[k].tolist()) & Counter(b[k].tolist())).values()) for k in rest}
    aside = dict.fromkeys(rest, FIRST_BAND)  # diagonals beside those of the corners
    while rest:
        rest.sort(key=lambda k: (aside[k], n[k], m[k]))
        again, lo = [], 0
        while lo < len(rest):
            first, hi = rest[lo], lo + 1
            narrow = lambda some: (min(0, *(int(m[k] - n[k]) for k in some)) - aside[first], max(0, *(int(m[k] - n[k]) for k in some)) + aside[first])  # noqa: E731, B023
            low, high = narrow([first, first])
            if (high - low + 1) >= m[first] + 1 or (high - low + 1) * (n[first] + 1) > CELLS:  # no less than the whole table
                if (n[first] + 1) * (m[first] + 1) > CELLS:
                    yield [first], [align_long(a[first], b[first])]
                else:
                    while hi < len(rest) and hi - lo < 256 and (hi - lo + 1) * (max(n[k] for k in rest[lo : hi + 1]) + 1) * (max(m[k] for k in rest[lo : hi + 1]) + 1) <= CELLS:
                        hi += 1
                    yield rest[lo:hi], align_many([a[k] for k in rest[lo:hi]], [b[k] for k in rest[lo:hi]])
                lo = hi
                continue
            while hi < len(rest) and hi - lo < 256 and aside[rest[hi]] == aside[first]:
                l, h = min(low, int(m[rest[hi]] - n[rest[hi]]) - aside[first]), max(high, int(m[rest[hi]] - n[rest[hi]]) + aside[first])
                if (hi - lo + 1) * (h - l + 1) * (n[rest[hi]] + 1) > CELLS or h - l > 2 * (high - low):
                    break
                low, high, hi = l, h, hi + 1
            some = rest[lo:hi]
            scores, ways = align_band([a[k] for k in some], [b[k] for k in some], low, high)
            done = []
            for k, score, way in zip(some, scores.tolist(), ways):
                most = int(3 * common[k] - (n[k] + m[k]) / 2 - score)  # gaps of a best way
                d = int(m[k] - n[k])
                if low <= -((most - d) // 2) and (most + d) // 2 <= high:
                    done.append((k, way))
                else:
                    aside[k] = max(2 * aside[k], min((most - abs(d)) // 2, 8 * aside[k]))
                    again.append(k)
            if done:
                yield [k for k, _ in done], [w for _, w in done]
            lo = hi
        rest = again


def align_long(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The same alignment of one pair whose table wouldn't fit: rows are kept at the ends of bands only.

    The way back goes through the last band first; each band, as far as the column
    where the way enters it, is split again until its table has ``cells`` at most. With
    ``BANDS`` rows kept a level, memory follows the length of b and not the product.
    """
    right = np.arange(len(b) + 1, dtype=np.float32) * np.float32(GAP)
    ai, bj = [], []

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty_like(row)
        new[0] = GAP * (i + 1)
        new[1:] = np.maximum(row[:-1] + np.where(a[i] == b[: len(row) - 1], np.float32(MATCH), np.float32(MISMATCH)), row[1:] + np.float32(GAP))
        return np.maximum.accumulate(new - right[: len(row)]) + right[: len(row)]

    def back(first: int, last: int, row: np.ndarray, q: int) -> int:
        """The way from (last, q) up to row ``first``, whose scores are ``row``; the column where it comes out."""
        kept = [row[: q + 1]]
        small = (last - first) * (q + 1) <= cells or last - first == 1
        cuts = range(first, last + 1) if small else sorted({first + (last - first) * k // BANDS for k in range(BANDS + 1)})
        for i in range(first, last if small else cuts[-2]):
            new = after(kept[-1] if small or i in cuts else new, i)
            if small or i + 1 in cuts:
                kept.append(new)
        if not small:
            for k in range(len(cuts) - 2, -1, -1):
                q = back(cuts[k], cuts[k + 1], kept[k], q)
            return q
        p = last
        while p > first:
            here = kept[p - first][q]
            if q and here == kept[p - first][q - 1] + np.float32(GAP):
                q -= 1
                ai.append(-1)
                bj.append(q)
            else:
                p -= 1
                up = here == kept[p - first][q] + np.float32(GAP)
                q -= not up
                ai.append(p)
                bj.append(-1 if up else q)
        return q

    q = back(0, len(a), right, len(b)) if len(a) else len(b)
    ai += [-1] * q
    bj += range(q - 1, -1, -1)
    return np.array(ai[::-1], np.int64), np.array(bj[::-1], np.int64)


def align(a: str, b: str) -> list[tuple[int, int]]:
    """One alignment, as index pairs."""
    ((i, j),) = align_many([_points(a)], [_points(b)])
    return list(zip(i.tolist(), j.tolist()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows for costly functions dealt evenly to all tasks: their number follows the cluster's and not the size of the texts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _normal(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id").cast("long").alias("id"), normalise(F.coalesce("a", F.lit(""))).alias("a"), normalise(F.coalesce("b", F.lit(""))).alias("b"))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Ids and code points of some pairs at a time, about ``CHARS_AT_ONCE``."""
    for batch in batches:
        sizes = np.cumsum([x + y for x, y in zip(*(pc.utf8_length(batch.column(c)).to_pylist() for c in (1, 2)))])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // CHARS_AT_ONCE)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                a, b = ([_points(t) for t in batch.column(c).slice(lo, hi - lo).to_pylist()] for c in (1, 2))
                yield batch.column(0).slice(lo, hi - lo), a, b


def alignments(pairs: DataFrame) -> DataFrame:
    """(id, a, b) -> a row for each alignment column: id, col, ca, cb, i, j. Texts are normalised first; pairs are independent, and of any length."""
    gap = np.uint32(0xFFFFFFFF)

    def letters(points: np.ndarray, at: np.ndarray) -> pa.Array:
        own = np.where(at < 0, np.uint32(32), points[np.maximum(at, 0)] if len(points) else gap).astype(np.uint32)
        text = list(own.tobytes().decode("utf-32-le", "surrogatepass"))
        return pa.array([None if x < 0 else c for x, c in zip(at.tolist(), text)], pa.string())

    def columns(own: int, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), own, np.int64)), pa.array(np.arange(len(i), dtype=np.int32)), letters(a, i), letters(b, j), *(pa.array(x.astype(np.int32), mask=x < 0) for x in (i, j))],
            ["id", "col", "ca", "cb", "i", "j"],
        )

    def run(batches):
        for ids, a, b in _texts(batches):
            for some, ways in align_pairs(a, b):
                for k, (i, j) in zip(some, ways):
                    yield columns(ids[k].as_py(), a[k], b[k], i, j)

    return _normal(dealt(pairs.select("id", "a", "b"), "id")).mapInArrow(run, "id long, col int, ca string, cb string, i int, j int")


def _between(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _side(points: list[np.ndarray], own: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[list[str], pa.Array]:
    """Texts and places of clusters, which begin at ``first`` among columns (pair, place or -1)."""
    here = at >= 0
    start = np.cumsum([0, *(len(p) for p in points)])
    letters = np.concatenate(points)[start[own[here]] + at[here]].astype(np.uint32) if here.any() else np.zeros(0, np.uint32)
    text = letters.tobytes().decode("utf-32-le", "surrogatepass")
    cut = np.concatenate([[0], np.cumsum(here)])[first]
    bounds = cut.tolist()
    return [text[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])], _between(pa.array(at[here].astype(np.int32)), cut)


def compared(pairs: DataFrame, clusters: bool = True) -> DataFrame:
    """(id, a, b) -> a row for each pair: id, same, columns (equal alignment columns, and all), and the clusters of unequal ones as ``divergences`` has them.

    Alignment columns never leave the task: they are as many as the characters of all texts.
    """

    def run(batches):
        for ids, a, b in _texts(batches):
            for some, ways in align_pairs(a, b):
                n = np.array([len(i) for i, _ in ways])
                i, j = (np.concatenate(w) for w in zip(*ways))
                own = np.repeat(np.arange(len(some)), n)
                x, y = [a[k] for k in some], [b[k] for k in some]
                u, v = (np.concatenate([*p, np.zeros(1, np.uint32)])[np.cumsum([0, *map(len, p)])[own] + np.maximum(at, 0)] for p, at in ((x, i), (y, j)))
                bad = (i < 0) | (j < 0) | (u != v)
                count = np.bincount(own[bad], minlength=len(some))
                cols = [ids.take(pa.array(some)), pa.array(n - count), pa.array(n)]
                if clusters:
                    col = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))[bad]
                    pair = own[bad]
                    new = np.ones(len(pair), bool)
                    new[1:] = (np.diff(pair) > 0) | (np.diff(col) > CLUSTER_GAP)
                    at = np.flatnonzero(new)
                    of = np.searchsorted(pair[at], np.arange(len(some) + 1))
                    seg = np.arange(len(at)) - of[pair[at]]
                    (ta, ia), (tb, ib) = (_side(p, pair, w[bad], np.append(at, len(pair))) for p, w in ((x, i), (y, j)))
                    rows = pa.StructArray.from_arrays([pa.array(seg), pa.array(ta, pa.string()), pa.array(tb, pa.string()), ia, ib], ["seg", "seg_a", "seg_b", "idx_a", "idx_b"])
                    cols.append(_between(rows, of))
                yield pa.RecordBatch.from_arrays(cols, ["id", "same", "columns", "clusters"][: len(cols)])

    schema = "id long, same long, columns long" + (", clusters array<struct<seg: long, seg_a: string, seg_b: string, idx_a: array<int>, idx_b: array<int>>>" if clusters else "")
    return _normal(dealt(pairs.select("id", "a", "b"), "id")).mapInArrow(run, schema)


def agreed(compared: DataFrame) -> DataFrame:
    """``agreement`` of compared pairs: id, agree, accepted."""
    share = F.when(F.col("columns") > 0, F.col("same") / F.col("columns")).otherwise(F.lit(1.0))
    return compared.select("id", share.alias("agree")).withColumn("accepted", F.col("agree") >= LEAST_AGREEMENT)


def clusters(compared: DataFrame) -> DataFrame:
    """``divergences`` of compared pairs."""
    return _with_kind(compared.select("id", F.explode("clusters").alias("c")).select("id", "c.*"), lambda c: F.col(c))


def agreement(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of alignment columns that are equal, and whether the pair is accepted; two empty texts agree."""
    same = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")
    found = columns.groupBy("id").agg((F.sum(same) / F.count("*")).alias("agree"))
    return pairs.select("id").join(found, "id", "left").withColumn("agree", F.coalesce("agree", F.lit(1.0))).withColumn("accepted", F.col("agree") >= LEAST_AGREEMENT)


def divergences(columns: DataFrame) -> DataFrame:
    """Clusters of unequal columns at most three apart, with their texts, indices and kind."""
    bad = columns.filter(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    w = Window.partitionBy("id").orderBy("col")
    bad = bad.withColumn("cut", (F.col("col") - F.lag("col").over(w) > CLUSTER_GAP).cast("int")).withColumn("seg", F.sum(F.coalesce("cut", F.lit(0))).over(w))
    g = bad.groupBy("id", "seg").agg(F.array_sort(F.collect_list(F.struct("col", "ca", "cb", "i", "j"))).alias("r"))
    pick = lambda f: F.filter(F.transform("r", lambda r: r[f]), lambda v: v.isNotNull())
    g = g.select("id", "seg", F.array_join(pick("ca"), "").alias("seg_a"), F.array_join(pick("cb"), "").alias("seg_b"), pick("i").alias("idx_a"), pick("j").alias("idx_b"))
    return _with_kind(g, lambda c: normalise(F.col(c)))


def _with_kind(found: DataFrame, normal: Callable[[str], Column]) -> DataFrame:
    number = lambda c: normal(c).rlike(f"^[{PAGENO_CHARS}]*$")
    kind = F.when(number("seg_a") & number("seg_b"), "pageno").when(normal("seg_a") == normal("seg_b"), "variant").otherwise("substantive")
    return found.withColumn("kind", kind)


def gram_names(points: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """A 64-bit name for the k characters from each place on."""
    n = max(0, len(points) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def anchors_of(pages: list[str], text: str) -> list[tuple[int, int]]:
    """First place and number of each page's grams that stand once in the text; names that meet are compared character by character."""
    t, p = _points(text), _points("".join(pages))
    names, first, n = np.unique(gram_names(t), return_index=True, return_counts=True)
    names, first = names[n == 1], first[n == 1]
    g, sizes = gram_names(p), np.array([len(x) for x in pages], np.int64)
    hits, low = np.zeros(len(pages), np.int64), np.full(len(pages), len(t), np.int64)
    if len(names) and len(g):
        of = np.repeat(np.arange(len(pages)), sizes)[: len(g)]
        at = np.minimum(np.searchsorted(names, g), len(names) - 1)
        own = np.flatnonzero((names[at] == g) & (np.arange(len(g)) + ANCHOR <= np.cumsum(sizes)[of]))  # of grams that end in their page
        pos = first[at[own]]
        same = np.ones(len(own), bool)
        for i in range(ANCHOR):
            same &= t[pos + i] == p[own + i]
        hits = np.bincount(of[own[same]], minlength=len(pages))
        np.minimum.at(low, of[own[same]], pos[same])
    return [(q if h else -1, h) for q, h in zip(low.tolist(), hits.tolist())]


def page_anchors(pages: DataFrame, transcripts: DataFrame, with_length: bool = False) -> DataFrame:
    """First place and number of a page's grams that are unique in the transcript: transcript_id, page_num, pos, hits, and perhaps the transcript's length as len.

    A transcript meets its own pages in one row, so its grams never leave the task and
    only texts are shuffled, once.
    """
    plain = normalise(F.coalesce("text", F.lit("")))
    own = pages.groupBy("transcript_id").agg(F.collect_list(F.struct(F.col("page_num").cast("int").alias("page_num"), plain.alias("plain"))).alias("pages"))
    both = own.join(transcripts.select("transcript_id", plain.alias("text")), "transcript_id").select("transcript_id", "text", "pages")

    def run(batches):
        for batch in batches:
            rows = []
            for t, text, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = anchors_of([p["plain"] for p in own], text)
                rows += [(t, p["page_num"], pos, hits, len(text)) for p, (pos, hits) in zip(own, found) if hits]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["transcript_id", "page_num", "pos", "hits", "len"])

    found = dealt(both, "transcript_id").mapInArrow(run, "transcript_id long, page_num int, pos int, hits long, len int")
    return found if with_length else found.drop("len")


def longest_rise(pos: list[int]) -> list[int]:
    """Indices of the longest strictly rising chain: the first of the ends, each with its earliest best predecessor."""
    # By length of chain: the ends with that length, in order of place, fall in value.
    best: list[int] = []
    lows: list[int] = []
    at_length: list[list[int]] = []
    prev = [-1] * len(pos)
    for i, p in enumerate(pos):
        n = bisect.bisect_left(lows, p)
        best.append(n)
        if n:
            ends = at_length[n - 1]
            # values fall along ends: the first end below p is the earliest predecessor
            prev[i] = ends[bisect.bisect_left(ends, True, key=lambda j: pos[j] < p)]
        if n == len(lows):
            lows.append(p)
            at_length.append([i])
        else:
            lows[n] = min(lows[n], p)
            at_length[n].append(i)
    chain, at = [], best.index(max(best)) if pos else -1
    while at >= 0:
        chain.append(at)
        at = prev[at]
    return chain[::-1]


def page_ranges(anchors: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Character range, confidence and a low flag for the pages of each transcript; a transcript with under two anchored pages has none."""

    @F.arrow_udf("array<int>")
    def chain(places: pa.Array) -> pa.Array:
        return pa.array([longest_rise(p) if len(p) > 1 else [] for p in places.to_pylist()], pa.list_(pa.int32()))

    if "len" not in anchors.columns:
        anchors = anchors.join(transcripts.select("transcript_id", F.length(normalise(F.col("text"))).alias("len")), "transcript_id")
    # a transcript is one row, with as many places as pages
    rows = anchors.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "pos", "hits"))).alias("r"), F.first("len").alias("len"))
    r = rows.select("transcript_id", "r", "len", chain(F.transform("r", lambda x: x["pos"])).alias("at")).select("transcript_id", F.transform("at", lambda i: F.get("r", i)).alias("r"), "len")
    ends = F.transform("r", lambda x, i: F.struct(x["page_num"].alias("page_num"), x["pos"].alias("pos"), x["hits"].alias("hits"), F.coalesce(F.get("r", i + 1)["pos"], F.col("len")).alias("char_end")))
    r = r.select("transcript_id", F.explode(ends).alias("x")).select("transcript_id", "x.*")
    conf = F.least(F.lit(1.0), F.col("hits") * ANCHOR / F.greatest(F.col("char_end") - F.col("pos"), F.lit(1)))
    return r.select("transcript_id", "page_num", F.col("pos").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), F.bround(conf, 3).alias("confidence"), (conf < LOW_CONFIDENCE).alias("low"))


def flag_lines(lines: DataFrame, marked: DataFrame, flag: str = "diff") -> DataFrame:
    """Sets a flag in ``suspect`` of the marked line ids and takes it from all others; running it twice changes nothing."""
    m = marked.select(F.col("line_id").alias("id")).distinct().withColumn("_m", F.lit(True))
    flags = F.filter(F.split(F.coalesce("suspect", F.lit("")), ","), lambda f: f != "")
    new = F.when(F.col("_m"), F.array_union(flags, F.array(F.lit(flag)))).otherwise(F.array_except(flags, F.array(F.lit(flag))))
    return lines.join(m, "id", "left").withColumn("suspect", F.nullif(F.array_join(new, ","), F.lit(""))).drop("_m")


def usable_lines(lines: DataFrame) -> DataFrame:
    """Lines of a page that can be collated: vertical text if the page has any, else all that isn't a number, footer, document title or table.

    A page without such a line has no rows.
    """
    page = Window.partitionBy("doc_id", "page_num")
    upright = F.coalesce(F.col("block_label") == "vertical_text", F.lit(False))
    other = ~F.coalesce(F.col("block_label").isin("number", "footer", "doc_title", "table"), F.lit(False))
    return lines.withColumn("_up", F.max(upright).over(page)).filter(F.when(F.col("_up"), upright).otherwise(other)).drop("_up")


def page_sequence(lines: DataFrame) -> DataFrame:
    """Text of each page as it is collated, and the end of each line in it: doc_id, page_num, text, ends (array of line_id, end)."""
    row = F.struct("block_num", "line_num", F.col("id").alias("line_id"), normalise(F.coalesce("text", F.lit(""))).alias("t"))
    g = usable_lines(lines).groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line_id:bigint,end:int>>").alias("ends"))
    step = lambda s, r: F.struct((s["at"] + F.length(r["t"])).alias("at"), F.concat(s["ends"], F.array(F.struct(r["line_id"].cast("long").alias("line_id"), (s["at"] + F.length(r["t"])).alias("end")))).alias("ends"))
    return g.select("doc_id", "page_num", F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("text"), F.aggregate("rows", start, step, lambda s: s["ends"]).alias("ends"))


def line_ids_at(places: str, ends: str) -> Column:
    """Ids of the lines that hold the places (array of indices from 0) of a page's sequence, sorted, each once."""
    at = lambda i: F.try_element_at(F.filter(ends, lambda e: e["end"] > i), F.lit(1))["line_id"]
    return F.array_sort(F.array_distinct(F.filter(F.transform(places, at), lambda x: x.isNotNull())))


def confirmed_pages(transcripts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Transcripts with the number of their pages whose range is confirmed."""
    n = ranges.filter("confirmed").groupBy("transcript_id").agg(F.count("*").alias("confirmed_pages"))
    return transcripts.join(n, "transcript_id", "left").fillna(0, ["confirmed_pages"])


def propose_ranges(have: DataFrame, found: DataFrame) -> DataFrame:
    """Ranges of pages that have none yet come in unconfirmed; those that are there stay."""
    key = ["transcript_id", "page_num"]
    return have.unionByName(found.join(have.select(key), key, "left_anti").withColumn("confirmed", F.lit(False)), allowMissingColumns=True)


def confirm_ranges(have: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen ranges, confirmed, in place of all that their transcripts have."""
    rest = have.join(chosen.select("transcript_id").distinct(), "transcript_id", "left_anti")
    return rest.unionByName(chosen.withColumn("confirmed", F.lit(True)), allowMissingColumns=True)


def check_pages(candidates: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run of the page check: candidates (doc_id, page_num, b) against the pages' own sequences.

    Gives the state of each page (done, rejected, unsupported) with its agreement, the
    divergences of accepted pages with the ids of their lines, and the lines: on
    accepted pages the ``diff`` flag stands where a line diverges by more than page
    numbers, and nowhere else, so that running it again changes nothing.
    """
    key = ["doc_id", "page_num"]
    both = candidates.join(page_sequence(lines), key, "left").withColumn("id", F.xxhash64(*key))
    known = both.filter("text IS NOT NULL").select("id", *key, F.col("text").alias("a"), "b", "ends")
    pairs = compared(known)
    agree = agreed(pairs)
    state = F.when(F.col("text").isNull(), "unsupported").when(F.col("accepted"), "done").otherwise("rejected")
    states = both.join(agree, "id", "left").select(*key, state.alias("state"), F.bround("agree", 3).alias("agree"))
    good = known.join(agree.filter("accepted").select("id"), "id", "left_semi")
    found = clusters(pairs.join(good.select("id"), "id", "left_semi")).join(good.select("id", *key, "ends"), "id")
    found = found.withColumn("line_ids", line_ids_at("idx_a", "ends")).drop("id", "ends", "idx_a", "idx_b")
    checked = good.select(*key).distinct()
    marked = found.filter("kind <> 'pageno'").select(F.explode("line_ids").alias("line_id"))
    flagged = flag_lines(lines.join(checked, key, "left_semi"), marked)
    return states, found, lines.join(checked, key, "left_anti").unionByName(flagged)
