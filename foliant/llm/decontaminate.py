"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

The CGK random walk reads a string with one shared random bit for each (step,
character): each step copies the current character and the bit says whether to
move on. Strings at a small edit distance walk in step again soon after each
edit, so their walks differ in few places (Hamming distance).

Benchmark items are small and known; the corpus is not. So items are walked from
*every* start, and documents only from every ``stride``-th character, with windows
of about half of the smallest item of a class or less: a passage has several of them,
and some have few of its edits. Keys of a few sampled places of a walk are looked up in a
table of item keys. The number of tables is the least that finds passages of the
class's shortest items, with as many edits as match, with a chance of ``recall``;
how far their walks agree is measured on such passages. A hit must then agree on
enough of the whole walk, and is confirmed by the exact edit distance of the item to
the best-fitting part of the text around it.

Texts are compared with A-Z lower-cased and white space as single spaces;
distances are in bytes of UTF-8. An item matches at a distance of up to
``max_edits_percent`` of its length. Items of less than 16 bytes leave no room for
windows: they match where they stand exactly, as whole words. Null or empty texts
and items match nothing. Rows that repeat an id are searched one by one, a null id
stays null, an empty table gives no rows, and other columns aren't read. A very
long text is searched in one task, in some twenty bytes of memory for each of its
own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import chunks, mix, strings

#: Classes of item lengths: least bytes, width and stride of windows, sampled places of a key.
CLASSES = ((128, 40, 16, 16), (64, 32, 12, 14), (40, 16, 4, 8), (24, 12, 3, 8), (16, 8, 2, 8))
#: Passages on which the agreement of walks is measured, and their letters.
TRIALS, LETTERS = 500, np.frombuffer(b"eeeeeetttaaaooiinnsshhrrddlucmwfgypb      ", np.uint8)
#: Greatest size of a class's table of item windows, in bytes; beyond it items are taken in blocks.
TABLE_BYTES = 64 << 20


def normal(text: str) -> bytes:
    """A-Z lower-cased, words with single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


class Walk:
    """``steps`` steps of a walk and the sampled places of its tables."""

    def __init__(self, steps: int, tables: int, sampled: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.bits = r.integers(0, 2, (steps, 256)).astype(np.int64)
        self.places = np.sort(np.stack([r.choice(steps, sampled, replace=False) for _ in range(tables)]), 1)

    def embed(self, buf: np.ndarray, start: np.ndarray) -> np.ndarray:
        """steps x windows; ``buf`` must have a margin of ``steps`` bytes after each start."""
        at, out = start.copy(), np.empty((len(self.bits), len(start)), np.uint8)
        for step, bits in enumerate(self.bits):
            c = buf[at]
            out[step] = c
            at += bits[c]
        return out

    def keys(self, walk: np.ndarray, table: int) -> np.ndarray:
        k = np.full(walk.shape[1], table + 1, np.uint64)
        for p in self.places[table]:
            k *= np.uint64(257)
            k += walk[p]
        return mix(k)


def _padded(parts: list[bytes], margin: int) -> tuple[np.ndarray, np.ndarray]:
    off, out = np.zeros(len(parts), np.int64), bytearray()
    for i, p in enumerate(parts):
        off[i] = len(out)
        out += p
        out += bytes(margin)
    return np.frombuffer(bytes(out), np.uint8), off


def steps_for(width: int) -> int:
    return int(1.8 * width)


def edited(text: np.ndarray, edits: int, r: np.random.Generator) -> np.ndarray:
    """The text after so many random substitutions, deletions and insertions."""
    for _ in range(edits):
        at, how, letter = r.integers(len(text)), r.integers(3), r.choice(LETTERS)
        text = np.concatenate([text[:at], [letter] if how else [], text[at + (how < 2) :]]).astype(np.uint8)
    return text


@functools.lru_cache(64)
def tables_for(at: int, least: int, walks: int, recall: float, max_edits_percent: int, least_share: float) -> int:
    """Tables a walk for class ``at``: passages of its shortest items (``least`` bytes), with all edits allowed, are found with a chance of ``recall``."""
    _, width, stride, sampled = CLASSES[at]
    steps, most = steps_for(width), least * max_edits_percent // 100
    # one edit more at a slightly greater length can be harder than the least length
    lengths = [least, *(-(-100 * (most + i) // max_edits_percent) for i in (1, 2) if max_edits_percent)]
    tables = 1
    # chance that all sampled places are among those that agree, as they are drawn without replacement
    hit = np.array([math.comb(n, sampled) / math.comb(steps, sampled) for n in range(steps + 1)])
    log_miss = np.log1p(-np.minimum(hit, 1 - 1e-9))
    for length in lengths:
        r = np.random.default_rng(length)
        edits = length * max_edits_percent // 100
        items = [r.choice(LETTERS, length) for _ in range(TRIALS)]
        texts = [np.concatenate([r.choice(LETTERS, r.integers(stride)), edited(x, edits, r), r.choice(LETTERS, steps + stride + 2 * edits)]) for x in items]
        starts, windows = np.arange(length - width + 1), np.arange(0, length + stride, stride)
        (own, off), (buf, first) = (_padded([x.tobytes() for x in y], steps) for y in (items, texts))
        missed = np.zeros(TRIALS)  # logarithm of the chance that one table of each walk misses the passage
        for seed in range(walks):
            walk = Walk(steps, 1, sampled, seed)
            e = walk.embed(own, (off[:, None] + starts).ravel()).reshape(steps, TRIALS, -1)
            w = walk.embed(buf, (first[:, None] + windows).ravel()).reshape(steps, TRIALS, -1)
            for n in range(len(windows)):
                same = (e == w[:, :, n, None]).sum(0)
                missed += np.where(same >= least_share * steps, log_miss[same], 0).sum(1)
        while np.exp(missed * tables).mean() > (1 - recall) / 3:  # a third, as the trials are few
            tables += 1
            if tables > 1024:
                raise ValueError(f"no {recall} recall for items of {length} bytes with {max_edits_percent} % of edits: use more walks or a smaller least_share")
    return tables


class ItemTable:
    """Walks of the items of one class from every start, and their keys."""

    def __init__(self, items: list[tuple[int, bytes]], at: int, walks: int, tables: int) -> None:
        _, self.width, self.stride, sampled = CLASSES[at]
        self.items, steps = items, steps_for(self.width)
        self.walks = [Walk(steps, tables, sampled, seed) for seed in range(walks)]
        buf, off = _padded([t for _, t in items], steps)
        starts = [np.arange(len(t) - self.width + 1) for _, t in items]
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in starts])
        self.shift = np.concatenate(starts)
        self.shorter = np.uint64(64 - min(20, max(10, math.ceil(math.log2(16 * len(self.item))))))  # leading bits of keys for the bitmap
        self.found = []
        for walk in self.walks:
            e = walk.embed(buf, off[self.item] + self.shift)
            per = []
            for t in range(tables):
                k = walk.keys(e, t)
                order = np.argsort(k)
                seen = np.zeros(1 << (64 - int(self.shorter)), bool)
                seen[k >> self.shorter] = True
                per.append((k[order], order.astype(np.int32), seen))
            self.found.append((e, per))

    def candidates(self, buf: np.ndarray, start: np.ndarray, least_share: float) -> tuple[np.ndarray, np.ndarray]:
        """(index into start, item window) pairs that share a key and agree on a share of the walk."""
        got, size = [np.zeros(0, np.int64)], len(self.item)  # pairs as one number
        for walk, (e, per) in zip(self.walks, self.found):
            w = walk.embed(buf, start)
            own = np.zeros(0, np.int64)
            for t, (keys, order, seen) in enumerate(per):
                k = walk.keys(w, t)
                hit = np.flatnonzero(seen[k >> self.shorter])
                lo, hi = np.searchsorted(keys, k[hit], "left"), np.searchsorted(keys, k[hit], "right")
                n = hi - lo
                if n.any():
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    own = np.union1d(own, np.repeat(hit, n) * size + order[at])
            for lo in range(0, len(own), 1 << 16):
                p = own[lo : lo + (1 << 16)]
                got.append(p[(w[:, p // size] == e[:, p % size]).mean(0) >= least_share])
        return np.divmod(np.unique(np.concatenate(got)), size)


def best_fit(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where that part ends; (most + 1, 0) if above.

    Bit-parallel: one column of the distance table is two integers of as many bits as the item has bytes.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, most + 1, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere: row 0 stays 0
        up, down = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _short(items: list[tuple[int, bytes]]) -> ahocorasick.Automaton | None:
    """Automaton of items that are too short for windows; bytes stand for themselves."""
    automaton = ahocorasick.Automaton()
    for i, t in items:
        word = t.decode("latin-1")
        automaton.add_word(word, [*automaton.get(word, []), (i, len(t))])
    automaton.make_automaton()
    return automaton if items else None


def _stands(text: bytes, start: int, end: int) -> bool:
    """Whether the bytes start..end are whole words."""
    inside = lambda c: c >= 128 or chr(c).isalnum()
    return not (start and inside(text[start - 1]) and inside(text[start])) and not (end < len(text) and inside(text[end]) and inside(text[end - 1]))


HITS = "array<struct<item_id:long,distance:long,start:long,end:long>>"


def searches(
    benchmark: DataFrame,
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_edits_percent: int = 10,
    recall: float = 0.99,
    walks: int = 3,
    least_share: float = 0.5,
) -> list[Callable[[Column], Column]]:
    """Column functions, text -> hits (each item found, at its best place), one for each block of the benchmark.

    The benchmark is read to the driver, as it is a fixed set; its tables are checked
    against TABLE_BYTES, and a larger benchmark is taken in blocks.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t IS NOT NULL").distinct()
    items = sorted({(r.i, t) for r in rows.toLocalIterator() if (t := normal(r.t))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    blocks: list[list[tuple[int, list]]] = [[]]
    room, tables = TABLE_BYTES, {}
    for at, (least, width, *_) in enumerate(CLASSES):
        own = [x for x in items if len(x[1]) >= least and (at == 0 or len(x[1]) < CLASSES[at - 1][0])]
        if own:
            tables[at] = tables_for(at, min(len(t) for _, t in own), walks, recall, max_edits_percent, least_share)
        for x in own:
            need = len(x[1]) * walks * (steps_for(width) + (12 + 16) * tables[at])  # walks, keys and their order, bitmap
            if need > room and blocks[-1]:
                blocks.append([])
                room = TABLE_BYTES
            if not blocks[-1] or blocks[-1][-1][0] != at:
                blocks[-1].append((at, []))
            blocks[-1][-1][1].append(x)
            room -= need
    sc = benchmark.sparkSession.sparkContext
    short = [x for x in items if len(x[1]) < CLASSES[-1][0]]
    return [
        _search(sc.broadcast(([ItemTable(own, at, walks, tables[at]) for at, own in block], short if n == 0 else [])), max_edits_percent, least_share)
        for n, block in enumerate(blocks)
    ]


def _search(shared, max_edits_percent: int, least_share: float) -> Callable[[Column], Column]:
    def in_class(table: ItemTable, norm: list[bytes], buf: np.ndarray, off: np.ndarray, found: list[dict]) -> None:
        n = [max(0, (len(x) - table.width) // table.stride + 1) for x in norm]
        doc = np.repeat(np.arange(len(norm)), n)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum([0, *n])[:-1], n)) * table.stride
        at, window = table.candidates(buf, off[doc] + place, least_share)
        begins = place[at] - table.shift[window]
        for d, k, b in sorted({(int(d), int(k), int(b) // 16) for d, k, b in zip(doc[at], table.item[window], begins)}):
            item_id, item = table.items[k]
            most = len(item) * max_edits_percent // 100
            lo = max(0, b * 16 - most)
            distance, end = best_fit(item, norm[d][lo : b * 16 + 16 + len(item) + most], most)
            if distance <= most and found[d].get(item_id, (most + 1,)) > (distance, lo + end):
                found[d][item_id] = (distance, lo + end, max(0, lo + end - len(item) - distance))

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        tables, items = shared.value
        short = _short(items)
        margin = max((len(w.bits) for t in tables for w in t.walks), default=1)
        norm = [normal(t) for t in strings(texts)]
        found: list[dict[int, tuple]] = [{} for _ in norm]
        for i, j in chunks(np.concatenate([[0], np.cumsum([len(x) for x in norm])]).astype(np.int64)):
            buf, off = _padded(norm[i:j], margin)
            for table in tables:
                in_class(table, norm[i:j], buf, off, found[i:j])
        for text, own in zip(norm, found) if short else ():
            for last, ids in short.iter(text.decode("latin-1")):
                for item_id, n in ids:
                    if _stands(text, last + 1 - n, last + 1):
                        own.setdefault(item_id, (0, last + 1, last + 1 - n))
        rows = [[{"item_id": k, "distance": v[0], "start": v[2], "end": v[1]} for k, v in sorted(f.items(), key=lambda x: (x[0] is None, x[0] or 0))] for f in found]
        return pa.array(rows, pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "distance", "start", "end")])))

    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, distance, start, end: each pair of a document and an item found in it, at its best place.

    ``start`` (least) and ``end`` are bytes of the normalised text; options as of ``searches``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [texts.select("doc_id", F.explode(find(F.col("text"))).alias("hit")).select("doc_id", "hit.*") for find in searches(benchmark, **options)]
    return functools.reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, as they are; each row is judged where it lies."""
    for find in searches(benchmark, **options):
        docs = docs.filter(F.size(find(F.col(text_col).cast("string"))) == 0)
    return docs
