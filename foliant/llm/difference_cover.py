"""Exact removal of repeated substrings by a suffix sort over a difference cover.

A perfect difference set ``COVER`` modulo ``PERIOD`` has each difference once, so
that for any two starts of equal strings some place not more than ``PERIOD`` bytes on is
sampled in both. Positions of texts are sampled by it (one in nine):

1. *Triples.* The bytes at a sampled place are a triple of characters of
   ``SIDE`` bytes each. All triples are sorted by range partition; a run of equal
   neighbours gets a name, and a triple without an equal neighbour is dropped: no
   string that has it at this place can repeat. A twice-seen filter keeps triples
   that are surely unique from being shuffled at all.
2. *Recursion on names.* Places of one residue follow each other at ``PERIOD``
   bytes, and their triples overlap; so three names in a row name all the bytes of
   a block as long as the strings and a period. As strings are cut at ``width``
   bytes, one level of recursion is all there is. Blocks that occur twice settle
   all the strings that start in them.
3. *Merge.* The other suffixes near a repeated triple are merged by (name, place
   from the sampled one, bytes) and each is compared with its neighbours.

Everything near a repeat is sampled ten times a period, and each sample is a row of
three shuffles: that takes more disk than the check tool's budget (README), so the
registered query is the method of ``suffix_dedup``. Both give the same rows.

Steps after the names, and treatment of nulls, repeated rows, empty tables and
long texts, are those of ``suffix_dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliant.llm.common import chunks, materialize, mix, prefix_hash, span_hash, text_buffer
from foliant.llm.repeat_filter import maybe_repeated
from foliant.llm.suffix_dedup import PART, merged, repeated_keys, texts_of

#: A perfect difference set modulo 91.
PERIOD, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
#: Bytes of a character; a triple must span a period, and leave one of the strings' length.
SIDE = 36
TRIPLE = 3 * SIDE
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def sampled(buf: np.ndarray, off: np.ndarray):
    """Sampled places with a whole triple in their text: the place in the buffer, its text, the three characters (hashes)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inner = np.arange(len(buf)) - off[:-1][doc]
    at = np.flatnonzero(_IN_COVER[inner % PERIOD] & (inner + TRIPLE <= np.diff(off)[doc]))
    h = prefix_hash(buf)
    return at, doc[at], [span_hash(h, at + k * SIDE, at + (k + 1) * SIDE) for k in range(3)], h


def triple_key(chars: list[np.ndarray]) -> np.ndarray:
    a, b, c = chars
    return mix(mix(a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0x9E3779B97F4A7C15) + c)


def triples(texts: DataFrame, bitmap, width: int) -> DataFrame:
    """c1, c2, c3, id, th, place, size of the text, and a hash of the bytes at the text's ends that no three names cover."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for i, j in chunks(off, PART):
                o = off[i : j + 1] - off[i]
                at, doc, chars, h = sampled(buf[off[i] : off[j]], o)
                hit = np.flatnonzero(maybe_repeated(bitmap.value, triple_key(chars)))
                at, doc = at[hit], doc[hit]
                lo, hi = o[doc], o[doc + 1]
                left = np.where(at - lo < PERIOD, span_hash(h, lo, at) + (at - lo).astype(np.uint64), np.uint64(0))
                right = np.where(at + PERIOD + TRIPLE > hi, span_hash(h, np.minimum(at + TRIPLE, hi), np.minimum(hi, at + width)) + (hi - at).astype(np.uint64), np.uint64(0))
                take = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[hit].view(np.int64)) for c in chars), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (at - lo, hi - lo)), pa.array(mix(left * np.uint64(31) + right).view(np.int64))],
                    ["c1", "c2", "c3", "id", "th", "q", "size", "ends"],
                )

    return texts.mapInArrow(run, "c1 long, c2 long, c3 long, id long, th long, q int, size int, ends long")


def named_by_order(rows: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """Rows in sorted order of the key, of which those with an equal neighbour get a name: the number of their run, by partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)

    def settle(t: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        keys = [t.column(k).to_numpy() for k in key]
        turn = np.ones(t.num_rows + 1, bool)
        turn[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        run = np.cumsum(turn[:-1]) - 1
        hit = pa.array(np.flatnonzero(~(turn[:-1] & turn[1:])))
        name = (TaskContext.get().partitionId() << 40) + first + run
        cols = [pa.array(name).take(hit), *(t.column(c).combine_chunks().take(hit) for c in rest)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["name", *rest]), first + int(run[-1]) + 1

    def number(batches):
        left, first = None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            if not t.num_rows:
                continue
            differ = np.logical_or.reduce([t.column(k).to_numpy() != t.column(k)[-1].as_py() for k in key])
            other = np.flatnonzero(differ)
            cut = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
            left = t.slice(cut)
            if cut:
                out, first = settle(t.slice(0, cut), first)
                yield out
        if left is not None and left.num_rows:
            yield settle(left, first)[0]

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    return inside.mapInArrow(number, f"name long, {types}")


def blocks(named: DataFrame, width: int) -> DataFrame:
    """Names of a text in order of place -> g (name), b (name of three names a period apart), id, th, a, s, e of the block around each."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = named.repartition(parts, "id", "th").sortWithinPartitions("id", "th", "q")

    def settle(t: pa.Table) -> pa.RecordBatch:
        ids, th, q, size, name, ends = (t.column(c).to_numpy() for c in ("id", "th", "q", "size", "name", "ends"))
        turn = np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])
        spot = (np.cumsum(turn) << 32) + q
        # Rows that are there twice have the same spots and names: any of them will do.
        def neighbour(shift):
            at = np.minimum(np.searchsorted(spot, spot + shift), len(spot) - 1)
            return np.where(spot[at] == spot + shift, name[at], -1)

        before, after = neighbour(-PERIOD), neighbour(PERIOD)
        first, last = q < PERIOD, q + PERIOD + TRIPLE > size
        alone = ((before < 0) & ~first) | ((after < 0) & ~last)
        u = lambda x: x.astype(np.int64).view(np.uint64)
        three = triple_key([u(np.where(first, -2, before)), u(name), u(np.where(last, -2, after))])
        own = triple_key([u(ids), u(th), u(q)])
        b = np.where(alone, own, mix(three + u(ends)))
        s, e = np.maximum(q - PERIOD, 0), np.minimum(q - 1, size - width)
        keep = pa.array(np.flatnonzero(e >= s))
        cols = [pa.array(name), pa.array(b.view(np.int64)), pa.array(ids), pa.array(th), *(pa.array(x.astype(np.int32)) for x in (q, s, e))]
        return pa.RecordBatch.from_arrays([c.take(keep) for c in cols], ["g", "b", "id", "th", "a", "s", "e"])

    def run(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            if not t.num_rows:
                continue
            other = np.flatnonzero((t.column("id").to_numpy() != t.column("id")[-1].as_py()) | (t.column("th").to_numpy() != t.column("th")[-1].as_py()))
            cut = int(other[-1]) + 1 if len(other) else 0
            left = t.slice(cut)
            if cut:
                yield settle(t.slice(0, cut))
        if left is not None and left.num_rows:
            yield settle(left)

    return order.mapInArrow(run, "g long, b long, id long, th long, a int, s int, e int")


def remove_repeats_by_cover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """id, kept (bytes), n_bytes, n_removed, n_spans, spans of each row; strings of ``width`` bytes, a triple and a period at least."""
    if width < PERIOD + TRIPLE:
        raise ValueError(f"width must be {PERIOD + TRIPLE} at least")
    texts = texts_of(docs, id_col, text_col)
    bitmap = repeated_keys(texts, lambda buf, off: triple_key(sampled(buf, off)[2]), PERIOD // len(COVER))
    named = materialize(named_by_order(triples(texts, bitmap, width), ["c1", "c2", "c3"], ["id", "th", "q", "size", "ends"]), "names")
    return merged(texts, materialize(blocks(named, width), "name-triples"), width)
