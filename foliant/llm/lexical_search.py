"""Ranked lexical search: a blocked product of an item-term and a term-document matrix.

Documents are walked once: each task finds the terms of its texts that some item
has, and writes them with their counts (``postings``). Counts of documents and terms
over the whole table give the weights. The second step reads the postings in blocks
of documents: a block is a sparse matrix of 64-bit impacts, term by document; the
rows of an item's terms are merged into one row of scores (Gustavson), and the best
``k`` of each item leave the block. Blocks are reduced in two steps, by groups of
tasks and then by item, so no task sees more than some thousand rows of an item.

Items go by blocks of at most ``terms`` different terms, so what is broadcast is
bounded; each block of items is one pass over the texts. A document's score:

    sum over the item's terms of  multiplicity * w * ((10^9 tf) div (1000 tf + 20 m))
    w = floor(1000 ln((2N + 2) / (2 df + 1))),   m = 50 + (50 n N) div L

N counts documents with a term, L their terms, n the document's terms, df the documents that
hold the term, tf its places in the document. ``multiplicity`` is 1, or the term's
places in the item.

Terms are runs of ASCII letters, digits and characters past ASCII, A-Z lower-cased;
two terms are one if 64 bits of their hashes and their lengths agree. Null and empty texts
have none, and are never found. Rows that repeat an item id (a null one too) are one
item. Each row of a table is a document of its own, also where it repeats an id; a
null id comes after all others of its score. No items, or no documents, give no rows;
columns besides id and text aren't read. A very long text is one unit of work, of some
hundred bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import chunks, lower_table, materialize, prefix_hash, runs, span_hash, text_buffer

#: Terms of a block of items, postings of a block of documents.
TERMS, POSTINGS = 1 << 20, 1 << 21
#: Tasks whose best documents meet first.
FAN_IN = 64


def _is_term() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


IN_TERM = _is_term()


def terms_of(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = IN_TERM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each term."""
    buf = lower_table()[buf]
    s, e = runs(inside[buf], off)
    return span_hash(prefix_hash(buf), s, e) + (e - s).astype(np.uint64), np.searchsorted(off[1:], s, "right"), s, e


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_key, h, n: different terms of each item with their places, from all its rows."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for i, j in chunks(off):
                h, doc, _, _ = terms_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(h.view(np.int64))], ["item", "h"])

    words = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item long, h long")
    return words.groupBy("item", "h").agg(F.count("*").alias("n"))


def _item_blocks(terms: DataFrame, most: int) -> Iterator[pa.Table]:
    """Items dealt by hash into blocks of about ``most`` rows (item, h, n); only one block is on the driver at a time."""
    blocks = -(-terms.count() // most)
    for b in range(blocks):
        yield terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), terms (numbers of those in the vocabulary, ascending) and tf; texts without any term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for i, j in chunks(off):
                h, doc, _, _ = terms_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.bincount(doc, minlength=j - i)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = known[at] == h
                cell, tf = np.unique(doc[own] * len(known) + at[own], return_counts=True)
                doc, term = cell // len(known), cell % len(known)
                rows = np.flatnonzero(n)
                cut = np.searchsorted(doc, np.append(rows, j - i))
                pack = lambda x: [x[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], np.append(cut[1:-1], len(x)))]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(n[rows]), pa.array(pack(term), pa.binary()), pa.array(pack(tf), pa.binary())], ["id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, terms binary, tf binary")


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary: each task counts its own."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            t = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            df += np.bincount(t, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    counts = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal scores the first places win."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        kth = np.partition(own, len(at) - k)[len(at) - k]
        above = at[own > kth]
        at = np.concatenate([above, at[own == kth][: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


class Product:
    """The items' side: rows of term numbers and multiplicities, the terms' weights, and what a document's length does."""

    def __init__(self, items: list[int | None], indptr: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, places: int, k: int) -> None:
        self.items, self.indptr, self.terms, self.times, self.weights = items, indptr, terms, times, weights
        self.documents, self.places, self.k = documents, places, k

    def block(self, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item number, scores, documents) of the best documents of a block, which are in the order of their ids."""
        uniq, back = np.unique(n, return_inverse=True)
        m = (50 + np.array([50 * int(x) * self.documents // self.places for x in uniq], np.int64))[back]
        impact = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(terms, kind="stable")
        terms, doc, impact = terms[order], doc[order], impact[order]
        lo = np.searchsorted(terms, self.terms)
        hi = np.searchsorted(terms, self.terms, "right")
        for i in range(len(self.items)):
            scores, some = np.zeros(len(n), np.int64), False
            for x in range(self.indptr[i], self.indptr[i + 1]):
                if lo[x] < hi[x]:  # a document stands once in a term's row
                    scores[doc[lo[x] : hi[x]]] += self.times[x] * impact[lo[x] : hi[x]]
                    some = True
            if some and len(at := _best(scores, self.k)):
                yield i, scores[at], at


def _settled(product: Product, held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held)
    null = pc.is_null(t.column("id")).to_numpy()
    ids = t.column("id").fill_null(0).to_numpy()
    order = np.lexsort((ids, null))
    t, ids, null = t.take(pa.array(order)), ids[order], null[order]
    packed, counts = t.column("terms").to_pylist(), t.column("tf").to_pylist()
    doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in packed])
    terms, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (packed, counts))
    out = list(product.block(t.column("n").to_numpy(), terms, tf, doc))
    if out:
        rows = np.concatenate([at for _, _, at in out])
        items = [product.items[i] for i, _, at in out for _ in at]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids[rows], pa.int64(), mask=null[rows]), pa.array(np.concatenate([s for _, s, _ in out])), pa.array([part] * len(rows), pa.int64())], ["item", "id", "score", "part"])


def _ranked(found: DataFrame, product: Product) -> DataFrame:
    """item, id, score, part: the best of each block of documents."""
    shared = found.sparkSession.sparkContext.broadcast(product)

    def run(batches):
        product, part = shared.value, TaskContext.get().partitionId() // FAN_IN
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy()) // 4
            at = 0
            while at < batch.num_rows:  # rows until the block is full, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if size >= POSTINGS or at < batch.num_rows:
                    yield from _settled(product, held, part)
                    held, size = [], 0
        if held:
            yield from _settled(product, held, part)

    return found.select("id", "n", "terms", "tf").mapInArrow(run, "item long, id long, score long, part long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", multiplicity: bool = False, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    terms = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    best = None
    for own in _item_blocks(terms, most_terms):
        vocabulary, at = np.unique(own["h"].to_numpy().view(np.uint64), return_inverse=True)
        found = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
        total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("places")).first()
        if not own.num_rows or not total.docs:
            continue
        weights = np.array([weight(total.docs, int(x)) for x in document_counts(found, len(vocabulary))], np.int64)
        null, item = pc.is_null(own["item"]).to_numpy(), own["item"].fill_null(0).to_numpy()
        order = np.lexsort((at, item, null))
        null, item = null[order], item[order]
        first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (null[1:] != null[:-1])]))
        times = own["n"].to_numpy()[order] if multiplicity else np.ones(len(order), np.int64)
        names = [None if null[x] else int(item[x]) for x in first]
        some = _ranked(found, Product(names, np.append(first, len(order)), at[order], times, weights, total.docs, total.places, k))
        best = some if best is None else best.unionAll(some)
    if best is None:
        return docs.sparkSession.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    by = [F.desc("score"), F.asc_nulls_last("id")]
    near = best.withColumn("_r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("_r") <= k)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
