"""Exact removal of repeated substrings: a covered-sample suffix method.

The task: remove each byte covered by a ``width``-byte string that also starts
anywhere else. ``difference_cover`` does this by the suffix sort over a positional
difference cover; it gives the same rows, but was stopped by the check tool for the
disk that it takes (figures in the README). This is a leaner method of the same
plan, with a cover that is chosen by content:

1. *Sample.* In each ``width``-byte window the ``gram``-byte string of least hash is
   its anchor (the last of equal ones). Equal windows have equal anchors at equal
   places, so the anchors are a cover of about one position in sixty. Windows
   that start in a row and share an anchor form one interval.
2. *Names.* An anchor's gram, and the whole block of bytes that its interval's
   windows cover, are named by 64-bit hashes. A twice-seen filter drops anchors
   whose gram is surely unique, before anything is shuffled. Blocks that occur
   twice settle all their windows at once.
3. *Merge.* Where a gram repeats but the block doesn't, the windows of one block
   of each name are compared with those of their gram's other blocks: sorted by
   (gram, place of the anchor, 200-byte window), neighbours that are equal repeat.
   Grams with very many different blocks are sorted across all tasks.

Two different strings count as equal if 128 bits of (anchor, block) or (anchor,
window) names agree, which doesn't happen by chance.

Null and empty texts have no bytes. Rows that repeat an id are documents of their
own; a null id is an id like any other and comes back as null. An empty table gives
no rows; columns besides id and text aren't read. A very long text is one unit of
work of some hundred bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import chunks, materialize, mix, powers, prefix_hash, span_hash, text_buffer
from foliant.llm.repeat_filter import filter_bits, maybe_repeated, repeat_filter

#: Bytes of text that are hashed at once: some hundred bytes of working memory for each.
PART = 1 << 18
#: Different blocks of one gram that one task may compare.
HOT = 4096
_NO_ID = -(2**63)
_PLACE = np.uint64((1 << 24) - 1)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value in each w values in a row, the last of equal ones (top 40 bits count)."""
    n = len(h)
    key = np.full(n + (-n) % w, np.uint64(2**64 - 1))
    key[:n] = (h & ~_PLACE) | (_PLACE - (np.arange(n, dtype=np.uint64) & _PLACE))
    key = key.reshape(-1, w)
    ahead = np.minimum.accumulate(key, 1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    start = np.arange(n - w + 1)
    low = _PLACE - (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & _PLACE)
    at = (start & ~int(_PLACE)) | low.astype(np.int64)
    return np.where(at < start, at + int(_PLACE) + 1, at)


def anchors(buf: np.ndarray, off: np.ndarray, width: int, gram: int):
    """Anchor, first and last start of each interval; the text of each; gram and block names."""
    none = np.zeros(0, np.int64)
    if len(buf) < width:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = prefix_hash(buf)
    at = np.arange(len(buf) - gram + 1)
    g = span_hash(h, at, at + gram)
    a = _least(g, width - gram + 1)
    inside = np.arange(len(a)) + width <= np.repeat(off[1:], np.diff(off))[: len(a)]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    a = a[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
    s, e = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])]
    a = a[first]
    return a, s, e, np.searchsorted(off[1:], s, "right"), g[a], mix(span_hash(h, s, e + width) + (a - s).astype(np.uint64))


def _names(rows: DataFrame, bitmap, width: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for i, j in chunks(off, PART):
                a, s, e, doc, g, b = anchors(buf[off[i] : off[j]], off[i : j + 1] - off[i], width, gram)
                hit = np.flatnonzero(maybe_repeated(bitmap.value, g))
                doc = doc[hit]
                base = (off[i:j] - off[i])[doc]
                take = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[hit].view(np.int64)), pa.array(b[hit].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x[hit] - base).astype(np.int32)) for x in (a, s, e))],
                    ["g", "b", "id", "th", "a", "s", "e"],
                )

    return rows.mapInArrow(run, "g long, b long, id long, th long, a int, s int, e int")


_OPEN = "g long, n long, members long, id long, th long, a int, s int, ctx binary"


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """(id, th, text, todo) -> a row for each open block, with its bytes."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            todo = batch.column(3)
            flat = todo.flatten()
            doc = np.repeat(np.arange(len(todo)), pc.list_value_length(todo).to_numpy(zero_copy_only=False).astype(np.int64))
            get = lambda k: flat.field(k).to_numpy(zero_copy_only=False)
            s, e = get("s").astype(np.int64), get("e").astype(np.int64)
            raw, lo, hi = buf.tobytes(), off[doc] + s, off[doc] + e + width
            ctx = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [flat.field("g"), flat.field("n"), flat.field("members"), batch.column(0).take(take), batch.column(1).take(take), flat.field("a"), flat.field("s"), ctx],
                ["g", "n", "members", "id", "th", "a", "s", "ctx"],
            )

    return rows.mapInArrow(run, _OPEN)


def _window_names(batch, width: int):
    """For all blocks of a batch: row, start (in the text) and name (gram, place, bytes) of each window."""
    buf, off = text_buffer_binary(batch.column("ctx"))
    size = np.diff(off) - width + 1
    row = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    h, at = prefix_hash(buf), off[row] + inner
    own = mix((h[at + width] - h[at]) * powers(len(h))[1][at])
    start = batch.column("s").to_numpy().astype(np.int64)[row] + inner
    back = (batch.column("a").to_numpy().astype(np.int64)[row] - start).astype(np.uint64)
    return row, start, mix(own ^ (batch.column("g").to_numpy().view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) + back))


def text_buffer_binary(col) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    arr = col.cast(pa.large_binary())
    _, places, data = arr.buffers()
    off = np.frombuffer(places, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _intervals(batch, row, start, good) -> pa.RecordBatch:
    """Runs of starts that repeat, as (id, th, s, e)."""
    row, start = row[good], start[good]
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.concatenate([first[1:] - 1, [len(row) - 1]])
    else:
        first = last = np.zeros(0, np.int64)
    take = pa.array(row[first])
    get = lambda k: batch.column(k).combine_chunks().take(take) if isinstance(batch.column(k), pa.ChunkedArray) else batch.column(k).take(take)
    return pa.RecordBatch.from_arrays([get("id"), get("th"), pa.array(start[first].astype(np.int32)), pa.array(start[last].astype(np.int32))], ["id", "th", "s", "e"])


def _compare(width: int):
    """Blocks sorted by gram -> intervals of starts, of blocks that occur once, whose windows another block has."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        row, start, name = _window_names(table, width)
        n = table.column("n").to_numpy()[row]
        _, which = np.unique(name, return_inverse=True)
        return _intervals(table, row, start, (np.bincount(which, weights=n)[which] > 1.5) & (n == 1))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            g = t.column("g").to_numpy()
            other = np.flatnonzero(g != g[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last gram may go on in the next batch
            rest = t.slice(cut)
            if cut:
                yield settle(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return run


def _cut_out(width: int):
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                own = buf[off[i] : off[i + 1]]
                if not spans:
                    rows.append((ids[i], own.tobytes(), len(own), 0, 0, []))
                    continue
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, [x["s"] for x in spans], 1)
                np.add.at(edge, [x["e"] + width for x in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                rows.append((ids[i], own[~gone].tobytes(), len(own), int(gone.sum()), len(turn) // 2, [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    return run


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (a number for null, too), hash of the text, text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_keys(texts: DataFrame, keys_of_part, share: int):
    """Broadcast twice-seen filter of the keys that ``keys_of_part`` (bytes, places where texts begin) gives, about one for ``share`` bytes."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys_of(batch):
        buf, off = text_buffer(batch.column(0))
        got = [keys_of_part(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in chunks(off, PART)]
        return np.concatenate(got) if got else np.zeros(0, np.uint64)

    return texts.sparkSession.sparkContext.broadcast(repeat_filter(texts.select("text"), keys_of, filter_bits(size // share + 1)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64) -> DataFrame:
    """id, kept (bytes), n_bytes, n_removed, n_spans, spans of each row."""
    texts = texts_of(docs, id_col, text_col)
    bitmap = repeated_keys(texts, lambda buf, off: anchors(buf, off, width, gram)[4], (width - gram) // 2)
    return merged(texts, materialize(_names(texts, bitmap, width, gram), "anchors"), width)


def merged(texts: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """What ``remove_repeats`` gives, from named blocks (g, b, id, th, a, s, e).

    Equal windows must be at equal places from equal names ``g``: the windows s..e
    of a block, around a. Blocks of equal ``b`` (which agree in g) are equal.
    """
    # Any row of a class of equal blocks stands for it: first() takes all of these from one row.
    rep = [F.first(c).alias(c) for c in ("id", "th", "a", "s", "e")]
    classes = materialize(named.groupBy("g", "b").agg(F.count("*").alias("n"), *rep), "blocks")
    opened = classes.groupBy("g").agg(F.count("*").alias("members"), F.min("n").alias("least")).filter("members > 1 AND least = 1").select("g", "members")
    todo = classes.join(materialize(opened, "open-grams"), "g")
    todo = todo.groupBy("id", "th").agg(F.collect_list(F.struct("g", F.least("n", F.lit(2)).alias("n"), "members", "a", "s", "e")).alias("todo"))
    ctx = materialize(_contexts(texts.join(todo, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "todo"), width), "open-blocks")

    cold = ctx.filter(F.col("members") <= HOT)
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = cold.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_compare(width), "id long, th long, s int, e int")

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                row, start, name = _window_names(batch, width)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column("n").take(take), batch.column("id").take(take), batch.column("th").take(take), pa.array(start.astype(np.int32))], ["w", "n", "id", "th", "s"])

    windows = ctx.filter(F.col("members") > HOT).mapInArrow(spread, "w long, n long, id long, th long, s int")
    repeated = materialize(windows.groupBy("w").agg(F.sum("n").alias("k")).filter("k > 1").select("w"), "hot-windows")
    hot = windows.filter("n = 1").join(repeated, "w").select("id", "th", "s", F.col("s").alias("e"))

    whole = named.join(classes.filter("n > 1").select("g", "b"), ["g", "b"]).select("id", "th", "s", "e")
    spans = whole.unionAll(merged).unionAll(hot).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    both = texts.join(spans, ["id", "th"], "left").select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"), "th", "text", "found")
    shape = "id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>"
    return both.mapInArrow(_cut_out(width), shape)


def repeat_digest(kept: DataFrame) -> DataFrame:
    """What ``remove_repeats`` gives -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
