"""Line deduplication with two Bloom filters.

Each task hashes its lines into a *once-seen* and a *twice-seen* filter (see
``repeat_filter``). Only lines that the merged twice-seen filter may hold are
shuffled, with their whole keys: a partial minimum and maximum of the ids settles
exactly which keys repeat and which document keeps its lines. A fuller filter
lets more lines through to the exact step and never changes a result. Texts move
only where they lose lines: a filter of the documents that do picks them in the
map, and all other texts go to the result from where they lie.

A null or empty text is one empty line. Rows with the same id are one document.
A null id counts as the last document of all. An empty table gives no rows, and
columns besides id and text aren't read. A very long text is handled in one task,
in a few times its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import lower_table, materialize, strings
from foliant.llm.repeat_filter import filter_bits, maybe_repeated, repeat_filter, seen

SPACES = b" \t\n\r\x0b\x0c"
_LOWER = lower_table().tobytes()
_CONTINUES = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).translate(_LOWER)


def first_lines(text: str, min_chars: int) -> dict[bytes, int]:
    """Each key of a text that counts, with the number of its first line."""
    out: dict[bytes, int] = {}
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= 4 * min_chars or len(key.translate(None, _CONTINUES)) >= min_chars:
                out.setdefault(key, i)
    return out


def key_hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    bits_per_line: int = 12,
    max_filter_bytes: int = 32 << 20,
) -> DataFrame:
    """id, kept text, n_lines, n_dropped of every row."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    n = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1

    def keys_of(batch):
        return np.concatenate([np.zeros(0, np.uint64), *(key_hashes(first_lines(t, min_chars)) for t in strings(batch.column(1)))])

    twice = spark.sparkContext.broadcast(repeat_filter(texts, keys_of, filter_bits(n, bits_per_line, max_filter_bytes)))

    def suspects(batches):
        for batch in batches:
            row, keys, at = [], [], []
            for i, text in enumerate(strings(batch.column(1))):
                own = first_lines(text, min_chars)
                row += [i] * len(own)
                keys += own.keys()
                at += own.values()
            hit = pa.array(np.flatnonzero(maybe_repeated(twice.value, key_hashes(keys))))
            row, keys, at = (pa.array(c, t).take(hit) for c, t in ((row, pa.int64()), (keys, pa.binary()), (at, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), keys, at], ["id", "th", "key", "line"])

    found = materialize(texts.mapInArrow(suspects, "id long, th long, key binary, line int"), "suspect-lines")
    # A null id counts as the last document of all.
    order = F.coalesce("id", F.lit(2**63 - 1))
    repeated = found.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last").select("key", "first")
    repeated = materialize(repeated, "repeated-lines")
    drops = found.join(repeated, "key").filter(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "th").agg(F.collect_set("line").alias("lines"))
    drops = materialize(drops, "dropped-lines")

    def rebuild(batches):
        for batch in batches:
            kept, total, gone = [], [], []
            for text, lines in zip(strings(batch.column(1)), batch.column(2).to_pylist()):
                if not lines:
                    kept.append(text)
                    total.append(text.count("\n") + 1)
                    gone.append(0)
                    continue
                whole = text.encode("utf-8", "surrogatepass").split(b"\n")
                bad = {line_key(whole[x]) for x in lines if x < len(whole)}
                rest = [x for x in whole if line_key(x) not in bad]
                kept.append(b"\n".join(rest).decode("utf-8", "surrogatepass"))
                total.append(len(whole))
                gone.append(len(whole) - len(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["id", "text", "n_lines", "n_dropped"])

    touched = seen(drops.select(F.xxhash64("id", "th")), most_bytes=max_filter_bytes)(F.xxhash64("id", "th"))
    drops = drops.withColumnsRenamed({"id": "of", "th": "of_text"})
    both = texts.filter(touched).join(drops.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & F.col("th").eqNullSafe(F.col("of_text")), "left").select("id", "text", "lines")
    whole = F.coalesce("text", F.lit(""))
    rest = texts.filter(~touched).select("id", whole.alias("text"), (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return rest.unionAll(both.mapInArrow(rebuild, "id long, text string, n_lines long, n_dropped long"))


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    kept = drop_repeated_lines(docs, **options)
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
