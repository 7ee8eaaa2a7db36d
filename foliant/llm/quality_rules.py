"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed one- and two-token grams: one
counted on trusted documents (labelled good and not toxic), one on the whole
corpus. A document's score is the mean of ``log p_trusted - log p_corpus`` over
its grams, so length doesn't matter. Counts cover every document and come to the
driver only as ``2 * buckets`` numbers. The threshold is a parameter, or else is
read from a histogram of the scores of labelled documents: the lowest point that
separates good from bad nearly (within ``TOLERANCE``) as well as the best one, so
that doubtful documents are kept.

Tokens for the ratio are runs of letters and digits (any non-ASCII byte counts as
a letter) and runs of other non-space characters, A-Z lower-cased.

Null, empty or blank texts have zero words and fail the base rules. Where no
label exists, or labels have one value only, the ratio rejects nothing. Rows that
repeat an id are judged one by one; a label of their id holds for all of them. A
null id has no label. An empty table gives no rows. Columns besides id and text
aren't read. A very long text is one unit of work of some fifty bytes of memory
for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import chunks, grams, lower_table, materialize, prefix_hash, runs, span_hash, strings, text_buffer, words
from foliant.llm.repeat_filter import seen

#: Hash buckets of the multinomials.
BUCKETS = 1 << 14
#: Bins of the histogram that the threshold is read from.
BINS = 4096
#: What a lower threshold may lose of (share of bad below) - (share of good below).
TOLERANCE = 0.01
_SPAN = 16.0  # scores are held to -16 .. 16 in the histogram

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter or digit, 2 other
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _gram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every one- and two-token gram."""
    kind = _KIND[buf]
    s1, e1 = runs(kind == 1, off)
    s2, e2 = runs(kind == 2, off)
    s, e = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    h, doc = span_hash(prefix_hash(lower_table()[buf]), s, e), np.searchsorted(off[1:], s, "right")
    two, doc2 = grams(h, doc, 2)
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc2])


def gram_counts(texts: DataFrame) -> DataFrame:
    """(text) -> bucket, n."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for i, j in chunks(off):
                total += np.bincount(_gram_buckets(buf[off[i] : off[j]], off[i : j + 1] - off[i])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """Add-one log ratio of each bucket; the table has BUCKETS rows at most."""
    total, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        total[r.bucket], good[r.bucket] = r.n_corpus, r.n_trusted
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((total + 1) / (total.sum() + BUCKETS))


def _repeat_words(h: np.ndarray, doc: np.ndarray, n: int, k: int = 5) -> np.ndarray:
    """Words in k-word windows that a text has twice or more."""
    if len(h) < k:
        return np.zeros(n, np.int64)
    m = len(h) - k + 1
    g, gdoc = grams(h, doc, k)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    key = g ^ (gdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ks = key[order]
    same = ks[1:] == ks[:-1]
    twice = np.zeros(len(ks), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def text_stats(spark: SparkSession, ratio: np.ndarray) -> Callable[[Column], Column]:
    """Base statistics and score of a text, as a struct: a column function, so that rows stay where they are."""
    table = spark.sparkContext.broadcast(ratio)
    names = [c.split()[0] for c in STATS.split(", ")]

    @F.arrow_udf(f"struct<{STATS.replace(' ', ':').replace(',:', ',')}>")
    def stats(texts: pa.Array) -> pa.Array:
        lr, out = table.value, [[] for _ in names]
        buf, off = text_buffer(texts)
        dup = np.fromiter(map(_dup_lines, strings(texts)), np.int64, len(texts))
        for i, j in chunks(off):
            b, o, n = buf[off[i] : off[j]], off[i : j + 1] - off[i], j - i
            s, e, doc = words(b, o)
            inside = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
            chars = np.bincount(doc, weights=inside[e] - inside[s], minlength=n).astype(np.int64)
            marks = np.concatenate([[0], np.cumsum(_SYMBOL[b])])
            h = span_hash(prefix_hash(b), s, e)
            g, gdoc = _gram_buckets(b, o)
            score = np.bincount(gdoc, weights=lr[g], minlength=n) / np.maximum(np.bincount(gdoc, minlength=n), 1)
            for c, x in zip(out, (np.bincount(doc, minlength=n), chars, marks[o[1:]] - marks[o[:-1]], dup[i:j], _repeat_words(h, doc, n), score)):
                c.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.float64 if k == "score" else np.int64)) for k, c in zip(names, cols)], names)

    return stats


def best_threshold(scored: DataFrame) -> float:
    """(score, good) -> the lowest score that separates good from bad within TOLERANCE of the best. Reads one histogram."""
    bin_ = F.floor((F.greatest(F.lit(-_SPAN), F.least(F.lit(_SPAN), F.col("score"))) + _SPAN) * (BINS / (2 * _SPAN)))
    hist = scored.groupBy(bin_.alias("bin"), F.col("good").cast("int").alias("good")).count().collect()
    n = np.zeros((2, BINS + 1))
    for r in hist:
        if r.good is not None:
            n[int(r.good), int(r.bin)] += r["count"]
    if not n.sum(1).all():
        return -np.inf
    below = np.cumsum(n, 1) / n.sum(1, keepdims=True)
    apart = below[0] - below[1]
    at = int(np.argmax(apart >= apart.max() - TOLERANCE))
    return (at + 1) * 2 * _SPAN / BINS - _SPAN


class Rules(NamedTuple):
    """What was learnt from a corpus and its labels: the statistics of a text, and the lowest score that is kept."""

    stats: Callable[[Column], Column]
    threshold: float
    min_words: int
    max_repeat_percent: int

    def base_failed(self, stats: Column) -> Column:
        return (stats["n_words"] < self.min_words) | (100 * stats["n_repeat_words"] > self.max_repeat_percent * stats["n_words"])

    def kept(self, stats: Column) -> Column:
        return ~self.base_failed(stats) & (stats["score"] >= F.lit(float(self.threshold)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float | None = None,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> Rules:
    """Both multinomials and the threshold.

    All texts are counted in one pass, where they are. Only texts of labelled
    documents meet the labels: a filter of bounded size picks them in the map, and
    an exact join settles which they are.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("bad"))
    lab = lab.filter("id IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"), F.max("bad").alias("bad"))
    lab = materialize(lab.filter("good IS NOT NULL"), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = seen(lab.select("id"))
    # Labels grow with the corpus: the same join at every size, not a broadcast while they are few.
    known = texts.filter(labelled(F.col("id"))).join(lab.hint("merge"), "id").select("text", "good", (F.col("good") & ~F.col("bad")).alias("trusted"))
    known = materialize(known, "labelled-texts")
    trusted = gram_counts(known.filter("trusted").select("text")).withColumnRenamed("n", "n_trusted")
    corpus = gram_counts(texts.select("text")).withColumnRenamed("n", "n_corpus")
    stats = text_stats(docs.sparkSession, log_ratio(corpus.join(trusted, "bucket", "left").fillna(0, ["n_trusted"])))
    if threshold is None:
        threshold = best_threshold(known.select(stats(F.col("text"))["score"].alias("score"), "good"))
    return Rules(stats, threshold, min_words, max_repeat_percent)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, threshold of each row; options as of ``learn``."""
    rules = learn(docs, labels, id_col, text_col, **options)
    s = F.col("s")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), rules.stats(F.col(text_col).cast("string")).alias("s"))
    return scored.select(
        "doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words",
        rules.base_failed(s).alias("base_failed"), rules.kept(s).alias("kept"), "s.score", F.lit(float(rules.threshold)).alias("threshold"),
    )


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, as they are; each row is judged by its own text, where it lies."""
    rules = learn(docs, labels, id_col, text_col, **options)
    return docs.filter(rules.kept(rules.stats(F.col(text_col).cast("string"))))
