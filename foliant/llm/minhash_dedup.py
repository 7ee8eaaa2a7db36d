"""Near-duplicates: MinHash bands, odd sketches, then a check on full sets.

1. Each text becomes the set of its k-word shingles (A-Z lower-cased, words are
   runs of non-space). Texts with equal sets form one class straight away.
2. A class is described by a MinHash of ``bands * rows`` samples. The bands give
   candidates; the *odd sketch* folds the samples into a parity bitmap whose XOR
   population count gives the size of the symmetric difference of the sample
   sets, and so the similarity.
3. Candidates that the sketch doesn't rule out are confirmed on the full sets of
   words, read from the texts again. Confirmed links give components.

Within a bucket no pairs are made: round one confirms each member against its
best bucket centre, round two against its other centres. Members of one bucket
that are *still in different components* are then held against each other inside
a task, in blocks of bounded size, by a parity bitmap of their full sets: its XOR
population count never exceeds the symmetric difference, so it rules out no link,
and lets few other pairs through to the check on texts. Of many such pairs that
would join the same two components the closest go first. Pairs inside one
component need no check, as they can't change the result.

Null or blank texts have an empty set and are linked with nothing; nor is a row
with a null id, whatever its text: its component is null, and it is kept. Rows with a repeated id belong
to one component by definition: each of their texts is searched, and links of any
of them hold for all. An empty table gives no rows; columns besides id and text
aren't read. A very long text is one unit of work of some hundred bytes of memory
for each of its bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import (
    chunks,
    grams,
    lower_table,
    materialize,
    mix,
    prefix_hash,
    span_hash,
    text_buffer,
    words,
)
from foliant.llm.components import components
from foliant.llm.repeat_filter import seen

ROWS, BANDS, SKETCH_WORDS = 4, 24, 8
#: Bits of the parity bitmap of a full set.
PARITY_BITS = 2048
#: Members of a bucket that a task compares at once.
BLOCK = 4096


@functools.lru_cache(2)
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, np.uint64)


def shingle_sets(buf, off, k):
    """For each text: sorted distinct shingle hashes (short texts: one shingle of all words)."""
    buf = lower_table()[buf]
    s, e, doc = words(buf, off)
    h = span_hash(prefix_hash(buf), s, e)
    g, gdoc = grams(h, doc, k)
    n = len(off) - 1
    cut, wcut = np.searchsorted(gdoc, np.arange(n + 1)), np.searchsorted(doc, np.arange(n + 1))
    out = []
    for i in range(n):
        if cut[i] < cut[i + 1]:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
        else:  # fewer than k words
            w = h[wcut[i] : wcut[i + 1]]
            out.append(mix(np.array([functools.reduce(lambda a, b: (a * 31 + int(b) + 1) % 2**64, w, len(w))], np.uint64)) if len(w) else w)
    return out


def _describe(sets: list[np.ndarray], rows: int, bands: int):
    """Class hash (two words), band keys, odd sketch and parity bitmap of each set that isn't empty."""
    k, n = rows * bands, len(sets)
    flat, cut = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    whole = np.stack([np.add.reduceat(mix(flat ^ np.uint64(c)), cut) for c in (0x51ED270B, 0xA0761D64)], 1)
    a, b = _family(k)
    low = np.stack([np.minimum.reduceat(flat * a[j] + b[j], cut) for j in range(k)], 1)
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::rows])
    keys = mix(keys + np.arange(bands, dtype=np.uint64))
    size = 64 * SKETCH_WORDS
    bit = (mix(low + np.arange(k, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(size)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * size + bit).ravel(), minlength=n * size).reshape(n, size) & 1
    at = np.repeat(np.arange(n) * PARITY_BITS, [len(x) for x in sets]) + (flat % np.uint64(PARITY_BITS)).astype(np.int64)
    parity = np.bincount(at, minlength=n * PARITY_BITS).reshape(n, PARITY_BITS) & 1
    return whole.view(np.int64), keys.view(np.int64), np.packbits(odd.astype(np.uint8), 1).view(np.int64), np.packbits(parity.astype(np.uint8), 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """id, hash of the text, n_shingles, class hash c0/c1, band keys, sketch words, parity; the rest null for an empty set."""

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for i, j in chunks(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                full = [x for x, s in enumerate(sets) if len(s)]
                c0, c1, keys, odd, parity = ([None] * len(sets) for _ in range(5))
                if full:
                    whole, kk, oo, pp = _describe([sets[x] for x in full], rows, bands)
                    for at, x in enumerate(full):
                        c0[x], c1[x], keys[x], odd[x], parity[x] = int(whole[at, 0]), int(whole[at, 1]), kk[at].tolist(), oo[at].tolist(), pp[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(c0, pa.int64()), pa.array(c1, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(parity, pa.binary())],
                    ["id", "th", "n_shingles", "c0", "c1", "keys", "odd", "parity"],
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(
        run, "id long, th long, n_shingles long, c0 long, c1 long, keys array<long>, odd array<long>, parity binary"
    )


def _word_sets(text: str, k: int) -> set:
    w = text.encode().translate(lower_table().tobytes()).split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k))))


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        last, left = None, set()
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if a != last:
                    last, left = a, _word_sets(x or "", shingle)
                right = _word_sets(y or "", shingle)
                common = len(left & right)
                if 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    # Pairs grow with the corpus: a sort-merge join at every size.
    both = pairs.select("a", "b").hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _similar(a: str, b: str, samples: int) -> F.Column:
    """Similarity as the odd sketches estimate it: XOR bits -> symmetric difference -> Jaccard."""
    bits = 64 * SKETCH_WORDS
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    gone = -bits / 2 * F.log(F.greatest(F.lit(1e-9), 1 - 2 * differ / bits))
    return 1 - gone / (2 * samples)


def _closest(ids, roots, size, bits, left, right, percent, cap):
    """Pairs of different roots that the bitmaps allow, the closest ``cap`` for two roots, and whether there are more."""
    share, got = (100 - percent) / (100 + percent), []
    for lo in range(0, len(left), 16):
        i = left[lo : lo + 16]
        gone = np.bitwise_count(bits[i][:, None, :] ^ bits[right][None]).sum(2, dtype=np.int64)
        most = share * (size[i][:, None] + size[right][None])
        ok = (gone <= most + 1e-9) & (roots[i][:, None] != roots[right][None])
        x, y = np.nonzero(ok)
        got.append(np.stack([i[x], right[y], (1e6 * gone[x, y] / np.maximum(most[x, y], 1)).astype(np.int64)]))
    x, y, far = np.concatenate(got, 1) if got else np.zeros((3, 0), np.int64)
    once = ids[x] < ids[y]
    swap = ~once & (len(left) != len(right) or (left != right).any())
    x, y = np.where(swap, y, x)[once | swap], np.where(swap, x, y)[once | swap]
    far = far[once | swap]
    lo, hi = np.minimum(roots[x], roots[y]), np.maximum(roots[x], roots[y])
    order = np.lexsort((ids[y], ids[x], far, hi, lo))
    x, y, lo, hi = x[order], y[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])) if len(x) else np.zeros(0, np.int64)
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
    return ids[x[rank < cap]], ids[y[rank < cap]], bool((rank >= cap).any())


def compare_open(placed: DataFrame, percent: int, cap: int) -> DataFrame:
    """(band, key, id, root, n_shingles, parity) of buckets with several roots -> pairs (a, b) to confirm, more."""
    size = placed.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = placed.join(materialize(size, "bucket-sizes"), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A member of block k meets all blocks: as the left side of (k, y) for y >= k, as the right side of (x, k) for x < k.
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "root", "n_shingles", "parity")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y")

    def settle(t: pa.Table) -> pa.RecordBatch:
        col = lambda k: t.column(k).to_numpy()
        cell = np.stack([col(k).astype(np.int64) for k in ("band", "key", "x", "y")])
        cut = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(0), [True]]))
        ids, roots, size, own = col("id"), col("root"), col("n_shingles"), col("own")
        bits = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(len(ids), -1)
        out = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            at = np.arange(lo, hi)
            left, right = (at, at) if cell[2, lo] == cell[3, lo] else (at[own[at] == cell[2, lo]], at[own[at] == cell[3, lo]])
            out.append(_closest(ids, roots, size, bits, left, right, percent, cap))
        a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        more = np.concatenate([np.full(len(o[0]), o[2]) for o in out])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "more"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            same = np.ones(t.num_rows, bool)
            for k in ("band", "key", "x", "y"):
                c = t.column(k).to_numpy()
                same &= c == c[-1]
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # the last cell may go on
            rest = t.slice(cut)
            if cut:
                yield settle(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return cells.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
    slack: float = 0.2,
) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept.

    ``slack`` is what a sketch may lie below the threshold before a candidate is
    ruled out: about five standard deviations of the estimate.
    """
    sigs = materialize(signatures(docs, id_col, text_col, shingle, rows, bands), "signatures")
    full = sigs.filter("c0 IS NOT NULL AND id IS NOT NULL")
    # A class of equal sets is a node: its least id, or its hash where several texts of that id begin a class.
    classes = full.groupBy("c0", "c1").agg(F.min(F.struct("id", "th")).alias("rep")).select("c0", "c1", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"))
    classes = materialize(classes, "classes")
    shared = classes.groupBy("rep").count().filter("count > 1").select(F.col("rep").alias("of"))
    classes = classes.join(shared, F.col("rep") == F.col("of"), "left").withColumn("node", F.when(F.col("of").isNull(), F.col("rep")).otherwise(F.xxhash64("c0", "c1"))).drop("of")
    classes = materialize(classes, "nodes")
    reps = full.join(classes.hint("merge"), ["c0", "c1"]).filter("id = rep AND th = rep_th").dropDuplicates(["c0", "c1"])
    reps = materialize(reps.select(F.col("node").alias("id"), "n_shingles", "keys", "odd", "parity"), "reps")
    # Links that need no check: the classes of one id.
    several = full.groupBy("id").agg(F.min(F.struct("c0", "c1")).alias("lo"), F.max(F.struct("c0", "c1")).alias("hi")).filter("lo <> hi").select("id", "lo.c0", "lo.c1")
    first = several.join(classes.select("c0", "c1", F.col("node").alias("b")), ["c0", "c1"]).select("id", "b")
    same_id = materialize(full.join(first, "id").join(classes, ["c0", "c1"]).select(F.col("node").alias("a"), "b").filter("a <> b").distinct(), "links-of-an-id")

    # A centre is the member with the least id after a bandwise exclusive or: as good as random, and a plain minimum.
    flip = lambda c, band: c.bitwiseXOR(F.xxhash64(band).bitwiseAND(F.lit(2**62 - 1)))
    member = reps.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = member.groupBy("band", "key").agg(F.min(flip(F.col("id"), F.col("band"))).alias("low"), F.count("*").alias("n"))
    buckets = materialize(buckets.filter("n > 1").select("band", "key", flip(F.col("low"), F.col("band")).alias("centre")), "buckets")
    # Rows of shared buckets only, with their centre; all later steps start from this table.
    placed = materialize(member.join(buckets.hint("merge"), ["band", "key"]), "shared-buckets")
    floor = percent / 100 - slack

    def likely(pairs: DataFrame) -> DataFrame:
        odd = reps.select("id", "odd")
        pairs = pairs.join(odd.select(F.col("id").alias("a"), F.col("odd").alias("oa")), "a").join(odd.select(F.col("id").alias("b"), F.col("odd").alias("ob")), "b")
        return pairs.withColumn("sim", _similar("oa", "ob", rows * bands)).filter(F.col("sim") >= floor).drop("oa", "ob")

    stars = placed.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialize(likely(stars), "stars")

    # Only members of shared buckets are ever confirmed: their texts are taken from the table once.
    members = placed.select(F.col("id").alias("node")).distinct()
    members = materialize(classes.join(members, "node").select("node", F.col("rep").alias("of"), F.col("rep_th").alias("of_text")), "members")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = texts.filter(seen(members.select(F.xxhash64("of", "of_text")))(F.xxhash64("id", "th")))
    texts = texts.join(members.hint("merge"), (F.col("id") == F.col("of")) & (F.col("th") == F.col("of_text"))).dropDuplicates(["id", "th"])
    texts = materialize(texts.select(F.col("node").alias("id"), "text"), "candidate-texts")

    best = stars.groupBy("b").agg(F.max(F.struct("sim", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    comp = components(confirm(best, texts, shingle, percent).union(same_id))

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components as yet."""
        ca, cb = comp.select(F.col("node").alias("a"), F.col("root").alias("ra")), comp.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    def joined(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Components after the pairs that hold up on full sets."""
        if pairs.isEmpty():
            return comp
        links = confirm(pairs, texts, shingle, percent)
        return components(links.union(comp.select("node", "root")))

    comp = joined(materialize(across(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), comp), "pairs-2"), comp)

    # Buckets whose members are still in more than one component.
    cap = 32
    while True:
        rooted = placed.join(comp, F.col("id") == F.col("node"), "left").select("band", "key", "id", F.coalesce("root", "id").alias("root"))
        open_ = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "key")
        rooted = rooted.join(open_, ["band", "key"], "left_semi").join(reps.select("id", "n_shingles", "parity"), "id")
        rest = materialize(compare_open(materialize(rooted, "open-buckets"), percent, cap), "pairs-3")
        comp = joined(rest, comp)
        if not rest.filter("more").take(1):
            break
        cap *= 64

    rooted = classes.join(comp, "node", "left").select("c0", "c1", "rep", "node", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "class-roots")
    # A root is the least id of its component but where a node is a hash: there the least id is looked up.
    hashed = rooted.filter("node <> rep").select("root").distinct()
    least = materialize(rooted.join(hashed, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("component")), "least-ids")
    rooted = rooted.join(least, "root", "left").select("c0", "c1", F.coalesce("component", "root").alias("component"))
    found = sigs.join(materialize(rooted, "class-components"), ["c0", "c1"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
