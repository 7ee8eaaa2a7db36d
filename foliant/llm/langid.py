"""Hierarchical language identification.

The language family is predicted first, then one-versus-one linear support
vector machines separate the languages of that family. Families are separated
one-versus-one as well. Features are hashed two- and three-byte grams of the
letters of a text (A-Z lower-cased, all else but non-ASCII bytes one space) as
shares of all its grams, over the whole text.

The machines are fitted on a bounded sample: at most ``sample_rows`` different
(id, text) pairs of labelled documents, the same number for each label, those of least
hash. Their hashed counts (``DIMS`` numbers a row) are all that comes to the driver.
Of over ``WIDTH`` families, or languages of a family, neighbours (by the first
principal direction of their means) are first told apart as groups, so that the number of
machines grows as the number of languages, not as its square. Prediction is one
pass over the texts, with the weights broadcast.

Null texts and texts without a letter get ``und`` and score 0; so does every
text if no row can be learnt from. A letter is a character of Unicode's category
L: fractions, circled digits and Roman number signs are none. Null labels are
never learnt; of more labels than ``sample_rows`` those with the least hashes are. Ties
between votes go to the larger summed margin, then to the first label in order.

Each row is predicted from its own text: rows that repeat an id, null ids, and
columns besides id, text and (when learning) lang don't matter; an empty table
gives no rows. A very long text is one unit of work of some fifty bytes of memory
for each of its bytes.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import chunks, lower_table, materialize, strings, text_buffer

#: Hashed grams; children of a node of the tree.
DIMS, WIDTH = 1 << 12, 16
#: Language code -> family. A code that isn't listed is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it oc pt ro",
    "germanic": "af da de en fy is nl no sv",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "finno-ugric": "et fi hu",
    "turkic": "az kk tr uz",
    "cjk": "ja ko zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_MAP = lower_table().copy()
_MAP[[c for c in range(128) if not chr(c).isalpha()]] = 32


def family_of(code: str) -> str:
    return _FAMILY.get(code, code)


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of all texts and the n + 1 places where those of each text begin."""
    b = _MAP[buf]
    keep = np.ones(len(b), bool)
    if len(b) > 1:
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    cut = np.concatenate([[0], np.cumsum(keep)])[off]
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    two = b[:-2] * np.uint32(257) + b[1:-1]
    three = two * np.uint32(263) + b[2:] + np.uint32(99991)
    mixed = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)  # noqa: E731  the top 12 bits
    # Two grams for each place; the last two places of a text would reach into the next.
    ok = np.ones(len(b) - 2, bool)
    ends = cut[1:]
    for back in (1, 2):
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    places = np.flatnonzero(ok)
    grams = np.stack([mixed(two[places]), mixed(three[places])], 1).ravel()
    return grams, 2 * np.searchsorted(places, cut)


def _picked(docs: DataFrame, sample_rows: int) -> DataFrame:
    """text, lang of the sample: for each label the same number of different rows, ``sample_rows`` in all at most."""
    rows = docs.withColumn("h", F.xxhash64("id", "text"))
    counts = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows")), "labels")
    quota = max(1, sample_rows // max(1, counts.count()))
    # Some four times the quota by share, then the quota by rank: what is ranked doesn't grow with the corpus.
    unit = F.pmod(F.col("h"), F.lit(1 << 40)) / (1 << 40)
    drawn = rows.select("lang", "h").join(counts, "lang").filter(unit * F.col("rows") < 4 * quota + 40).select("lang", "h").distinct()
    least = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("nth") <= quota)
    least = materialize(least.orderBy("nth", "h").limit(sample_rows).select("lang", "h"), "sample")
    return rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))  # ``sample_rows`` at most


def _sample(docs: DataFrame, sample_rows: int) -> tuple[np.ndarray, list[str]]:
    """Shares of hashed grams and labels of the sample."""
    picked = _picked(docs, sample_rows)

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            rows = []
            for i, j in chunks(off):
                g, cut = _features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for x in range(j - i):
                    at, n = np.unique(g[cut[x] : cut[x + 1]], return_counts=True)
                    rows.append(at.astype(np.uint16).tobytes() + (n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["lang", "x"])

    got = picked.select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    got = sorted(got, key=lambda r: (r.lang, bytes(r.x)))
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        n = len(r.x) // 6
        x[i, np.frombuffer(r.x[: 2 * n], np.uint16)] = np.frombuffer(r.x[2 * n :], np.float32)
    return x, [r.lang for r in got]


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and L2 penalty, by accelerated gradient steps; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    w0, b0 = w, b
    step = 0.5 / max(1e-6, float((weight * ((x * x).sum(1) + 1)).sum()) + c)
    for t in range(rounds):
        k = t / (t + 3)
        vw, vb = w + k * (w - w0), b + k * (b - b0)
        g = weight * y * np.maximum(0, 1 - y * (x @ vw + vb))
        w0, b0 = w, b
        w, b = vw + 2 * step * (g @ x) - 2 * step * c * vw, float(vb + 2 * step * g.sum())
    return w, b


class Model:
    """A tree of choices: among families, in each among its languages; one machine for each pair of children of a node."""

    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        self.langs = sorted(set(labels))
        self.children: dict[str, list[str]] = {}
        self.pairs: list[tuple[str, str, str]] = []
        self._x, self._lab = x, np.array(labels)
        self._scale = 1 / np.sqrt(x.mean(0) + 1e-4) if len(x) else np.ones(DIMS, np.float32)
        self._machines: list[tuple[np.ndarray, float]] = []
        families = sorted({family_of(k) for k in self.langs})
        if families:
            self._grow("root", [(f"family:{f}", [k for k in self.langs if family_of(k) == f]) for f in families])
        for f in families:
            self._grow(f"family:{f}", [(f"lang:{k}", [k]) for k in self.langs if family_of(k) == f])
        self.weights = np.stack([m[0] for m in self._machines], 1).astype(np.float32) if self._machines else np.zeros((DIMS, 0), np.float32)
        self.bias = np.array([m[1] for m in self._machines], np.float32)
        del self._x, self._lab, self._scale, self._machines

    def _grow(self, node: str, groups: list[tuple[str, list[str]]]) -> None:
        """Children of a node (name, languages), by way of groups of neighbours where they are many, and their machines."""
        if len(groups) > WIDTH:
            means = np.stack([self._x[np.isin(self._lab, langs)].mean(0) * self._scale for _, langs in groups])
            first = np.linalg.svd(means - means.mean(0), full_matrices=False)[2][0]
            near = [groups[i] for i in np.lexsort((np.arange(len(groups)), means @ first))]
            cuts = np.linspace(0, len(near), WIDTH + 1).astype(int)
            parts = [(f"{node}/{i}", near[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            for name, part in parts:
                if len(part) > 1:
                    self._grow(name, sorted(part))
            groups = [(name if len(part) > 1 else part[0][0], [k for _, langs in part for k in langs]) for name, part in parts]
        self.children[node] = [name for name, _ in groups]
        for (a, one), (b, two) in itertools.combinations(groups, 2):
            left = np.isin(self._lab, one)
            rows = left | np.isin(self._lab, two)
            w, bias = fit_svm(self._x[rows] * self._scale.astype(np.float32), np.where(left[rows], 1, -1).astype(np.float32))
            self._machines.append((w * self._scale, bias))
            self.pairs.append((node, a, b))

    def margins(self, grams: np.ndarray, cut: np.ndarray) -> np.ndarray:
        n = np.diff(cut)
        out = np.zeros((len(n), len(self.pairs)), np.float32)
        full = n > 0
        if full.any():
            for p in range(len(self.pairs)):
                w = np.ascontiguousarray(self.weights[:, p])[grams]
                out[full, p] = np.add.reduceat(w, cut[:-1][full]) / n[full] + self.bias[p]
        return out

    def _choose(self, node: str, m: np.ndarray) -> tuple[str, float]:
        """The child with most votes, and the mean chance that its machines give it."""
        names = self.children[node]
        votes = {k: [0, 0.0, 0.0] for k in names}
        for at in self._own[node]:
            _, a, b = self.pairs[at]
            for name, y in ((a, m[at]), (b, -m[at])):
                votes[name][0] += y > 0
                votes[name][1] += y
                votes[name][2] += 1 / (1 + np.exp(-4 * float(y)))
        best = max(names, key=lambda k: (votes[k][0], votes[k][1], -names.index(k)))
        return best, votes[best][2] / max(1, len(names) - 1) if len(names) > 1 else 1.0

    @functools.cached_property
    def _own(self) -> dict[str, list[int]]:
        """Machines of each node."""
        out: dict[str, list[int]] = {node: [] for node in self.children}
        for at, (node, _, _) in enumerate(self.pairs):
            out[node].append(at)
        return out

    def predict(self, m: np.ndarray) -> tuple[str, float]:
        node, score = "root", 1.0
        while node in self.children:
            node, p = self._choose(node, m)
            score *= p
        return node.removeprefix("lang:"), float(score)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3000) -> Model:
    known = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return Model(*_sample(known, sample_rows))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            letters = [bool(model.langs) and _LETTER.search(t) is not None for t in strings(batch.column(2))]
            langs, scores = [], []
            for i, j in chunks(off):
                m = model.margins(*_features(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                for x in range(j - i):
                    lang, score = model.predict(m[x]) if letters[i + x] else ("und", 0.0)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
