"""Words of a run without spaces, by a dictionary.

All dictionary words that stand in a run make a graph; the way through it with the
highest sum of log frequencies is the cut (of equal ways, the one with the longer
word first). For search, dictionary words of two and three characters inside a longer
word stand before it, so that a shorter query word finds the longer one too.

A dictionary is a table of words and frequencies: of a file, of a vocabulary, or
counted in a corpus. Its size is checked before it comes to the driver and goes to
all tasks.

Queries are cut run by run. Tasks cut many texts at once, with the dictionary in arrays: the
same cuts, for all runs together from their last characters to their first.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and characters of a dictionary at most.
MOST_WORDS, MOST_CHARS = 2_000_000, 16_000_000
#: Runs whose cut a task keeps.
KEPT = 50_000
#: Characters of texts that are cut together; a run, and what stands between two, is never parted.
CHARS_AT_ONCE = 1 << 17
#: First and last character of those that stand in runs, as in the planner's pattern.
CJK = 0x3400, 0xFAFF
_RUN = "{}-{}".format(*map(chr, CJK))
_CHANGE = re.compile(f"(?<=[{_RUN}])(?=[^{_RUN}])|(?<=[^{_RUN}])(?=[{_RUN}])")
#: Characters that are white space; there are none beyond.
BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, freq of a file: a word, its frequency (1 where there is none) and anything after, parted by white space; of equal words the highest frequency counts."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' AND value NOT LIKE '#%'").select(p[0].alias("word"), F.coalesce(F.get(p, 1).try_cast("long"), F.lit(1)).alias("freq"))
    return rows.groupBy("word").agg(F.max("freq").alias("freq"))


def vocabulary_words(vocabulary: DataFrame) -> DataFrame:
    """word, freq of a vocabulary table (term[, weight])."""
    freq = F.col("weight").cast("long") if "weight" in vocabulary.columns else F.lit(1)
    return vocabulary.select(F.trim("term").alias("word"), F.coalesce(freq, F.lit(1)).alias("freq")).filter("word <> ''").groupBy("word").agg(F.max("freq").alias("freq"))


class Segmenter:
    """Cuts runs; as a function it is the ``cut`` of a search planner."""

    def __init__(self, words: Iterable[tuple[str, int]]) -> None:
        freq = {w: max(1, int(n)) for w, n in words}
        total = math.log(sum(freq.values()) or 1)
        #: Logarithm of each word's share, and that of a character that is no word.
        self.weight, self.unknown = {w: math.log(n) - total for w, n in freq.items()}, -total
        self._kept: dict[str, list[str]] = {}

    @functools.cached_property
    def starts(self) -> set[str]:
        """Starts of words that go on."""
        return {w[:i] for w in self.weight for i in range(1, len(w))}

    @functools.cached_property
    def in_arrays(self) -> Words:
        """The dictionary as tasks have it."""
        return Words(self.weight, self.unknown)

    @classmethod
    def of(cls, table: DataFrame) -> Segmenter:
        """From a table of word, freq that is checked for its size."""
        kept = table.select("word", "freq").persist()  # a dictionary counted in a corpus is counted once
        try:
            size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
            if size.n > MOST_WORDS or size.chars > MOST_CHARS:
                raise ValueError(f"a dictionary of {size.n} words and {size.chars} characters is too large to send to all tasks")
            rows = kept.toArrow()
        finally:
            kept.unpersist()
        return cls(zip(rows["word"].to_pylist(), rows["freq"].to_pylist()))

    def words(self, run: str) -> list[str]:
        """The cut: words end to end are the run."""
        n, weight, starts, unknown = len(run), self.weight.get, self.starts, self.unknown
        score, to = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            piece = run[i]
            own = weight(piece)
            best, at = (unknown if own is None else own) + score[i + 1], i + 1
            end = i + 1
            while piece in starts and end < n:
                end += 1
                piece = run[i:end]
                own = weight(piece)
                if own is not None and own + score[end] >= best:  # of equal ways the longer word
                    best, at = own + score[end], end
            score[i], to[i] = best, at
        out, i = [], 0
        while i < n:
            out.append(run[i : to[i]])
            i = to[i]
        return out

    def __call__(self, run: str) -> list[str]:
        """The words, each after the dictionary words of two and three characters inside it."""
        if run not in self._kept:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[run] = [x for w in self.words(run) for x in (*self._inside(w, 2), *self._inside(w, 3), w)]
        return self._kept[run]

    def _inside(self, word: str, size: int) -> list[str]:
        return [p for i in range(len(word) - size + 1) if (p := word[i : i + size]) in self.weight] if len(word) > size else []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "in_arrays")} | {"_kept": {}}


class Words:
    """A dictionary in arrays: a tree of the starts of its words, with the steps from start to start in a hash table."""

    def __init__(self, weight: dict[str, float], unknown: float) -> None:
        own = [w for w in weight if w]
        code, size = _points("".join(own)), np.array([len(w) for w in own], np.int64)
        letters, symbol = np.unique(code, return_inverse=True)
        #: Number of each character that words have, from 1; 0 is any other.
        self.symbol = np.zeros(int(letters[-1]) + 2 if len(letters) else 1, np.int32)
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.width, self.unknown = len(letters) + 1, unknown
        first, at, nodes, keys = np.cumsum(size) - size, np.zeros(len(own), np.int64), 1, []
        last = np.zeros(len(own), np.int64)
        alive = np.arange(len(own))
        depth = 0
        while len(alive):  # the starts of one more character, numbered on
            found, at = np.unique(at * self.width + symbol[first[alive] + depth] + 1, return_inverse=True)
            at, nodes, depth = at + nodes, nodes + len(found), depth + 1
            keys.append(found)
            last[alive] = at
            on = size[alive] > depth
            alive, at = alive[on], at[on]
        #: Of each start: the weight, if it is a word; whether it goes on.
        self.weight, self.goes_on = np.full(nodes, -np.inf), np.zeros(nodes, bool)
        self.weight[last] = [weight[w] for w in own]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.goes_on[key // self.width] = True
        self._bits = max(4, int(2 * nodes - 1).bit_length())
        self.keys, self.node = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key[free]  # of several for one slot, one stays
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.node[slot] = np.arange(1, nodes)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _next(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The start that is longer by a character; 0 where no word goes on so."""
        key = node * self.width + symbol
        slot = self._slot(key)
        found = self.keys.take(slot)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found[left] = self.keys[slot[left]]
            left = left[(found[left] != key[left]) & (found[left] >= 0)]
        return np.where(found == key, self.node.take(slot), 0)

    def _matches(self, symbol: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For sizes from 1 on: which of the places begin a word of that size, and its weight."""
        out, node, row = [], np.zeros(len(at), np.int64), np.arange(len(at))
        while len(row):
            node = self._next(node, symbol.take(at + len(out)))
            weight = self.weight.take(node)  # -inf at no start
            word = np.flatnonzero(weight > -np.inf)
            out.append((row[word], weight[word]))
            on = np.flatnonzero(self.goes_on.take(node) & (node > 0))
            at, row, node = at.take(on), row.take(on), node.take(on)
        return out

    def spaced(self, texts: list[str | None]) -> list[str | None]:
        """Each text as a ``Segmenter`` cuts it, its parts joined by spaces."""
        own = [(i, p) for i, t in enumerate(texts) if t is not None for p in _stretches(t)]
        out, lo, size = [None if t is None else [] for t in texts], 0, 0
        for hi, (_, p) in enumerate(own, 1):
            size += len(p)
            if size >= CHARS_AT_ONCE or hi == len(own):
                for (i, _), x in zip(own[lo:hi], self._spaced([p for _, p in own[lo:hi]])):
                    if x:  # it isn't blank
                        out[i].append(x)
                lo, size = hi, 0
        return [None if x is None else " ".join(x) for x in out]

    def _spaced(self, texts: list[str]) -> list[str]:
        n = np.array([len(t) for t in texts], np.int64)
        code = _points("\n".join(texts) + " ")  # the last is the space that is put after parts
        end = np.cumsum(n + 1)  # of each text, and of what stands after it
        run = (code >= CJK[0]) & (code <= CJK[1])
        symbol = np.where(run, self.symbol[np.minimum(code, len(self.symbol) - 1)], 0)
        at = np.flatnonzero(run)
        begins = np.diff(run, prepend=False)  # parts: words of runs, and what stands between runs
        begins[0] = begins[end - 1] = begins[end[:-1]] = True
        size, two, three = self._cut(symbol, at)
        word = np.flatnonzero(size)
        begins[at[word]] = True
        # of each part that isn't blank: where it begins, its size, and the smaller words inside it
        start = np.flatnonzero(begins)
        long = np.diff(start, append=len(code))
        solid = np.concatenate([[0], np.cumsum(~BLANK[np.minimum(code, len(BLANK) - 1)])])
        full = solid[start + long] > solid[start]
        full[np.searchsorted(start, end - 1)] = False
        part = np.cumsum(begins) - 1
        pieces = []
        for k, places in ((2, two), (3, three)):
            p = part[places]
            inside = (long[p] > k) & (places + k <= start[p] + long[p])
            pieces.append((k, places[inside], p[inside]))
        counts = [np.bincount(p, minlength=len(start)) for _, _, p in pieces]
        each = full + counts[0] + counts[1]
        first = np.cumsum(each) - each
        begin, length = np.empty(each.sum(), np.int64), np.empty(each.sum(), np.int64)
        before = first
        for (k, places, p), count in zip(pieces, counts):
            to = before[p] + np.arange(len(p)) - (np.cumsum(count) - count)[p]
            begin[to], length[to] = places, k
            before = before + count
        begin[before[full]], length[before[full]] = start[full], long[full]
        # all parts one after another, a space after each
        put = np.concatenate([[0], np.cumsum(length + 1)])
        source = np.repeat(begin - put[:-1], length + 1) + np.arange(put[-1])
        source[put[1:] - 1] = len(code) - 1
        text = code.take(source).tobytes().decode("utf-32-le")
        ends = put[np.concatenate([[0], np.append(first, len(begin))[np.searchsorted(start, end)]])].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]

    def _cut(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place of a run the size of the word that begins there in the cut, or 0; the places where words of two and of three characters stand."""
        n = len(at)
        if not n:
            return at, at, at
        begin = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        end = np.append(begin[1:], n)
        rest = np.repeat(end, end - begin) - np.arange(n)  # characters to the end of the run
        step = np.concatenate([[0], np.cumsum(np.bincount(rest)[1:])]).tolist()
        order = np.argsort(rest.astype(np.uint16) if len(step) < 1 << 16 else rest, kind="stable")  # places by what is left after them
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = np.arange(n), n
        rest = rest[order]
        match = self._matches(symbol, at[order])
        # the ways on from each place, from short to long: weight, and the place they lead to
        count = np.ones(n, np.int64)
        for row, _ in match[1:]:
            count[row] += 1
        first = np.cumsum(count) - count
        weight, to, size = np.empty(count.sum()), np.empty(count.sum(), np.int64), np.empty(count.sum(), np.int32)
        weight[first] = self.unknown
        weight[first[match[0][0]]] = match[0][1]
        free = first.copy()
        for k, (row, w) in enumerate(match, 1):
            if k == 1:
                row = np.arange(n)
            e = free[row]
            if k > 1:
                weight[e] = w
            to[e] = np.where(rest.take(row) == k, n, rank.take(order.take(row) + k))
            size[e] = k
            free[row] += 1
        score = np.zeros(n + 1)
        bounds = np.append(first, len(to))[step].tolist()
        for a, b, e, f in zip(step, step[1:], bounds, bounds[1:]):
            score[a:b] = np.maximum.reduceat(weight[e:f] + score.take(to[e:f]), first[a:b] - e)
        best = weight + score.take(to) == np.repeat(score[:n], count)
        go = np.maximum.reduceat(np.where(best, size, 0), first)[rank[:n]]  # of equal ways the longer word
        out = np.zeros(n, np.int64)
        while len(begin):
            out[begin] = go[begin]
            begin = begin + go[begin]
            on = begin < end
            begin, end = begin[on], end[on]
        two, three = (np.sort(at[order[match[k][0]]]) if len(match) > k else at[:0] for k in (1, 2))
        return out, two, three


def _stretches(text: str) -> Iterator[str]:
    """A long text parted where a run begins or ends."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE and (m := _CHANGE.search(text, at + CHARS_AT_ONCE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")
