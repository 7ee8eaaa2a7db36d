"""Embedding near-duplicates, ranked lexical search and the source audit against brute force, and on awkward tables."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import lexical_search, source_divergence as divergence
from foliant.llm.lexical_search import ranked_search
from foliant.llm.source_divergence import share, source_divergence
from foliant.llm.vector_dedup import cosine, linked, similar_vectors, unit
from tests.conftest import SF
from tests.llm.test_operators import LONG, docs

VECTORS = "vec_id long, embedding array<double>, label string, id long, n long, tile int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]], r[2], 5, 5, 5, "x") for r in rows], VECTORS)


# --- 11 -------------------------------------------------------------------------


def plain_vectors(rows, threshold):
    """(id, links, component) of each row, by all pairs."""
    ok = [i for i, (k, v, label) in enumerate(rows) if k is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(ok, 2):
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= threshold:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = k if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(near[i]), least, k == least))
    return sorted(out, key=str)


def clustered(seed, n, dim, labels=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 12 + 1, dim))
    return [(int(i), (centres[r.integers(len(centres))] + r.normal(size=dim) * r.choice([0.05, 0.2, 0.4])).tolist(), str(r.integers(labels))) for i in r.permutation(n)]


@pytest.mark.parametrize(("dim", "tile", "threshold"), [(24, 4096, 0.93), (24, 16, 0.93), (7, 9, 0.8), (40, 11, 0.99)])
def test_vectors_equal_brute_force(spark, dim, tile, threshold):
    rows = clustered(dim, 160, dim)
    rows += [(1000 + i, v, label) for i, (_, v, label) in enumerate(rows[:20])]  # copies
    got = similar_vectors(vectors(spark, rows), threshold, tile=tile).collect()
    assert sorted(map(tuple, got), key=str) == plain_vectors(rows, threshold)


def test_linked_drops_no_pair_however_far_it_looks_ahead():
    r = np.random.default_rng(1)
    for dim in (1, 15, 16, 17, 70):
        left, right = unit(r.normal(size=(700, dim))), unit(r.normal(size=(50, dim)))
        left[100:120] = unit(right[:20] + r.normal(size=(20, dim)) * 0.05)
        for t in (0.1, 0.9, 0.9999):
            want = {(int(i), int(j)) for i, j in zip(*np.nonzero(left @ right.T >= t))}
            assert {(int(a), int(b)) for i, j, _ in linked(left, right, t) for a, b in zip(i, j)} == want


def test_vectors_at_the_threshold_are_decided_as_given(spark):
    rows = [(1, [1, 0], "a"), (2, [0.93, math.sqrt(1 - 0.93**2)], "a"), (3, [0.9299999, math.sqrt(1 - 0.9299999**2)], "b"), (4, [1, 0], "b"), (5, [1e200, 1e190], "c"), (6, [1e-200, 0], "c"), (7, [3, 4], "d"), (8, [6, 8], "d")]
    assert sorted(map(tuple, similar_vectors(vectors(spark, rows)).collect()), key=str) == plain_vectors(rows, 0.93)


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, "a"), (2, [], "a"), (3, [0, 0], "a"), (4, [1, None], "a"), (5, [1, nan], "a"), (6, [1, inf], "a"), (7, [1, 1], None), (None, [1, 1], "a"), (None, None, None)]
    good = [(9, [1, 1], "a"), (8, [2, 2], "a"), (9, [1, 1], "a"), (9, [1, -1], "a"), (9, [1, -1], "b"), (10, [1, -1.01], "b"), (11, [1, 1, 0], "a"), (12, [1], "a"), (13, [-0.0, 1], "a"), (14, [0.0, 1], "a")]
    got = similar_vectors(vectors(spark, bad + good)).collect()
    assert sorted(map(tuple, got), key=str) == plain_vectors(bad + good, 0.93)
    assert similar_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in similar_vectors(vectors(spark, bad)).filter("vec_id < 3").orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_large_group_of_near_copies_sends_few_rows(spark):
    r = np.random.default_rng(3)
    one = r.normal(size=16)
    rows = [(i, (one + r.normal(size=16) * 0.01).tolist(), "a") for i in range(400)]
    got = similar_vectors(vectors(spark, rows), tile=64).collect()
    assert {tuple(x)[1:] for x in got} == {(399, 0, True), (399, 0, False)} and sum(x.kept for x in got) == 1


# --- 12 -------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def folded(pattern, text):
    return pattern.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(rows, items, k, multiplicity=False):
    texts = [(d, collections.Counter(folded(TERM, t))) for d, t in rows]
    texts = [(d, c, c.total()) for d, c in texts if c]
    n_docs, places = len(texts), sum(n for _, _, n in texts)
    df = collections.Counter(t for _, c, _ in texts for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        wanted[i].update(folded(TERM, t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in texts:
            m = 50 + 50 * n * n_docs // places
            s = sum((terms[t] if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scored.append((-s, d is None, d or 0))
        best = sorted(x for x in scored if x[0] < 0)[:k]
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(best)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r.doc_id, r.text) for r in d.collect()]


@pytest.mark.parametrize(("terms", "size", "multiplicity"), [(1 << 20, 1 << 21, False), (300, 500, False), (1 << 20, 1, True)])
def test_search_equals_brute_force(spark, texts, monkeypatch, terms, size, multiplicity):
    monkeypatch.setattr(lexical_search, "POSTINGS", size)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:15]
    items += [(100, texts[3][1]), (100, "zebra " + texts[7][1][:300]), (101, None), (102, "nosuchwordanywhere"), (None, texts[5][1][:100])]
    rows = texts + [(None, texts[0][1]), (texts[0][0], texts[0][1]), (9999, None), (9998, " .,! ")]
    got = ranked_search(docs(spark, rows).drop("id"), spark.createDataFrame(items, "item_id long, text string"), 7, multiplicity=multiplicity, most_terms=terms).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, 7, multiplicity)


def test_search_ties_and_long_texts(spark):
    rows = [(i, "same words here") for i in range(30, 0, -1)] + [(50, LONG), (51, "Ünï ¡código! 字 same"), (52, "SAME")]
    items = [(1, "same"), (2, "WORD word"), (3, "字 字"), (4, "")]
    got = ranked_search(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, 5)


def test_search_empty_tables(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs(spark, []), some), (docs(spark, [(1, "a")]), none), (docs(spark, [(1, None), (2, " ")]), some), (docs(spark, [(1, "b")]), some)):
        assert ranked_search(d, i).columns == ["item_id", "rank", "doc_id", "score"] and ranked_search(d, i).collect() == []


# --- 13 -------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    count, df, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = collections.Counter(folded(WORD, text))
        for t, n in words.items():
            count[lang, source, t] += n
            df[lang, t] += 1
    out = []
    for lang in {k for k, _ in groups}:
        kept = sorted((t for k, t in df if k == lang and df[k, t] >= least), key=str.encode)
        own = sorted((s for k, s in groups if k == lang), key=str.encode)
        places = {s: sum(count[lang, s, t] for t in kept) for s in own}
        p = {s: [1 + 10**9 * (count[lang, s, t] + 1) // (places[s] + len(kept)) for t in kept] for s in own}
        whole = sum(places.values())
        q = [1 + 10**9 * (sum(count[lang, s, t] for s in own) + 1) // (whole + len(kept)) for t in kept]
        for s in own:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in own if o != s]
            terms = [(-((a - b) ** 2 // b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if count[lang, s, t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("tile", "held"), [(1 << 22, 1 << 19), (64, 50)])
def test_divergence_equals_brute_force(spark, monkeypatch, tile, held):
    monkeypatch.setattr(divergence, "HELD", held)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in d.collect()] + [(None, "en", "hollow"), (" ", None, None), ("Zebra zebra z", "xx", "a"), ("a b", "xx", "b"), ("一二 Éa", "en", "src1"), (LONG, "en", None)]
    table = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "block", "part")})
    got = source_divergence(table, tile=tile, top=20).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows, 3, 20)


def test_divergence_awkward(spark):
    rows = [(None, None, None)] * 3 + [("", "", ""), ("same word", "", "x"), ("same word", "", "x"), ("same Word", "", "y"), ("lone", "de", "only")]
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, source_divergence(table).collect())) == plain_divergence(rows, 3, 200)
    assert source_divergence(table.limit(0)).collect() == []


def test_share_is_exact_for_large_counts():
    r = random.Random(5)
    whole = [r.randrange(1, 9 * 10**15) for _ in range(200)] + [1, 2, 9 * 10**15]
    count = [r.randrange(0, w) for w in whole]
    got = share(np.array(count), np.array(whole))
    assert got.tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count, whole)]
