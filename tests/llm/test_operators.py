"""Operators for training data: brute force, exact round trips, and awkward tables for each of them."""

import collections
import hashlib
import math
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.llm import common
from foliant.llm.components import components
from foliant.llm.decontaminate import best_fit, clean, contaminated, normal
from foliant.llm.difference_cover import COVER, PERIOD, TRIPLE, remove_repeats_by_cover
from foliant.llm.langid import family_of, fit, identify
from foliant.llm.license_scan import BASE, EXCEPTIONS, NOTICES, OPEN, TAGS, base_name, evaluate, is_license, license_scan, parse, tokens
from foliant.llm.line_dedup import drop_repeated_lines, line_digest
from foliant.llm.minhash_dedup import near_duplicates
from foliant.llm.mixing import mix_sources
from foliant.llm.quality_rules import BINS, BUCKETS, quality_rules
from foliant.llm.queries import QUERIES, SQL, VOCABULARY
from foliant.llm.sharding import shard_rows, write_shards
from foliant.llm.suffix_dedup import remove_repeats, repeat_digest
from foliant.llm.token_counts import Counter, read_pieces, token_counts
from tests.conftest import SF, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, row string, shard string, key string, score double"
LONG = "word " * 60_000


def docs(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None, 7, 7, "x", "x", "x", 0.5) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, a repeated id."""
    return docs(spark, [(1, None, None, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, "x"), (None, "some words of a null id"), (None, None), (6, "Ünï ¡código! 字\n\n### a\x0bb"), (6, "another text of the same id")]).cache()


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# --- SQL ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = same_rows(QUERIES[name](spark, SF), duck.sql(SQL[name]))
    assert got == want


# --- 1 --------------------------------------------------------------------------


def plain_repeats(texts, width):
    count = collections.Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("method", [remove_repeats, remove_repeats_by_cover])
def test_repeats_equal_brute_force(spark, method):
    r = random.Random(3)
    base = "".join(r.choice("abcd é\n") for _ in range(900))
    texts = [base, base[:400] + "X" + base[401:], base[100:350] + base[100:350], "q" * 500, "", None, "short", base[:199], base[:200], "z" + base[300:700]]
    texts += [base[:199] + "é", "y" + base[500:700], "yy" + base[500:701] + "z", base[850:] + base[:150]]  # 199, 200 and 201 bytes, and a seam
    got = repeat_digest(method(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    want = plain_repeats([(t or "").encode() for t in texts], 200)
    assert [tuple(g)[1:] for g in got] == want


def test_repeats_hot_grams_go_the_wide_way(spark, monkeypatch):
    from foliant.llm import suffix_dedup

    r = random.Random(4)
    base = "".join(r.choice("abcdefg ") for _ in range(600))
    texts = [base[: 250 + 7 * i] + f"#{i}#" + base[250 + 7 * i :] for i in range(30)]
    want = plain_repeats([t.encode() for t in texts], 200)
    for hot in (4096, 2):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = repeat_digest(remove_repeats(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
        assert [tuple(g)[1:] for g in got] == want


def test_cover_has_each_difference_once():
    d = collections.Counter((a - b) % PERIOD for a in COVER for b in COVER if a != b)
    assert set(d.values()) == {1} and len(d) == PERIOD - 1 and TRIPLE >= PERIOD


@pytest.mark.parametrize("method", [remove_repeats, remove_repeats_by_cover])
def test_repeats_awkward(awkward, empty, method):
    got = method(awkward).collect()
    assert len(got) == 10 and method(empty).count() == 0
    assert [r.n_removed for r in got if r.id == 4] == [len(LONG)] * 2


# --- 2 --------------------------------------------------------------------------


def test_token_counts_equal_tokenizer(spark, corpus):
    from tokenizers import Tokenizer, models

    pieces = read_pieces(VOCABULARY)
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    rows = [r.text or "" for r in corpus.orderBy("doc_id").collect()] + ["", " ", "a  b", "日本語 ☃☃\n\nx", "<s> <0x0A>", "\t\ttab"]
    got = token_counts(docs(spark, list(enumerate(rows))), pieces).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0 for x in rows]


def test_token_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -2.0), ("c", -1.0), ("abc", -3.0), ("▁", -1.0), ("c▁a", -2.0)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    c = Counter(pieces)
    assert not c.by_word
    for text in ("abc", "abcabc", "a zz b", "zz", "c a c a", "xaxbx"):
        assert c.tokens(text) == len(t.encode("▁" + text.replace(" ", "▁")).ids), text


def test_token_counts_awkward(awkward, empty):
    from tokenizers import Tokenizer, models

    pieces = read_pieces(VOCABULARY)
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    count = lambda x: len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0
    want = [(r.doc_id, len(r.text or ""), count(r.text)) for r in awkward.collect()]
    assert sorted(map(tuple, token_counts(awkward, pieces).collect()), key=str) == sorted(want, key=str)
    assert token_counts(empty, pieces).count() == 0


# --- 3 --------------------------------------------------------------------------


def test_languages_held_out(corpus):
    r = identify(corpus, fit(corpus)).join(corpus.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    n, good = r.count(), r.filter("lang = lang_pred").count()
    assert n > 20 and good / n > 0.95
    assert r.filter("score < 0 OR score > 1").count() == 0


def test_language_never_reads_label_or_source(spark, corpus):
    model = fit(corpus)
    other = corpus.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    assert sorted(identify(corpus, model).collect()) == sorted(identify(other, model).collect())


def test_languages_need_a_letter(spark, corpus):
    rows = [(1, "½ ² ①"), (2, "Ⅷ 12"), (3, "_ 3"), (4, "é"), (5, "字")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(spark, rows), fit(corpus)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and got[4][0] != "und" and got[5][0] != "und"


def test_languages_sample_is_bounded(spark, corpus, monkeypatch):
    """Null ids, copies and many labels: never more rows than asked for, and none of few labels left out."""
    from foliant.llm import langid

    nulls = docs(spark, [(None, f"text number {i} of no id", "en") for i in range(3000)] + [(None, "the same", "de")] * 3000 + [(7, f"other {i}", "fr") for i in range(50)])
    known = nulls.select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    got = langid._picked(known, 90).collect()
    assert collections.Counter(r.lang for r in got) == {"en": 30, "de": 1, "fr": 30}
    assert sorted(langid._picked(known, 90).collect()) == sorted(got)
    assert len(langid._picked(known, 2).collect()) == 2
    many = corpus.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("l"), F.col("doc_id"))).otherwise(F.col("lang")))
    model = fit(many)
    labels = {r.lang for r in many.filter("lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1").select("lang").collect()}
    assert set(model.langs) == labels and len(labels) > langid.WIDTH
    assert len(model.pairs) < langid.WIDTH * len(labels)
    assert {r.lang_pred for r in identify(many, model).collect()} <= labels | {"und"}


def plain_language(model, text):
    """Features, votes and score, one text at a time."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not model.langs:
        return "und", 0.0
    b = re.sub(b" +", b" ", bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in text.encode()))
    grams = []
    for i in range(len(b) - 2):
        two = b[i] * 257 + b[i + 1]
        grams += [(x * 2654435761 % 2**32) >> 20 for x in (two, (two * 263 + b[i + 2] + 99991) % 2**32)]
    margin = [sum(float(model.weights[g, p]) for g in grams) / len(grams) + float(model.bias[p]) if grams else 0.0 for p in range(len(model.pairs))]
    node, score = "root", 1.0
    while node in model.children:
        votes = {k: [0, 0.0, 0.0] for k in model.children[node]}
        for (own, a, c), m in zip(model.pairs, margin):
            if own == node:
                for k, y in ((a, m), (c, -m)):
                    votes[k] = [votes[k][0] + (y > 0), votes[k][1] + y, votes[k][2] + 1 / (1 + math.exp(-4 * y))]
        names = list(votes)
        score *= votes[(best := max(names, key=lambda k: (votes[k][0], votes[k][1], -names.index(k))))][2] / (len(names) - 1) if len(names) > 1 else 1.0
        node = best if len(names) > 1 else names[0]
    return node.removeprefix("lang:"), score


def test_languages_equal_brute_force(spark, corpus):
    model = fit(corpus)
    rows = [(r.doc_id, r.text) for r in corpus.collect() if len(r.text or "") < 4000][:80] + [(1, "é"), (2, "ab"), (3, "Å b"), (4, None), (5, " . ")]
    got = identify(docs(spark, rows), model).collect()
    for (i, text), r in zip(rows, got):
        lang, score = plain_language(model, text)
        assert (r.doc_id, r.lang_pred) == (i, lang) and abs(r.score - score) < 1e-4


def test_languages_awkward(awkward, empty, corpus):
    got = identify(awkward, fit(corpus)).collect()
    assert len(got) == 10 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert identify(empty, fit(corpus)).count() == 0
    assert {r.lang_pred for r in identify(awkward, fit(empty)).collect()} == {"und"}
    assert family_of("es") == "romance" and family_of("xx") == "xx"


# --- 4 --------------------------------------------------------------------------


def plain_components(texts, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "block"), [(2, 4096), (5, 4096), (2, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block):
    from foliant.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    r = random.Random(k)
    bases = [[f"w{r.randrange(400)}" for _ in range(120)] for _ in range(4)]
    texts = []
    for i in range(120):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 3, 5, 6, 7, 9])):
            w[r.randrange(len(w))] = f"v{r.randrange(9999)}"
        texts.append((i, " ".join(w)))
    texts += [(900, "one"), (901, "ONE"), (902, None), (903, " "), (904, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts), shingle=k).collect()}
    assert got == plain_components(texts, k, 80)


def test_near_duplicates_of_every_text_of_an_id(spark):
    """Each text of a repeated id is searched, also where the id is the least of several classes."""
    r = random.Random(5)
    a, b = ([f"{k}{r.randrange(900)}" for _ in range(60)] for k in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(a)), (0, " ".join(b)), (7, "x y z"), (5, near(b)), (7, "quite other words")]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs(spark, rows), shingle=2).collect())
    assert got == sorted((i, 7 if i == 7 else 0) for i, _ in rows)


def test_near_duplicates_null_ids_have_no_component(spark):
    rows = [(1, "one two three four"), (None, "one two three four"), (None, "one two three four"), (2, "one two three four")]
    got = near_duplicates(docs(spark, rows), shingle=2).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]


def test_near_duplicates_awkward(awkward, empty):
    got = near_duplicates(awkward, shingle=2).collect()
    assert len(got) == 10 and all(r.kept for r in got)
    assert near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


# --- 5, 6 --------------------------------------------------------------------------


def test_mixing_meets_weights_and_budget(spark):
    rows = [(i, "x" * 400, "en" if i % 4 else "fr", f"src{i % 3}") for i in range(600)]
    w = {"domain": {"domain0": 2, "domain1": 1, "domain2": 1}, "lang": {"en": 1, "fr": 3}}
    got = mix_sources(docs(spark, rows), w, budget_percent=50, max_epochs=2).groupBy("domain", "lang").agg(F.sum("n_tokens").alias("n")).collect()
    n = {(r.domain, r.lang): r.n for r in got}
    # 600 * 100 tokens, half of it: 15000 to domain0; its French is worth 11250, but can give 50 * 100 * 2 only.
    assert n[("domain0", "fr")] == 10_000 and n[("domain0", "en")] == 5_000
    assert n[("domain1", "fr")] == 5_600 or n[("domain1", "fr")] == 5_625 // 100 * 100
    assert sum(n.values()) <= 30_000


def test_mixing_small_and_large_buckets_agree(spark, corpus):
    w = {"lang": {"en": 3}}
    one = mix_sources(corpus, w, bucket_rows=1).select("row.doc_id", "epoch").collect()
    two = mix_sources(corpus, w, bucket_rows=10**9).select("row.doc_id", "epoch").collect()
    assert sorted(one) == sorted(two)


def test_mixing_awkward(awkward, empty):
    assert mix_sources(awkward, {}, 100, 1).select("row.*").columns == awkward.columns
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(mix_sources(awkward, {}, 100, 1).select("row.*")) == rows(awkward)  # the whole budget, one epoch: each row once
    assert mix_sources(empty, {}).count() == 0


@pytest.mark.parametrize("limit", [3_000, 40_000, 10**9])
def test_shards_fit_and_cover(spark, tmp_path, corpus, limit):
    got = shard_rows(corpus, limit).select("row.doc_id", "n_bytes", "shard", "shard_bits", "shard_bytes").collect()
    assert len(got) == corpus.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert len(r.shard) == r.shard_bits
    for name, rows in by.items():
        size = sum(r.n_bytes for r in rows)
        assert size == rows[0].shard_bytes and (size <= limit or len({r.doc_id for r in rows}) == 1)
        assert not any(other != name and other.startswith(name) for other in by)
        if name:  # the parent bucket was too large
            assert sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > limit


def test_shards_write_and_awkward(spark, tmp_path, awkward, empty):
    s = shard_rows(awkward, 1000)
    assert s.count() == 10 and shard_rows(empty, 1000).count() == 0
    plain = awkward.drop("shard")
    write_shards(shard_rows(plain, 1000), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10


# --- 7 --------------------------------------------------------------------------


def plain_quality(t):
    t = t or ""
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_base_equals_brute_force(spark, corpus, awkward):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = corpus.select("doc_id", "text").limit(60).union(awkward.select("doc_id", "text").filter("doc_id IS NOT NULL AND doc_id <> 4"))
    both = both.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    want = {r.doc_id: plain_quality(r.text) for r in both.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(both, labels).collect()}
    assert got == want


def test_quality_verdict(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_rules(corpus, labels).join(labels, "doc_id").filter("NOT base_failed")
    good = r.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = r.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and (bad is None or bad < 0.3)


def plain_gram_buckets(text):
    """Buckets of one- and two-token grams, one text at a time, by the engine's hash of a token."""
    from foliant.llm import quality_rules as q

    raw = (text or "").encode()
    tokens = [m[0].lower() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", raw)]
    h = []
    for t in tokens:
        buf = common.np.frombuffer(t, common.np.uint8)
        h.append(common.span_hash(common.prefix_hash(buf), common.np.array([0]), common.np.array([len(t)]))[0])
    h = common.np.array(h, common.np.uint64)
    two, _ = common.grams(h, common.np.zeros(len(h), common.np.int64), 2)
    return [int(x) for x in h % common.np.uint64(q.BUCKETS)] + [int(x) for x in two % common.np.uint64(q.BUCKETS)]


def plain_verdicts(rows, labels):
    """(n_words, base_failed, kept) of each (id, text), from counts, logarithms and a threshold worked out in plain Python."""
    label = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            good, bad = label.get(i, (True, False))
            label[i] = (good and quality == 1, bad or toxic == 1)
    grams = [plain_gram_buckets(t) for _, t in rows]
    total, good = collections.Counter(), collections.Counter()
    for (i, _), g in zip(rows, grams):
        total.update(g)
        if label.get(i) == (True, False):
            good.update(g)
    n, m = sum(total.values()), sum(good.values())
    ratio = {b: math.log((good[b] + 1) / (m + BUCKETS)) - math.log((total[b] + 1) / (n + BUCKETS)) if m else 0.0 for b in total}
    score = [sum(ratio[b] for b in g) / max(1, len(g)) for g in grams]
    bins = {True: [], False: []}
    for (i, _), s in zip(rows, score):
        if i in label:
            bins[label[i][0]].append(math.floor((max(-16, min(16, s)) + 16) * BINS / 32))
    cut = -math.inf
    if bins[True] and bins[False]:
        apart = [sum(x <= b for x in bins[False]) / len(bins[False]) - sum(x <= b for x in bins[True]) / len(bins[True]) for b in range(BINS + 1)]
        cut = (next(b for b, x in enumerate(apart) if x >= max(apart) - 0.01) + 1) * 32 / BINS - 16
    out = []
    for (_, t), s in zip(rows, score):
        words, *_, repeats = plain_quality(t)
        failed = words < 10 or 100 * repeats > 20 * words
        out.append((words, failed, not failed and s >= cut))
    return out


def test_quality_verdict_equals_brute_force(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = [r.doc_id for r in labels.collect()][:60]
    some = corpus.filter(F.col("doc_id").isin(ids) | (F.col("doc_id") % 7 == 0)).cache()
    rows = sorted(some.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules(some, labels).collect())
    want = plain_verdicts([tuple(r) for r in rows], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, want))
    assert len({g[3] for g in got}) == 2


def test_quality_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(4, None, None), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        got = quality_rules(awkward, labels).collect()
        assert len(got) == 10 and all(r.base_failed and not r.kept for r in got if r.n_words < 10)
        assert quality_rules(empty, labels).count() == 0


# --- 8 --------------------------------------------------------------------------


def test_best_fit_is_the_edit_distance():
    r = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return min(row)

    for _ in range(200):
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert best_fit(a, b, 99)[0] == slow(a, b)


def test_contamination_recall(spark, corpus):
    """Planted passages, exact and edited: at least nine in ten found, and no other document."""
    r = random.Random(2)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    clean = [t for (t,) in corpus.select("text").collect() if not any(normal(i.text) in normal(t) for i in items)][:80]
    rows = list(enumerate(clean))
    want = set()
    for n, item in enumerate(items):
        text = list(item.text)
        for _ in range(len(text) * (n % 3) // 50):  # 0, 2 and 4 % of the characters
            text[r.randrange(len(text))] = r.choice("etaoin")
        at = r.randrange(len(clean[n % 80]) + 1)
        rows.append((1000 + n, clean[n % 80][:at] + " " + "".join(text).upper() + "\n" + clean[n % 80][at:]))
        want.add((1000 + n, item.item_id))
    got = {(x.doc_id, x.item_id) for x in contaminated(docs(spark, rows), spark.createDataFrame(items)).collect()}
    assert len(want & got) >= 0.9 * len(want)
    assert {d for d, _ in got - want} <= {d for d, _ in want}


def test_contamination_recall_at_every_length(spark):
    """Passages with all the edits that match (a tenth), by length of the item: the stated recall of 0.99, give or take the sample."""
    r = random.Random(7)
    text = lambda n: "".join(r.choice("eeeettaaooiinnsshhrrddlucmwfgypb") for _ in range(n))
    for lengths in ((16, 20, 29, 39, 50, 63), (64, 70, 81, 100, 113), (128, 130, 160, 233)):
        items, rows = [], []
        for n in range(40 * len(lengths)):
            item = text(lengths[n % len(lengths)])
            part = list(item)
            for _ in range(len(item) // 10):
                at, how = r.randrange(len(part)), r.randrange(3)
                part[at : at + (how < 2)] = [text(1)] if how else []
            items.append((n, item))
            rows.append((n, text(r.randrange(99)) + "".join(part) + text(r.randrange(99))))
        want = {n for (n, item), (_, doc) in zip(items, rows) if best_fit(item.encode(), doc.encode(), len(item) // 10)[0] <= len(item) // 10}
        assert len(want) == len(rows)
        found = contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).filter("doc_id = item_id").collect()
        for at in range(len(lengths)):
            assert sum(x.doc_id % len(lengths) == at for x in found) >= 38, lengths[at]
        assert all(x.distance == best_fit(items[x.item_id][1].encode(), rows[x.doc_id][1].encode(), 99)[0] for x in found)


def test_contamination_equals_brute_force(spark, corpus):
    """Every document against every item by the exact distance: nothing is found that isn't there, and (here) all that is."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = corpus.filter(F.col("doc_id").isin([r.doc_id for r in contaminated(corpus, bench).collect()]) | (F.col("doc_id") % 12 == 0)).cache()
    want = set()
    for r in some.select("doc_id", "text").collect():
        for i, t in items:
            item = normal(t)
            if item and best_fit(item, normal(r.text or ""), len(item) // 10)[0] <= len(item) // 10:
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(some, bench).collect()}
    assert got == want and want


def test_contamination_short_items_stand_exactly(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "H2O"), (3, "the  sun."), (4, "x"), (5, "Paris")], "item_id long, text string")
    rows = [(1, "It is PARIS!"), (2, "comparison of h2o2"), (3, "h2o is not the\nsun. at all"), (4, "x"), (5, None)]
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 1, 0, 6, 11), (1, 5, 0, 6, 11), (3, 2, 0, 0, 3), (3, 3, 0, 11, 19), (4, 4, 0, 0, 1)}


def test_contamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (None, "x" * 90), (4, "word " * 20), (4, "word " * 20)], "item_id long, text string")
    got = contaminated(awkward, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 4)}
    assert contaminated(empty, bench).count() == 0
    assert contaminated(awkward, bench.filter("item_id > 9")).count() == 0
    passage = "a passage of an item that nobody has given a number, which must go all the same"
    nameless = spark.createDataFrame([(None, passage), (None, "tiny item"), (3, "word " * 20)], "item_id long, text string")
    some = docs(spark, [(1, f"before it. {passage} and after"), (2, "a tiny item here"), (3, "clean")])
    assert {(r.doc_id, r.item_id) for r in contaminated(some, nameless).collect()} == {(1, None), (2, None)}
    assert [r.doc_id for r in clean(some, nameless).collect()] == [3]


# --- 9 --------------------------------------------------------------------------


def test_lines_keep_the_first_document(spark):
    rows = [(1, "A common line here\nown line number one\nshort"), (2, " a COMMON line here\t\nshort\nA common line here"), (3, "x\nown line number two"), (2, " a COMMON line here\t\nshort\nA common line here"), (9, None)]
    got = {(r.id, r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {(1, rows[0][1], 3, 0), (2, "short", 3, 2), (3, rows[2][1], 2, 0), (9, "", 1, 0)}


def test_lines_small_filter_changes_nothing(corpus):
    full = sorted(line_digest(corpus).collect())
    assert sorted(line_digest(corpus, max_filter_bytes=8192, bits_per_line=1).collect()) == full


def test_lines_awkward(awkward, empty):
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(r.doc_id, (r.text or "").count("\n") + 1, 0, digest(r.text)) for r in awkward.collect()]  # a line that one document alone has stays, also twice
    assert sorted(map(tuple, line_digest(awkward).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str) == sorted(want, key=str)
    assert line_digest(empty).count() == 0


# --- 10 -------------------------------------------------------------------------


def test_license_phrases(spark):
    t = "Text CC-BY and the General  Public\nLicense. all rights reserved! cc byx"
    r = license_scan(docs(spark, [(1, t)])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (13, 3, 1, 8, "cc-by,gpl,reserved")


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "mit apache-2.0 bsd-3-clause and or"),
        ("(mit or isc) and zlib", "mit isc or zlib and"),
        ("gpl-2.0-only with classpath-exception-2.0 or mit", "gpl-2.0-only classpath-exception-2.0 with mit or"),
        ("mit with proprietary", "mit"), ("mit or", "mit"), (") mit", ""), ("mit isc", "mit"), ("((mit)", ""), ("mit, isc", "mit"), ("see the file", ""), ("LicenseRef-own-1 or mit", "licenseref-own-1 mit or"),
    ],
)
def test_license_expressions(text, postfix):
    assert " ".join(parse(tokens(text.lower()))) == postfix


def test_license_values(spark):
    assert evaluate(parse(tokens("mit or licenseref-own")))[1] == 1.0 and evaluate(parse(tokens("mit and licenseref-own")))[1] == 0.5
    rows = [(1, "// SPDX-License-Identifier: MIT OR LicenseRef-Own\ncode"), (2, "none"), (3, "MIT License"), (4, "SPDX-License-Identifier: " + "x" * 900), (5, "Permission is hereby granted, free of charge, to"), (6, "GNU Lesser General Public License")]
    got = {r.doc_id: (r.labels, r.score, r.base_labels) for r in license_scan(docs(spark, rows)).collect()}
    assert got[1] == ("licenseref-own,mit", 1.0, "") and got[2] == got[4] == ("", 0.0, "") and got[3] == got[5] == ("mit", 0.5, "") and got[6] == ("gpl,lgpl", 0.5, "gpl")


def test_license_many_tags_on_one_line_are_read_once(spark):
    t = "spdx-license-identifier: mit or " * 20_000
    start = time.monotonic()
    assert license_scan(docs(spark, [(1, t), (2, "license-identifier: " + "(" * 300_000 + "mit" + ")" * 300_000)])).filter("labels = 'mit'").count() == 2
    assert time.monotonic() - start < 60


def plain_expression(toks):
    """Names and value of the longest start that is an expression, by recursive descent over every start."""

    def atom(i, n):
        if i < n and toks[i] == "(":
            got = level(i + 1, n, "or")
            return (got[0] + 1, *got[1:]) if got and got[0] < n and toks[got[0]] == ")" else None
        if i < n and is_license(toks[i]):
            return i + 1, {toks[i]}, 1.0 if base_name(toks[i]) in OPEN else 0.5
        return None

    def level(i, n, op):
        below = {"or": "and", "and": "with"}.get(op)
        left = atom(i, n) if below is None else level(i, n, below)
        while left and left[0] < n and toks[left[0]] == op:
            j = left[0] + 1
            if op == "with":
                right = (j + 1, {toks[j]}, left[2]) if j < n and base_name(toks[j]) in EXCEPTIONS else None
            else:
                right = level(j, n, below)
            if right is None:
                return None
            value = {"or": max, "and": min, "with": lambda x, _: x}[op](left[2], right[2])
            left = right[0], left[1] | right[1], value
        return left

    for n in range(len(toks), 0, -1):
        got = level(0, n, "or")
        if got and got[0] == n:
            return got[1:]
    return set(), 0.0


def plain_license(text):
    """Labels and score, phrase by phrase and tag by tag."""
    text = text or ""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    stands = lambda p: any(words[i : i + len(p)] == p for i in range(len(words)))
    labels = {v for k, v in (BASE | NOTICES).items() if stands(k.split())}
    score, values = 0.5 if labels else 0.0, []
    for tag in TAGS:
        at = lower.find(tag)
        while at >= 0:
            rest, found = lower[at + len(tag) :].split("\n")[0], []
            while m := re.match(r"[ \t]*([()]|[a-z0-9][a-z0-9.+\-]*)", rest):
                found.append(m[1])
                rest = rest[m.end() :]
            names, value = plain_expression(found)
            labels |= names
            values += [value] if names else []
            at = lower.find(tag, at + 1)
    return ",".join(sorted(labels)), max(values) if values else score


def test_license_labels_equal_brute_force(spark, corpus):
    r = random.Random(6)
    pieces = ["mit", "GPL-3.0-only", "apache-2.0", "LicenseRef-x", "sspl-1.0", "or", "AND", "with", "classpath-exception-2.0", "(", ")", "word", ",", "\t", "bsd-3-clause", "cc0-1.0"]
    made = ["SPDX-License-Identifier: " + " ".join(r.choice(pieces) for _ in range(r.randint(0, 9))) + r.choice(["", "\nlicense-identifier: mit or sspl", " licence-identifier: zlib and json\n and gpl", ". The MIT license"]) for _ in range(600)]
    made += [f"{a} {b}, {c}!" for a in ("CC-BY", "cc  by", "ccby") for b in ("Public Domain", "public\ndomains") for c in ("all rights reserved", "All-Rights/reserved")]
    rows = list(enumerate(made + [x.text for x in corpus.collect()] + [None, "", LONG]))
    got = {x.doc_id: (x.labels, x.score) for x in license_scan(docs(spark, rows)).collect()}
    assert {i: plain_license(t) for i, t in rows} == got and len({v for v, _ in got.values()}) > 40


def test_license_awkward(awkward, empty):
    assert license_scan(awkward).count() == 10 and license_scan(empty).count() == 0


# --- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, corpus, awkward):
    """Each stage's rows against a plain version over the rows that it got; awkward rows are among them."""
    import corpus_pipeline

    columns = corpus.columns
    odd = awkward.select(*[F.col(c).cast(corpus.schema[c].dataType) for c in columns])
    moved = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10**6).alias("doc_id")
    table = corpus.filter("doc_id % 8 = 0").unionAll(odd.select(moved, *columns[1:])).cache()
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda rows: sorted(map(repr, rows))
    kept = table
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, common.materialize(stage(spark, kept, SF), "test-stage")
        rows, got = [tuple(r) for r in before.select(*columns).collect()], [tuple(r) for r in kept.select(*columns).collect()]
        if name == "quality rules":
            verdicts = plain_verdicts([r[:2] for r in rows], labels)
            assert plain(got) == plain(r for r, v in zip(rows, verdicts) if v[2])
        if name == "near duplicates":
            roots = plain_components([r[:2] for r in rows if r[0] is not None], 5, 80)
            assert plain(got) == plain(r for r in rows if r[0] is None or roots[r[0]][1] == r[0])
        if name == "decontamination":
            found = lambda t: any(best_fit(i, normal(t or ""), len(i) // 10)[0] <= len(i) // 10 for _, i in items)
            assert plain(got) == plain(r for r in rows if not found(r[1]))
        if name == "source mixing":
            n = collections.Counter(map(repr, got))
            assert set(n) <= set(map(repr, rows)) and max(n.values()) <= 2 * max(collections.Counter(map(repr, rows)).values())
            size = lambda rs: sum((len((r[1] or "").encode()) + 3) // 4 for r in rs)
            assert 0 < size(got) <= size(rows) * 80 // 100
        if name == "sharding":
            assert plain(got) == plain(rows) and kept.filter("shard_prefix IS NULL").count() == 0
            by = collections.Counter()
            for r in kept.collect():
                h = bin(int(hashlib.md5(str(r.doc_id).encode() if r.doc_id is not None else b"").hexdigest()[:15], 16))[2:].zfill(60)
                assert h.startswith(r.shard_prefix) and len(r.shard_prefix) == r.shard_bits
                by[r.shard_prefix] += len((r.text or "").encode())
            assert max(by.values()) <= 16 << 20
        assert kept.columns[: len(columns)] == columns
    assert corpus_pipeline.STAGES[0][1](spark, table.limit(0), SF).count() == 0
