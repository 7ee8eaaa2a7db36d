"""Cutting by a dictionary against all ways to cut, scripts and sounds of whole tables, keys that never meet."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import variants
from foliant.functions.segment import MOST_WORDS, Segmenter, read_dictionary, vocabulary_words
from foliant.functions.variants import read_scripts, read_sounds, sounded, sounds, standard_scripts
from foliant.operators import search
from foliant.operators.gram_index import GramIndex
from foliant.plans import registry, text_catalog
from foliant.plans.search_plan import Planner, spaced_text
from foliant.sources import bibtex, corpus
from tests.conftest import SF

WORDS = {"史学": 9, "史学集刊": 2, "集刊": 4, "学集": 1, "中央": 7, "研究": 8, "研究院": 5, "中央研究院": 3, "考据": 6, "考据学": 2, "乾嘉": 2}


def plain_cut(run, freq):
    """The best of all cuts into dictionary words and single characters; of equal ones the longer words first."""
    total = math.log(sum(freq.values()))
    cuts = []
    for at in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        ends = [0, *[i + 1 for i, x in enumerate(at) if x], len(run)]
        words = [run[a:b] for a, b in zip(ends, ends[1:])]
        if all(w in freq or len(w) == 1 for w in words):
            cuts.append((round(sum(math.log(freq.get(w, 1)) - total for w in words), 9), [len(w) for w in words], words))
    return max(cuts)[2]


def test_cut_is_the_best_of_all():
    r = random.Random(1)
    letters = "史学集刊中央研究院考据"
    cut = Segmenter(WORDS.items())
    for n in range(1, 12):
        for _ in range(40):
            run = "".join(r.choice(letters) for _ in range(n)) if r.random() < 0.5 else "".join(r.choices(list(WORDS), k=3))[:n]
            assert cut.words(run) == plain_cut(run, WORDS)
            assert "".join(cut.words(run)) == run
    ties = Segmenter({"ab": 4, "a": 2, "b": 2, "c": 1, "bc": 2, "x" * 3: 1}.items())
    assert ties.words("") == [] and ties.words("zz") == ["z", "z"] and ties("x" * 7) == ["x" * 3, "x" * 3, "x"]


def test_search_cut_has_the_shorter_words():
    cut = Segmenter(WORDS.items())
    assert cut("中央研究院考据学") == ["中央", "研究", "研究院", "中央研究院", "考据", "考据学"]
    assert Planner(cut=cut).tokens("乾嘉考据学 Marc Bloch") == ["乾嘉", "考据", "考据学", " Marc Bloch"]
    assert spaced_text("《史学集刊》abc", cut) == "《 史学 学集 集刊 史学集刊 》abc"


def test_index_and_query_are_cut_alike(spark, tmp_path):
    """Words of a query meet the words of the index, not stretches across them."""
    texts = ["乾嘉考据学之史学集刊", "考据考据学", "中央研究院", "史学", "中央 研究", None]
    lines = spark.createDataFrame([(i, i, 1, 1, 1, t, "text") for i, t in enumerate(texts) if t], "id long, doc_id long, page_num int, block_num int, line_num int, text string, block_label string")
    planner = Planner(scripts=standard_scripts(spark), cut=Segmenter(WORDS.items()))
    blocks = corpus.blocks_of(lines, planner)
    assert {r.doc_id: r.index_text for r in blocks.collect()} == {i: spaced_text(t, planner.cut) for i, t in enumerate(texts) if t}
    index = GramIndex.built(blocks, str(tmp_path))
    docs = spark.createDataFrame([(i,) for i in range(6)], "id long")
    for words, want in (("考据学", {0, 1}), ("考據學", {0, 1}), ("研究院", {2}), ("中央研究院", {2}), ("史學集刊", {0}), ("史学", {0, 3}), ("研究", {2, 4})):
        for table in (blocks, index):
            assert {r.doc_id for r in search.search(table, docs, lines, words, planner).collect()} == want


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# words\n史学 5 n\n史学 7\n集刊\n\n  考据\t3\n")
    assert sorted(map(tuple, read_dictionary(spark, str(tmp_path / "d.txt")).collect())) == [("史学", 7), ("考据", 3), ("集刊", 1)]
    v = spark.createDataFrame([("史学", 2), (" 史学", 4), ("", 1), (None, 1)], "term string, weight long")
    assert [tuple(r) for r in vocabulary_words(v).collect()] == [("史学", 4)]
    assert [tuple(r) for r in vocabulary_words(v.drop("weight")).collect()] == [("史学", 1)]
    with pytest.raises(ValueError, match="too large"):
        Segmenter.of(spark.range(MOST_WORDS + 1).select(F.lit("x").alias("word"), F.lit(1).alias("freq")))
    assert Segmenter.of(spark.createDataFrame([], "word string, freq long")).words("史学") == ["史", "学"]


def test_segmented_documents_equal_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    freq = {r.word: r.freq for r in text_catalog.dictionary(spark, SF).collect()}
    said = str.maketrans(text_catalog.LETTERS, text_catalog.SAID)
    total = math.log(sum(freq.values()))

    def cut(run):
        best = [(0.0, [])]  # of the last k characters
        for k in range(1, len(run) + 1):
            at = len(run) - k
            ways = [(math.log(freq.get(run[at : at + n], 1)) - total + best[k - n][0], n) for n in range(1, min(k, 30) + 1) if n == 1 or run[at : at + n] in freq]
            score, n = max(ways)
            best.append((score, n))
        out, at = [], 0
        while at < len(run):
            n = best[len(run) - at][1]
            w = run[at : at + n]
            out += [w[i : i + s] for s in (2, 3) if n > s for i in range(n - s + 1) if w[i : i + s] in freq] + [w]
            at += n
        return out

    got = {r.doc_id: (r.parts, r.digest) for r in registry.QUERIES["segmented_documents"](spark, SF).collect()}
    for r in [r for r in rows if len(r.text or "") < 3000][:60]:
        text = re.sub(" +", "", r.text or "").lower().translate(said)
        parts = [w for i, p in enumerate(re.split("([㐀-鿿豈-﫿]+)", text)) if p.strip() for w in (cut(p) if i % 2 else [p])]
        t = " ".join(parts)
        assert got[r.doc_id] == (len(t.split(" ")), hashlib.sha256(t.encode()).hexdigest())


def test_whole_script_table(spark, tmp_path):
    s = standard_scripts(spark)
    assert len(s.pairs) > 2500 and {"发", "髮", "發"} <= set(s.of("发")) and "后" in s.of("後") and s.of("a") == ["a"]
    old, new = s.fold()
    fold = lambda t: t.translate(str.maketrans(old, new))
    assert fold("鴉片戰爭史") == "鸦片战争史" and fold("髮發臺灣") == "发发台湾" and len(old) == len(set(old))
    assert not set(new) & set(old)  # folding twice changes nothing
    for c in old:
        assert c in {x for y in s.of(fold(c)) for x in s.of(y)}
    docs = spark.createDataFrame([(1, "鴉片戰爭史", "a.pdf"), (2, "鸦片战争史料", "b.pdf"), (3, "臺灣", "鴉片戰爭史.pdf")], "id long, title string, filename string")
    got = bibtex.match_entries(docs, spark.createDataFrame([(7, "鸦片战争史")], "entry_id long, title string")).collect()
    assert {r.doc_id: r.kind for r in got} == {1: "exact-title", 2: "substring-title", 3: "exact-filename"}
    (tmp_path / "s.txt").write_text("# old\tnew\n發\t发\n髮\t发\n乾\t干 乾\nab\tc\n", encoding="utf-8")
    assert read_scripts(spark, str(tmp_path / "s.txt")).pairs == ("發发", "髮发", "乾干")
    assert Planner.standard(spark).plan("歷史論").phrases == (tuple(sorted(standard_scripts(spark).of("歷史論"))),)


def test_sounds(spark, tmp_path):
    table = sounds(spark)
    assert len(table) > 20_000 and (table["鴉"], table["女"], table["绿"], table["吕"]) == ("ya", "nv", "lv", "lv")
    assert [table[c] for c in text_catalog.SAID] == text_catalog.SOUNDS
    d = spark.createDataFrame([("鲁迅 and 其他", "1921", "阿Q正传", None), ("Bloch, M.", None, "歷史学家", "卷二"), (None, None, None, None)], "author string, year string, title string, volume string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in d.select(bibtex.cite_key_base(F.col("author"), F.col("year"), none, F.col("title"), F.col("volume"), none, table)).collect()]
    assert got == ["lu1921aqzheng", "blochlishixue-v2", "anonuntitled"]
    (tmp_path / "p.txt").write_text("# sounds\n山\tsan\n水\tsui\n", encoding="utf-8")
    own = read_sounds(spark, str(tmp_path / "p.txt"))
    assert own == {"山": "san", "水": "sui"}
    assert [r[0] for r in spark.createDataFrame([("山a水",), (None,)], "t string").select(sounded(F.col("t"), own)).collect()] == ["sanasui", None]
    assert variants.MOST_PAIRS >= len(table)


def test_keys_of_one_base_never_meet(spark):
    rows = [(i, "c", "wang2020", None if i % 3 else f"f{i}.pdf") for i in range(1500)] + [(5000, "c", "wang2020ab", None)]
    d = spark.createDataFrame(rows, "id long, collection string, base string, filename string")
    keys = [r.cite_key for r in bibtex.distinct_cite_keys(d).orderBy("id").collect()]
    assert len(set(keys)) == len(rows) and keys[:3] == ["wang2020", "wang2020b", "wang2020c"]
    assert bibtex.next_key("k", {"k"} | {"k" + c for c in "abcdefghijklmnopqrstuvwxyz"}, None) == "kaa"
    assert bibtex.next_key("k", {"k", "kb"}, None, own="kb") == "kb"
