"""tasks cut many texts at once, as a segmenter cuts each run; a dictionary is counted once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import segment
from foliant.functions.segment import BLANK, CJK, Segmenter
from foliant.plans import text_catalog
from foliant.plans.search_plan import _CJK, Planner, spaced_text
from tests.conftest import SF
from tests.test_words import WORDS

LETTERS = "史学集刊中央研究院考据乾嘉龍"


def texts(seed, n):
    r = random.Random(seed)
    odd = ["", " ", "\n", "\t史", "史　学", "a", "A史B", "𠀀史学", "é", " ", "，", "", "가", "x y", "0"]
    return [None if r.random() < 0.03 else "".join(r.choice(list(WORDS) + list(LETTERS) + (odd if r.random() < 0.5 else [])) for _ in range(r.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("words", [WORDS, {"史": 1}, {}, {"a": 4, "史a": 2, "学": 3, "": 2}, {"史" * 4: 1, "史" * 2: 1, "史": 1}, {a + b: 1 for a in LETTERS for b in LETTERS}])
@pytest.mark.parametrize("at_once", [1, 40, 1 << 17])
def test_texts_cut_at_once_are_as_runs_cut_alone(words, at_once, monkeypatch):
    monkeypatch.setattr(segment, "CHARS_AT_ONCE", at_once)
    cut = Segmenter(words.items())
    own = [*texts(at_once, 400), *texts(1, 30)[:1], "史" * 1000, None, "学史" * 300 + "\n史", None]
    assert cut.in_arrays.spaced(own) == [None if t is None else spaced_text(t, cut) for t in own]
    assert cut.in_arrays.spaced([]) == [] and cut.in_arrays.spaced([None]) == [None] and cut.in_arrays.spaced([""]) == [""]


def test_a_long_text_is_parted_between_runs(monkeypatch):
    """What is in memory at once does not follow the text, but its longest run."""
    monkeypatch.setattr(segment, "CHARS_AT_ONCE", 1000)
    cut, sizes = Segmenter(WORDS.items()).in_arrays, []
    monkeypatch.setattr(cut, "_spaced", lambda t, f=cut._spaced: sizes.append(sum(map(len, t))) or f(t))
    text = "史学集刊，\n" * 5000 + " " * 3000 + "史学" * 1000
    assert cut.spaced([text]) == [spaced_text(text, Segmenter(WORDS.items()))] and sum(sizes) == len(text) and max(sizes) < 6000


def test_equal_ways_take_the_longer_word_first():
    """All frequencies are powers of two, so that many ways through a run have equal sums."""
    r = random.Random(3)
    for _ in range(60):
        words = {"".join(r.choice("史学集") for _ in range(r.randrange(1, 5))): 2 ** r.randrange(4) for _ in range(r.randrange(1, 40))}
        cut = Segmenter(words.items())
        own = ["".join(r.choice("史学集刊 ") for _ in range(r.randrange(60))) for _ in range(40)]
        assert cut.in_arrays.spaced(own) == [spaced_text(t, cut) for t in own]


def test_characters_are_those_of_the_planner():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in every if _CJK.match(chr(c))] == [c for c in every if CJK[0] <= c <= CJK[1]]
    assert [c for c in every if chr(c).isspace()] == [c for c in every if BLANK[min(c, len(BLANK) - 1)]]


def test_indexed_texts_do_not_take_a_step_a_character(spark):
    """The way that cuts run by run takes several times as long."""
    cut = Segmenter.of(text_catalog.dictionary(spark, SF))
    said = str.maketrans(text_catalog.LETTERS, text_catalog.SAID)
    own = [(r.text or "").replace(" ", "").lower().translate(said) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    cut.in_arrays, cut.starts  # noqa: B018  made before the clock starts
    began = time.process_time()
    fast = cut.in_arrays.spaced(own)
    middle = time.process_time()
    slow = [spaced_text(t, cut) for t in own]
    assert fast == slow and middle - began < (time.process_time() - middle) / 2
    t = spark.createDataFrame([(i, x) for i, x in enumerate([*own[:20], None])], "i int, t string")
    assert [r.t for r in t.select("i", Planner(cut=cut).index_text(F.col("t")).alias("t")).orderBy("i").collect()] == [*slow[:20], None]


def test_dictionary_is_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(w):
        seen.add(1)
        return w

    table = spark.createDataFrame([("史学", 2), ("集刊", 1)], "w string, freq long").select(read.asNondeterministic()("w").alias("word"), "freq")
    assert Segmenter.of(table)("史学集刊") == ["史学", "集刊"] and seen.value == 2
