"""Forms of a query word: script variants and confusable characters; full tables of scripts and sounds.

The tables come from the transliteration rules that Spark brings along (ICU), or from
a file; they have one row a character, some thousand in all. Forms of a query are
worked out on the driver, over the query.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Undirected pairs of characters that recognition takes for each other.
CONFUSIONS = ["己已", "己巳", "已巳", "戊戌", "戊戍", "戌戍", "土士", "未末", "日曰", "甲申", "甲由", "申由", "州洲", "干千", "崇祟"]
#: A starter table of traditional and simplified forms, for use without a session; ``standard_scripts`` is the full one.
SCRIPTS = "學学 據据 歷历 導导 論论 臺台 灣湾 國国 書书 簡简 筆笔 漢汉 語语 鄉乡 誌志 黃黄 糧粮 跡迹 戶户 萬万 與与 義义 體体 編编 譯译".split()

MOST_VARIANTS, MOST_FORMS = 32, 48
#: Rows of a table of characters at most.
MOST_PAIRS = 100_000


@dataclass(frozen=True)
class ScriptVariants:
    """Maps a character to its forms in the other script, both ways."""

    pairs: tuple[str, ...] = tuple(SCRIPTS)
    table: dict[str, str] = field(init=False, hash=False, compare=False)

    def __post_init__(self) -> None:
        table: dict[str, str] = {}
        for old, new in self.pairs:
            table[old] = table.get(old, old) + new
            table[new] = table.get(new, new) + old
        object.__setattr__(self, "table", table)

    def of(self, word: str) -> list[str]:
        return sorted({"".join(c) for c in product(*(self.table.get(ch, ch) for ch in word))})

    def count(self, word: str) -> int:
        return math.prod(len(set(self.table.get(ch, ch))) for ch in word)

    def classes(self, word: str) -> list[str]:
        """The forms of each character."""
        return [self.table.get(ch, ch) for ch in word]

    def pattern(self, word: str) -> str:
        """A regular expression for all forms."""
        return "".join(f"[{t}]" if len(t := self.table.get(ch, ch)) > 1 else re.escape(ch) for ch in word)

    def fold(self) -> tuple[str, str]:
        """The two sides of a translate() to the simplified form: of several, the one that comes first."""
        to: dict[str, str] = {}
        for old, new in self.pairs:
            to.setdefault(old, new)
        ends: dict[str, str] = {}
        for old in to:  # a chain of forms ends where the last one does, a ring at its least character
            way, at = [old], to[old]
            while at in to and at not in way:
                way.append(at)
                at = to[at]
            ends[old] = min(way[way.index(at) :]) if at in way else at
        ends = {old: new for old, new in ends.items() if old != new}
        return "".join(ends), "".join(ends.values())


#: Blocks of Chinese characters.
HAN = [(0x3400, 0x9FFF), (0xF900, 0xFAFF)]


def _by_rule(spark: SparkSession, rule: str) -> dict[str, str]:
    """What a transliteration rule makes of each Chinese character, where it makes something else of it."""
    chars = [chr(c) for a, b in HAN for c in range(a, b + 1)]
    found = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(chars)).split("\n")
    return {c: f for c, f in zip(chars, found, strict=True) if f != c}


@functools.lru_cache(4)
def _standard(application: str) -> ScriptVariants:
    spark = SparkSession.active()
    simple, old = _by_rule(spark, "Traditional-Simplified"), _by_rule(spark, "Simplified-Traditional")
    return ScriptVariants(tuple(c + f for c, f in simple.items() if len(f) == 1) + tuple(f + c for c, f in old.items() if len(f) == 1 and simple.get(f) != c and c not in simple))


def standard_scripts(spark: SparkSession) -> ScriptVariants:
    """All pairs of traditional and simplified characters, one to many."""
    return _standard(spark.sparkContext.applicationId)


def read_scripts(spark: SparkSession, path: str) -> ScriptVariants:
    """A table of a file: a traditional character, a tab, its simplified forms; comments are left out. Some thousand rows; more than a character has no place in it."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).select(F.trim(F.get("p", 0)).alias("a"), F.explode(F.split(F.regexp_replace(F.get("p", 1), r"\s", ""), "")).alias("b"))
    rows = rows.filter("length(a) = 1 AND length(b) = 1 AND a <> b").limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs")
    return ScriptVariants(tuple(dict.fromkeys(r.a + r.b for r in rows)))


@functools.lru_cache(4)
def _sounds(application: str) -> dict[str, str]:
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c) or c == "\u0308")  # noqa: E731  the tones go
    return {c: unicodedata.normalize("NFC", bare(f)).replace("ü", "v").strip() for c, f in _by_rule(SparkSession.active(), "Han-Latin").items()}


def sounds(spark: SparkSession) -> dict[str, str]:
    """Chinese characters -> their sound in Latin letters without tones, v for ü."""
    return _sounds(spark.sparkContext.applicationId)


def read_sounds(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of a file: a character, a tab, its sound."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).selectExpr("trim(get(p, 0)) AS a", "trim(get(p, 1)) AS b").filter("length(a) = 1 AND b <> ''").limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} characters")
    return {r.a: r.b for r in rows}


def sounded(c: Column, table: dict[str, str]) -> Column:
    """A text with each character of the table as its sound."""
    by_code = {ord(k): v for k, v in table.items()}

    @F.arrow_udf("string")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.translate(by_code) for t in texts.to_pylist()], pa.string())

    return read(c)


def confusion_table(pairs: list[str] = CONFUSIONS) -> dict[str, str]:
    out: dict[str, str] = {}
    for a, b in pairs:
        out[a] = out.get(a, "") + b
        out[b] = out.get(b, "") + a
    return out


def read_confusions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated pairs, both ways round; comments and pairs of anything but single characters are left out."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    one = raw.select(F.get("p", 0).alias("a"), F.get("p", 1).alias("b")).filter("length(a) = 1 AND length(b) = 1 AND a <> b")
    return one.union(one.select("b", "a")).distinct()


def confusion_forms(base: list[str], table: dict[str, str]) -> list[str]:
    """Forms with one character replaced, in order, without those in base."""
    out: dict[str, None] = {}
    for word in base:
        for i, ch in enumerate(word):
            for other in table.get(ch, ""):
                form = word[:i] + other + word[i + 1 :]
                if form not in base:
                    out.setdefault(form)
    return list(out)


def forms(word: str, scripts: ScriptVariants, confusions: dict[str, str]) -> list[str]:
    """All forms to look for: scripts (over 32: the word alone), then confusions up to 48 in all."""
    base = scripts.of(word)
    if len(base) > MOST_VARIANTS:
        base = [word]
    return base + confusion_forms(base, confusions)[: max(0, MOST_FORMS - len(base))]
