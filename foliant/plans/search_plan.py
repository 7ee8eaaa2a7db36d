"""What a query asks for: groups of phrases and of short words. A driver-side value; Spark runs it."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.segment import Segmenter
from foliant.functions.variants import MOST_VARIANTS, ScriptVariants, confusion_forms, confusion_table, forms, standard_scripts

_SYNTAX = str.maketrans("", "", '"()*:^{}[]')
_CJK = re.compile("([㐀-鿿豈-﫿]+)")


def whole_runs(text: str) -> list[str]:
    """The tokenizer used where no dictionary is given: a CJK run is one word."""
    return [text]


class Pattern(str):
    """A phrase as a regular expression: a class of characters for each that has several forms."""

    #: The forms of each character.
    classes: tuple[str, ...] = ()

    @classmethod
    def of(cls, pattern: str, classes: list[str]) -> Pattern:
        p = cls(pattern)
        p.classes = tuple(classes)
        return p


#: Grams that may stand at a place of a pattern; a place with more of them isn't looked up.
MOST_AT_A_PLACE = 64


def pattern_grams(phrase: str) -> list[tuple[str, ...]]:
    """Three-character grams in lower case at each place of a phrase: one, or those that a pattern allows."""
    if not isinstance(phrase, Pattern):
        low = phrase.lower()
        return [(low[i : i + 3],) for i in range(len(low) - 2)]
    low = [sorted({f.lower() for f in c}) for c in phrase.classes]
    if any(len(f) > 1 for c in low for f in c):  # a character whose lower case is longer
        low = [c if all(len(f) == 1 for f in c) else [] for c in low]
    out = []
    for i in range(len(low) - 2):
        n = len(low[i]) * len(low[i + 1]) * len(low[i + 2])
        if 0 < n <= MOST_AT_A_PLACE:
            out.append(tuple("".join(x) for x in product(*low[i : i + 3])))
    return out


@dataclass(frozen=True)
class SearchPlan:
    #: AND over groups, OR inside; phrases of three characters or more.
    phrases: tuple[tuple[str, ...], ...] = ()
    #: The same for words of one or two characters.
    short: tuple[tuple[str, ...], ...] = ()
    #: Where an entity's names widen the query: OR over all of them, and nothing else.
    any_name: tuple[str, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.phrases or self.short or self.any_name)

    @property
    def scored(self) -> tuple[str, ...]:
        return self.any_name or tuple(p for g in self.phrases for p in g)


@dataclass(frozen=True)
class Planner:
    """Turns query strings into plans."""

    scripts: ScriptVariants = field(default_factory=ScriptVariants)
    confusions: dict[str, str] = field(default_factory=confusion_table)
    cut: Callable[[str], list[str]] = whole_runs

    @classmethod
    def standard(cls, spark: SparkSession, dictionary: DataFrame | None = None) -> Planner:
        """Full script tables, and words cut by a dictionary (word, freq) where one is given."""
        return cls(scripts=standard_scripts(spark), cut=Segmenter.of(dictionary) if dictionary is not None else whole_runs)

    def tokens(self, query: str) -> list[str]:
        """Words of CJK runs; other runs whole, with their inner and outer spaces."""
        out = []
        for i, run in enumerate(_CJK.split((query or "").translate(_SYNTAX))):
            if run.strip():
                out += [t for t in self.cut(run) if t.strip()] if i % 2 else [run]
        return out

    def plan(self, query: str, names: list[str] | None = None) -> SearchPlan:
        if names:
            wide = [v for n in [query, *names] if len(n.strip()) >= 3 for v in self.spellings(n.strip())]
            if wide:
                return SearchPlan(any_name=tuple(dict.fromkeys(wide)))
        groups = [(t, tuple(forms(t, self.scripts, self.confusions))) for t in self.tokens(query)]
        return SearchPlan(tuple(g for t, g in groups if len(t) >= 3), tuple(g for t, g in groups if len(t) < 3))

    def spellings(self, word: str) -> list[str]:
        """All script forms of a word; where they are very many, one pattern that stands for them."""
        return self.scripts.of(word) if self.scripts.count(word) <= MOST_VARIANTS else [Pattern.of(self.scripts.pattern(word), self.scripts.classes(word))]

    def highlight_terms(self, query: str) -> list[str]:
        """All forms of all words, longest first; unlike what is searched for, without a limit."""
        found: set[str] = set()
        for t in self.tokens(query):
            own = self.spellings(t)
            plain = [w for w in own if not isinstance(w, Pattern)] or [t]
            found |= {*own, *confusion_forms(plain, self.confusions)}
        return sorted(found, key=lambda x: (-len(x), x))

    def index_text(self, text: Column) -> Column:
        """Text as it is indexed: CJK runs cut into words, all parts joined by spaces. A shelf that is searched with a ``cut`` is indexed with it."""
        if self.cut is whole_runs:
            return text
        sc = SparkSession.active().sparkContext
        if type(self.cut) is Segmenter:
            words = sc.broadcast(self.cut.in_arrays)  # a dictionary is checked for its size where it is read

            @F.arrow_udf("string")
            def cut_at_once(texts: pa.Array) -> pa.Array:
                return pa.array(words.value.spaced(texts.to_pylist()), pa.string())

            return cut_at_once(text)
        shared = sc.broadcast(cloudpickle.dumps(self.cut))

        @F.arrow_udf("string")
        def spaced(texts: pa.Array) -> pa.Array:
            cut = _unpacked(shared.value)
            return pa.array([None if t is None else spaced_text(t, cut) for t in texts.to_pylist()], pa.string())

        return spaced(text)


@functools.lru_cache(2)
def _unpacked(packed: bytes) -> Callable[[str], list[str]]:
    return cloudpickle.loads(packed)


def spaced_text(text: str, cut: Callable[[str], list[str]]) -> str:
    parts = [(w for w in cut(p) if w.strip()) if i % 2 else [p] for i, p in enumerate(_CJK.split(text)) if p.strip()]
    return " ".join(w for p in parts for w in p)
