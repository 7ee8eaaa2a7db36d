"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton enumerates the pieces that end at each character;
dynamic programming carries the best score and the number of pieces of its path.
Ties follow the tokenizer: of equal scores the piece that starts first wins, an
unknown character costs the least score less ten and is tried last, and unknown
characters become one token a byte where the vocabulary has all byte pieces
(``<0x00>`` to ``<0xFF>``), else a run of them one token.

The text is ``▁`` and the text with spaces as ``▁``. No piece of such a vocabulary
reaches over a space into the next word, so each word's count is worked out once
in a task and kept in a bounded table; a vocabulary with pieces that do is taken
text by text.

Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import strings

SPACE = "▁"
#: Words whose counts a task keeps; the table is emptied when it is full.
KEPT = 300_000
_SPACES = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """Pieces of a string, by the string; as a dict, words that were counted before."""

    def __init__(self, pieces: Iterable[tuple[str, float]]) -> None:
        pieces = list(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.byte_pieces = all(f"<0x{b:02X}>" in names for b in range(256))
        #: Whether words can be counted one by one.
        self.by_word = SPACE in names and self.byte_pieces and not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in names)

    def count(self, text: str) -> int:
        n = len(text)
        score, pieces, lone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):  # the longest first at each end
            ends[end].append(found)
        for at in range(1, n + 1):
            best, single = None, False
            for size, value in ends[at - 1]:
                new = score[at - size] + value
                single = single or size == 1
                if best is None or new > best:
                    best, start = new, at - size
            if not single:
                new = score[at - 1] + self.unknown
                if best is None or new > best:
                    score[at], lone[at] = new, True
                    extra = len(text[at - 1].encode("utf-8", "surrogatepass")) if self.byte_pieces else not lone[at - 1]
                    pieces[at] = pieces[at - 1] + extra
                    continue
            score[at], pieces[at] = best, pieces[start] + 1
        return pieces[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = n = self.count(word)
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.count(text)
        return sum(map(self.__getitem__, _SPACES.findall(text)))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            texts = strings(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter.tokens(t) for t in texts], pa.int64())],
                ["doc_id", "n_chars", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long"
    )
