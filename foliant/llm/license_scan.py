"""Licence scan: Aho-Corasick for phrases and identifier tags, shunting-yard for expressions.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Two
automata run over a text: one of phrases over the words joined by single spaces
(with spaces at both ends, so that words match whole), one of identifier tags
over the raw text. What follows a tag is read as a licence expression: the
shunting-yard method turns ``or``, ``and``, ``with`` and brackets into a
canonical form and tells whether a reader may choose only open licences.

Only names of licences and exceptions count (``IDENTIFIERS``, ``EXCEPTIONS`` and
``LicenseRef-`` names): an expression ends at the first word that is neither, so
that prose after a tag gives no labels. A text is read in time linear in its length.

``score`` is how openly the text is licensed: the value of the best-valued tag
expression (1 where its ``or`` / ``and`` structure can be met with known open
licences, 0.5 where it names other ones; ``with`` keeps the value of its left side
for a known exception), else 0.5 for any phrase, else 0.

Null is the empty text: no words, empty labels, score 0. Each row is scanned by
itself: rows that repeat an id and null ids stay as they are, an empty table gives
no rows, and columns besides id and text aren't read. A very long text is scanned
in one task, in a few times its own size.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import strings

#: Fixed by the contract: phrases of words and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases that the method adds: names of licences, and the words with which their texts begin.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "permission to use copy modify and distribute this software": "isc",
    "mozilla public license": "mpl",
    "source code form is subject to the terms of the mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "proprietary and confidential": "proprietary",
}
#: Tags before an expression.
TAGS = ("spdx-license-identifier:", "licence-identifier:", "license-identifier:")
#: Identifiers of licences without version and suffix, open ones first.
OPEN = (
    "0bsd", "afl", "agpl", "apache", "apsl", "artistic", "blueoak", "bsd", "bsl", "cc-by", "cc-by-sa", "cc0", "cddl", "cecill", "cpl", "ecl", "efl",
    "epl", "eupl", "fsfap", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "ipl", "isc", "lgpl", "libpng", "lppl", "miros", "mit", "mit-0", "mpl", "ms-pl",
    "ms-rl", "mulanpsl", "ncsa", "odbl", "ofl", "openssl", "osl", "php", "postgresql", "psf", "python", "qpl", "ruby", "sleepycat", "tcl", "unicode-dfs",
    "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl",
)
IDENTIFIERS = frozenset(OPEN) | {"busl", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "elastic", "json", "none", "noassertion", "proprietary", "sspl"}
#: Identifiers of exceptions without version.
EXCEPTIONS = frozenset(
    {"autoconf-exception", "bison-exception", "bootloader-exception", "classpath-exception", "clisp-exception", "font-exception", "gcc-exception", "libtool-exception", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception", "openssl-exception", "qt-gpl-exception", "qt-lgpl-exception", "swift-exception", "u-boot-exception", "wxwindows-exception"}
)

_TOKEN = re.compile(r"[ \t]*(?:(\(|\)|[a-z0-9][a-z0-9.+\-]*)|[^\s()])")
_VERSION = re.compile(r"-?v?\d[\d.]*(?:-(?:clause|only|or-later))*\+?$|\+$")
_VARIANT = re.compile(r"-\d-clause(?:-[a-z]+)*$|-(?:only|or-later)$|-[a-z]+$")
_BINDS = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def base_name(token: str) -> str:
    """An identifier without version and variant, as far as that gives a known name."""
    for _ in range(3):
        if token in IDENTIFIERS or token in EXCEPTIONS:
            break
        token = _VERSION.sub("", token) if _VERSION.search(token) else _VARIANT.sub("", token)
    return token


def is_license(token: str) -> bool:
    return token.startswith("licenseref-") or base_name(token) in IDENTIFIERS


def tokens(text: str, start: int = 0, end: int | None = None):
    """Brackets and words from a place on, read as they are asked for; anything else ends them."""
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        if m[1] is None:
            return
        yield m[1]


def parse(found) -> list[str]:
    """Postfix form of the longest well-formed start of an expression (its tokens); [] if there is none.

    Reads one token more than it uses. What follows ``with`` must be an exception, all other names licences.
    """
    out, ops, want, depth = [], [], True, 0
    good: tuple[int, list[str]] | None = None  # length of the output, and operators that close it

    for token in found:
        if want:
            if token == "(" and (not ops or ops[-1] != "with"):
                ops.append(token)
                depth += 1
            elif base_name(token) in EXCEPTIONS if ops and ops[-1] == "with" else is_license(token):
                out.append(token)
                want = False
            else:
                break
        elif token == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif token in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[token]:
                out.append(ops.pop())
            ops.append(token)
            want = True
        else:
            break
        if not want and not depth:
            good = len(out), ops[::-1]
    return out[: good[0]] + good[1] if good else []


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Identifiers of an expression and its value: or takes the better side, and the worse, with the left."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _BINDS:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a | b, {"or": max(x, y), "and": min(x, y), "with": x}[token]))
        else:
            stack.append(({token}, 1.0 if base_name(token) in OPEN else 0.5))
    return stack[-1] if stack else (set(), 0.0)


def _automaton(words) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], tags) -> None:
        self.base = {f" {k} ": v for k, v in base.items()}
        self.labels = self.base | {f" {k} ": v for k, v in notices.items()}
        self.phrases, self.tags = _automaton(self.labels), _automaton(tags)

    def scan(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.translate(_WORDS).split()
        flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        places, base, labels, score = [], set(), set(), 0.0
        for end, phrase in self.phrases.iter(flat):
            labels.add(self.labels[phrase])
            score = 0.5
            if phrase in self.base:
                base.add(self.labels[phrase])
                places.append(end + 1 - len(phrase))
        if places:  # character places to word numbers
            places.sort()
            at, n, numbers = 0, 0, []
            for p in places:
                n += flat.count(" ", at, p)
                numbers.append(n)
                at = p
            places = numbers
        best, line_end = None, -1
        lower = raw.translate(_ASCII_LOWER).decode("utf-8", "surrogatepass")
        for end, _ in self.tags.iter(lower):
            if line_end <= end:
                at = lower.find("\n", end + 1)
                line_end = at if at >= 0 else len(lower)
            names, value = evaluate(parse(tokens(lower, end + 1, line_end)))
            labels |= names
            if names:
                best = value if best is None else max(best, value)
        return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score if best is None else best


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags=TAGS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        scanner = Scanner(base, notices, tags)
        for batch in batches:
            rows = [scanner.scan(t) for t in strings(batch.column(1))]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
