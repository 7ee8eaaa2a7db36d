"""Bibliographies: a BibTeX source, keys, volumes, matching to documents, and export."""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import title_key
from foliant.functions.variants import sounded, standard_scripts
from foliant.sources.scratch import written

ENTRY = "type string, cite_key string, fields array<struct<k:string,v:string>>"
_HEAD = re.compile(r"@(\w+)\s*([{(])")
_FIELD = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*")


def _closing(text: str, at: int, opener: str) -> int:
    """Place of the bracket that closes the one before ``at``, or -1."""
    closer, depth = {"{": "}", "(": ")"}[opener], 1
    for i in range(at, len(text)):
        depth += (text[i] == opener) - (text[i] == closer)
        if not depth:
            return i
    return -1


def parse_entries(text: str) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """Entries of a file; @string, @comment and @preamble and entries that don't end are left out."""
    out, at = [], 0
    while m := _HEAD.search(text, at):
        end = _closing(text, m.end(), m[2])
        if end < 0:
            at = m.end()
            continue
        at = end + 1
        if m[1].lower() not in ("string", "comment", "preamble"):
            key, _, body = text[m.end() : end].partition(",")
            if "=" in key:
                key, body = "", text[m.end() : end]
            out.append(("@" + m[1].lower(), key.strip(), parse_fields(body)))
    return out


def parse_fields(body: str) -> list[tuple[str, str]]:
    """Fields in order, lower-case names; values in braces, in quotes or bare; empty ones are left out."""
    out, at = [], 0
    while m := _FIELD.match(body, at):
        i = m.end()
        if body[i : i + 1] == "{":
            end = _closing(body, i + 1, "{")
            value, at = (body[i + 1 : end], end + 1) if end >= 0 else (body[i + 1 :], len(body))
        elif body[i : i + 1] == '"':
            end = body.find('"', i + 1)
            value, at = (body[i + 1 : end], end + 1) if end >= 0 else (body[i + 1 :], len(body))
        else:
            end = body.find(",", i)
            value, at = (body[i:end], end) if end >= 0 else (body[i:], len(body))
        if value.strip():
            out.append((m[1].lower(), " ".join(value.split())))
    return out


def read_bibtex(files: DataFrame, text_col: str = "value") -> DataFrame:
    """A row for each entry of the files' texts."""

    def run(parts):
        for pdf in parts:
            rows = [(t, k, [{"k": a, "v": b} for a, b in f]) for text in pdf[text_col] for t, k, f in parse_entries(text or "")]
            yield pd.DataFrame(rows, columns=["type", "cite_key", "fields"])

    return files.select(text_col).mapInPandas(run, ENTRY)


def field(name: str, fields: str = "fields") -> Column:
    return F.try_element_at(F.filter(fields, lambda f: f["k"] == name), F.lit(1))["v"]


def bib_type(c: Column, sub_type: Column) -> Column:
    """Type with its @, aliases folded; a thesis by its type field."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = F.when((t != "") & ~t.startswith("@"), F.concat(F.lit("@"), t)).otherwise(t)
    master = F.coalesce(F.lower(sub_type).rlike("master|mathesis"), F.lit(False))
    return F.when(t == "@thesis", F.when(master, "@mastersthesis").otherwise("@phdthesis")).when(t == "@conference", "@inproceedings").when(t.isin("@electronic", "@www"), "@online").otherwise(t)


def doc_kind(type_: Column) -> Column:
    t = bib_type(type_, F.lit(None).cast("string"))
    paper = ["@article", "@inproceedings", "@phdthesis", "@mastersthesis", "@techreport", "@unpublished", "@manuscript"]
    book = ["@book", "@incollection", "@inbook", "@proceedings", "@manual", "@booklet"]
    return F.when(t.isin(paper), "paper").when(t.isin(book), "book").otherwise("other")


#: Numerals, their units, marks of a volume and its parts in a set of two or three.
_DIGITS, _UNITS, _MARKS, _PARTS = "零一二三四五六七八九", {"十": 10, "百": 100}, "卷冊册集辑輯篇函帙", "上中下"
_NUMERAL = f"[0-9{_DIGITS}{''.join(_UNITS)}]+"
#: Where a title tells its volume, in order.
_IN_TITLE = [
    re.compile(p)
    for p in (
        rf"({_NUMERAL})\s*[{_MARKS}]", rf"[{_MARKS}]\s*({_NUMERAL})", rf"[（(]\s*([{_PARTS}])\s*[)）]",
        rf"[{_MARKS}]\s*([{_PARTS}])|([{_PARTS}])\s*[{_MARKS}]", rf"[（(]\s*({_NUMERAL})\s*[)）]",
    )
]


def to_number(numeral: str | None) -> int | None:
    """Digits or Chinese numerals up to hundreds; None for zero or anything else."""
    if not numeral:
        return None
    if numeral.isdigit() and numeral.isascii():
        return int(numeral) or None
    total = pending = 0
    for c in numeral:
        if c in _UNITS:  # a unit alone counts once
            total, pending = total + max(pending, 1) * _UNITS[c], 0
        elif c in _DIGITS:
            pending = _DIGITS.index(c)
        else:
            return None
    return total + pending or None


def volume_of(volume: str | None, number: str | None, title: str | None) -> str:
    """v1 to v99: the fields first, then the patterns of the title in order; empty for none."""
    found = [m[0] for raw in (volume, number) if (m := re.search(_NUMERAL, raw or ""))]
    found += [next(g for g in m.groups() if g) for p in _IN_TITLE if (m := p.search(title or ""))]
    values = (_PARTS.find(f) + 1 or to_number(f) for f in found)
    return next((f"v{n}" for n in values if n and n <= 99), "")


@F.pandas_udf(T.IntegerType())
def chinese_number(c: pd.Series) -> pd.Series:
    return c.map(to_number, na_action="ignore").astype("Int32")


@F.pandas_udf(T.StringType())
def volume_token(volume: pd.Series, number: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([volume_of(*x) for x in zip(volume, number, title)], dtype=object)


def slug(c: Column, pinyin: dict[str, str] | None = None) -> Column:
    """Latin letters and digits of a text, lower case; Chinese characters by a table of sounds (``variants.sounds``) where one is given."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(sounded(c, pinyin) if pinyin else c), "[^a-z0-9]", "")


#: What parts authors.
_AUTHORS = r"\s+and\s+|[;，,]"


def surname(author: Column, pinyin: dict[str, str] | None = None) -> Column:
    first = F.trim(F.split(F.trim(F.coalesce(author, F.lit(""))), _AUTHORS)[0])
    cjk = first.rlike("[一-鿿]")
    last = F.regexp_replace(F.lower(F.element_at(F.split(first, r"\s+"), -1)), "[^a-z]", "")
    return F.coalesce(F.nullif(F.when(cjk, slug(F.substring(first, 1, 1), pinyin)).otherwise(last), F.lit("")), F.lit("anon"))


def title_slug(title: Column, pinyin: dict[str, str] | None = None) -> Column:
    t = F.coalesce(title, F.lit(""))
    word = slug(F.split(F.trim(t), r"[\s:,.;]")[0])
    return F.coalesce(F.nullif(F.when(t.rlike("[一-鿿]"), slug(F.substring(t, 1, 3), pinyin)).otherwise(word), F.lit("")), F.lit("untitled"))


def cite_key_stem(author: Column, year: Column, date: Column, title: Column, pinyin: dict[str, str] | None = None) -> Column:
    """Surname, year and title word: a key without its volume."""
    y = F.coalesce(F.nullif(F.trim(year), F.lit("")), F.regexp_extract(F.coalesce(date, F.lit("")), r"(\d{4})", 1))
    return F.concat(surname(author, pinyin), y, title_slug(title, pinyin))


def cite_key_base(author: Column, year: Column, date: Column, title: Column, volume: Column, number: Column, pinyin: dict[str, str] | None = None) -> Column:
    """Surname, year and title word, and the volume after a dash."""
    v = volume_token(volume, number, title)
    return F.concat(cite_key_stem(author, year, date, title, pinyin), F.when(v != "", F.concat(F.lit("-"), v)).otherwise(""))


def _family(key: Column) -> Column:
    """Keys that can meet by a letter or a file mark at the end are of one family: all but the last letters, or the first two of a key of letters only."""
    bare = F.regexp_replace(F.regexp_replace(key, "-[0-9a-f]{4}x?$", ""), "[a-z]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.substring(key, 1, 2))


def _endings() -> Iterator[str]:
    """aa, ab, ... zz, aaa, ..."""
    return ("".join(x) for n in itertools.count(2) for x in itertools.product(string.ascii_lowercase, repeat=n))


class KeysTaken:
    """Keys of a family: a new one is its base if that is free (or the row's own key), else with b to z, else with four digits of the file name's SHA-1, else with two letters or more."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self._further: dict[str, Iterator[str]] = {}

    def add(self, base: str, file_name: str | None, own: str | None = None) -> str:
        tries = [base] if base not in self._further else []
        tries += [base + c for c in string.ascii_lowercase[1:]] if base not in self._further else []
        if file_name:
            tries.append(f"{base}-{hashlib.sha1(file_name.encode()).hexdigest()[:4]}")
        new = next((t for t in tries if t == own or t not in self.taken), None)
        while new is None or (new != own and new in self.taken):  # goes on where the last row of this base stopped
            new = base + next(self._further.setdefault(base, _endings()))
        self.taken.add(new)
        return new


def next_key(base: str, taken: set[str], file_name: str | None, own: str | None = None) -> str:
    """The key that a row gets beside those taken."""
    keys = KeysTaken()
    keys.taken = set(taken)
    return keys.add(base, file_name, own)


def distinct_cite_keys(docs: DataFrame, key: str = "base", tie: str = "filename", existing: DataFrame | None = None) -> DataFrame:
    """Keys of a collection in id order, none of which an earlier row or ``existing`` (collection, cite_key) has.

    Only keys of one family can meet: a family is one sorted run of a task, of which
    the task holds the keys and not the rows.
    """
    come = docs.select(F.lit(1).alias("turn"), "collection", "id", F.col(key).alias("base"), F.col(tie).alias("tie"))
    if existing is not None:
        come = come.union(existing.select(F.lit(0), "collection", F.lit(None).cast(docs.schema["id"].dataType), "cite_key", F.lit(None).cast("string")))
    parts = come.withColumn("family", _family(F.col("base"))).repartition("collection", "family").sortWithinPartitions("collection", "family", "turn", "id")

    def run(batches):
        at, taken = None, KeysTaken()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.collection, r.family) != at:
                    at, taken = (r.collection, r.family), KeysTaken()
                if r.turn:
                    out.append((r.id, taken.add(r.base, r.tie)))
                else:
                    taken.taken.add(r.base)
            yield pd.DataFrame(out, columns=["_id", "cite_key"])

    keys = parts.mapInPandas(run, f"_id {docs.schema['id'].dataType.simpleString()}, cite_key string")
    return docs.drop("cite_key").join(keys, F.col("id") == F.col("_id")).drop("_id")


def _containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s) of two characters or more and (l) -> pairs where l holds s: each s meets only the long keys that have its rarest two characters."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    held = long.filter(F.length("l") >= 2).select("l", F.explode(pieces("l")).alias("g"))
    counts = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = short.select("s", F.explode(pieces("s")).alias("g")).join(counts, "g", "left").groupBy("s").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    return rarest.join(held, "g").filter(F.contains("l", F.col("s"))).select("s", "l")


def match_entries(docs: DataFrame, entries: DataFrame, simplify: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, status (matched, ambiguous, unmatched), hits, entry and kind of the only hit.

    Both titles are folded to simplified characters by the full table. Keys meet once
    each, however many documents and entries share them: equal ones join, and
    containment joins on the rarest two characters of the shorter one, with a check of
    the whole; so no pair of all documents and entries is made.
    """
    fold = standard_scripts(docs.sparkSession).fold() if simplify is None else simplify
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    keyed = docs.select(F.col("id").alias("doc_id"), title_key(F.col("title"), fold).alias("tk"), title_key(stem, fold).alias("fk"))
    # What is met is a matter of the two keys: documents that share both are one row until the end.
    kinds = written(keyed.select("tk", "fk").distinct(), "title-keys")
    both = F.array(F.struct(F.lit(0).alias("by_file"), F.col("tk").alias("dk")), F.struct(F.lit(1).alias("by_file"), F.col("fk").alias("dk")))
    keys = kinds.select("tk", "fk", F.explode(both).alias("x")).select("tk", "fk", "x.by_file", "x.dk").filter("dk <> ''")
    named = written(entries.select("entry_id", title_key(F.col("title"), fold).alias("ek")).filter("ek <> ''").groupBy("ek").agg(F.count("*").alias("n"), F.min("entry_id").alias("entry_id")), "entry-keys")
    d, e = keys.select("dk").distinct(), named.select("ek")
    exact = d.join(e, F.col("dk") == F.col("ek")).select("dk", "ek", F.lit(1).alias("turn"))
    long_d, long_e = d.filter(F.length("dk") >= 2), e.filter(F.length("ek") >= 2)
    in_e = _containing(long_d.toDF("s"), long_e.toDF("l")).toDF("dk", "ek")
    in_d = _containing(long_e.toDF("s"), long_d.toDF("l")).toDF("ek", "dk")
    one = e.filter(F.length("ek") == 1).join(long_d.withColumn("c", F.explode(F.array_distinct(F.split("dk", "")))), F.col("c") == F.col("ek"))
    met = reduce(DataFrame.union, [x.select("dk", "ek", F.lit(3).alias("turn")) for x in (in_e, in_d, one)], exact)
    # A document's entries: each key once, however it is met.
    hits = keys.join(met, "dk").groupBy("tk", "fk", "ek").agg(F.min(F.col("turn") + F.col("by_file")).alias("rank")).join(named, "ek")
    hits = hits.groupBy("tk", "fk").agg(F.sum("n").alias("hits"), F.min("entry_id").alias("entry_id"), F.min("rank").alias("rank"))
    kind = F.element_at(F.array(*map(F.lit, ("exact-title", "exact-filename", "substring-title", "substring-filename"))), F.col("rank"))
    lone = F.col("hits") == 1
    d = keyed.join(hits, ["tk", "fk"], "left")
    return d.select("doc_id", F.when(F.col("hits").isNull(), "unmatched").when(lone, "matched").otherwise("ambiguous").alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), F.when(lone, F.col("entry_id")).alias("entry_id"), F.when(lone, kind).alias("kind"))


def to_bibtex(type_: Column, key: Column, fields: Column) -> Column:
    """An entry as text; fields keep their order, empty ones are left out. Without type or fields it is a @misc with its title."""
    key = F.coalesce(F.nullif(key, F.lit("")), F.lit("untitled"))
    full = F.filter(fields, lambda f: F.coalesce(f["v"], F.lit("")) != "")
    rows = F.transform(full, lambda f: F.concat(F.lit("  "), f["k"], F.lit(" = {"), f["v"], F.lit("}")))
    entry = F.concat(type_, F.lit("{"), key, F.lit(",\n"), F.array_join(rows, ",\n"), F.lit("\n}\n"))
    title = F.coalesce(F.try_element_at(F.filter(fields, lambda f: f["k"] == "title"), F.lit(1))["v"], F.lit(""))
    bare = F.concat(F.lit("@misc{"), key, F.lit(",\n  title = {"), title, F.lit("},\n}\n"))
    return F.when((F.coalesce(type_, F.lit("")) != "") & (F.coalesce(F.size(fields), F.lit(0)) > 0), entry).otherwise(bare)
