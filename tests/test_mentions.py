"""Mentions by automaton against a plain walk; compiling documents anew."""

import random
import re

import pytest

from foliant.operators import entities
from foliant.operators.entities import anchor_mentions, compiled, places_of_names

BLOCKS = "doc_id long, page_num int, block_num int, index_text string"


def bare(t):
    return re.sub(r"\s+", "", t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(d, p, b, "".join(r.choice("abcd \n史学") for _ in range(r.randint(0, 40))) if r.random() < 0.95 else None) for d in range(6) for p in [1, 2, 63, 64, 65, 200][: 2 + d] for b in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def surfaces():
    r = random.Random(4)
    return sorted({"".join(r.choice("abcd史学") for _ in range(r.randint(1, 4))) for _ in range(120)} | {"a b", "ab ", "\n", "史 学", "abcd" * 20})


def plain(rows, surface, doc, most):
    s = bare(surface)
    return [(p, b) for d, p, b, t in sorted(rows, key=lambda r: r[:3]) if d == doc and len(s) >= 2 and s in bare(t)][:most]


@pytest.mark.parametrize(("most", "pages"), [(20, 64), (2, 64), (3, 1)])
def test_seeds_are_found_in_their_document(spark, rows, surfaces, monkeypatch, most, pages):
    monkeypatch.setattr(entities, "PAGES_AT_ONCE", pages)
    r = random.Random(5)
    seeds = [(d, s) for d in range(7) for s in surfaces if r.random() < 0.6]
    got = anchor_mentions(spark.createDataFrame(seeds + seeds[:5], "doc_id long, surface string"), spark.createDataFrame(rows, BLOCKS), most).collect()
    want = [(d, s, *at) for d, s in seeds for at in plain(rows, s, d, most) or [(None, None)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chars", [8_000_000, 100])
def test_names_are_found_in_all_documents(spark, rows, surfaces, monkeypatch, chars):
    monkeypatch.setattr(entities, "MOST_CHARS", chars)
    names = spark.createDataFrame([(s,) for s in [*surfaces, surfaces[0]]], "surface string")
    got = places_of_names(names, spark.createDataFrame(rows, BLOCKS), 3).collect()
    want = [(s, d, *at) for s in surfaces for d in range(6) for at in plain(rows, s, d, 3)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert places_of_names(names.limit(0), spark.createDataFrame(rows, BLOCKS)).collect() == []


def test_compiling_replaces_the_mentions_of_its_documents(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "Bloch and Feb vre"), (1, 2, 1, "Febvre again"), (2, 1, 1, "Bloch")], BLOCKS)
    ents = spark.createDataFrame([(1, "Bloch", ["Marc Bloch"], "person"), (5, "Pirenne", [], None)], "id long, canonical string, aliases array<string>, category string")
    old = spark.createDataFrame([(7, 5, 1, 9, 9, "Pirenne", True), (8, 1, 2, 1, 1, "Bloch", False), (9, 5, 3, 1, 1, "Pirenne", True)], "id long, entity_id long, doc_id long, page_num int, block_num int, surface string, valid boolean")
    seeds = [(1, 0, "Febvre", 4, None), (1, 1, "Marc  Bloch", 2, 7), (1, 2, "MarcBloch", 3, 1), (1, 3, "Bloch", None, None), (1, 4, "nowhere", 6, None), (1, 5, " ", 1, None), (1, 6, "x", 8, None), (9, 0, "Febvre", 1, 1)]
    e, m = compiled(spark.createDataFrame([(1,), (3,)], "doc_id long"), spark.createDataFrame(seeds, "doc_id long, pos int, surface string, page_num int, block_num int"), ents, old, blocks)
    names = {r.id: r.canonical for r in e.collect()}
    assert sorted(names.items()) == [(1, "Bloch"), (5, "Pirenne"), (6, "Febvre"), (7, "nowhere"), (8, "x")]
    got = sorted(((r.doc_id, names[r.entity_id], r.page_num, r.block_num, r.surface, r.valid) for r in m.collect()), key=str)
    assert got == sorted([
        (2, "Bloch", 1, 1, "Bloch", False),  # another document's stay
        (1, "Febvre", 1, 1, "Febvre", True), (1, "Febvre", 2, 1, "Febvre", True), (1, "Bloch", 2, 7, "Marc  Bloch", True), (1, "Bloch", 1, 1, "Bloch", True), (1, "nowhere", 6, None, "nowhere", True), (1, "x", 8, None, "x", True),
    ], key=str)
    # Once more with the same seeds: nothing changes but that surfaces are known now.
    again_e, again = compiled(spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame(seeds, "doc_id long, pos int, surface string, page_num int, block_num int"), e, m, blocks)
    assert again_e.count() == e.count() and sorted((r.entity_id, r.doc_id, str(r.page_num), r.surface) for r in again.collect()) == sorted((r.entity_id, r.doc_id, str(r.page_num), r.surface) for r in m.collect())
