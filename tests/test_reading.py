"""Cards and their candidates, page maps, pages written anew, terms, a reader's views: small fixtures with known rows."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import folds, pagemap
from foliant.operators import cards, mutate, reading
from foliant.sources import ocr, texts



def now():
    return F.lit("2026-02-03 04:05:06").cast("timestamp")


CARD = "doc_id long, kind string, content string, status string, updated_at timestamp"
CAND = "id long, doc_id long, ctype string, label string, category string, page_num int, block_num int, status string"
DECIDE = "id long, action string, label string, category string, mount string"


def by_kind(df):
    return {(r.doc_id, r.kind): (json.loads(r.content), r.status) for r in df.collect()}


def test_saving_cards(spark):
    have = spark.createDataFrame([(1, "toc", '{"tree": []}', "draft", None), (2, "meta", "{}", "draft", None)], CARD)
    new = spark.createDataFrame([(1, "toc", '{"tree": [1]}', "reviewed"), (1, "summary", '"s"', "draft"), (1, "poem", "{}", "draft"), (2, "meta", "{bad", "draft"), (2, "entity", "{}", "done"), (9, "toc", "{}", "draft"), (2, "entity_source", None, "draft")], "doc_id long, kind string, content string, status string")
    got = cards.save_cards(have, new, spark.createDataFrame([(1,), (2,)], "id long"), now())
    assert by_kind(got) == {(1, "toc"): ({"tree": [1]}, "reviewed"), (1, "summary"): ("s", "draft"), (2, "meta"): ({}, "draft")}
    changed = cards.set_status(got, spark.createDataFrame([(2, "meta", "reviewed"), (1, "toc", "lost"), (3, "toc", "draft")], "doc_id long, kind string, new_status string"), now())
    assert {(r.doc_id, r.kind): (r.status, r.updated_at is not None) for r in changed.collect()} == {(1, "toc"): ("reviewed", True), (1, "summary"): ("draft", True), (2, "meta"): ("reviewed", True)}


def test_candidates_go_into_cards(spark):
    have = spark.createDataFrame([
        (1, "toc", json.dumps({"nodes": [{"label": "Old", "page_num": 2, "x": 1}, {"page_num": 3}]}), "reviewed", None), (1, "entity", json.dumps({"items": [{"label": " Bloch "}], "more": 1}), "draft", None), (2, "toc", "{bad", "draft", None), (3, "meta", "{}", "draft", None),
    ], CARD)
    found = spark.createDataFrame([(i, d, t, n, None, 5, 1, "pending") for i, d, t, n in ((1, 1, "toc", "A"), (2, 1, "toc", "B"), (3, 1, "entity", "Bloch"), (4, 1, "person", "Febvre"), (5, 2, "toc", "C"), (6, 3, "entity", "no"), (7, 3, "entity", "maybe"), (8, 4, "entity", "later"), (9, 1, "toc", "D"))], CAND)
    decide = spark.createDataFrame([(1, "adopt", None, "part", "[0]"), (2, "adopt", "", None, "[7, 1]"), (9, "adopt", "Dee", None, "[0, 0]"), (3, "adopt", None, None, None), (4, "adopt", "L. Febvre", None, None), (5, "adopt", None, None, "[]"), (6, "reject", "x", None, None), (7, "patch", "surely", "c", None), (8, "eat", None, None, None)], DECIDE)
    c, n = cards.review(have, found, decide, now())
    got = by_kind(c)
    old = {"label": "Old", "category": None, "page_num": 2, "block_num": None, "from": None}
    node = lambda label, i, category=None, **more: {"label": label, "category": category, "page_num": 5, "block_num": 1, "from": f"candidate#{i}", **more}
    assert got[1, "toc"] == ({"tree": [old | {"children": [node("A", 1, "part", children=[node("Dee", 9)])]}, node("B", 2)]}, "reviewed")
    assert got[1, "entity"] == ({"items": [{"label": " Bloch "}, {"label": "L. Febvre", "category": None, "page_num": 5, "from": "candidate#4"}], "more": 1}, "draft")
    assert got[2, "toc"] == ({"tree": [node("C", 5)]}, "draft") and got[3, "meta"] == ({}, "draft") and len(got) == 4
    assert {r.id: (r.status, r.label, r.category) for r in n.collect() if r.id > 4} == {5: ("adopted", "C", None), 6: ("rejected", "no", None), 7: ("pending", "surely", "c"), 8: ("pending", "later", None), 9: ("adopted", "D", None)}
    assert {r.doc_id for r in c.collect() if r.updated_at} == {1, 2}


def test_page_numbers_are_converted(spark):
    docs = spark.createDataFrame([(1, '{"v": 2, "groups": [{"label": "", "anchors": [[1, 11], [10, 20]]}], "default": ""}'), (2, None), (3, "[[5, 6]]")], "id long, page_map string")
    have = spark.createDataFrame([(1, "entity", '{"items": [{"label": "a", "page_num": 12}, {"label": "b"}, {"label": "c", "page_num": 0}, {"label": "d", "page_num": 30}], "k": "字"}', "draft", None), (1, "toc", '{"items": [{"page_num": 12}]}', "draft", None), (2, "entity", '{"items": [{"page_num": 12}]}', "draft", None), (3, "entity", "{bad", "draft", None), (3, "meta", "{}", "draft", None)], CARD)
    cand = spark.createDataFrame([(1, 1, "toc", "a", None, 12, 1, "pending"), (2, 1, "toc", "a", None, 12, 1, "adopted"), (3, 1, "toc", "a", None, None, 1, "pending"), (4, 2, "toc", "a", None, 12, 1, "pending"), (5, 3, "toc", "a", None, 12, 1, "pending")], CAND)
    c, n = cards.convert_pages(have, cand, docs)
    got = {(r.doc_id, r.kind): r.content for r in c.collect()}
    assert json.loads(got[1, "entity"]) == {"items": [{"label": "a", "page_num": 2}, {"label": "b"}, {"label": "c", "page_num": 0}, {"label": "d", "page_num": 20}], "k": "字"}
    assert got[3, "entity"] == "{bad" and json.loads(got[1, "toc"]) == {"items": [{"page_num": 12}]} and json.loads(got[2, "entity"]) == {"items": [{"page_num": 12}]}
    assert {r.id: r.page_num for r in n.collect()} == {1: 2, 2: 12, 3: None, 4: 12, 5: 11}


def test_page_maps_are_kept(spark):
    docs = spark.createDataFrame([(1, None), (2, "[[1, 10], [5, 14]]"), (3, '{"v": 2, "groups": [{"label": "a", "anchors": [[1, 1]]}, {"label": "b", "anchors": [[1, 9]]}], "default": "b"}'), (4, "junk")], "id long, page_map string")
    new = spark.createDataFrame([(1, " front ", 1, 3), (1, "front", 0, 4), (1, "back", 7, 0), (2, None, 5, 15), (2, "", 7, 17), (3, "c", 2, 20), (1, "front", 1, 2)], "doc_id long, label string, printed int, pdf int")
    got = {r.id: r.page_map and json.loads(r.page_map) for r in pagemap.put_anchors(docs, new).filter("id < 4").collect()}
    group = lambda label, *a: {"label": label, "anchors": [list(x) for x in a]}
    assert got[1] == {"v": 2, "groups": [group("front", (1, 3))], "default": "front"}
    assert got[2] == {"v": 2, "groups": [group("", (1, 10), (5, 15), (7, 17))], "default": ""}
    assert got[3] == {"v": 2, "groups": [group("a", (1, 1)), group("b", (1, 9)), group("c", (2, 20))], "default": "b"}
    cut = pagemap.without_anchor(pagemap.parse(F.col("page_map")), F.lit("b"), F.lit(1))
    out = {r.id: r.m for r in docs.select("id", pagemap.to_raw(cut, pagemap.default_of(F.col("page_map"))).alias("m")).collect()}
    assert json.loads(out[3])["default"] == "a" and out[4] is None and out[1] is None
    named = pagemap.set_default(docs, spark.createDataFrame([(3, " a"), (2, "none"), (1, "")], "doc_id long, label string"))
    assert {r.id: r.page_map for r in named.collect()}[2] == "[[1, 10], [5, 14]]" and json.loads({r.id: r.page_map for r in named.collect()}[3])["default"] == "a"


LINE = "id long, doc_id long, page_num int, block_num int, line_num int, text string, block_label string, trans string, gloss string, draft_flags map<string,string>"


def test_pages_written_anew(spark):
    lines = spark.createDataFrame([
        (1, 1, 1, 1, 1, "head", "number", None, None, None), (2, 1, 1, 2, 1, "one", "text", "eins", "1", {"trans": "ai", "gloss": "ai"}), (3, 1, 1, 2, 2, "two", "other", "zwei", None, {"trans": "ai"}), (4, 1, 1, 3, 1, "gone", None, None, None, None),
        (5, 1, 2, 1, 1, "stays", "text", None, None, None), (6, 2, 1, 1, 1, "emptied", "text", None, None, None), (7, 3, 1, 1, 1, "same", "footer", None, None, None),
    ], LINE)
    new = spark.createDataFrame([(1, 1, 1, "\nhead\n", None, None), (1, 1, 2, "one", "EINS", "1"), (1, 1, 3, "two!", " zwei ", ""), (3, 1, 1, "same", None, None), (3, 1, 2, "more", None, None)], "doc_id long, page_num int, pos int, text string, trans string, gloss string")
    pages = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, page_num int")
    after, log = mutate.edit_pages(lines, new, pages)
    assert sorted(map(tuple, log.collect())) == sorted([(1, 1, 2, "[译] eins", "[译] EINS"), (1, 1, 3, "two", "two!"), (1, 1, 4, "gone", ""), (2, 1, 1, "emptied", ""), (3, 1, 2, "", "more")])
    got = {(r.doc_id, r.page_num, r.block_num): (r.line_num, r.text, r.block_label, r.trans, r.gloss, r.draft_flags) for r in after.collect()}
    assert got == {
        (1, 1, 1): (1, "head", "text", None, None, None), (1, 1, 2): (1, "one", "text", "EINS", "1", {"gloss": "ai"}), (1, 1, 3): (1, "two!", "text", "zwei", None, {"trans": "ai"}), (1, 2, 1): (1, "stays", "text", None, None, None),
        (3, 1, 1): (1, "same", None, None, None, None), (3, 1, 2): (1, "more", None, None, None, None),
    }
    assert sorted(r.id for r in after.collect()) == [5, 8, 9, 10, 11, 12]


def test_terms(spark):
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "kind string, term string")
    new = spark.createDataFrame([(" x \r\n\n字　",), ("z",), (None,)], "t string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(texts.import_terms(have, new, "a")) == [("a", "x"), ("a", "z"), ("a", "字"), ("b", "y")]
    assert rows(texts.import_terms(have, new, "b", replace=True)) == [("a", "x"), ("b", "x"), ("b", "z"), ("b", "字")]
    assert rows(texts.import_terms(have, new.filter("t IS NULL"), "a", replace=True)) == rows(have)


def test_entities_in_detail(spark):
    e = spark.createDataFrame([(1, "Bloch", ["Marc"], "person", {"era": "20"}), (2, "Annales", [], "journal", None)], "id long, canonical string, aliases array<string>, category string, props map<string,string>")
    names = spark.createDataFrame([(1, "Bloch"), (1, "Marc"), (2, "Annales")], "entity_id long, name string")
    m = spark.createDataFrame([(1, 7, 1, 2, "Bloch", True), (1, 7, 1, 1, "Bloch", True), (1, 8, 1, None, "Marc", False), (1, 9, 1, 1, "Marc", True)], "entity_id long, doc_id long, page_num int, block_num int, surface string, valid boolean")
    d = spark.createDataFrame([(7, "T", "t.pdf"), (8, "U", "u.pdf")], "id long, title string, filename string")
    l = spark.createDataFrame([(7, 1, 1, "by Bloch"), (7, 1, 2, "Blo"), (7, 1, 2, "ch")], "doc_id long, page_num int, block_num int, text string")
    got = {r.canonical: r for r in reading.entities_in_detail(e, names, m, d, l).collect()}
    assert got["Bloch"].mention_count == 3 and [(x.doc_id, x.block_num, x.anchor_ok, x.title) for x in got["Bloch"].mentions] == [(7, 1, True, "T"), (7, 2, False, "T"), (8, None, False, "U"), (9, 1, False, None)]
    assert got["Annales"].mention_count == 0 and got["Annales"].mentions == []
    of = lambda **k: [(r.canonical, len(r.mentions)) for r in reading.entities_in_detail(e, names, m, d, l, **k).collect()]
    assert of(query="marc") == [("Bloch", 4)] and of(category="journal") == [("Annales", 0)] and of(doc_id=7, era="2") == [("Bloch", 2)] and of(limit=1) == [("Annales", 0)]


def test_regions_and_questions(spark):
    l = spark.createDataFrame([(1, 1, 1, 1, " first ", [0.0, 0.0, 50.0, 10.0]), (1, 1, 2, 1, "second", [0.0, 20.0, 50.0, 30.0]), (1, 1, 3, 1, " ", [0.0, 0.0, 5.0, 5.0]), (1, 1, 4, 1, "no box", None), (1, 1, 5, 1, "far", [80.0, 80.0, 90.0, 90.0])], "doc_id long, page_num int, block_num int, line_num int, text string, bbox array<double>")
    l = l.withColumns({"page_w": F.lit(100.0), "page_h": F.lit(100.0)})
    assert [tuple(r) for r in reading.region_texts(l, 0.0, 0.0, 0.6, 0.5).collect()] == [(1, 1, "first\nsecond")]
    assert [r.text for r in reading.region_texts(l, 0.0, 0.0, 0.6, 0.5, most_chars=8).collect()] == ["first\nse"] and reading.region_texts(l, 0.6, 0.0, 0.1, 0.1).collect() == []
    chat = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(1, 16)] + [(2, 1, "user", "x" * 9000)], "conv_id long, turn int, role string, text string")
    notes = spark.createDataFrame([(i, 1, 3, f"n{i}", None) for i in range(30)] + [(50, 1, 3, "", ""), (51, 1, 4, "other page", None)], "id long, doc_id long, page_num int, note string, clip_text string")
    asked = spark.createDataFrame([(1, 1, 3, " why? "), (2, 1, 9, "how?"), (3, 1, 3, "  ")], "conv_id long, doc_id long, page_num int, question string")
    got = {r.conv_id: [(m.role, m.content) for m in r.messages] for r in reading.questions(asked, chat, notes, spark.createDataFrame([(1, "a clip")], "conv_id long, text string"), "help").collect()}
    assert got.keys() == {1, 2} and got[2] == [("system", "help"), ("user", "how?")]
    assert [c for _, c in got[1][1:-1]] == [f"t{t}" for t in range(4, 16)]
    assert got[1][-1] == ("user", "【选区文本 第3页】\na clip\n\n【用户在本页的批注】\n" + "\n".join(f" → n{i}" for i in range(20)) + "\n\n【提问】why?")


def test_raw_blocks_have_their_suspects(spark):
    w = spark.createDataFrame([(1, 1, [0.0, 50.0, 9.0, 60.0], " b \n c "), (1, 1, [5.0, 10.0, 9.0, 20.0], "x"), (1, 1, [0.0, 10.0, 9.0, 400.0], "tall one"), (1, 1, [0.0, 0.0, 1.0, 1.0], " ")], "doc_id long, page_num int, bbox array<double>, text string")
    got = [(r.block_num, r.text, r.suspect) for r in ocr.raw_blocks(w.withColumn("page_h", F.lit(1000.0))).orderBy("block_num").collect()]
    assert got == [(1, "tall one", "label_geom_mismatch"), (2, "x", "single_char"), (3, "b c", None)]


@pytest.mark.parametrize(("text", "want"), [("Санкт- Петербург и А нализ", "Санкт-Петербург и Анализ"), ("С анкт-Петербург", "Санкт-Петербург"), ("В статье", "В статье"), ("Ünder Ä nderung x- y", "Ünder Änderung x- y"), ("А\nнализ  А  нализ", "А\nнализ  А  нализ"), ("", "")])
def test_split_words_are_joined_by_rule(text, want):
    known = ({"Анализ", "Санкт", "Петербург", "Встатье", "Änderung"}, {"В статье"}, {"Санкт-Петербург"})
    assert folds.repair(text, *known) == want
