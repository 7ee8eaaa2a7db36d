"""Small fixtures with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import folds, pagemap, text
from foliant.operators import collate
from foliant.sources import bibtex, ocr, texts


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


def test_normalise_and_page_numbers(spark):
    assert one(spark, "黃, 糧!\n a", text.normalise) == "黄粮a"
    assert one(spark, "〇一二", text.is_page_number) and not one(spark, "一a", text.is_page_number)
    assert one(spark, None, text.is_page_number) is False


def test_suspects(spark):
    box = [F.lit(float(v)) for v in (10, 300, 1000)]
    assert one(spark, " x ", lambda c: text.suspect_flags(c, F.lit("text"), *box)) == "single_char,label_geom_mismatch"
    assert one(spark, "\x01\x02a", lambda c: text.suspect_flags(c, F.lit("title"), *box)) == "weird_chars"
    assert one(spark, "  ", lambda c: text.suspect_flags(c, F.lit("text"), *box)) is None


def test_highlight_and_excerpts(spark):
    assert one(spark, "a<B b", lambda c: text.highlight(c, ["b"])) == "a&lt;<mark>B</mark> <mark>b</mark>"
    assert one(spark, "x <mark>y</mark>", text.strip_marks) == "x y"
    assert one(spark, "q" * 50 + "term" + "z" * 90, lambda c: text.hit_excerpt(c, "term")).startswith("…")
    assert one(spark, "short", lambda c: text.hit_excerpt(c, "term")) == "short"


def test_lenient_years(spark):
    assert [one(spark, v, text.sqlite_year) for v in ("1999-01", "19xx", "abcd", None)] == [1999, 19, 0, None]


@pytest.mark.parametrize(("pdf", "want"), [(5, 1), (7, 2), (3, 0), (30, 14), (2, 0)])
def test_page_map(spark, pdf, want):
    groups = pagemap.parse(F.col("c"))
    raw = json.dumps({"v": 2, "groups": [{"label": "main", "anchors": [[1, 5], [11, 25]]}]})
    got = one(spark, raw, lambda c: pagemap.to_printed(groups, F.lit(pdf)))
    points = [(5, 1), (25, 11)]
    assert got == round(points[0][1] + (pdf - 5) * 10 / 20) == want
    assert one(spark, raw, lambda c: pagemap.to_pdf(groups, F.lit("main"), F.lit(6))) == 15


def test_page_map_edges(spark):
    assert one(spark, "[[1, 10]]", lambda c: pagemap.to_pdf(pagemap.parse(c), F.lit(""), F.lit(4))) == 13
    assert one(spark, "not json", lambda c: pagemap.to_pdf(pagemap.parse(c), F.lit(""), F.lit(4))) == 4
    added = one(spark, "[[1, 10]]", lambda c: pagemap.with_anchor(pagemap.parse(c), F.lit("app"), F.lit(1), F.lit(50)))
    assert [(g.label, len(g.anchors)) for g in added] == [("", 1), ("app", 1)]


def test_alignment_rules():
    assert collate.align("abc", "abc") == [(0, 0), (1, 1), (2, 2)]
    assert collate.align("abc", "ac") == [(0, 0), (1, -1), (2, 1)]
    assert collate.align("", "ab") == [(-1, 0), (-1, 1)]


def test_divergences(spark):
    pairs = spark.createDataFrame([(1, "上谷郡城", "上谷群城"), (2, "a1", "a2"), (3, "", "")], "id long, a string, b string")
    cols = collate.alignments(pairs).cache()
    kinds = {(r.id, r.kind) for r in collate.divergences(cols).collect()}
    assert kinds == {(1, "substantive"), (2, "pageno")}
    agree = {r.id: (r.agree, r.accepted) for r in collate.agreement(cols, pairs).collect()}
    assert agree[1] == (0.75, True) and agree[2] == (0.5, False) and agree[3] == (1.0, True)


def test_rising_chain():
    assert collate.longest_rise([5, 1, 2, 9, 3]) == [1, 2, 3]
    assert collate.longest_rise([]) == []


def test_page_ranges(spark):
    body = "".join(chr(0x4E00 + i) for i in range(120))
    pages = spark.createDataFrame([(1, 1, body[:40]), (1, 2, body[40:80]), (1, 3, body[80:])], "transcript_id long, page_num int, text string")
    t = spark.createDataFrame([(1, body)], "transcript_id long, text string")
    got = [(r.page_num, r.char_start, r.char_end, r.low) for r in collate.page_ranges(collate.page_anchors(pages, t), t).orderBy("page_num").collect()]
    assert got == [(1, 0, 40, False), (2, 40, 80, False), (3, 80, 120, False)]
    assert collate.page_ranges(collate.page_anchors(pages.filter("page_num = 1"), t), t).count() == 0


def test_bibtex(spark):
    src = '@string{x = "y"} @Book{k1, title = {A {Nested} one}, year = 1999, note = "q", empty = {}} @article(k2, title={T}) @misc{open, title={x}'
    got = bibtex.parse_entries(src)
    assert [(t, k) for t, k, _ in got] == [("@book", "k1"), ("@article", "k2")]
    assert got[0][2] == [("title", "A {Nested} one"), ("year", "1999"), ("note", "q")]
    rows = bibtex.read_bibtex(spark.createDataFrame([(src,), (None,)], "value string")).collect()
    assert len(rows) == 2
    back = spark.createDataFrame(rows, bibtex.ENTRY).select(bibtex.to_bibtex(F.col("type"), F.col("cite_key"), F.col("fields")).alias("t")).first().t
    assert bibtex.parse_entries(back)[0] == got[0]


@pytest.mark.parametrize(("title", "want"), [("史记第二卷", "v2"), ("卷三", "v3"), ("志(上)", "v1"), ("志下册", "v3"), ("(1924)", ""), ("書(二)", "v2"), ("第二十一集", "v21"), ("x", "")])
def test_volumes(spark, title, want):
    none = F.lit(None).cast("string")
    assert one(spark, title, lambda c: bibtex.volume_token(none, none, c)) == want


def test_cite_keys(spark):
    none = F.lit(None).cast("string")
    key = lambda a, t: one(spark, a, lambda c: bibtex.cite_key_base(c, F.lit("1931"), none, F.lit(t), none, none))
    assert key("Marc Bloch and X", "The Feudal") == "bloch1931the" and key(None, "") == "anon1931untitled"
    d = spark.createDataFrame([(i, "s", "k", f"f{i}") for i in range(28)], "id int, collection string, base string, filename string")
    got = [r.cite_key for r in bibtex.distinct_cite_keys(d).orderBy("id").collect()]
    assert got[:3] == ["k", "kb", "kc"] and got[25] == "kz" and got[26].startswith("k-") and len(set(got)) == 28
    # keys that meet by a letter at the end, and keys that are there already
    bases = ["wang2000a", "wang2000a", "wang2000ab", "wang2000ab", "wang2000zoo"]
    d = spark.createDataFrame([(i, "s", b, f"f{i}") for i, b in enumerate(bases)], "id int, collection string, base string, filename string")
    have = spark.createDataFrame([("s", "wang2000zoo"), ("t", "wang2000a")], "collection string, cite_key string")
    assert [r.cite_key for r in bibtex.distinct_cite_keys(d, existing=have).orderBy("id").collect()] == ["wang2000a", "wang2000ab", "wang2000abb", "wang2000abc", "wang2000zoob"]


def test_chinese_numbers_and_keys_of_titles(spark):
    for numeral, want in (("二百", 200), ("四百", 400), ("一百零五", 105), ("十", 10), ("二十三", 23), ("零", None), ("12", 12), ("x", None)):
        assert bibtex.to_number(numeral) == want
    d = spark.createDataFrame([(1, "歷史學導論", "a.pdf"), (2, "x", "论语.pdf")], "id int, title string, filename string")
    e = spark.createDataFrame([(7, "历史学导论"), (8, "論語")], "entry_id int, title string")
    got = {r.doc_id: (r.status, r.entry_id, r.kind) for r in bibtex.match_entries(d, e).collect()}
    assert got == {1: ("matched", 7, "exact-title"), 2: ("matched", 8, "exact-filename")}
    bare = spark.createDataFrame([(None, None, [{"k": "title", "v": "T"}]), ("@book", "k", [{"k": "a", "v": ""}, {"k": "title", "v": "T"}])], bibtex.ENTRY)
    assert [r.t for r in bare.select(bibtex.to_bibtex(F.col("type"), F.col("cite_key"), F.col("fields")).alias("t")).collect()] == ["@misc{untitled,\n  title = {T},\n}\n", "@book{k,\n  title = {T}\n}\n"]


def test_markdown_marks(spark):
    strip = lambda t: one(spark, t, text.strip_markdown)
    assert [strip(t) for t in ("1. one", "2) two", "> - three", "# 3. four", "a `b` **c** __d__", "-5")] == ["one", "two", "three", "four", "a b c __d__", "-5"]


def test_bib_types(spark):
    t = lambda v, s=None: one(spark, v, lambda c: bibtex.bib_type(c, F.lit(s).cast("string")))
    assert [t("thesis", "mathesis"), t("@Thesis"), t("conference"), t("www"), t("zine")] == ["@mastersthesis", "@phdthesis", "@inproceedings", "@online", "@zine"]
    assert [one(spark, v, bibtex.doc_kind) for v in ("article", "@book", "zine")] == ["paper", "book", "other"]


def test_batches_and_parts(spark):
    assert one(spark, [500, 400, 10, 10, 10, 10, 900, 1], folds.batches, "array<int>") == [0, 1, 1, 1, 1, 2, 3, 4]
    parts = folds.split_text("x" * 300 + "。" + "y" * 200 + "。" + "z" * 20 + "。")
    assert "".join(parts) == "x" * 300 + "。" + "y" * 200 + "。" + "z" * 20 + "。" and len(parts) == 2
    assert folds.find_json('say [1, {"a": 2}] end', "[") == '[1,{"a":2}]' and folds.find_json("none", "[") is None
    assert [r["level"] for r in folds.toc_rows('[{"title": "a", "children": [{"title": "b", "page": 3}]}]')] == [1, 2] and folds.toc_rows("{bad") == []
    known = {"Рис", "Анализ", "Новиков", "Даурский", "It", "go", "into", "attributes"}, {"В статье", "I t"}, {"Санкт-Петербург", "Новиков-Даурский"}
    for text, want in (
        ("Р ис. 1 А нализ", "Рис. 1 Анализ"), ("В статье", "В статье"), ("Санкт- Петербург", "Санкт-Петербург"), ("С анкт-Петербург", "Санкт-Петербург"),
        ("Н овиков-Даурский", "Новиков-Даурский"), ("go in to", "go in to"), ("attri- butes", "attri- butes"), ("I tx", "I tx"),
    ):
        assert folds.repair(text, *known) == want
    assert folds.repair("А нализ", set(), set(), set()) == "А нализ"


def test_ocr_shapes(spark):
    page = {"page_index": 0, "width": 100, "height": 200, "parsing_res_list": [{"block_label": "header", "block_content": "h", "block_bbox": [0, 0, 1, 1]}, {"block_label": "text", "block_content": " a ", "block_bbox": [0, 0, 50, 10]}, {"block_label": "table", "block_content": {"html": "<t>", "markdown": "m"}, "block_bbox": [0, 0, 1, 1]}, {"block_label": "text", "block_content": "", "block_bbox": [0, 0, 1, 1]}]}
    shapes = [[page], {"pages": [page]}, {"result": {"pages": [page]}}, {"layoutParsingResults": [{"prunedResult": page}]}]
    raw = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "doc_id int, response string")
    got = ocr.lines(ocr.pages(raw)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_num", "text"))).alias("t")).collect()
    assert len(got) == 4 and all([tuple(x) for x in r.t] == [(1, "a"), (2, "<t>")] for r in got)


def test_grounding(spark):
    raw = spark.createDataFrame([(1, "![title](10,20,900,80) Heading ![text+](1, 2, 3, 4) body"), (2, "plain")], "doc_id int, markup string")
    got = [(r.doc_id, r.block_label, r.text, r.bbox) for r in ocr.grounding(raw).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "title", "Heading", [10.0, 20.0, 900.0, 80.0]), (1, "text", "body", [1.0, 2.0, 3.0, 4.0]), (2, "text", "plain", None)]


def test_layout_details(spark):
    el = {"label": "text", "content": " hi ", "bbox": [10, 10, 20, 20], "width": 100, "height": 50}
    raw = spark.createDataFrame([(1, json.dumps({"layout_details": [el]})), (2, json.dumps({"layout_details": [[el]]})), (3, json.dumps({"md_results": "md"}))], "doc_id int, response string")
    got = {r.doc_id: (r.text, r.bbox) for r in ocr.layout_details(raw).collect()}
    assert got == {1: ("hi", [0.1, 0.2, 0.2, 0.4]), 2: ("hi", [0.1, 0.2, 0.2, 0.4]), 3: ("md", None)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nline one  \n\n\nline two\n")
    d = texts.read_whole(spark, str(tmp_path)).withColumn("doc_id", F.lit(1))
    assert [r.text for r in texts.markdown_lines(d).orderBy("line_num").collect()] == ["# T", "line one", "line two"]
    pages = spark.createDataFrame([(1, 1, "# H\n\n**a**\nb\n\n\n"), (1, 2, "")], "doc_id int, page_num int, text string")
    assert [(r.block_num, r.text) for r in texts.native_lines(pages).orderBy("block_num").collect()] == [(1, "H"), (2, "a b")]
    assert texts.sparse_pages(pages).first().warn is True
