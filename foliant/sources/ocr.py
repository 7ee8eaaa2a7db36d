"""Recognition results as tables: the shapes that services answer in, one row for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import suspect_flags

_BLOCK = "struct<block_label:string,block_content:string,block_bbox:array<double>>"
_PAGE = f"struct<page_index:int,width:double,height:double,parsing_res_list:array<{_BLOCK}>>"


def pages(raw: DataFrame, doc_col: str = "doc_id", json_col: str = "response") -> DataFrame:
    """Pages of ``[page]``, ``{pages}``, ``{result: {pages}}`` or ``{layoutParsingResults: [{prunedResult: page}]}``."""
    r = F.col(json_col)
    flat = F.from_json(r, f"array<{_PAGE}>")
    one = F.from_json(r, f"struct<pages:array<{_PAGE}>,result:struct<pages:array<{_PAGE}>>,layoutParsingResults:array<struct<prunedResult:{_PAGE}>>>")
    found = F.coalesce(one["pages"], one["result"]["pages"], F.transform(one["layoutParsingResults"], lambda x: x["prunedResult"]), F.when(F.ltrim(r).startswith("["), flat))
    p = raw.select(F.col(doc_col).alias("doc_id"), F.posexplode(found).alias("pos", "page"))
    return p.select("doc_id", F.coalesce("page.page_index", "pos").alias("page_index"), "page.width", "page.height", "page.parsing_res_list")


def content(c: Column) -> Column:
    """Text of a block: the string, or the html or else the markdown of an object."""
    o = F.from_json(c, "struct<html:string,markdown:string>")
    return F.trim(F.when(F.ltrim(c).startswith("{"), F.coalesce(F.nullif(o["html"], F.lit("")), o["markdown"], F.lit(""))).otherwise(F.coalesce(c, F.lit(""))))


def lines(pages: DataFrame) -> DataFrame:
    """One line for each block that isn't a header and has text; blocks numbered densely; suspects flagged."""
    b = pages.select("doc_id", (F.col("page_index") + 1).alias("page_num"), "width", "height", F.posexplode("parsing_res_list").alias("pos", "b"))
    b = b.select("doc_id", "page_num", "width", "height", "pos", F.col("b.block_label").alias("block_label"), content(F.col("b.block_content")).alias("text"), F.col("b.block_bbox").alias("bbox"))
    b = b.filter((F.coalesce("block_label", F.lit("")) != "header") & (F.col("text") != ""))
    n = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("pos"))
    box = F.col("bbox")
    flags = suspect_flags(F.col("text"), F.col("block_label"), box[2] - box[0], box[3] - box[1], F.col("height"))
    return b.select("doc_id", "page_num", n.alias("block_num"), F.lit(1).alias("line_num"), "text", "bbox", "block_label", F.col("width").alias("page_w"), F.col("height").alias("page_h"), flags.alias("suspect"))


def layout_details(raw: DataFrame, doc_col: str = "doc_id", json_col: str = "response") -> DataFrame:
    """Elements of flat or nested layout lists with any of their field names; boxes scaled by the element's own size; else the plain markdown."""
    el = "struct<type:string,label:string,text:string,content:string,markdown:string,md:string,bbox_2d:array<double>,bbox:array<double>,box:array<double>,width:double,height:double>"
    r = F.col(json_col)
    d = F.get_json_object(r, "$.layout_details")
    nested = F.flatten(F.from_json(d, f"array<array<{el}>>"))
    els = F.when(d.rlike(r"^\s*\[\s*\["), nested).otherwise(F.from_json(d, f"array<{el}>"))
    md = F.get_json_object(r, "$.md_results")
    only = F.array(F.struct(*[(F.lit("text") if n == "type" else md if n == "text" else F.lit(None)).cast(t).alias(n) for n, t in [("type", "string"), ("label", "string"), ("text", "string"), ("content", "string"), ("markdown", "string"), ("md", "string"), ("bbox_2d", "array<double>"), ("bbox", "array<double>"), ("box", "array<double>"), ("width", "double"), ("height", "double")]]))
    e = raw.select(F.col(doc_col).alias("doc_id"), F.posexplode(F.when(F.size(els) > 0, els).when(md.isNotNull(), only)).alias("pos", "e"))
    box = F.coalesce("e.bbox_2d", "e.bbox", "e.box")
    w, h = F.col("e.width"), F.col("e.height")
    scaled = F.when((w > 0) & (h > 0) & (F.size(box) == 4), F.array(box[0] / w, box[1] / h, box[2] / w, box[3] / h)).otherwise(box)
    return e.select("doc_id", "pos", F.coalesce("e.type", "e.label", F.lit("text")).alias("block_label"), F.trim(F.coalesce("e.text", "e.content", "e.markdown", "e.md", F.lit(""))).alias("text"), scaled.alias("bbox"))


def grounding(raw: DataFrame, doc_col: str = "doc_id", text_col: str = "markup") -> DataFrame:
    """Blocks of ``![label](x0,y0,x1,y1) text``: a text runs to the next mark; without marks all is one block."""
    mark = r"!\[[^\]]*\]\(\s*[\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+\s*,\s*[\d.]+\s*\)"
    c = F.col(text_col)
    marks, bodies = F.regexp_extract_all(c, F.lit(f"({mark})"), 1), F.split(c, mark)
    both = F.transform(marks, lambda m, i: F.struct(m.alias("m"), F.element_at(bodies, i + 2).alias("t")))
    rows = F.when(F.size(marks) > 0, both).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("m"), c.alias("t"))))
    e = raw.select(F.col(doc_col).alias("doc_id"), F.posexplode(rows).alias("pos", "r"))
    label = F.regexp_replace(F.regexp_extract("r.m", r"!\[([^\]]*)\]", 1), r"\+$", "")
    box = F.transform(F.regexp_extract_all("r.m", F.lit(r"([\d.]+)(?=\s*[,)])"), 1), lambda x: x.cast("double"))
    text = F.regexp_replace(F.regexp_replace("r.t", r"^\s*#{1,6}\s+|\*\*", ""), r"^\s+|\s+$", "")
    return e.select("doc_id", "pos", F.coalesce(F.nullif(label, F.lit("")), F.lit("text")).alias("block_label"), text.alias("text"), F.when(F.col("r.m").isNotNull(), F.slice(box, -4, 4)).alias("bbox"))


def plain_text(lines: DataFrame) -> DataFrame:
    """Readable text of each page: titles as headings, no images, rules, headers and footers."""
    keep = lines.filter(~F.coalesce("block_label", F.lit("text")).isin("image", "separator", "header", "footer"))
    row = F.when(F.col("block_label").isin("title", "doc_title"), F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text"))
    g = keep.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_num", "line_num", row.alias("t")))).alias("r"))
    return g.select("doc_id", "page_num", F.array_join(F.transform("r", lambda r: r["t"]), "\n\n").alias("text"))


def raw_blocks(words: DataFrame) -> DataFrame:
    """Extracted text blocks (bbox, text[, block_label, page_h]) of pages in order of top, then left edge, white space collapsed, with what is suspect about them."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    w = Window.partitionBy("doc_id", "page_num").orderBy(F.col("bbox")[1], F.col("bbox")[0], F.col("bbox")[3], F.col("bbox")[2], "text")
    b = words.withColumn("text", text).filter("text <> ''").withColumn("block_num", F.row_number().over(w))
    label = F.col("block_label") if "block_label" in words.columns else F.lit("text")
    tall = F.col("page_h") if "page_h" in words.columns else F.lit(None).cast("double")
    x0, y0, x1, y1 = (F.col("bbox")[i] for i in range(4))
    return b.withColumn("suspect", suspect_flags(F.col("text"), label, x1 - x0, y1 - y0, tall))
