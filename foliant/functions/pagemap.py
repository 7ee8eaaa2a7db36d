"""Printed page numbers against pages of a file: groups of anchors, as columns.

A map is ``array<struct<label, anchors: array<struct<printed, pdf>>>>``. Between
two anchors numbers are interpolated, beyond the last ones continued with the
nearest slope, and rounded half to even; one anchor is a fixed shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "array<struct<label:string,anchors:array<struct<printed:int,pdf:int>>>>"


def parse(raw: Column) -> Column:
    """Groups of the JSON form ``{"v": 2, "groups": [{"label", "anchors": [[printed, pdf]]}]}`` or of plain ``[[printed, pdf]]``."""
    two = F.from_json(raw, "struct<v:int,groups:array<struct<label:string,anchors:array<array<int>>>>>")
    one = F.from_json(raw, "array<array<int>>")
    groups = F.when(two["v"] == 2, two["groups"]).when(F.size(one) > 0, F.array(F.struct(F.lit("").alias("label"), one.alias("anchors"))))
    pair = lambda a: F.struct(a[0].alias("printed"), a[1].alias("pdf"))
    typed = F.transform(groups, lambda g: F.struct(F.coalesce(g["label"], F.lit("")).alias("label"), F.transform(g["anchors"], pair).alias("anchors")))
    return F.filter(F.coalesce(typed, F.array().cast(TYPE)), lambda g: F.size(g["anchors"]) > 0)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _line(points: Column, x: Column) -> Column:
    """Piecewise linear value at x of sorted (x, y) structs."""

    def at(p):
        later = F.filter(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda q: q["x"] >= x)
        i = F.when(F.size(later) > 0, F.size(p) - F.size(later)).otherwise(F.size(p) - 1)
        return _let(F.struct(F.element_at(p, F.greatest(i, F.lit(1))).alias("a"), F.element_at(p, F.least(F.greatest(i, F.lit(1)) + 1, F.size(p))).alias("b"), (F.size(later) > 0).alias("inside")), value)

    def value(s):
        slope = F.when(s["b"]["x"] != s["a"]["x"], (s["b"]["y"] - s["a"]["y"]) / (s["b"]["x"] - s["a"]["x"])).otherwise(1.0)
        base = F.when(s["inside"], s["a"]["y"] + (x - s["a"]["x"]) * slope).otherwise(s["b"]["y"] + (x - s["b"]["x"]) * slope)
        return F.bround(base).cast("int")

    return _let(points, lambda p: F.when(F.size(p) == 0, x.cast("int")).when(F.size(p) == 1, (x + p[0]["y"] - p[0]["x"]).cast("int")).otherwise(at(p)))


def _points(group: Column, x: str, y: str) -> Column:
    return F.array_sort(F.transform(group["anchors"], lambda a: F.struct(a[x].alias("x"), a[y].alias("y"))))


def _reach(group: Column, side: str) -> Column:
    return F.transform(group["anchors"], lambda a: a[side])


def _spanning(groups: Column, side: str, x: Column) -> Column:
    return F.filter(groups, lambda g: (F.array_min(_reach(g, side)) <= x) & (F.array_max(_reach(g, side)) >= x))


def to_printed(groups: Column, pdf: Column) -> Column:
    """The group that spans the page, else the one with the nearest anchor."""
    near = F.transform(groups, lambda g, i: F.struct(F.array_min(F.transform(_reach(g, "pdf"), lambda p: F.abs(p - pdf))).alias("d"), i.alias("i"), g.alias("g")))
    best = F.coalesce(F.try_element_at(_spanning(groups, "pdf", pdf), F.lit(1)), F.try_element_at(F.array_sort(near, lambda a, b: F.when(a["d"] == b["d"], a["i"] - b["i"]).otherwise(a["d"] - b["d"])), F.lit(1))["g"])
    return F.when(F.size(groups) == 0, pdf.cast("int")).otherwise(_let(best, lambda g: _line(_points(g, "pdf", "printed"), pdf)))


def to_pdf(groups: Column, default: Column, printed: Column) -> Column:
    """Of the groups that span the number the default one, else the first; with none the default group is continued."""
    first = lambda gs: F.coalesce(F.try_element_at(F.filter(gs, lambda g: g["label"] == default), F.lit(1)), F.try_element_at(gs, F.lit(1)))
    best = F.coalesce(first(_spanning(groups, "printed", printed)), first(groups))
    return F.when(F.size(groups) == 0, printed.cast("int")).otherwise(_let(best, lambda g: _line(_points(g, "printed", "pdf"), printed)))


def with_anchor(groups: Column, label: Column, printed: Column, pdf: Column) -> Column:
    """Groups with an anchor set: one of the same printed number is replaced, a new label starts a group."""
    new = F.struct(printed.cast("int").alias("printed"), pdf.cast("int").alias("pdf"))
    put = lambda g: F.struct(g["label"].alias("label"), F.array_sort(F.concat(F.filter(g["anchors"], lambda a: a["printed"] != printed), F.array(new))).alias("anchors"))
    changed = F.transform(groups, lambda g: F.when(g["label"] == label, put(g)).otherwise(g))
    return F.when(F.exists(groups, lambda g: g["label"] == label), changed).otherwise(F.concat(groups, F.array(F.struct(label.alias("label"), F.array(new).alias("anchors")))))


def without_anchor(groups: Column, label: Column, printed: Column) -> Column:
    """Groups without the anchor of a printed number; a group without anchors goes."""
    cut = F.transform(groups, lambda g: F.when(g["label"] == label, F.struct(g["label"].alias("label"), F.filter(g["anchors"], lambda a: a["printed"] != printed).alias("anchors"))).otherwise(g))
    return F.filter(cut, lambda g: F.size(g["anchors"]) > 0)


def default_of(raw: Column) -> Column:
    """The label of the group that a number belongs to where several have it; empty for a map of one group."""
    return F.coalesce(F.when(F.get_json_object(raw, "$.v") == "2", F.get_json_object(raw, "$.default")), F.lit(""))


def held_default(groups: Column, default: Column) -> Column:
    """The default if a group has that label, else the label of the first; empty without groups."""
    first = F.get(groups, 0)["label"]
    return F.coalesce(F.when(F.exists(groups, lambda g: g["label"] == default), default), first, F.lit(""))


def to_raw(groups: Column, default: Column) -> Column:
    """The JSON form of a map; null without groups."""
    pairs = F.transform(groups, lambda g: F.struct(g["label"].alias("label"), F.transform(g["anchors"], lambda a: F.array(a["printed"], a["pdf"])).alias("anchors")))
    return F.when(F.size(groups) > 0, F.to_json(F.struct(F.lit(2).alias("v"), pairs.alias("groups"), held_default(groups, default).alias("default"))))


def put_anchors(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Documents (id, page_map) with anchors (doc_id, label, printed, pdf) set; numbers under 1 are left out.

    Of several anchors of one printed number and group the one with the highest file page stands. A
    document's first map has the first label of these as its default.
    """
    good = anchors.filter("printed >= 1 AND pdf >= 1").select("doc_id", F.trim(F.coalesce("label", F.lit(""))).alias("label"), F.col("printed").cast("int").alias("printed"), F.col("pdf").cast("int").alias("pdf"))
    once = good.groupBy("doc_id", "label", "printed").agg(F.max("pdf").alias("pdf"))
    new = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "printed", "pdf"))).alias("_new"))
    d = docs.join(new, F.col("id") == F.col("doc_id"), "left").drop("doc_id")
    put = F.aggregate("_new", parse(F.col("page_map")), lambda groups, a: with_anchor(groups, a["label"], a["printed"], a["pdf"]))
    had = F.size(parse(F.col("page_map"))) > 0
    default = F.when(had, default_of(F.col("page_map"))).otherwise(F.get("_new", 0)["label"])
    return d.withColumn("page_map", F.when(F.col("_new").isNotNull(), to_raw(put, default)).otherwise(F.col("page_map"))).drop("_new")


def set_default(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the default group that ``labels`` (doc_id, label) names, where there is such a group."""
    new = labels.select(F.col("doc_id").alias("_of"), F.trim(F.coalesce("label", F.lit(""))).alias("_label"))
    d = docs.join(new, F.col("id") == F.col("_of"), "left")
    groups = parse(F.col("page_map"))
    there = F.coalesce(F.exists(groups, lambda g: g["label"] == F.col("_label")), F.lit(False))
    return d.withColumn("page_map", F.when(there, to_raw(groups, F.col("_label"))).otherwise(F.col("page_map"))).drop("_of", "_label")
