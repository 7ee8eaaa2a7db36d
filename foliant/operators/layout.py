"""Page geometry: regions, reading order, selections, scaling. Boxes are arrays x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = 1 << 30


def box(c: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c)[i] for i in range(4))


def overlap(a: tuple, b: tuple) -> tuple[Column, Column]:
    """Width and height of the common part."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])), F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def centre_in(a: tuple, b: tuple) -> Column:
    cx, cy = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (cx >= b[0]) & (cx <= b[2]) & (cy >= b[1]) & (cy <= b[3])


def assign_regions(blocks: DataFrame, regions: DataFrame, least_share: float | None = 0.5, keep_all: bool = False) -> DataFrame:
    """First region of the page that holds a block's centre, or ``least_share`` of its area; blocks outside go, or stay with null."""
    found = blocks.columns
    placed = with_regions(blocks, regions).withColumn("region_idx", first_region(least_share)["region_idx"])
    return (placed if keep_all else placed.filter("region_idx IS NOT NULL")).select(*[c for c in found if c != "region_idx"], "region_idx")


def with_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks with the regions of their page as an array, so that they move once to their page and stay there."""
    direction = F.col("direction") if "direction" in regions.columns else F.lit(None).cast("string")
    row = F.struct("region_idx", F.col("bbox").alias("rbox"), direction.alias("direction"))
    own = regions.groupBy("doc_id", "page_num").agg(F.collect_list(row).alias("_regions"))
    return blocks.join(own, ["doc_id", "page_num"], "left")


def first_region(least_share: float | None) -> Column:
    """region_idx and direction of the first region of ``_regions`` that holds the block, or null."""
    b = box("bbox")

    def hit(r: Column) -> Column:
        q = tuple(r["rbox"][i] for i in range(4))
        if least_share is None:
            return centre_in(b, q)
        w, h = overlap(b, q)
        return centre_in(b, q) | (w * h / F.greatest(F.lit(1e-6), (b[2] - b[0]) * (b[3] - b[1])) >= least_share)

    held = F.transform(F.filter("_regions", hit), lambda r: F.struct(r["region_idx"].alias("region_idx"), r["direction"].alias("direction")))
    return F.when(F.size("bbox") == 4, F.array_min(held))


def reading_order(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """New dense block numbers: regions in turn, inside them by direction; blocks outside any region stay at the end."""
    return in_order(with_regions(blocks, regions))


def in_order(placed: DataFrame) -> DataFrame:
    """``reading_order`` of blocks that have the regions of their page."""
    at = first_region(None)
    placed = placed.withColumns({"region_idx": at["region_idx"], "direction": at["direction"]}).drop("_regions")
    x0, y0, x1, y1 = box("bbox")
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    first = F.when(F.col("direction") == "v_rtl", -cx).when(F.col("direction") == "v_ltr", cx).otherwise(cy)
    second = F.when(F.col("direction").isin("v_rtl", "v_ltr"), cy).otherwise(cx)
    outside = F.col("region_idx").isNull()
    keys = [F.coalesce("region_idx", F.lit(FAR)), F.when(~outside, first).asc_nulls_last(), F.when(~outside, second).asc_nulls_last(), "block_num"]
    return placed.withColumn("new_block", F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(*keys)))


def selected(blocks: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Blocks that a selection (0..1) covers: 30 % of the area, or the centre, or half of the height."""
    sel = tuple(F.lit(float(v)) for v in (x, y, x + w, y + h))
    x0, y0, x1, y1 = box("bbox")
    pw, ph = F.coalesce(F.nullif("page_w", F.lit(0)), x1 - x0), F.coalesce(F.nullif("page_h", F.lit(0)), y1 - y0)
    n = (x0 / pw, y0 / ph, x1 / pw, y1 / ph)
    iw, ih = overlap(n, sel)
    area = F.greatest((n[2] - n[0]) * (n[3] - n[1]), F.lit(1e-9))
    tall = ih / F.greatest(n[3] - n[1], F.lit(1e-9)) >= 0.5
    return blocks.filter((F.size("bbox") == 4) & ((iw * ih / area >= 0.30) | (centre_in(n, sel) & (iw > 0) & (ih > 0)) | (tall & (iw > 0))))


def valid_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Rectangle held to the unit square, null where it isn't one (a hair over the edge is let pass)."""
    ok = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1.001) & (y + h <= 1.001)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y"), F.least(w, 1 - x).alias("w"), F.least(h, 1 - y).alias("h")))


def rescale(bbox: Column, kx: Column, ky: Column) -> Column:
    return F.array(bbox[0] * kx, bbox[1] * ky, bbox[2] * kx, bbox[3] * ky)


def apply_template(regions: DataFrame, from_w: float, from_h: float, pages: DataFrame) -> DataFrame:
    """Regions of one page scaled to others (page_num, page_w, page_h): whole numbers inside the page, empty ones gone."""
    kx, ky = F.col("page_w") / from_w, F.col("page_h") / from_h
    hold = lambda v, most: F.least(F.greatest(F.bround(v).cast("int"), F.lit(0)), most.cast("int"))
    x0, y0, x1, y1 = box("bbox")
    new = F.array(hold(x0 * kx, F.col("page_w")), hold(y0 * ky, F.col("page_h")), hold(x1 * kx, F.col("page_w")), hold(y1 * ky, F.col("page_h")))
    out = regions.select("region_idx", "direction", "bbox").join(pages).withColumn("bbox", new)  # regions of one page: at most 50
    return out.filter((F.col("bbox")[2] > F.col("bbox")[0]) & (F.col("bbox")[3] > F.col("bbox")[1])).select("page_num", "region_idx", "bbox", "direction")


def page_size(lines: DataFrame) -> DataFrame:
    """Largest stated page size, else the largest box."""
    return lines.groupBy("doc_id", "page_num").agg(F.coalesce(F.max("page_w"), F.max(F.col("bbox")[2])).alias("page_w"), F.coalesce(F.max("page_h"), F.max(F.col("bbox")[3])).alias("page_h"))


def line_order(lines: DataFrame, thin: float = 0.45, tall: float = 0.12) -> DataFrame:
    """Order of recognised lines of a page: columns right to left if most lines are thin and tall, else bands of half the median height."""
    page = Window.partitionBy("page")
    x0, y0, x1, y1 = box("bbox")
    w, h = x1 - x0, y1 - y0
    t = lines.withColumns({"_h": h, "_up": ((w / F.greatest(h, F.lit(1e-9)) < thin) & (h >= tall * F.col("page_h"))).cast("int"), "_cx": (x0 + x1) / 2, "_cy": (y0 + y1) / 2})
    t = t.withColumns({"_n": F.count("*").over(page), "_votes": F.sum("_up").over(page), "_mid": F.sort_array(F.collect_list("_h").over(page))})
    band = F.floor(F.col("_cy") / F.greatest(F.element_at("_mid", (F.floor(F.col("_n") / 2) + 1).cast("int")) / 2, F.lit(1e-9)))
    upright = F.col("_votes") > F.col("_n") / 2
    keys = [F.when(upright, -F.col("_cx")).otherwise(band), F.when(upright, F.col("_cy")).otherwise(F.col("_cx"))]
    return t.withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy(*keys, "id"))).drop("_h", "_up", "_cx", "_cy", "_n", "_votes", "_mid")
