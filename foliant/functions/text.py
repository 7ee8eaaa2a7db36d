"""Column functions over text: folding, normalising, highlighting, quality flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Variant characters that count as equal in collation.
VARIANT_FROM, VARIANT_TO = "黃糧荳跡戶", "黄粮豆迹户"
#: Characters of a printed page number.
PAGENO_CHARS = "〇一二三四五六七八九十百千兩0123456789"


def ascii_fold(c: Column) -> Column:
    """Lower-cases A-Z only, as a LIKE of short words does; accented letters stay apart."""
    return F.translate(c, UPPER, LOWER)


def normalise(c: Column) -> Column:
    """Text for collation: variants folded, punctuation, symbols, space and control characters gone."""
    return F.regexp_replace(F.translate(c, VARIANT_FROM, VARIANT_TO), r"[\p{P}\p{S}\p{Z}\p{C}]", "")


def is_page_number(c: Column) -> Column:
    return F.coalesce(normalise(c).rlike(f"^[{PAGENO_CHARS}]+$"), F.lit(False))


def weird_share(c: Column) -> Column:
    """Share of control, unassigned and private-use characters, newline and tab apart."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, r"[^\p{C}]|[\n\t]", "")) / n)


def suspect_flags(text: Column, label: Column, width: Column, height: Column, page_height: Column) -> Column:
    """Comma-joined reasons to look at a line again, null for none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    thin = (label == "text") & (page_height > 0) & (width > 0) & (height > 0) & (width / height < 0.45) & (height >= 0.25 * page_height)
    flags = F.array(
        F.when(F.length(t) == 1, "single_char"),
        F.when(weird_share(t) > 0.2, "weird_chars"),
        F.when(F.coalesce(thin, F.lit(False)), "label_geom_mismatch"),
    )
    return F.when(t != "", F.nullif(F.array_join(flags, ","), F.lit("")))


def highlight(c: Column, terms: list[str]) -> Column:
    """HTML-escaped text with <mark> around each term (a text, or a pattern of the plan), longest first, any case."""
    escaped = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    if not terms:
        return escaped
    words = "|".join(re.escape(t) if type(t) is str else t for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(escaped, f"(?iu)({words})", "<mark>$1</mark>")


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, "</?mark>", "")


def snippet(c: Column, term: str, before: int, after: int, cap: int | None = None) -> Column:
    """The text around the first place of a term; the start of the text where it isn't found."""
    at = F.instr(F.lower(c), term.lower())
    start = F.greatest(at - before, F.lit(1))
    cut = F.when(at > 0, F.substring(c, start, F.lit(before + after) - F.greatest(F.lit(before) - at + 1, F.lit(0)))).otherwise(F.substring(c, 1, before + after))
    return F.substring(cut, 1, cap) if cap else cut


def hit_excerpt(c: Column, term: str, longest: int = 80, before: int = 30) -> Column:
    """Texts of over ``longest`` characters cut around the term, with an ellipsis at each cut end."""
    at = F.greatest(F.instr(F.lower(c), term.lower()) - before, F.lit(1))
    cut = F.substring(c, at, F.lit(longest))
    marked = F.concat(F.when(at > 1, "…").otherwise(""), cut, F.when(at + longest - 1 < F.length(c), "…").otherwise(""))
    return F.when(F.length(c) > longest, marked).otherwise(c)


def title_key(c: Column, simplify: tuple[str, str] = ("", "")) -> Column:
    """Title for matching: script folded, lower case, only CJK, letters and digits."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), *simplify)), r"[^一-鿿㐀-䶿a-z0-9]", "")


def split_terms(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[，,；;、/|\s]+"), lambda x: x != "")


def repeats_itself(c: Column) -> Column:
    """Whether a stretch of two characters or more stands twice in a row."""
    return c.rlike(r"(.{2,})\1")


def strip_markdown(c: Column) -> Column:
    """Heading, list, number and quote marks at the start of a line, any run of them; double stars and backticks anywhere."""
    marks = r"(?m)^[ \t]*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)+"
    return F.regexp_replace(F.regexp_replace(c, marks, ""), r"\*\*|`", "")


def clean_field(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def json_fields(c: Column) -> Column:
    """A JSON object as a map of texts; null for anything else."""
    return F.when(F.ltrim(c).startswith("{"), F.from_json(c, "map<string,string>"))


def source_flags(tags: Column) -> Column:
    """is_primary, is_secondary and is_reference of a JSON list of tags; what is no list counts as primary."""
    own = F.coalesce(F.when(F.ltrim(tags).startswith("["), F.from_json(tags, "array<string>")), F.array(F.lit("primary")))
    return F.struct(*[F.array_contains(own, t).cast("int").alias(f"is_{t}") for t in ("primary", "secondary", "reference")])


def slice_page(c: Column, start: Column, end: Column) -> Column:
    """Characters start..end (from 0) of the text as it is collated."""
    return F.substring(normalise(c), start + 1, end - start)


def clamp_page(page: Column, page_count: Column) -> Column:
    """A page number held to 1..page_count."""
    return F.greatest(F.lit(1), F.least(page, F.greatest(F.coalesce(page_count, F.lit(1)), F.lit(1))))


def excerpt(c: Column, most: int = 120) -> Column:
    """Text with white space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def sqlite_year(c: Column) -> Column:
    """First four characters as a number the lenient way: leading digits, 0 for none, null for null."""
    digits = F.regexp_extract(F.substring(c, 1, 4), r"^\s*(\d+)", 1)
    return F.when(c.isNotNull(), F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0)))


#: Languages that are read in four rows.
FOUR_ROW = ("ja", "jpn", "ru", "rus", "ko", "kor", "el", "ell", "grc", "gre")


def tri_row_mode(lang: Column, explicit: Column) -> Column:
    """Rows that the reading view shows for each line: one for Chinese, an explicit 3 or 4, else by language."""
    lang = F.coalesce(lang, F.lit("zh"))
    return F.when(lang == "zh", 1).when(explicit.isin(3, 4), explicit).when(lang.isin(*FOUR_ROW), 4).otherwise(3)


def detected_language(cjk: Column, latin: Column) -> Column:
    """'eng' for clearly Latin text (400 characters counted, under 2 % CJK), else null: stay with the default."""
    return F.when((cjk + latin >= 400) & (cjk / (cjk + latin) < 0.02), "eng")
