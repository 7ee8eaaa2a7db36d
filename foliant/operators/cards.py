"""Cards of documents: saving, review of candidates, page numbers of a file turned into printed ones.

A card has its content as JSON: a tree of headings (``toc``), or a list of items
(``entity``). What many candidates of a document change in a card is one edit of its
JSON, in the order of the candidates; cards of different documents are independent.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import pagemap
from foliant.operators.mutate import upsert

#: Kinds of cards, their states, and what can be done with a candidate.
KINDS, STATES, ACTIONS = ("meta", "toc", "summary", "entity", "entity_source"), ("draft", "reviewed"), ("adopt", "reject", "patch")


def _loaded(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _dumped(content: dict) -> str:
    return json.dumps(content, ensure_ascii=False)


@F.arrow_udf(T.BooleanType())
def _is_json(texts: pa.Array) -> pa.Array:
    def good(t: str | None) -> bool:
        try:
            json.loads(t or "")
        except ValueError:
            return False
        return True

    return pa.array([good(t) for t in texts.to_pylist()], pa.bool_())


def save_cards(cards: DataFrame, new: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Cards (doc_id, kind, content, status, updated_at) with new ones in place of those of their document and kind.

    A new card of an unknown kind or state, without valid JSON, or of no document is left out.
    """
    good = new.filter(F.col("kind").isin(*KINDS) & F.col("status").isin(*STATES) & _is_json("content"))
    good = good.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "kind", "content", "status", now.alias("updated_at"))
    return upsert(cards, good, ["doc_id", "kind"])


def set_status(cards: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Cards with the state that ``changes`` (doc_id, kind, new_status) gives; states that there aren't change nothing."""
    c = changes.filter(F.col("new_status").isin(*STATES)).select("doc_id", "kind", "new_status")
    both = cards.join(c, ["doc_id", "kind"], "left")
    hit = F.col("new_status").isNotNull()
    return both.withColumns({"status": F.coalesce("new_status", "status"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(cards.columns)


def _node(c: dict[str, Any]) -> dict[str, Any]:
    return {"label": c["label"], "category": c["category"], "page_num": c["page_num"], "block_num": c["block_num"], "from": f"candidate#{c['id']}"}


def _place(tree: list, mount: str | None) -> list:
    """The list of children that a path of indices leads to; the root where it leads nowhere."""
    try:
        at = tree
        for i in json.loads(mount) if mount else []:
            at = at[int(i)].setdefault("children", [])
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return tree
    return at if isinstance(at, list) else tree


def _adopted(kind: str, content: dict, candidates: list[dict[str, Any]]) -> dict:
    if kind == "toc":
        if not content.get("tree"):  # an older card has its headings in a row
            flat = content.pop("nodes", None) or []
            content["tree"] = [{k: n.get(k) for k in ("label", "category", "page_num", "block_num", "from")} for n in flat if isinstance(n, dict) and n.get("label")]
        for c in candidates:
            _place(content["tree"], c["mount"]).append(_node(c))
        return content
    items = content.setdefault("items", [])
    there = {str(i.get("label") or "").strip() for i in items if isinstance(i, dict)}
    for c in candidates:
        if (c["label"] or "").strip() not in there:
            there.add((c["label"] or "").strip())
            items.append({k: v for k, v in _node(c).items() if k != "block_num"})
    return content


@F.arrow_udf(T.StringType())
def _with_candidates(kinds: pa.Array, contents: pa.Array, candidates: pa.Array) -> pa.Array:
    return pa.array([_dumped(_adopted(k, _loaded(t), c)) if c else t for k, t, c in zip(kinds.to_pylist(), contents.to_pylist(), candidates.to_pylist())], pa.string())


def review(cards: DataFrame, candidates: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Cards and candidates after decisions (id, action, label, category, mount) on candidates (id, doc_id, ctype, label, category, page_num, block_num, status).

    ``patch`` changes label and category; ``reject`` and ``adopt`` set the state, and an
    adopted candidate goes into the card of its document, under the label and category
    that the decision gives: a heading into the tree of the ``toc`` card, at the path
    ``mount`` (a JSON list of indices; else at the root), anything else into the items of
    the ``entity`` card unless one has its label. A card that isn't there yet begins as a draft.
    """
    d = decisions.filter(F.col("action").isin(*ACTIONS)).select(F.col("id").alias("_id"), "action", F.col("label").alias("_label"), F.col("category").alias("_category"), F.col("mount").alias("_mount"))
    both = candidates.join(d, F.col("id") == F.col("_id"), "left")
    label, category = F.coalesce(F.nullif("_label", F.lit("")), "label"), F.coalesce(F.nullif("_category", F.lit("")), "category")
    patch = F.col("action") == "patch"
    status = F.when(F.col("action") == "adopt", "adopted").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    after = both.withColumns({"label": F.when(patch, label).otherwise(F.col("label")), "category": F.when(patch, category).otherwise(F.col("category")), "status": status}).select(candidates.columns)
    kind = F.when(F.col("ctype") == "toc", "toc").otherwise("entity")
    own = F.struct("id", label.alias("label"), category.alias("category"), "page_num", "block_num", F.col("_mount").alias("mount"))
    come = both.filter("action = 'adopt'").groupBy("doc_id", kind.alias("kind")).agg(F.array_sort(F.collect_list(own)).alias("_come"))
    c = cards.join(come, ["doc_id", "kind"], "full")
    hit = F.col("_come").isNotNull()
    c = c.withColumns({"content": _with_candidates("kind", "content", "_come"), "status": F.coalesce("status", F.lit("draft")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return c.select(cards.columns), after


# --- page numbers ---------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def _with_pages(contents: pa.Array, pages: pa.Array) -> pa.Array:
    """Items of a card with their page numbers, one for each item."""
    out = []
    for text, new in zip(contents.to_pylist(), pages.to_pylist()):
        content = _loaded(text)
        for item, page in zip(content.get("items") or [], new or []):
            if item.get("page_num"):
                item["page_num"] = page
        out.append(_dumped(content) if new else text)
    return pa.array(out, pa.string())


def convert_pages(cards: DataFrame, candidates: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and candidates of documents with a page map: page numbers of the file in items of ``entity`` cards and in pending candidates become printed ones.

    Headings have printed numbers from the start. The change can't be undone, and a
    second one would shift them again: it is for documents that are converted for the first time.
    """
    maps = docs.select(F.col("id").alias("_of"), pagemap.parse(F.col("page_map")).alias("_map")).filter(F.size("_map") > 0)
    c = cards.join(maps, F.col("doc_id") == F.col("_of"), "left")
    items = F.from_json("content", "struct<items:array<struct<page_num:int>>>")["items"]
    pages = F.transform(items, lambda i: F.when(i["page_num"] != 0, pagemap.to_printed(F.col("_map"), i["page_num"])))
    mine = F.col("_map").isNotNull() & (F.col("kind") == "entity") & (F.size(F.coalesce(items, F.array())) > 0)
    c = c.withColumn("_pages", F.when(mine, pages)).withColumn("content", F.when(F.col("_pages").isNotNull(), _with_pages("content", "_pages")).otherwise(F.col("content")))
    n = candidates.join(maps, F.col("doc_id") == F.col("_of"), "left")
    open_ = F.col("_map").isNotNull() & (F.col("status") == "pending") & F.col("page_num").isNotNull()
    n = n.withColumn("page_num", F.when(open_, pagemap.to_printed(F.col("_map"), F.col("page_num"))).otherwise(F.col("page_num")))
    return c.select(cards.columns), n.select(candidates.columns)
