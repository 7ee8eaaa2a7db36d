"""Keyed tables: only touched buckets, batches once, conflicts. Shelves: staged import in three ways, failures, deletion, renaming."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import mutate
from foliant.sources import shelves, versions
from foliant.sources.keyed import KeyedTable, into
from foliant.sources.shelves import Refused

ROW = "collection string, id long, text string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(spark, data, schema=ROW):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.created(make(spark, [("a", i, f"t{i}", 1) for i in range(40)] + [(None, 1, "null", 1)]), str(tmp_path / "t"), ["collection", "id"], buckets=8)


def test_changes_equal_those_of_whole_tables(spark, table):
    old = table.rows()
    new = make(spark, [("a", 3, "new", 9), ("b", 3, "other", 9), (None, 1, "was null", 2), (None, 2, "null too", 2)])
    assert rows(table.upserted(new).rows()) == sorted([r for r in rows(old) if r[:2] not in {("a", 3), (None, 1)}] + [tuple(r) for r in new.collect()], key=str)
    latest = KeyedTable.opened(spark, table.root)
    assert rows(latest.inserted(make(spark, [("a", 4, "late", 0), ("c", 1, "c", 0), (None, 1, "late", 0)])).rows()) == sorted([*rows(latest.rows()), ("c", 1, "c", 0)], key=str)
    latest = KeyedTable.opened(spark, table.root)
    gone = latest.removed(make(spark, [(None, 1), ("a", 5), ("a", 999)], "collection string, id long"))
    assert rows(gone.rows()) == [r for r in rows(latest.rows()) if r[:2] not in {(None, 1), ("a", 5)}]
    both = gone.combined(make(spark, [("a", 6, "x", 5), ("d", 6, "d", 5)]), {"n": lambda a, b: a + b})
    assert rows(both.where({"collection": "a", "id": 6})) == [("a", 6, "t6", 6)] and rows(both.where({"collection": "d", "id": 6})) == [("d", 6, "d", 5)]
    assert rows(both.where({"collection": None, "id": 2})) == [(None, 2, "null too", 2)] and rows(both.where({"collection": None, "id": 7})) == []
    assert KeyedTable.opened(spark, table.root).version == both.version == 5
    assert rows(KeyedTable.opened(spark, table.root, 1).rows()) == rows(old)


def test_files_of_other_buckets_stay(spark, table):
    one = make(spark, [("a", 7, "new", 1)])
    after = table.upserted(one)
    touched = [b for b in range(8) if table.files.get(b) != after.files.get(b)]
    assert len(touched) == 1 and rows(after.rows(touched)) != rows(table.rows(touched))
    empty = after
    for r in table.rows(touched).collect():
        empty = empty.removed(make(spark, [r[:2]], "collection string, id long"))
    assert touched[0] not in empty.files and len(empty.files) == len(after.files) - 1
    again = empty.upserted(one)
    assert again.rows(touched).count() == 1
    assert again.upserted(one.limit(0)).files == again.files


def test_a_key_twice_and_a_second_writer_are_refused(spark, table):
    with pytest.raises(ValueError, match="more than once"):
        table.upserted(make(spark, [("a", 1, "x", 1), ("a", 1, "y", 1)]))
    table.upserted(make(spark, [("a", 1, "x", 1)]))
    with pytest.raises(Exception, match="(?i)exists"):
        table.upserted(make(spark, [("a", 2, "y", 1)]))
    assert rows(KeyedTable.opened(spark, table.root).where({"collection": "a", "id": 1})) == [("a", 1, "x", 1)]


def test_a_batch_that_runs_again_counts_once(spark, table, tmp_path):
    counts = KeyedTable.created(make(spark, [("old", 2)], "query string, hits long"), str(tmp_path / "c"), ["query"], 4)
    add = into(counts.root, "misses", lambda t, r, batch: t.combined(r.groupBy("query").agg(F.count("*").alias("hits")), {"hits": lambda a, b: a + b}, **batch))
    first, second = make(spark, [("old",), ("new",), ("old",)], "query string"), make(spark, [("new",)], "query string")
    for number, batch in ((0, first), (0, first), (1, second), (0, first), (1, second)):
        add(batch, number)
    assert rows(KeyedTable.opened(spark, counts.root).rows()) == [("new", 2), ("old", 4)] and KeyedTable.opened(spark, counts.root).version == 3
    # The same by a stream that is started twice from one checkpoint.
    make(spark, [("s",), ("old",)], "query string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = spark.readStream.schema("query string").parquet(str(tmp_path / "in")).writeStream.foreachBatch(into(counts.root, "stream", lambda t, r, batch: t.combined(r.groupBy("query").agg(F.count("*").alias("hits")), {"hits": lambda a, b: a + b}, **batch)))
        q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    assert rows(KeyedTable.opened(spark, counts.root).rows()) == [("new", 2), ("old", 5), ("s", 1)]


# --- shelves ------------------------------------------------------------------------

DOC, LINE, NOTE = "id long, cite_key string, filename string, title string", "id long, doc_id long, text string", "id long, doc_id long, note string"


@pytest.fixture
def shelf(spark):
    return {"documents": make(spark, [(1, "k1", "a.pdf", "A"), (2, None, "b.pdf", "B"), (7, "", None, "no name")], DOC), "lines": make(spark, [(1, 1, "a1"), (2, 1, "a2"), (3, 2, "b1")], LINE)}


@pytest.fixture
def other(spark):
    return {"documents": make(spark, [(1, "k1", "other.pdf", "A again"), (2, "k9", "b.pdf", "B again"), (3, "k3", "c.pdf", "C"), (4, None, None, "D")], DOC), "lines": make(spark, [(1, 1, "x"), (2, 3, "c1"), (3, 3, "c2"), (9, 77, "stray")], LINE), "notes": make(spark, [(1, 3, "a note"), (2, 1, "lost")], NOTE)}


def test_three_ways_of_an_import(spark, tmp_path, shelf, other):
    root, pkg = str(tmp_path / "shelves"), str(tmp_path / "pkg")
    shelves.create(root, "other", other)
    shelves.create(root, "史学 one", shelf)
    assert shelves.shelves(spark, root) == ["other", "史学 one"]
    assert shelves.export(spark, root, "other", pkg)["rows"] == {"documents": 4, "lines": 4, "notes": 2}
    s = shelves.stage(spark, root, pkg, "史学 one")
    assert s.report == {"rows": {"documents": 4, "lines": 4, "notes": 2}, "shelf_is_there": True, "ways": ["overwrite", "merge"], "clashes": 2, "newcomers": 2, "stray_rows": 1, "new_tables": ["notes"], "lost_tables": []}
    assert [(r.id, r.by) for r in s.clashes().orderBy("id").collect()] == [(1, "cite_key"), (2, "filename")]
    with pytest.raises(Refused, match="there is a shelf"):
        s.publish("create")
    with pytest.raises(Refused, match="no such way"):
        s.publish("append")
    before = {n: rows(t) for n, t in shelves.tables(spark, root, "史学 one").items()}
    assert before == {n: rows(t) for n, t in shelf.items()}
    assert shelves.opened(spark, root, s.name).publish("merge") == 2
    now = shelves.tables(spark, root, "史学 one")
    assert rows(now["documents"].select("id", "title")) == [(1, "A"), (2, "B"), (7, "no name"), (8, "C"), (9, "D")]
    assert rows(now["lines"]) == [(1, 1, "a1"), (2, 1, "a2"), (3, 2, "b1"), (4, 8, "c1"), (5, 8, "c2")] and rows(now["notes"]) == [(1, 8, "a note")]
    with pytest.raises(Refused, match="published before"):
        s.publish("merge")
    # The same package once more: nothing comes in. Then as a whole.
    again = shelves.stage(spark, root, pkg, "史学 one")
    assert (again.report["clashes"], again.report["newcomers"]) == (3, 1)  # the one without names can't be known again
    assert again.publish("overwrite") == 3
    assert {n: rows(t) for n, t in shelves.tables(spark, root, "史学 one").items()} == {n: rows(t) for n, t in other.items()}
    assert {n: rows(t) for n, t in shelves.tables(spark, root, "史学 one", 1).items()} == before
    new = shelves.stage(spark, root, pkg, "third")
    assert new.report["ways"] == ["create"] and new.report["newcomers"] == 4 and new.clashes().collect() == []
    with pytest.raises(Refused, match="no shelf"):
        new.publish("merge")
    assert new.publish("create") == 1 and "third" in shelves.shelves(spark, root)


def test_a_failed_publication_leaves_the_shelf(spark, tmp_path, shelf, other, monkeypatch):
    root, pkg = str(tmp_path / "shelves"), str(tmp_path / "pkg")
    shelves.create(root, "one", shelf)
    shelves.create(root, "other", other)
    shelves.export(spark, root, "other", pkg)
    s = shelves.stage(spark, root, pkg, "one")
    want = {n: rows(t) for n, t in shelf.items()}

    def breaks(*a):
        raise OSError("the disk is full")

    for where in ("_write", "_publish"):  # while tables are written, and after that
        with monkeypatch.context() as m:
            m.setattr(shelves, where, breaks)
            with pytest.raises(OSError, match="full"):
                s.publish("overwrite")
        assert {n: rows(t) for n, t in shelves.tables(spark, root, "one").items()} == want and versions.numbers(spark, f"{root}/one") == [1]
    assert s.publish("overwrite") == 2  # the stage is still good


def test_bad_packages_are_refused(spark, tmp_path, shelf):
    root = str(tmp_path / "shelves")
    shelves.create(root, "one", shelf)
    with pytest.raises(Refused, match="no manifest"):
        shelves.stage(spark, root, str(tmp_path / "none"))

    def package(name, told, data):
        for n, t in data.items():
            t.write.parquet(str(tmp_path / name / n))
        make(spark, [(json.dumps(told),)], "value string").coalesce(1).write.text(str(tmp_path / name / "manifest"))
        return str(tmp_path / name)

    for name, told, data, why in (
        ("p1", {"collection": "x", "rows": {"lines": 3}}, {"lines": shelf["lines"]}, "without documents"), ("p2", {"collection": "x", "rows": {"documents": 3}}, {"documents": shelf["documents"].drop("cite_key")}, "cite_key"),
        ("p3", {"collection": "x", "rows": {"documents": 4}}, {"documents": shelf["documents"]}, "than told"), ("p4", {"collection": "../x", "rows": {"documents": 3}}, {"documents": shelf["documents"]}, "no name"),
    ):
        with pytest.raises(Refused, match=why):
            shelves.stage(spark, root, package(name, told, data))
    assert shelves.shelves(spark, root) == ["one"]
    with pytest.raises(Refused, match="no stage"):
        shelves.opened(spark, root, "nothing")


def test_delete_and_rename(spark, tmp_path, shelf):
    root = str(tmp_path / "shelves")
    shelves.create(root, "one", shelf)
    with pytest.raises(Refused, match="there is a shelf"):
        shelves.create(root, "one", shelf)
    shelves.create(root, "two", shelf)
    for bad in ("two", "", ".x", "one", "a/b"):
        with pytest.raises(Refused):
            shelves.rename(spark, root, "one", bad)
    shelves.rename(spark, root, "one", "three")
    assert shelves.shelves(spark, root) == ["three", "two"] and rows(shelves.tables(spark, root, "three")["lines"]) == rows(shelf["lines"])
    shelves.delete(spark, root, "two")
    assert shelves.shelves(spark, root) == ["three"]
    with pytest.raises(FileNotFoundError):
        shelves.tables(spark, root, "two")
    with pytest.raises(Refused):
        shelves.delete(spark, root, "two")
    assert rows(shelves.tables(spark, root, "two", 1)["lines"]) == rows(shelf["lines"])
    shelves.create(root, "two", shelf)
    shelves.rename(spark, root, "three", "one")
    assert shelves.shelves(spark, root) == ["one", "two"]


def test_children_of_an_import_get_ids_of_their_own(spark):
    ids = make(spark, [(3, 8)], "old_id long, new_id long")
    got = mutate.import_children(make(spark, [(5, 1, "a")], LINE), make(spark, [(5, 3, "b"), (2, 3, "c"), (4, 9, "no")], LINE), ids)
    assert rows(got) == [(5, 1, "a"), (6, 8, "c"), (7, 8, "b")]
