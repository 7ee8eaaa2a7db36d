"""A folder as a source, watching it with timers, and state that expires."""

import datetime as dt
import os
import time

import pytest

from foliant.sources import folder
from foliant.streaming import intake


def put(root, path, text="x", age=0):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (time.time() - age,) * 2)
    return p


def started(df, tmp_path, name, mode="append", **trigger):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def until(spark, name, want, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.table(name).collect()
        if want(rows):
            return rows
        time.sleep(0.3)
    raise AssertionError(f"{name} has {rows}")


def test_listing_of_a_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "shelves"
    put(root, "a/one.pdf", "12345", age=100)
    put(root, "a/deep/er.pdf")
    put(root, "b/in/two.md")
    put(root, "b/ünï 字.md")
    put(root, ".hidden/x.md")
    put(root, "loose.md")
    os.symlink(root / "a/one.pdf", root / "a/link.pdf")
    rows = {(r.collection, r.name): r for r in folder.listing(spark, str(root)).collect()}
    assert rows.keys() == {("a", "one.pdf"), ("b", "ünï 字.md")}
    one = rows["a", "one.pdf"]
    assert one.size == 5 and abs(one.mtime.timestamp() - os.stat(root / "a/one.pdf").st_mtime) < 1e-3 and one.seen_at > one.mtime
    assert [(r.collection, r.name) for r in folder.listing(spark, str(root), "in").collect()] == [("b", "two.md")]
    monkeypatch.setattr(folder, "EACH", 1)
    assert [p.value for p in folder._partitions({"a/x": [1, 2], "a/y": [3, 4]})] == [[("a/x", [1, 2])], [("a/y", [3, 4])]] and folder._partitions({})[0].value == []
    (tmp_path / "none").mkdir()
    assert folder.listing(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_a_folder_gives_each_change_once_and_starts_again(spark, tmp_path):
    root = tmp_path / "shelves"
    put(root, "a/one.pdf")
    put(root, "a/two.pdf")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def look():
        q = folder.listings(spark, str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.name, r.size) for r in spark.read.parquet(out).collect())

    assert look() == [("one.pdf", 1), ("two.pdf", 1)]
    assert look() == [("one.pdf", 1), ("two.pdf", 1)]  # from the checkpoint: nothing twice
    put(root, "b/three.pdf", "333")
    put(root, "a/one.pdf", "changed")
    (root / "a/two.pdf").unlink()
    assert look() == [("one.pdf", 1), ("one.pdf", 7), ("three.pdf", 3), ("two.pdf", 1)]
    assert look() == [("one.pdf", 1), ("one.pdf", 7), ("three.pdf", 3), ("two.pdf", 1)]


def test_a_file_listed_once_comes_out_when_its_time_has_come(spark, tmp_path):
    root = tmp_path / "shelves"
    put(root, "s/old.pdf", age=1000)
    put(root, "s/new.pdf")
    put(root, "s/half.part", age=1000)
    q = started(intake.watch(folder.listings(spark, str(root)), seconds=6), tmp_path, "watched")
    try:
        rows = until(spark, "watched", lambda r: r)
        assert [r.name for r in rows] == ["old.pdf"]
        rows = until(spark, "watched", lambda r: len(r) == 2)
        assert rows[1].name == "new.pdf" and time.time() - rows[1].mtime.timestamp() >= 6
        # A file that is written to while it waits begins to wait anew, and a changed one comes out again.
        put(root, "s/slow.pdf", "1")
        time.sleep(3)
        put(root, "s/slow.pdf", "12")
        put(root, "s/old.pdf", "more", age=500)
        rows = until(spark, "watched", lambda r: len(r) == 4)
        assert [(r.name, r.size) for r in rows[2:]] == [("old.pdf", 4), ("slow.pdf", 2)]
        time.sleep(2)
        assert spark.table("watched").count() == 4
    finally:
        q.stop()
    assert q.exception() is None


def test_files_given_out_are_judged(spark, tmp_path):
    when = dt.datetime(2026, 1, 1)
    files = spark.createDataFrame([("s", n, when, 1) for n in ("a.pdf", "b.pdf", "c.pdf", "d.pdf")], "collection string, name string, mtime timestamp, size long")
    docs = spark.createDataFrame([("s", "a.pdf"), ("t", "b.pdf"), ("s", "a.pdf")], "collection string, filename string")
    failed = spark.createDataFrame([("s", "c.pdf", when), ("s", "c.pdf", when - dt.timedelta(1)), ("s", "d.pdf", when - dt.timedelta(1))], "collection string, name string, mtime timestamp")
    assert {r.name: r.verdict for r in intake.judged(files, docs, failed).collect()} == {"a.pdf": "duplicate", "b.pdf": "new", "c.pdf": "failed", "d.pdf": "new"}
    files.write.parquet(str(tmp_path / "f"))
    q = started(intake.judged(spark.readStream.schema(files.schema).parquet(str(tmp_path / "f")), docs, failed), tmp_path, "verdicts", availableNow=True)
    q.awaitTermination(60)
    assert {r.name: r.verdict for r in spark.table("verdicts").collect()} == {"a.pdf": "duplicate", "b.pdf": "new", "c.pdf": "failed", "d.pdf": "new"}


@pytest.mark.parametrize("forget_after", [2, 3600])
def test_tries_of_a_page_are_forgotten_in_time(spark, tmp_path, forget_after):
    name, shape = f"tries{forget_after}", "doc_id long, page_num int, outcome string"
    batch = lambda n, rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    batch(0, [(1, 1, "error"), (1, 1, "error"), (1, 1, "error"), (1, 1, "done"), (2, 1, "error")])
    q = started(intake.ocr_queue(spark.readStream.schema(shape).parquet(str(tmp_path / "q")), forget_after), tmp_path, name, "update")
    try:
        rows = until(spark, name, lambda r: len(r) == 2)
        assert {r.doc_id: (r.status, r.tries) for r in rows} == {1: ("error", 3), 2: ("error", 1)}
        time.sleep(4)
        batch(1, [(1, 1, "done")])
        rows = until(spark, name, lambda r: len(r) == 3)
        assert (rows[2].status, rows[2].tries) == (("done", 1) if forget_after == 2 else ("error", 3))
        batch(2, [(2, 1, "changed")])
        rows = until(spark, name, lambda r: len(r) == 4)
        assert (rows[3].doc_id, rows[3].status, rows[3].tries) == (2, "queued", 0)
    finally:
        q.stop()
