"""Folder intake, recognition queue and search logs as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed values of the folder source.
EXTENSIONS = ("pdf", "md", "txt", "docx", "epub", "png", "jpg", "jpeg")
TEMPORARY = (".part", ".tmp", ".crdownload", ".download")
STABLE_SECONDS, DUPLICATE_SECONDS, MOST_TRIES = 60, 3600, 3

LISTING = "collection string, name string, size long, mtime timestamp, seen_at timestamp"


def wanted(name: Column) -> Column:
    """Files to take in: not hidden, no lock or half-loaded file, a known extension."""
    low = F.lower(name)
    bad = name.startswith(".") | name.startswith("~$")
    for end in TEMPORARY:
        bad = bad | low.endswith(end)
    return ~bad & F.regexp_extract(low, r"\.([^.]+)$", 1).isin(*EXTENSIONS)


def stable(mtime: Column, now: Column, seconds: int = STABLE_SECONDS) -> Column:
    """A file that nobody has written to for a while."""
    return now.cast("long") - mtime.cast("long") >= seconds


def scan(listing: DataFrame, docs: DataFrame, failed: DataFrame) -> DataFrame:
    """One look at a folder: each wanted file as new, duplicate, unstable or failed (until it changes)."""
    f = listing.filter(wanted(F.col("name")))
    known = docs.select("collection", F.col("filename").alias("name"), F.lit(True).alias("known")).distinct()
    bad = failed.select("collection", "name", F.col("mtime").alias("bad_mtime"))
    x = f.join(known, ["collection", "name"], "left").join(bad, ["collection", "name"], "left")
    verdict = F.when(F.col("known"), "duplicate").when(F.col("bad_mtime").eqNullSafe(F.col("mtime")), "failed").when(~stable(F.col("mtime"), F.col("seen_at")), "unstable").otherwise("new")
    return x.select("collection", "name", "mtime", verdict.alias("verdict"))


def vanished(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose file is gone; virtual ones never had one."""
    return docs.filter(~F.coalesce("original_virtual", F.lit(False))).join(listing.select("collection", F.col("name").alias("filename")), ["collection", "filename"], "left_anti")


class _Watched(StatefulProcessor):
    """A file's last change, and whether it was given out; a timer stands at the time when it has been left alone for long enough."""

    def __init__(self, seconds: int, forget_after: int) -> None:
        self.seconds, self.forget_after = seconds, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "mtime timestamp, size long, given boolean", self.forget_after * 1000)

    def _rows(self, key, mtime, size) -> pd.DataFrame:
        return pd.DataFrame({"collection": [key[0]], "name": [key[1]], "mtime": [mtime], "size": [size]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values(["seen_at", "mtime"]).iloc[-1]
        had = self.file.get() if self.file.exists() else None
        if had is not None and (had[0], had[1]) == (last["mtime"], last["size"]):
            return
        for at in list(self.handle.listTimers()):  # it is written to again: the wait begins anew
            self.handle.deleteTimer(at)
        ripe = int(last["mtime"].timestamp() * 1000) + self.seconds * 1000
        now = ripe <= timerValues.getCurrentProcessingTimeInMs()
        self.file.update((last["mtime"].to_pydatetime(), int(last["size"]), now))
        if now:
            yield self._rows(key, last["mtime"], int(last["size"]))
        else:
            self.handle.registerTimer(ripe)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self.file.get() if self.file.exists() else None
        if had is not None and not had[2]:
            self.file.update((had[0], had[1], True))
            yield self._rows(key, had[0], had[1])

    def close(self) -> None:
        pass


#: Seconds after which the state of a key that nothing came for is dropped.
FORGET_SECONDS = 90 * 24 * 3600


def _timed(spark: SparkSession) -> None:
    """Timers and expiry need the state store that keeps keys on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch(listings: DataFrame, seconds: int = STABLE_SECONDS, forget_after: int = FORGET_SECONDS) -> DataFrame:
    """Streaming: a file is given out once for each change of it, when it has been left alone for ``seconds``.

    A file that is listed once comes out by itself when its time has come: a listing
    need not repeat it. One that changes while it waits begins its wait anew. A file that failed
    afterwards is given out again when it has changed, and not before.
    """
    _timed(listings.sparkSession)
    good = listings.filter(wanted(F.col("name"))).select("collection", "name", "size", "mtime", "seen_at")
    shape = "collection string, name string, mtime timestamp, size long"
    return good.groupBy("collection", "name").transformWithStateInPandas(_Watched(seconds, forget_after), shape, "append", "ProcessingTime")


def judged(files: DataFrame, docs: DataFrame, failed: DataFrame) -> DataFrame:
    """Streaming (or not): files given out as new, duplicate or failed, by the documents and failures as they stand when a batch runs."""
    known = docs.select("collection", F.col("filename").alias("name"), F.lit(True).alias("known")).distinct()
    bad = failed.groupBy("collection", "name").agg(F.max("mtime").alias("bad_mtime"))
    x = files.join(known, ["collection", "name"], "left").join(bad, ["collection", "name"], "left")
    verdict = F.when(F.col("known"), "duplicate").when(F.col("bad_mtime").eqNullSafe(F.col("mtime")), "failed").otherwise("new")
    return x.select("collection", "name", "mtime", verdict.alias("verdict"))


class _Tried(StatefulProcessor):
    """Tries of a page's recognition; ``changed`` begins anew."""

    def __init__(self, forget_after: int) -> None:
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "tries int, status string", self.forget_after * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tries, status = self.page.get() if self.page.exists() else (0, "queued")
        for pdf in rows:
            for outcome in pdf["outcome"]:
                if outcome == "changed":
                    tries, status = 0, "queued"
                elif outcome in ("done", "error") and status != "done" and tries < MOST_TRIES:
                    tries, status = tries + 1, outcome
        self.page.update((tries, status))
        yield pd.DataFrame({"doc_id": [key[0]], "page_num": [key[1]], "status": [status], "tries": [tries]})

    def close(self) -> None:
        pass


def ocr_queue(requests: DataFrame, forget_after: int = FORGET_SECONDS) -> DataFrame:
    """Streaming (doc_id, page_num, outcome): state of each page's recognition; errors are tried three times, until the page has changed; old pages are forgotten."""
    _timed(requests.sparkSession)
    shape = "doc_id long, page_num int, status string, tries int"
    return requests.groupBy("doc_id", "page_num").transformWithStateInPandas(_Tried(forget_after), shape, "update", "ProcessingTime")


def pages_to_do(pages: DataFrame, states: DataFrame, resume: bool = True) -> DataFrame:
    """Pages without a done state; all of them where a run isn't a continuation."""
    return pages.join(states.filter("status = 'done'"), ["doc_id", "page_num"], "left_anti") if resume else pages


def finished(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Each document: done, done_with_errors, or running while pages are open."""
    x = pages.join(states.select("doc_id", "page_num", "status"), ["doc_id", "page_num"], "left").groupBy("doc_id").agg(F.count_if(F.col("status").isNull()).alias("left_"), F.count_if(F.col("status") == "error").alias("errors"))
    return x.select("doc_id", F.when(F.col("left_") > 0, "running").when(F.col("errors") > 0, "done_with_errors").otherwise("done").alias("state"))


def misses(events: DataFrame) -> DataFrame:
    """Streaming: zero-hit searches counted by query."""
    return events.filter("total_docs = 0").groupBy("query").agg(F.count("*").alias("hits"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))


def once_an_hour(notices: DataFrame) -> DataFrame:
    """Streaming: a duplicate is reported once within the window."""
    return notices.withWatermark("seen_at", f"{DUPLICATE_SECONDS} seconds").dropDuplicatesWithinWatermark(["collection", "name"])


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """The driver's events as a stream of parquet files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def click_log(events: DataFrame, clicks: DataFrame, within: str = "1 hour") -> DataFrame:
    """Streaming: search events (id, query, ts, ...) with whether a click (event_id, clicked_at) came within the time; each event once."""
    e = events.withWatermark("ts", "10 minutes")
    c = clicks.withWatermark("clicked_at", within).select(F.col("event_id").alias("id"), "clicked_at").dropDuplicatesWithinWatermark(["id"])
    e, c = e.alias("e"), c.alias("c")
    near = (F.col("e.id") == F.col("c.id")) & (F.col("c.clicked_at") >= F.col("e.ts")) & (F.col("c.clicked_at") <= F.col("e.ts") + F.expr(f"INTERVAL {within}"))
    return e.join(c, near, "left_outer").select("e.*", F.col("c.clicked_at").isNotNull().alias("clicked"))


def keep_status(folder: str):
    """A ``foreachBatch`` function that writes each batch's summary of verdicts (new, duplicate, unstable, failed) beside its number; a batch that runs twice is written once."""

    def write(batch: DataFrame, number: int) -> None:
        scan_status(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def scan_status(verdicts: DataFrame) -> DataFrame:
    """Counts of a look at each collection's folder, and the names that wait or failed."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"{v}_files")
    names = lambda v: F.array_sort(F.collect_set(F.when(F.col("verdict") == v, F.col("name")))).alias(f"{v}_names")
    return verdicts.groupBy("collection").agg(*map(n, ("new", "duplicate", "unstable", "failed")), *map(names, ("unstable", "failed")))
