"""Stateful rules over streams: each has a batch twin in operators and folds events in the order that the twin sorts them.

Keyed state lives in the RocksDB state store (the session must set it as provider).  Claims leave by TTL, items that have ended,
leases and digests by event-time timers 30 days after their last event, files when a scan no longer has them, due records when
they are told.  `presence` and `progress` keep a row for each machine and item.  Event times are epoch seconds in the rows; a
batch's rows are sorted by (ts, seq) per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import intake as I
from ..operators import lifecycle as L
from ..staging import release, stage

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETENTION_MS = I.RETENTION * 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _all(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch in order."""
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Fold(StatefulProcessor):
    """A state of one row for each key, carried from batch to batch."""

    state = ""
    ttl: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state, self.ttl)

    def close(self) -> None:
        pass


# ST02
class Stability(StatefulProcessor):
    """Emits an observation when size and time repeat in the machine's very next scan.

    Keyed by machine and a share of the paths.  A file that a scan no longer has can't be stable in the scan after it, so what
    was last seen before the last two scans is forgotten: the state is the files of two scans.
    """

    output = "machine_id string, path string, scan_no long, size long, modified_secs long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "path string", "scan_no long, size long, modified_secs long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out, last = {}, [], 0
        for r in _all(rows, ["scan_no"]).itertuples():
            path = r.path
            if path not in now:
                now[path] = tuple(self.seen.getValue((path,))) if self.seen.containsKey((path,)) else None
            before, found = now[path], (int(r.scan_no), int(r.size), int(r.modified_secs))
            if before and before[0] == found[0] - 1 and before[1:] == found[1:]:
                out.append((r.machine_id, path, *found))
            now[path], last = found, max(last, found[0])
        gone = [k[0] for k, v in self.seen.iterator() if k[0] not in now and v[0] < last - 1]
        for path in gone:
            self.seen.removeKey((path,))
        for path, found in now.items():
            if found[0] >= last - 1:
                self.seen.updateValue((path,), found)
            elif self.seen.containsKey((path,)):
                self.seen.removeKey((path,))
        if out:
            yield pd.DataFrame(out, columns=["machine_id", "path", "scan_no", "size", "modified_secs"])


# ST03, ST12
class Claims(_Fold):
    """Claim state by document key; emits the state after each batch.  An event that loses to a later heartbeat is refused.

    At one instant a renewal or an end comes before a claim, so that a last-instant renewal beats a takeover.
    """

    state, ttl = "owner string, state string, lease long, beat long, refused int", RETENTION_MS
    output = "key string, owner string, state string, refused int"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.kept.get() if self.kept.exists() else I.FREE
        for r in _all(rows, I.CLAIM_ORDER).itertuples():
            now = I.next_claim(tuple(now), (int(r.ts), r.machine_id, r.event, int(r.lease_expires_at)))
        self.kept.update(tuple(now))
        yield pd.DataFrame([(key[0], now[0], now[1], now[4])], columns=["key", "owner", "state", "refused"])


class _Timed(_Fold):
    """A fold whose last state field is the time (seconds) of the key's one timer, 0 for none."""

    def wait(self, before: int, at: int) -> None:
        """Have the timer at `at` instead of `before`; 0 for none."""
        if before and before != at:
            self.handle.deleteTimer(before * 1000)
        if at and before != at:
            self.handle.registerTimer(at * 1000)


# ST05
class Lifecycle(_Timed):
    """Status by item; emits it after each batch with the number of illegal moves so far.

    An item that has ended is forgotten 30 days after its last event; live items are as many as the queue has.
    """

    state = "status string, illegal int, timer long"
    output = "item long, status string, illegal int"
    general = {(a, b) for a, bs in L.STATUS_MOVES.items() for b in bs}
    named = {(e, a, b) for e, moves in L.NAMED_MOVES.items() for a, b in moves}
    ended = frozenset(("failed", "canceled", "completed"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, illegal, timer = self.kept.get() if self.kept.exists() else ("queued", 0, 0)
        found = _all(rows, ["seq"])
        for r in found.itertuples():
            if (status, r.to_status) in self.general or (r.event, status, r.to_status) in self.named:
                status = r.to_status
            else:
                illegal += 1
        at = max(timer, int(found.ts.max()) + I.RETENTION)
        self.wait(timer, at)
        self.kept.update((status, illegal, at))
        yield pd.DataFrame([(key[0], status, illegal)], columns=["item", "status", "illegal"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, illegal, _ = self.kept.get()
        if status in self.ended:
            self.kept.clear()
        else:
            self.kept.update((status, illegal, 0))
        yield from ()


# ST08
class OnChange(_Timed):
    """Emits a row if its digest differs from the key's last one, or if that is more than 30 days old and so forgotten."""

    state = "digest long, ts long, timer long"
    output = "key string, ts long, digest long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, ts, timer = self.kept.get() if self.kept.exists() else (None, 0, 0)
        out = []
        for r in _all(rows, ["ts", "seq"]).itertuples():
            if last != int(r.digest) or int(r.ts) - ts > I.RETENTION:
                out.append((key[0], int(r.ts), int(r.digest)))
            last, ts = int(r.digest), int(r.ts)
        self.wait(timer, ts + I.RETENTION)
        self.kept.update((last, ts, ts + I.RETENTION))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "digest"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()


# ST06
class Leases(_Timed):
    """Gives an item back when its owner's lease is over and no heartbeat came for 60 s, told by the next event or by an event-time timer.

    How often it failed is forgotten when nothing was heard of the owner for 30 days after that.
    """

    state = "end long, failures int, timer long"
    output = "owner string, item long, ts long, failures int"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, failures, timer = self.kept.get() if self.kept.exists() else (0, 0, 0)
        out = []
        for r in _all(rows, ["ts", "seq"]).itertuples():
            if end and int(r.ts) > end:
                failures += 1
                out.append((*key, end, failures))
            end = max(int(r.lease_expires_at), int(r.ts) + L.SESSION_SECONDS)
        self.wait(timer, end)
        self.kept.update((end, failures, end))
        if out:
            yield pd.DataFrame(out, columns=["owner", "item", "ts", "failures"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, failures, timer = self.kept.get()
        if not end:
            self.kept.clear()
            return
        self.wait(0, timer + I.RETENTION)
        self.kept.update((0, failures + 1, timer + I.RETENTION))
        yield pd.DataFrame([(*key, end, failures + 1)], columns=["owner", "item", "ts", "failures"])


# ST04, ST11
class Due(_Fold):
    """Holds the latest record of a key until its time `due` has come by event time, then emits the key and forgets it."""

    state = "due long"
    output = "key string, due long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            self.handle.deleteTimer(self.kept.get()[0] * 1000)
        due = int(_all(rows, ["seen_at", "due"]).iloc[-1].due)
        self.kept.update((due,))
        # a time that has passed is told by the next watermark
        self.handle.registerTimer(max(due * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (due,) = self.kept.get()
        self.kept.clear()
        yield pd.DataFrame([(key[0], due)], columns=["key", "due"])


def _keyed(stream: DataFrame, key: str, processor: type[_Fold], mode: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor(), processor.output, mode, "ProcessingTime" if processor.ttl else "None")


def stable_files(stream: DataFrame, shares: int = 64) -> DataFrame:
    """machine_id, path, scan_no, size, modified_secs of stable files; each machine's scans must come in order."""
    shared = stream.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(shares)))
    return shared.groupBy("machine_id", "share").transformWithStateInPandas(Stability(), Stability.output, "Append", "None")


def _timed(stream: DataFrame, keys: list[str], processor: type[_Timed], mode: str, late: str) -> DataFrame:
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(processor(), processor.output, mode, "EventTime")


def claim_states(stream: DataFrame) -> DataFrame:
    return _keyed(I.in_claim_order(stream), "key", Claims, "Update")


def item_states(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """item, status, illegal; stream: item, ts, seq, event, to_status.  Events later than `late` are lost."""
    return _timed(stream, ["item"], Lifecycle, "Update", late)


def changes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return _timed(stream, ["key"], OnChange, "Append", late)


def expired_leases(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """owner, item, ts, failures; stream: owner, item, ts, seq, lease_expires_at."""
    return _timed(stream, ["owner", "item"], Leases, "Append", late)


# ST01
FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified_secs of files as they come, by Spark's file source; S01's rules."""
    from ..functions import names as N
    from ..sources.files import LISTED

    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)
    name = N.leaf(F.col("path"))
    keep = (F.col("length") > 0) & ~name.startswith(".") & ~name.startswith("~$") & N.path_extension(F.col("path")).isin(LISTED)
    return files.filter(keep).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_secs"))


def due(stream: DataFrame, key: str, late: str = "0 seconds") -> DataFrame:
    """key, due of the records (key, due, seen_at) when their time comes, by the clock of seen_at."""
    timed = stream.select(F.col(key).alias("key"), "due", "seen_at", F.timestamp_seconds("seen_at").alias("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Due(), Due.output, "Append", "EventTime").withColumnRenamed("key", key)


# ST04
def released(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """path, due: another machine's files (path, modified_secs, seen_at) 120 s after their time; one that comes earlier is held till then."""
    return due(I.courtesy_due(stream), "path", late)


# ST11
def pruned(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """file_name, due: coordination files (A11's columns and seen_at) when they may go: 30 days for good ones, a day for malformed ones."""
    return due(I.retention_due(stream), "file_name", late)


# ST07
def presence(stream: DataFrame) -> DataFrame:
    """machine_id, last_seen_at in update mode."""
    return stream.groupBy("machine_id").agg(F.max("last_seen_at").alias("last_seen_at"))


def active_machines(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, machine_id, last_seen_at: the machines of each ten-minute window of event time; late rows end the window's state."""
    timed = stream.withColumn("at", F.timestamp_seconds("last_seen_at")).withWatermark("at", late)
    # one row for each window and machine, so that the count is exact and no window's machines meet in one state
    return timed.groupBy(F.window("at", "10 minutes"), "machine_id").agg(F.max("last_seen_at").alias("last_seen_at")).select(F.unix_timestamp("window.start").alias("start"), "machine_id", "last_seen_at")


# ST09
def progress(stream: DataFrame) -> DataFrame:
    """item, percent (0 to 100, null without a total) of the latest event, in update mode."""
    percent = F.when(F.col("total") > 0, F.least(F.greatest(F.col("current") / F.col("total") * 100, F.lit(0.0)), F.lit(100.0)))
    return stream.groupBy("item").agg(F.max_by(F.struct(percent.alias("percent")), "ts").alias("p")).select("item", "p.percent")


# ST10
FIRST = ["source_path_key", "source_hash"]


def first_rows(batch: DataFrame, number: int, folder: str, buckets: int = 64) -> DataFrame:
    """A row of each path key and hash that no batch of a smaller number had; staged.

    What was there is a table in folder, dealt by a hash of the keys; only the buckets that the batch touches are read.  A batch
    that is repeated finds the same rows and writes the same part of the table again.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*FIRST), F.lit(buckets)).cast("int")
    rows = stage(batch.dropDuplicates(FIRST).withColumn("bucket", bucket), "arrived")
    spark.createDataFrame([], "source_path_key string, source_hash string, bucket int, batch long").write.mode("ignore").partitionBy("bucket", "batch").parquet(folder)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
    known = spark.read.schema("source_path_key string, source_hash string, bucket int, batch long").parquet(folder).filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
    known = known.select(*(F.col(c).alias(f"known_{c}") for c in FIRST))
    fresh = rows.join(known, F.col(FIRST[0]).eqNullSafe(F.col(f"known_{FIRST[0]}")) & F.col(FIRST[1]).eqNullSafe(F.col(f"known_{FIRST[1]}")), "left_anti")
    out = stage(fresh, "fresh")
    out.select(*FIRST, "bucket", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
    release(rows)
    return out.drop("bucket")


def enqueue(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict):
    """Start a stream that hands the first row of each path key and hash to handle(rows, batch), once for ever; no state is kept in the stream."""
    write = stream.writeStream.foreachBatch(lambda batch, number: handle(first_rows(batch, number, folder), number))
    return write.option("checkpointLocation", checkpoint).trigger(**trigger).start()
