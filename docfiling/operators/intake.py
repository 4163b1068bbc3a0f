"""Shared-folder intake: roots, origins, claims, stability, retention.  Times are epoch seconds; `as_of` stands for now."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_LEFT, PRESENCE_AGE, PRESENCE_ACTIVE = 450, 300, 600
COURTESY, HEARTBEAT_GRACE = 120, 900
RETENTION, MALFORMED_GRACE = 30 * 86400, 86400


# J13
def with_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) with kind and root of the longest root that holds them, whole components and any case; null without one.

    Each path's prefixes are looked up by equality, so no pair of a path and a root that doesn't fit is ever made.
    """
    fold = lambda c: F.lower(F.regexp_replace(F.translate(c, "\\", "/"), "(?<!/)/+$", ""))
    parts = F.split(fold(F.col("path")), "/")
    paths = files.select("path").distinct()
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("prefix"))
    known = roots.select("kind", "root", fold(F.col("root")).alias("prefix")).filter("prefix <> ''")
    best = prefixes.join(known, "prefix").groupBy("path").agg(F.max_by(F.struct("kind", "root"), F.struct(F.char_length("prefix"), "root")).alias("r"))
    return files.join(best, "path", "left").select(*files.columns, F.col("r.kind").alias("kind"), F.col("r.root").alias("root"))


# W12
def stable(observations: DataFrame) -> DataFrame:
    """observations (machine_id, path, scan_no, size, modified_secs) with stable: the same size and time as in the scan just before."""
    by_path = Window.partitionBy("machine_id", "path").orderBy("scan_no")
    before = F.lag(F.struct("scan_no", "size", "modified_secs")).over(by_path)
    same = (before["scan_no"] == F.col("scan_no") - 1) & (before["size"] == F.col("size")) & (before["modified_secs"] == F.col("modified_secs"))
    return observations.withColumn("stable", F.coalesce(same, F.lit(False)))


# A09
def first_origins(observed: DataFrame) -> DataFrame:
    """key, machine_id of the first machine that observed it; the smaller id of two at once."""
    return observed.groupBy("key").agg(F.min_by("machine_id", F.struct("observed_at", "machine_id")).alias("machine_id"))


# J14
def decisions(files: DataFrame, claims: DataFrame, origins: DataFrame, backlog: DataFrame, machine: str, as_of: int, take_others: bool) -> DataFrame:
    """key, decision for stable files (key, relative_path, modified_secs) as `machine` sees them.

    mine_claimed, mine_done, other_claimed, other_done; without a claim: claim, claim_new_local (and mark the origin), or hold.
    """
    df = files.join(claims.select("key", F.col("machine_id").alias("owner"), "state"), "key", "left")
    df = df.join(origins.select("key", F.col("machine_id").alias("origin")), "key", "left")
    df = df.join(backlog.select("relative_path", F.lit(True).alias("old")).distinct(), "relative_path", "left")
    others = F.lit(take_others) & (as_of - F.col("modified_secs") >= COURTESY)
    claimed = F.concat(F.when(F.col("owner") == machine, "mine_").otherwise("other_"), F.col("state"))
    free = (
        F.when(F.col("origin") == machine, "claim")
        .when(F.col("origin").isNotNull() | F.col("old").isNotNull(), F.when(others, "claim").otherwise("hold"))
        .otherwise("claim_new_local")
    )
    return df.select("key", F.when(F.col("owner").isNotNull(), claimed).otherwise(free).alias("decision"))


# A10
def intake_status(decided: DataFrame, machines: DataFrame) -> DataFrame:
    """One row: held_for_others, claimed_by_others, processed_here, machines (ids in order)."""
    count = lambda d: F.count_if(F.col("decision") == d)
    totals = decided.agg(count("hold").alias("held_for_others"), count("other_claimed").alias("claimed_by_others"), count("mine_done").alias("processed_here"))
    return totals.crossJoin(machines.agg(F.array_sort(F.collect_set("machine_id")).alias("machines")))  # one row each


# A11
def retention_due(records: DataFrame) -> DataFrame:
    """records (kind, key, file_name, readable, state, claimed_at, heartbeat_at, done_at, observed_at, last_seen_at, file_mtime) with due.

    Done claims, heartbeats, origins and presence go after 30 days, unreadable files and conflict copies after a day.
    """
    good = F.col("readable") & (F.col("file_name") == F.concat("key", F.lit(".json")))
    at = (
        F.when((F.col("kind") == "claim") & (F.col("state") == "done"), F.coalesce("done_at", "claimed_at"))
        .when(F.col("kind") == "claim", F.col("heartbeat_at"))
        .when(F.col("kind") == "origin", F.col("observed_at"))
        .otherwise(F.col("last_seen_at"))
    )
    return records.withColumn("due", F.when(F.coalesce(good, F.lit(False)), at + RETENTION).otherwise(F.col("file_mtime") + MALFORMED_GRACE))


def retention(records: DataFrame, as_of: int) -> DataFrame:
    """records with keep; see retention_due."""
    return retention_due(records).withColumn("keep", F.coalesce(F.col("due") > as_of, F.lit(True))).drop("due")


# P13
def lease_due(lease_expires_at: Column, as_of: int) -> Column:
    return lease_expires_at - as_of < LEASE_LEFT


def presence_due(last_seen_at: Column, as_of: int) -> Column:
    return as_of - last_seen_at >= PRESENCE_AGE


def presence_active(last_seen_at: Column, as_of: int) -> Column:
    """Seen within ten minutes; a time ahead of as_of counts as seen."""
    return as_of - last_seen_at <= PRESENCE_ACTIVE


# T03, T04
def unseen(owned: DataFrame, visited: DataFrame) -> DataFrame:
    return owned.join(visited.select("key"), "key", "left_anti")


def live_only(observed: DataFrame, live: DataFrame) -> DataFrame:
    return observed.join(live.select("path"), "path", "left_semi")


# ST03, ST12
def next_claim(state: tuple, event: tuple) -> tuple:
    """The claim (owner, state, lease, beat, refused) after an event (ts, machine_id, event, lease_expires_at).

    claim takes what is free, its own, or what may be taken over: the lease has run out and there was no heartbeat for 900 s.
    renew, done and release count only for the owner; done is final.
    """
    (owner, status, lease, beat, refused), (ts, machine, what, until) = state, event
    mine = owner == machine and status == "claimed"
    over = status == "claimed" and ts >= lease and ts >= beat + HEARTBEAT_GRACE
    if (what == "claim" and (status == "free" or mine or over)) or (what == "renew" and mine):
        return machine, "claimed", until, ts, refused
    if what == "done" and mine:
        return machine, "done", lease, ts, refused
    if what == "release" and mine:
        return None, "free", lease, ts, refused
    return owner, status, lease, beat, refused + 1


FREE = (None, "free", 0, 0, 0)
#: At one instant what the owner does comes before a claim, so that a last-instant renewal beats a takeover.
CLAIM_ORDER = ["ts", "late", "seq"]


def in_claim_order(events: DataFrame) -> DataFrame:
    return events.withColumn("late", (F.col("event") == "claim").cast("int"))


# ST03's batch twin
def folded_claims(events: DataFrame) -> DataFrame:
    """key, owner, state (claimed, done, free), refused, after the events (key, ts, seq, machine_id, event, lease_expires_at) in order.

    Events are dealt by key, sorted there and folded as they come by; only one key's state is held at a time, however long its log.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, FREE
        kind = pa.schema([("key", pa.string()), ("owner", pa.string()), ("state", pa.string()), ("refused", pa.int32())])
        for batch in batches:
            done = []
            for key, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, state[0], state[1], state[4]))
                    now, state = key, FREE
                state = next_claim(state, tuple(event))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, state[0], state[1], state[4]), kind, strict=True)], schema=kind)

    dealt = in_claim_order(events.filter("key is not null")).repartition("key").sortWithinPartitions("key", *CLAIM_ORDER)
    return dealt.select("key", "ts", "machine_id", "event", "lease_expires_at").mapInArrow(run, "key string, owner string, state string, refused int")


# ST06's batch twin
def expired_leases(events: DataFrame, as_of: Column, silence: int) -> DataFrame:
    """owner, item, ts, failures: leases that run out before the owner's next sign of life, or before as_of.

    events: owner, item, ts, seq, lease_expires_at.  A lease is over when its time is up and no heartbeat came for `silence` seconds.
    """
    by_item = Window.partitionBy("owner", "item").orderBy("ts", "seq")
    end = F.greatest(F.col("lease_expires_at"), F.col("ts") + silence)
    df = events.withColumn("end", end).withColumn("then", F.coalesce(F.lead("ts").over(by_item), as_of)).filter(F.col("then") > F.col("end"))
    return df.select("owner", "item", F.col("end").alias("ts"), F.row_number().over(by_item).alias("failures"))


# ST04's and ST11's batch twin
def due(records: DataFrame, key: str, as_of: Column) -> DataFrame:
    """key, due of the latest record (by seen_at) of each key whose time `due` has come at as_of."""
    return records.groupBy(key).agg(F.max_by("due", F.struct("seen_at", "due")).alias("due")).filter(F.col("due") <= as_of)


def courtesy_due(files: DataFrame) -> DataFrame:
    """files (path, modified_secs) with due: when another machine's file may be taken."""
    return files.withColumn("due", F.col("modified_secs") + COURTESY)


# ST08's batch twin
def changes(rows: DataFrame) -> DataFrame:
    """key, ts, digest of the rows (key, ts, seq, digest) that differ from the row before, or come more than 30 days after it."""
    by_key = Window.partitionBy("key").orderBy("ts", "seq")
    told = ~F.col("digest").eqNullSafe(F.lag("digest").over(by_key)) | (F.col("ts") - F.lag("ts").over(by_key) > RETENTION)
    return rows.withColumn("told", told).filter("told").select("key", "ts", "digest")


# ST07's batch twin
def machines_by_window(rows: DataFrame, seconds: int = PRESENCE_ACTIVE) -> DataFrame:
    """start, machines: different machines seen in each window of ten minutes."""
    start = (F.floor(F.col("last_seen_at") / seconds) * seconds).alias("start")
    return rows.select(start, "machine_id").distinct().groupBy("start").agg(F.count("*").alias("machines"))


# T01
def listed(rows: DataFrame, by: str) -> DataFrame:
    """rows in order: by id, by relative path, by lower-cased path (rows of equal ones by the path as it is), or machines by id."""
    order = {"id": ["id"], "relative_path": ["relative_path"], "path": [F.lower("path"), "path"], "machine_id": ["machine_id"]}[by]
    return rows.orderBy(*order)
