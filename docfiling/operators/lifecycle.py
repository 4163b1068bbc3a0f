"""Audits and views of work-queue tables and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

# The moves of a receipt's stage and of an item's status.
STAGE_MOVES = {
    "planned": ["copied", "published", "rollback_required", "rolled_back"],
    "copied": ["verified", "rollback_required"],
    "verified": ["published", "rollback_required"],
    "published": ["complete", "rollback_required"],
    "rollback_required": ["rolled_back"],
}
STATUS_MOVES = {
    "queued": ["canceled"],
    "extracting": ["analyzing", "queued", "failed", "canceled"],
    "analyzing": ["ready", "needs_review", "queued", "failed", "canceled"],
    "ready": ["canceled"],
    "needs_review": ["ready", "canceled"],
}
#: event -> moves beyond the general ones
NAMED_MOVES = {
    "claim": [("queued", "extracting")],
    "retry": [("failed", "queued"), ("canceled", "queued"), ("needs_review", "applying")],
    "keep": [("ready", "completed"), ("needs_review", "completed")],
    "begin": [("ready", "applying"), ("completed", "applying")],
    "finish": [("applying", "completed"), ("applying", "ready")],
    "roll_back": [("applying", "completed"), ("applying", "ready")],
    "defer": [("applying", "needs_review")],
    "approve": [("ready", "ready"), ("needs_review", "ready")],
    "demote": [("ready", "needs_review")],
}
STATUSES = ["queued", "extracting", "analyzing", "ready", "needs_review", "failed", "canceled", "applying", "completed"]
SESSION_SECONDS, MOST_FAILURES = 60, 2


def _pairs(moves: dict[str, list[str]]) -> list[str]:
    return [f"{a}>{b}" for a, bs in moves.items() for b in bs]


def stage_may_follow(before: Column, after: Column) -> Column:
    """Whether a receipt may go from one stage to the other; a stage may repeat."""
    return (before == after) | F.concat_ws(">", before, after).isin(_pairs(STAGE_MOVES))


def status_may_follow(event: Column, before: Column, after: Column) -> Column:
    named = [f"{e}:{a}>{b}" for e, moves in NAMED_MOVES.items() for a, b in moves]
    move = F.concat_ws(">", before, after)
    return move.isin(_pairs(STATUS_MOVES)) | F.concat_ws(":", event, move).isin(named)


# W09
def latest_receipts(receipts: DataFrame) -> DataFrame:
    """The receipt with the largest id of each item."""
    row = F.struct(*receipts.columns)
    return receipts.groupBy("queue_item_id").agg(F.max_by(row, "id").alias("r")).select("r.*")


# J08
def item_view(items: DataFrame, proposals: DataFrame, receipts: DataFrame) -> DataFrame:
    """Items with proposal_json and their latest receipt (struct receipt), nulls where there is none."""
    latest = latest_receipts(receipts)
    latest = latest.select("queue_item_id", F.struct(*latest.columns).alias("receipt"))
    df = items.join(proposals.select(F.col("queue_item_id").alias("id"), "proposal_json"), "id", "left")
    return df.join(latest.withColumnRenamed("queue_item_id", "id"), "id", "left")


# J09
def active_receipts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """item_id, receipt_id where the active receipt exists and is the item's own."""
    return items.select(F.col("id").alias("queue_item_id"), F.col("active_receipt_id").alias("id")).join(receipts.select("id", "queue_item_id"), ["id", "queue_item_id"]).select(
        F.col("queue_item_id").alias("item_id"), F.col("id").alias("receipt_id")
    )


# J10
def abandoned(items: DataFrame, sessions: DataFrame, as_of: int) -> DataFrame:
    """id, action (recover, reconcile) of working items whose owner is gone."""
    working = items.filter(F.col("status").isin("extracting", "analyzing", "applying")).select("id", "status", "owner_session", "lease_expires_at")
    df = working.join(sessions.select(F.col("session_id").alias("owner_session"), "heartbeat_at"), "owner_session", "left")
    silent = (F.col("lease_expires_at") <= as_of) & (F.col("heartbeat_at") <= as_of - SESSION_SECONDS)
    gone = F.col("owner_session").isNull() | F.col("heartbeat_at").isNull() | F.coalesce(silent, F.lit(False))
    return df.filter(gone).select("id", F.when(F.col("status") == "applying", "reconcile").otherwise("recover").alias("action"))


# J11
def new_files(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of found (path, source_hash) whose folded path and hash aren't known, each once (the first path by order)."""
    keyed = found.withColumn("source_path_key", N.path_key(F.col("path")))
    once = keyed.groupBy("source_path_key", "source_hash").agg(F.min("path").alias("path"))
    return once.join(items.select("source_path_key", "source_hash"), ["source_path_key", "source_hash"], "left_anti").select("path", "source_path_key", "source_hash")


# J12
def drift(items: DataFrame, files: DataFrame) -> DataFrame:
    """id, outcome of ready items: apply, or needs_review with FILE_CHANGED or IO_ERROR.  files: path, sha256 (null: unreadable)."""
    ready = items.filter("status = 'ready'").select("id", F.col("source_path").alias("path"), "source_hash")
    df = ready.join(files.select("path", "sha256"), "path", "left")
    error = F.when(F.col("sha256").isNull(), "IO_ERROR").when(F.col("sha256") != F.col("source_hash"), "FILE_CHANGED")
    return df.select("id", F.when(error.isNull(), "apply").otherwise("needs_review").alias("outcome"), error.alias("error_code"))


# J18
def fates(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """path, item_id, fate (renamed, kept_original, unknown, or null while open), name: by the newest item of each path."""
    newest = items.groupBy("source_path").agg(F.max_by(F.struct("id", "status", "proposed_name"), "id").alias("i")).select("source_path", "i.*")
    latest = latest_receipts(receipts).select(F.col("queue_item_id").alias("id"), "direction", "stage", "destination_path")
    df = newest.join(latest, "id", "left")
    renamed = (F.col("direction") == "apply") & (F.col("stage") == "complete")
    fate = F.when((F.col("status") == "completed") & renamed, "renamed").when(F.col("status") == "completed", "kept_original").when(F.col("status") == "canceled", "unknown")
    name = F.when(fate == "renamed", F.coalesce(N.leaf(F.col("destination_path")), "proposed_name"))
    return df.select(F.col("source_path").alias("path"), F.col("id").alias("item_id"), fate.alias("fate"), name.alias("name"))


# J19
def reconcile_plan(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """id, action for receipts, by stage and by what files (path, sha256) hold at both ends.

    roll_back, complete, delete_source, or manual where the paths don't fit the stage.
    """
    at = lambda side: files.select(F.col("path").alias(f"{side}_path"), F.col("sha256").alias(f"{side}_hash"))
    df = receipts.join(at("source"), "source_path", "left").join(at("destination"), "destination_path", "left")
    source, there = F.col("source_hash").isNotNull(), F.col("destination_hash").isNotNull()
    same_source = F.coalesce(F.col("source_hash") == F.col("pre_hash"), F.lit(False))
    same_there = F.coalesce(F.col("destination_hash") == F.coalesce("post_hash", "pre_hash"), F.lit(False))
    undo = F.when(same_source & ~there, "roll_back")
    action = (
        F.when(F.col("stage").isin("planned", "copied", "verified", "rollback_required", "rolled_back"), undo)
        .when(F.col("stage") == "published", F.when(same_there & ~source, "complete").when(same_there & same_source, "delete_source"))
        .when(F.col("stage") == "complete", F.when(same_there & ~source, "complete"))
    )
    return df.select("id", F.coalesce(action, F.lit("manual")).alias("action"))


# A12
def exclusivity_violations(receipts: DataFrame) -> DataFrame:
    """Items with more than one receipt that is neither complete nor rolled back."""
    open_ = receipts.filter(~F.col("stage").isin("complete", "rolled_back"))
    return open_.groupBy("queue_item_id").agg(F.count("*").alias("n")).filter("n > 1")


# A13
def retries(events: DataFrame) -> DataFrame:
    """item, failures, status after an item's events in order: failure and recovered count, retry starts anew, 2 fail it."""
    start = F.struct(F.lit(0).alias("failures"), F.lit("queued").alias("status"))

    def step(s: Column, e: Column) -> Column:
        more = s["failures"] + 1
        failed = F.struct(more.alias("failures"), F.when(more >= MOST_FAILURES, "failed").otherwise("queued").alias("status"))
        return F.when(e["event"].isin("failure", "recovered"), failed).when(e["event"] == "retry", start).otherwise(s)

    log = events.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("log"))
    return log.select("item", F.aggregate("log", start, step).alias("s")).select("item", "s.failures", "s.status")


# A14
def status_counts(items: DataFrame) -> DataFrame:
    """rank, status, n in fixed order, statuses without items left out; one row 'none' if there are no items."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    counted = items.groupBy("status").agg(F.count("*").alias("n")).select(rank.cast("int").alias("rank"), "status", "n")
    nothing = items.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).alias("rank"), F.lit("none").alias("status"), "n")
    return counted.unionByName(nothing)


# A15
def same_content(items: DataFrame) -> DataFrame:
    """source_hash, n, first of hashes that stand at several paths."""
    return items.groupBy("source_hash").agg(F.count_distinct("source_path").alias("n"), F.min("source_path").alias("first")).filter("n > 1")


# W10
def stage_audit(events: DataFrame) -> DataFrame:
    """Illegal neighbours in the stage events of a receipt: id, seq, before, after."""
    before = F.lag("to_status").over(Window.partitionBy("id").orderBy("seq"))
    df = events.withColumn("before", before).filter(F.col("before").isNotNull())
    return df.filter(~stage_may_follow(F.col("before"), F.col("to_status"))).select("id", "seq", "before", F.col("to_status").alias("after"))


# W11
def transition_audit(events: DataFrame) -> DataFrame:
    """Item events whose move isn't allowed: id, seq, event, from_status, to_status."""
    ok = status_may_follow(F.col("event"), F.col("from_status"), F.col("to_status"))
    return events.filter(~F.coalesce(ok, F.lit(False))).select("id", "seq", "event", "from_status", "to_status")


# ST05's batch twin
def folded_status(events: DataFrame) -> DataFrame:
    """item, status, illegal: the status after an item's moves in order, illegal ones leaving it as it is."""
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("illegal"))

    def step(s: Column, e: Column) -> Column:
        ok = F.coalesce(status_may_follow(e["event"], s["status"], e["to_status"]), F.lit(False))
        return F.struct(F.when(ok, e["to_status"]).otherwise(s["status"]).alias("status"), (s["illegal"] + (~ok).cast("int")).alias("illegal"))

    log = events.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "to_status"))).alias("log"))
    return log.select("item", F.aggregate("log", start, step).alias("s")).select("item", "s.status", "s.illegal")


# W14
def revisions(edits: DataFrame) -> DataFrame:
    """item, revision (1 and one more for each edit or demotion), last filename: events are create, edit, demote."""
    changed = F.col("event").isin("edit", "demote")
    named = F.when(F.col("filename").isNotNull(), F.col("seq"))
    return edits.groupBy("item").agg((1 + F.count_if(changed)).cast("long").alias("revision"), F.max_by("filename", named).alias("filename"))


# S11
def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """One proposal for each item: the latest, and of equal times that of new."""
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    latest = both.groupBy("queue_item_id").agg(F.max_by(F.struct("proposal_json", "created_at"), F.struct("created_at", "src")).alias("p"))
    return latest.select("queue_item_id", "p.proposal_json", "p.created_at")


# P07
VIEWS = {"queue": [s for s in STATUSES if s != "completed"], "review": ["needs_review"], "completed": ["completed"], "waiting": ["queued"]}


def in_view(name: str) -> Column:
    """Whether an item is in a view: queue, review, completed, waiting, or ready (which needs a proposed name)."""
    if name == "ready":
        return (F.col("status") == "ready") & F.col("proposed_name").isNotNull()
    return F.col("status").isin(VIEWS[name])


def view(items: DataFrame, name: str) -> DataFrame:
    return items.filter(in_view(name))


# P08
def undoable(items: DataFrame, receipts: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of completed items whose latest receipt is a complete apply, with a free original path and the recorded content at the other."""
    latest = latest_receipts(receipts).filter((F.col("direction") == "apply") & (F.col("stage") == "complete"))
    df = items.filter("status = 'completed'").select("id").join(latest.drop("id").withColumnRenamed("queue_item_id", "id"), "id")
    df = df.join(files.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    return df.join(files.select(F.col("path").alias("destination_path"), F.col("sha256").alias("post_hash")), ["destination_path", "post_hash"], "left_semi").select("id")


# P09
def retained(items: DataFrame, what: str) -> DataFrame:
    """Items left after clearing terminal, waiting or removable ones."""
    gone = {"terminal": F.col("status").isin("failed", "canceled", "completed"), "waiting": F.col("status") == "queued", "removable": ~F.col("status").isin("extracting", "analyzing", "applying")}
    return items.filter(~gone[what])


# P12
def review_rows(view_: DataFrame) -> DataFrame:
    """The rows that a reviewer sees; view_: item_view with proposal columns document_type, document_date, parties, reasons, filename."""
    r = F.col("receipt")
    waiting = F.col("status") == "queued"
    pending = (F.col("status") == "needs_review") & (F.col("error_code") == "SOURCE_DELETE_FAILED") & (r["direction"] == "apply") & (r["stage"] == "published")
    hide = lambda c: F.when(~waiting, c)
    return view_.select(
        "id", N.leaf(F.col("source_path")).alias("original"), "status", hide(F.col("filename")).alias("filename"), hide(F.col("document_type")).alias("document_type"),
        hide(F.col("document_date")).alias("document_date"), hide(F.array_join("parties", "; ")).alias("parties"),
        F.coalesce(F.nullif(F.array_join("reasons", ", "), F.lit("")), "error_code").alias("reason"), F.when(F.coalesce(pending, F.lit(False)), r["id"]).alias("reconciliation_receipt"),
    )


# T02
def apply_plan(items: DataFrame, files: DataFrame) -> DataFrame:
    """id, planned, refusal of ready items with a proposed name: content unchanged, a valid leaf name, the same extension."""
    ready = items.filter((F.col("status") == "ready") & F.col("proposed_name").isNotNull())
    df = ready.select("id", "source_path", "proposed_name").join(drift(items, files), "id")
    refusal = F.coalesce(F.col("error_code"), F.when(~N.is_leaf_name(F.col("proposed_name")), "INVALID_NAME"), F.when(~N.keeps_extension(F.col("proposed_name"), F.col("source_path")), "EXTENSION_CHANGED"))
    return df.select("id", refusal.isNull().alias("planned"), refusal.alias("refusal"))
