"""One query for each operator, over whole tables; oracles.py has the SQL of those that SQL expresses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus as C
from ..functions import names as N
from ..functions import replies as R
from ..functions import text as T
from ..operators import distill as D
from ..operators import evaluate as E
from ..operators import intake as I
from ..operators import lifecycle as L
from ..operators import naming, pages as P, validate as V
from ..sources import files as S
from ..staging import shared_dir, stage
from ..streaming import stateful
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
AS_OF = 300


def query(f: Callable[[C.Reader], DataFrame]) -> Callable[[C.Reader], DataFrame]:
    """Register f under its name as a query of (spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    _found[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def _digest_row(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "page_count", "source_characters", "digest_characters", "compressed", "block_count", F.size("segments").cast("long").alias("n_segments"), F.size("outline").cast("long").alias("n_outline"),
        F.size("date_lines").cast("long").alias("n_dates"), F.sha2("text", 256).alias("text_sha256"),
    )


@query
def c01_distil(t):
    """Digests of all documents."""
    return _digest_row(D.distill(C.documents_as_pages(t)))


@query
def c01_distil_contracts(t):
    """Digests of the contracts, which pass whole."""
    return _digest_row(D.distill(C.contracts(t)))


@query
def c01_distil_statements(t):
    """Digests of long multi-page statements under a small budget."""
    return _digest_row(D.distill(C.statements(t), budget=2000, passthrough=2000))


@query
def s13_report(t):
    df = D.report(D.distill(C.conversations_as_pages(t)))
    return df.select("doc_id", "pages", "source_characters", "digest_characters", F.round("ratio", 4).alias("ratio"), "compressed", F.sha2("digest", 256).alias("digest_sha256"))


@query
def w01_runs(t):
    """Runs of lines by kind in all documents."""
    found = D.runs(C.documents_as_pages(t))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.char_length("joined")).alias("characters"))


@query
def w01_runs_statements(t):
    found = D.runs(C.statements(t))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.char_length("joined")).alias("characters"))


@query
def a01_running_lines(t):
    """Blocks of statements before and after running lines go."""
    docs = D.documents(C.statements(t)).filter(F.size("found") > 0)
    left = D.without_running_lines(F.col("found"), F.col("n_pages"))
    return docs.select("doc_id", F.size("found").cast("long").alias("blocks"), F.size(left).cast("long").alias("left"))


@query
def a05_sizes(t):
    return D.sizes(C.conversations_as_pages(t))


@query
def a06_outline(t):
    heads = D.runs(C.statements(t)).filter("kind = 'heading'").select("doc_id", D.heading_text(F.col("joined")).alias("heading"))
    return heads.groupBy("heading").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query
def x_signals(t):
    """Date signals, cues, identifiers, money and headings by line of the contracts."""
    # a document's lines stay in its row: as rows, each with its shape would be a group
    total = lambda f: F.aggregate("lines", F.lit(0).cast("long"), lambda s, line: s + f(line).cast("long"))
    docs = C.contracts(t).groupBy("doc_id").agg(F.flatten(F.collect_list(F.split("text", "\n"))).alias("lines"))
    return docs.select(
        "doc_id", total(T.date_signals).alias("dates"), *(total(lambda line, cues=cues: T.cue_count(line, cues)).alias(f"{k}_cues") for k, cues in T.CUES.items()), total(T.has_identifier).alias("identifiers"),
        total(T.has_money).alias("money"), total(T.is_heading).alias("headings"), F.size(F.array_distinct(F.transform("lines", T.digit_mask))).cast("long").alias("shapes"),
    )


@query
def p05_headings(t):
    return _lines(C.documents_as_pages(t)).filter(T.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("headings"))


@query
def x04_cue_histogram(t):
    """Documents by cue, over all documents."""
    known = F.array(*(F.struct(F.lit(f"{kind}:{cue}").alias("name"), F.lit(cue).alias("cue")) for kind, cues in T.CUES.items() for cue in cues))
    hits = T.bound(T.ascii_lower(F.col("text")), lambda low: F.transform(F.filter(known, lambda x: F.contains(low, x["cue"])), lambda x: x["name"]))
    return t("documents").select(F.explode(hits).alias("cue")).groupBy("cue").agg(F.count("*").alias("documents"))


@query
def x01_evidence_text(t):
    return t("documents").select("doc_id", F.sha2(T.evidence_text(F.col("text")), 256).alias("normal_sha256"))


@query
def x07_sentences(t):
    """Chunks of all documents at 700 characters: nothing is lost."""
    parts = T.split_sentences(F.col("text"), 700)
    return t("documents").select("doc_id", "text", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("chunks"), F.char_length(F.array_join("p", "")).cast("long").alias("characters"), (F.array_join("p", "") == F.col("text")).alias("whole"))


@query
def d03_dates(t):
    """ISO checks, ordinals and renderings of order dates."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    day = F.dayofmonth("o_orderdate")
    has = F.array_contains(T.date_renderings(iso), F.lower(F.date_format("o_orderdate", C.LONG_DATE)))
    odd = F.concat(F.substring(iso, 1, 8), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return t("orders").select("o_orderkey", F.concat(day.cast("string"), T.ordinal(day)).alias("nth"), T.is_iso_date(iso).alias("valid"), T.is_iso_date(odd).alias("odd_valid"), has.alias("rendered"))


@query
def x15_first_sentences(t):
    s = T.first_sentence(F.col("text"))
    cut, over = T.capped_sentence(s)
    return t("documents").select("doc_id", F.sha2(cut, 256).alias("sentence_sha256"), over.alias("over"), T.is_usable_sentence(cut).alias("usable"))


@query
def x08_segments(t):
    """File-name parts and keys from customers and parts."""
    raw = F.concat(F.lit(" "), F.col("p_type"), F.lit(": "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit(" .. "))
    return t("part").repartition("p_partkey").select("p_partkey", N.segment(raw).alias("segment"), N.name_key(raw).alias("name_key"), N.extension(F.concat(F.lit("."), F.col("p_brand"))).alias("extension"))


@query
def x13_path_keys(t):
    df = C.items(t)
    return df.select("id", N.path_key(F.col("source_path")).alias("path_key"), N.document_key(F.col("source_path"), F.col("id"), F.col("lease_expires_at")).alias("document_key"), N.leaf(F.col("source_path")).alias("leaf"), N.path_extension(F.col("source_path")).alias("extension"))


def _digests(t) -> DataFrame:
    return D.distill(C.contracts(t))


@query
def c02_validate(t):
    """Proposals for the contracts against their digests."""
    out = V.validate(C.proposals(t), _digests(t))
    return out.select("doc_id", "document_type", "document_date", "date_role", F.array_join("parties", "; ").alias("parties"), "party_relation", "status", F.array_join("reasons", ",").alias("reasons"))


@query
def a08_reasons(t):
    return V.reason_histogram(V.validate(C.proposals(t), _digests(t)))


def _named(t) -> tuple[DataFrame, DataFrame]:
    df = C.proposals(t).select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("folder"), F.lit(".PDF").alias("extension"), "document_type", F.substring("document_date", 1, 7).alias("document_date"), F.array().cast("array<string>").alias("parties"), F.lit("none").alias("party_relation"))
    listing = df.filter("doc_id % 40 = 0").select("folder", F.concat(F.concat_ws(" ", "document_date", "document_type"), F.when(F.col("doc_id") % 80 == 0, F.lit(" (2)")).otherwise(F.lit("")), F.lit(".pdf")).alias("name")).distinct()
    return df, listing


@query
def c03_names(t):
    """Names for a batch with many clashes, beside what the folders hold."""
    return naming.compose_names(*_named(t))


@query
def x12_fitted(t):
    """Names with parties, fitted to 120 characters."""
    df = C.proposals(t).withColumn("extension", F.lit("pdf")).withColumn("document_type", F.repeat("document_type", F.lit(1)))
    long = F.transform("parties", lambda p: F.repeat(F.concat(p, F.lit(" ")), (F.col("doc_id") % 5 + 1).cast("int")))
    return naming.parts(df.withColumn("parties", long)).select("doc_id", naming.name_with(F.lit(1)).alias("name"))


@query
def k02_decode(t):
    """Fields of good replies, and which are bad, in one pass."""
    good = F.col("reason").isNull()
    of = lambda c, name: F.when(good, c).alias(name)
    return R.decoded(C.replies(t)).select("doc_id", *(of(F.col(c), c) for c in ("document_type", "document_date", "party_relation")), of(F.size("parties").cast("long"), "n_parties"), good.alias("good"))


@query
def k03_unwrapped(t):
    """Turns wrapped as chat completions, as text and in parts, some of them cut off, and unwrapped again."""
    k = F.col("conv_id") + F.col("turn")
    message = lambda content: F.to_json(F.struct(F.array(F.struct(F.when(k % 7 == 0, "length").when(k % 3 == 0, "stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices")))
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.lit(" end")))
    body = F.when(k % 5 == 0, message(parts)).otherwise(message(F.col("text")))
    return t("conversations").select("conv_id", "turn", F.sha2(R.chat_content(body), 256).alias("content_sha256"))


@query
def k04_legacy_replies(t):
    """The proposals as replies of the older kind: in a fence, amid prose, or none at all."""
    k = F.col("doc_id")
    body = F.to_json(F.struct("document_type", "document_date", F.lit("issue").alias("date_kind"), F.get("parties", F.lit(0)).alias("subject"), (k % 4 == 0).alias("needs_review"), F.lit(1).alias("unknown")))
    reply = F.when(k % 5 == 0, "no answer").when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" That is all.")))
    df = C.proposals(t).select("doc_id", R.legacy_reply(reply).alias("r"))
    return df.select("doc_id", "r.document_type", "r.document_date", "r.date_kind", "r.subject", "r.party", "r.needs_review")


@query
def st09_progress(t):
    """Percent of the latest event of each item, as the stream ends with it."""
    e = F.col("event_id")
    steps = t("events").select((e % 500).alias("item"), e.alias("ts"), (e % 150).alias("current"), F.when(e % 3 != 0, 100).alias("total"))
    return stateful.progress(steps)


@query
def k05_domains(t):
    df = C.results(t).select("file", "pipeline", F.when(F.col("pipeline") == "old", "due").otherwise(F.col("date_role")).alias("date_role"), "status")
    return R.domain_rejects(df, {"date_role": "date_role", "status": "status"}).groupBy("pipeline", "column", "value").agg(F.count("*").alias("n"))


def _scored(t) -> DataFrame:
    return E.scores(C.results(t), C.gold(t))


@query
def e01_scores(t):
    return _scored(t).drop("filename")


@query
def e08_flags(t):
    return E.by_flag(_scored(t)).withColumn("rate", F.round("rate", 6))


@query
def e09_review_rate(t):
    return E.review_rate(_scored(t)).withColumn("rate", F.round("rate", 6))


@query
def e10_latency(t):
    return E.latency(_scored(t))


@query
def e11_named(t):
    return E.date_when_named(_scored(t)).select("pipeline", F.round("rate", 6).alias("rate"), "n", "n_wrong")


@query
def e12_gates(t):
    return E.gate_failures(_scored(t)).withColumn("value", F.round("value", 6))


@query
def j17_compare(t):
    return E.compare(_scored(t), "new", "old").withColumn("changed", F.array_join("changed", ","))


@query
def j16_audit(t):
    """A manifest of the documents with faults against the documents."""
    sha = F.sha2("text", 256)
    there = t("documents").filter("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("file"), F.char_length("text").cast("long").alias("size"), sha.alias("sha256"))
    listed = t("documents").filter("doc_id % 10 <> 4").select(F.col("doc_id").cast("string").alias("file"), F.char_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 10 == 5, "0").otherwise(sha).alias("sha256"))
    return E.audit(listed, there)


@query
def j08_items(t):
    p = t("orders").filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("queue_item_id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("proposal_json"))
    return L.item_view(C.items(t), p, C.receipts(t)).select("id", "status", "proposal_json", F.col("receipt.id").alias("receipt_id"), F.col("receipt.stage").alias("stage"))


@query
def j09_active(t):
    return L.active_receipts(C.items(t), C.receipts(t))


@query
def j10_abandoned(t):
    return L.abandoned(C.items(t), C.sessions(t), AS_OF)


@query
def j11_new_files(t):
    found = C.items(t).select(F.upper("source_path").alias("path"), F.when(F.col("id") % 3 == 0, F.lit("new")).otherwise(F.col("source_hash")).alias("source_hash"))
    return L.new_files(found, C.items(t).filter("id % 7 <> 0"))


@query
def j12_drift(t):
    return L.drift(C.items(t), C.files(t))


@query
def j18_fates(t):
    return L.fates(C.items(t), C.receipts(t))


@query
def j19_reconcile(t):
    return L.reconcile_plan(C.receipts(t), C.files(t))


@query
def a12_exclusive(t):
    return L.exclusivity_violations(C.receipts(t))


@query
def a13_retries(t):
    return L.retries(C.retry_events(t))


@query
def a14_status(t):
    return L.status_counts(C.items(t))


@query
def a15_same_content(t):
    return L.same_content(t("documents").select(F.sha2("text", 256).alias("source_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_path")))


@query
def w09_latest(t):
    return L.latest_receipts(C.receipts(t)).select("queue_item_id", "id", "stage")


@query
def w10_stages(t):
    return L.stage_audit(C.receipt_events(t))


@query
def w11_transitions(t):
    return L.transition_audit(C.item_events(t))


@query
def st05_fold(t):
    return L.folded_status(C.item_events(t))


@query
def w14_revisions(t):
    e = C.item_events(t)
    kind = F.when(F.col("seq") == 0, "create").when(F.col("event") == "demote", "demote").when(F.col("event") == "approve", "edit").otherwise("view")
    return L.revisions(e.select("item", "seq", kind.alias("event"), F.when(F.col("event") == "approve", F.concat(F.lit("n"), F.col("seq").cast("string"))).alias("filename")))


@query
def s11_upsert(t):
    old = t("orders").select(F.col("o_orderkey").alias("queue_item_id"), F.lit("old").alias("proposal_json"), (F.col("o_orderkey") % 10).alias("created_at"))
    new = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("queue_item_id"), F.lit("new").alias("proposal_json"), (F.col("o_custkey") % 10).alias("created_at"))
    return L.upserted(old, new)


@query
def p07_views(t):
    """Items in each view, counted in one scan."""
    views = (*L.VIEWS, "ready")
    counts = C.items(t).agg(*(F.count_if(L.in_view(name)).alias(name) for name in views))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("view"), F.col(name).alias("n")) for name in views))).alias("v")).select("v.*")


@query
def p08_undoable(t):
    return L.undoable(C.items(t), C.receipts(t), C.files(t))


@query
def p09_retained(t):
    return L.retained(L.retained(C.items(t), "terminal"), "removable").groupBy("status").agg(F.count("*").alias("n"))


@query
def t02_apply_plan(t):
    return L.apply_plan(C.items(t), C.files(t))


@query
def j13_roots(t):
    """Pages' addresses under roots, the longest winning."""
    files = t("pages").select(F.col("page_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    hosts = files.select(F.substring_index("path", "/", 1).alias("h")).distinct()
    roots = hosts.select(F.lit("host").alias("kind"), F.upper("h").alias("root")).unionByName(hosts.select(F.lit("french").alias("kind"), F.concat("h", F.lit("/FR/")).alias("root")))
    return I.with_root(files, roots).select("page_id", "kind", "root")


@query
def w12_stable(t):
    return I.stable(C.scans(t)).select("path", "scan_no", "size", "stable")


@query
def a09_origins(t):
    return I.first_origins(C.claim_events(t).select("key", "machine_id", F.col("ts").alias("observed_at")))


def _decided(t) -> DataFrame:
    files = C.scans(t).select(F.concat_ws("#", "path", F.col("scan_no").cast("string")).alias("key"), F.col("path").alias("relative_path"), "modified_secs", "scan_no")
    n = F.pmod(F.col("scan_no") * 7 + F.col("modified_secs"), F.lit(6))
    claims = files.filter(n < 2).select("key", F.when(n == 0, "m1").otherwise("m2").alias("machine_id"), F.when(F.col("modified_secs") % 2 == 0, "done").otherwise("claimed").alias("state"))
    origins = files.filter(n.isin(2, 3)).select("key", F.when(n == 2, "m1").otherwise("m2").alias("machine_id"))
    return I.decisions(files, claims, origins, files.filter(n == 4).select("relative_path"), "m1", 130, True)


@query
def j14_decisions(t):
    return _decided(t)


@query
def a10_status(t):
    return I.intake_status(_decided(t), C.claim_events(t).select("machine_id")).withColumn("machines", F.array_join("machines", ","))


@query
def a11_retention(t):
    e = C.claim_events(t)
    name = F.concat("key", F.when(F.col("seq") % 5 == 0, F.lit(" (copy).json")).otherwise(F.lit(".json")))
    kind = F.when(F.col("seq") % 3 == 0, "claim").when(F.col("seq") % 3 == 1, "origin").otherwise("machine")
    records = e.select(
        "seq", kind.alias("kind"), "key", name.alias("file_name"), (F.col("seq") % 7 != 0).alias("readable"), F.when(F.col("event") == "done", "done").otherwise("claimed").alias("state"),
        F.col("ts").alias("claimed_at"), (F.col("ts") + 60).alias("heartbeat_at"), F.when(F.col("seq") % 2 == 0, F.col("ts") + 100).alias("done_at"), (F.col("ts") + 5).alias("observed_at"), (F.col("ts") + 9).alias("last_seen_at"), F.col("ts").alias("file_mtime"),
    )
    return I.retention(records, 2_700_000).select("seq", "keep")


@query
def st03_claims(t):
    return I.folded_claims(C.claim_events(t))


@query
def st06_leases(t):
    """Items whose owner went silent, by the events' own clock."""
    e = F.col("event_id")
    events = t("events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("owner"), (e % 3).alias("item"), e.alias("ts"), e.alias("seq"), (e + e % 1200).alias("lease_expires_at"))
    return I.expired_leases(events, F.lit(100_000), L.SESSION_SECONDS)


@query
def st04_released(t):
    """Files of other machines whose courtesy time is over a minute after the last sighting."""
    e = F.col("event_id")
    files = t("events").select(F.concat(F.lit("f"), (e % 700).cast("string")).alias("path"), (e - e % 90).alias("modified_secs"), e.alias("seen_at"))
    (now,) = files.agg(F.max("seen_at") + 60).first()
    return I.due(I.courtesy_due(files), "path", F.lit(now))


@query
def st11_pruned(t):
    """Coordination files that may go."""
    c = C.claim_events(t)
    records = c.select(
        F.lit("claim").alias("kind"), "key", F.concat("key", F.when(F.col("seq") % 5 == 0, F.lit(" (copy).json")).otherwise(F.lit(".json"))).alias("file_name"), (F.col("seq") % 7 != 0).alias("readable"), F.when(F.col("event") == "done", "done").otherwise("claimed").alias("state"),
        F.col("ts").alias("claimed_at"), (F.col("ts") + 60).alias("heartbeat_at"), (F.col("ts") + 100).alias("done_at"), F.col("ts").alias("observed_at"), F.col("ts").alias("last_seen_at"), F.col("ts").alias("file_mtime"), F.col("seq").alias("seen_at"),
    )
    return I.due(I.retention_due(records), "file_name", F.lit(2_700_000))


@query
def st08_changes(t):
    e = F.col("event_id")
    return I.changes(t("events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), e.alias("ts"), e.alias("seq"), (F.floor(e / 4) % 5).alias("digest")))


@query
def st07_machines(t):
    return I.machines_by_window(t("events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("machine_id"), (F.col("event_id") * 3).alias("last_seen_at")))


@query
def t01_listing(t):
    """Items by lower-cased path."""
    return I.listed(C.items(t).select("id", F.col("source_path").alias("path")), "path")


@query
def t04_live(t):
    """Observations of files that are still there."""
    return I.live_only(C.scans(t).select("path", "scan_no"), C.scans(t).filter("scan_no % 3 = 0").select("path").distinct())


@query
def p04_barely_readable(t):
    return P.barely_readable(C.documents_as_pages(t), t("documents").filter("doc_id % 2 = 0").select("doc_id"))


@query
def p13_fresh(t):
    """Leases and presence that are due, and active machines, by items and machines."""
    return C.items(t).select("id", I.lease_due(F.col("lease_expires_at"), 20).alias("renew"), I.presence_due(F.col("lease_expires_at"), 420).alias("touch"), I.presence_active(F.col("lease_expires_at"), 900).alias("active"))


@query
def p12_review_rows(t):
    """Items as a reviewer sees them."""
    p = t("orders").filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("queue_item_id"), F.lit("p").alias("proposal_json"))
    k = F.col("id")
    view = L.item_view(C.items(t), p, C.receipts(t))
    view = view.withColumns({"error_code": F.when(k % 5 == 4, "SOURCE_DELETE_FAILED").otherwise(F.col("error_code")), "filename": F.col("proposed_name"), "document_type": F.concat(F.lit("T"), (k % 3).cast("string")), "document_date": F.lit("2024-01-02"), "parties": F.array(F.lit("A"), F.lit("B")), "reasons": F.when(k % 4 == 0, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array().cast("array<string>"))})
    return L.review_rows(view)


@query
def t03_unseen(t):
    e = C.claim_events(t).select("key").distinct()
    return I.unseen(e, C.claim_events(t).filter("event = 'done' and machine_id = 'm1'").select("key"))


@query
def a02_readings(t):
    return P.readings(C.ocr_pages(t)).select("doc_id", "rotation", F.sha2("text", 256).alias("text_sha256"), F.round("confidence", 4).alias("confidence"))


@query
def a03_best(t):
    read = P.readings(C.ocr_pages(t))
    turn = F.element_at(F.array(*map(F.lit, (0, 90, 180, 270))), (F.col("doc_id") % 4 + 1).cast("int"))
    return P.best_readings(read, t("documents").select("doc_id", F.lit(1).alias("page_number"), turn.alias("detected"))).select("doc_id", "rotation", F.round("confidence", 4).alias("confidence"))


@query
def p01_routes(t):
    a, b = F.col("native_text"), F.col("image_coverage")
    return C.inspections(t).select("doc_id", "page_index", P.needs_ocr(a, b).alias("ocr"), P.needs_vision(a, b).alias("vision"))


@query
def p03_limits(t):
    sizes = t("documents").select("doc_id", (F.col("n_chars") * 500_000).alias("size"))
    return P.over_limits(sizes, C.inspections(t)).select("doc_id", "error_code")


@query
def w08_vision(t):
    ins = C.inspections(t)
    return P.first_vision_page(ins, ins.select("doc_id", "page_index", F.col("doc_id").cast("int").alias("ocr_confidence")).filter("doc_id % 11 = 0"))


@query
def a04_warnings(t):
    pages = C.conversations_as_pages(t).withColumn("origin", F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("native")).withColumn("ocr_confidence", F.when(F.col("page_number") % 3 == 0, 50).otherwise(90))
    flags = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") % 5 == 0).alias("corrupt"), (F.col("turn") > 6).alias("truncated"))
    return P.warnings(pages, flags).withColumn("codes", F.array_join("codes", ","))


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def s04_events(t):
    """The conversations as lines of worker events, written and read back; each seventh turn's line is cut off and rejected."""
    page = F.struct((F.col("turn") + 1).alias("page_number"), "text", F.lit("native").alias("origin"))
    event = F.struct(F.lit("parsed").alias("type"), F.struct(F.array(page).alias("pages")).alias("document"))
    line = F.to_json(F.struct(F.when(F.col("turn") % 5 == 4, 2).otherwise(1).alias("protocol_version"), F.concat_ws("-", "conv_id", "turn").alias("request_id"), event.alias("event")))
    lines = t("conversations").select(F.when(F.col("turn") % 7 == 6, F.left(line, F.char_length(line) - 5)).otherwise(line).alias("value"))
    folder = _folder(lines, "events")
    lines.write.text(folder)
    good, bad = S.worker_events(lines.sparkSession.read.text(folder))
    pages = S.parsed_pages(good).select("request_id", "page_number", F.sha2("text", 256).alias("text_sha256"))
    return pages.unionByName(bad.groupBy().agg(F.count("*").cast("string").alias("request_id")), allowMissingColumns=True)


@query
def s05_checked(t):
    """Pages of the conversations with faults: a repeated number, a zero, an image of no page; the good documents' pages."""
    k = F.col("doc_id")
    pages = C.conversations_as_pages(t).withColumn("page_number", F.when(k % 11 == 0, F.col("page_number") - 1).when((k % 13 == 0) & (F.col("page_number") == 2), 1).otherwise(F.col("page_number"))).withColumn("ocr_confidence", (k % 130).cast("double") - 10.4)
    images = pages.select("doc_id").distinct().select("doc_id", F.when(k % 17 == 0, 99).otherwise(1).alias("page_number"), F.when(k % 19 == 0, "image/jpeg").otherwise("image/png").alias("media_type")).filter(k % 11 != 0)
    good, bad = S.checked_pages(pages, images)
    return good.select("doc_id", "page_number", "ocr_confidence", F.lit(True).alias("good")).unionByName(bad.distinct().select("doc_id", F.lit(False).alias("good")), allowMissingColumns=True)


@query
def s06_gold(t):
    """The gold answers as fixture files of one answer a line, written and read back."""
    g = C.gold(t)
    whole = g.select(F.lit(2).alias("schema_version"), F.array(F.struct(*g.columns)).alias("fixtures"))
    folder = _folder(whole, "gold")
    whole.write.option("ignoreNullFields", "true").json(folder)
    df = S.gold(whole.sparkSession, folder, lines=True)
    return df.select("file", "document_type", "document_date", F.array_join("forbidden_dates", ",").alias("forbidden_dates"), F.array_join("parties", ",").alias("parties"), "expected_readiness", "expected_error", F.size("acceptable_types").alias("n_types"), F.col("ambiguity").isNull().alias("silent"))


@query
def s07_lifecycle(t):
    """Items, receipts and sessions as lifecycle tables of an older kind, read back with the columns that those lack."""
    items = C.items(t).drop("proposed_name")
    folder = _folder(items, "lifecycle")
    for name, df in (("queue_items", items), ("operation_receipts", C.receipts(t)), ("queue_sessions", C.sessions(t))):
        df.write.parquet(f"{folder}/{name}")
    read = lambda name: S.lifecycle(items.sparkSession, folder, name)
    old = S.with_defaults(read("queue_items"), {"processing_failures": 0, "error_code": "NONE"})
    rows = old.select("id", "status", "processing_failures", "error_code", F.col("created_at").isNull().alias("lacks"))
    more = read("operation_receipts").select("id", F.col("stage").alias("status"), F.lit(1).alias("processing_failures"), F.col("direction").alias("error_code"), F.col("temporary_path").isNull().alias("lacks"))
    return rows.unionByName(more).unionByName(read("queue_sessions").select(F.col("heartbeat_at").alias("id"), F.col("session_id").alias("status"), F.lit(2).alias("processing_failures"), F.lit("s").alias("error_code"), F.lit(False).alias("lacks")))


@query
def s09_analysis(t):
    """The stored proposals as analysis JSON, read back field by field."""
    df = C.proposals(t).select("doc_id", F.lit("n.pdf").alias("filename"), "description", F.lit("ready").alias("status"), F.array(F.lit("A")).alias("reasons"), "document_type", "document_date", "date_role", "parties", "party_relation", F.lit(0.5).alias("confidence"), F.lit("s").alias("prompt_sha256"), F.lit(7).alias("prompt_characters"))
    j = lambda path: F.get_json_object("json", f"$.{path}")
    return S.analysis_json(df).select("doc_id", j("proposal.documentType").alias("document_type"), j("proposal.documentDate").alias("document_date"), j("proposal.partyRelation").alias("party_relation"), j("reviewReasons[0]").alias("reason"), j("telemetry.promptCharacters").alias("characters"), F.contains("json", F.lit('"documentDate":null')).alias("dateless"))


@query
def s02_routes(t):
    """Addresses of pages as files, and where they would go."""
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "DOCX", "docm", "txt", "md", "PNG", "tiff", "exe", ""))), (F.col("page_id") % 9 + 1).cast("int"))
    return S.routed(t("pages").select("page_id", F.concat(F.lit("in/p"), F.col("page_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("path"))).select("page_id", "route", "error_code")


@query
def x18_legacy(t):
    d = jobs.legacy_digest(C.statements(t))
    return d.select("doc_id", F.size("segments").cast("long").alias("n_segments"), F.char_length(F.array_join("segments", "")).cast("long").alias("characters"))


@query
def c06_legacy(t):
    """The older method over the contracts."""
    p = C.proposals(t)
    quoted = p.select("doc_id", "document_type", "document_date", F.lit("issue").alias("date_kind"), F.get("parties", F.lit(0)).alias("subject"), "description", "confidence", F.upper("document_type").alias("type_evidence"), F.concat(F.lit("Invoice Date: "), F.date_format(F.col("document_date").cast("date"), C.LONG_DATE)).alias("date_evidence"), F.concat(F.lit("Bill To: "), F.get("parties", F.lit(0))).alias("subject_evidence"))
    return jobs.legacy(C.contracts(t), quoted).select("doc_id", "document_type", "document_date", "subject", "status", F.array_join("reasons", ",").alias("reasons"), "filename")


@query
def x21_prompts(t):
    return jobs.prompts(_digests(t)).drop("prompt")


@query
def c04_replay(t):
    """Validation and naming of stored proposals, as U03 and C04 do."""
    p = stage(C.proposals(t), "proposals")
    places = p.select("doc_id", F.lit("in").alias("folder"), F.lit("pdf").alias("extension"))
    # every eighth name is there already
    people = F.when(p["party_relation"] == "none", F.concat(F.lit("- "), F.col("parties")[0])).when(p["party_relation"] == "between", F.concat(F.lit("with "), F.col("parties")[0])).otherwise(F.concat_ws(" ", "party_relation", F.col("parties")[0]))
    there = p.filter("doc_id % 8 = 0").select(F.lit("in").alias("folder"), F.concat(F.concat_ws(" ", "document_date", "document_type", people), F.lit(".PDF")).alias("name"))
    out = jobs.replay(p, _digests(t), there, places)
    return out.select("doc_id", "status", "filename", "collision_index")


