"""Sources, sinks and composed jobs on small planted files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docfiling import schemas
from docfiling.functions import replies as R
from docfiling.operators import lifecycle as L
from docfiling.plans import jobs
from docfiling.sources import files as S


def test_scan_route_and_text(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name, content in {"a.txt": b"hello", "sub/b.MD": b"# hi", ".hidden.txt": b"x", "~$lock.docx": b"x", "empty.txt": b"", "c.exe": b"x", "bad.txt": b"\xff\xfe", "d.pdf": b"%PDF"}.items():
        (root / name).write_bytes(content)
    found = {r["relative_path"]: r["size"] for r in S.scan(spark, str(root)).collect()}
    assert found == {"a.txt": 5, "sub/b.MD": 4, "bad.txt": 2, "d.pdf": 4}
    deep = tmp_path / "deep"
    for k in range(4):
        (deep / f"a{k}" / "b" / "c" / "d").mkdir(parents=True)
        for at in ("", f"a{k}", f"a{k}/b", f"a{k}/b/c/d"):
            (deep / at / f"f{k}.txt").write_text("x" * (k + 1))
    (deep / "a0" / "link.txt").symlink_to(deep / "f1.txt")
    (deep / "a1" / "again").symlink_to(deep)
    (deep / "broken.pdf").symlink_to(tmp_path / "nowhere")
    rows = S.scan(spark, str(deep)).collect()
    want = sorted(f"{at}f{k}.txt" for k in range(4) for at in ("", f"a{k}/", f"a{k}/b/", f"a{k}/b/c/d/"))
    assert [r["relative_path"] for r in rows] == want and {r["size"] for r in rows} == {1, 2, 3, 4} and all(r["modified_secs"] > 10**9 for r in rows)
    assert "content" not in S.scan(spark, str(deep))._jdf.queryExecution().toString()
    routes = {r["path"]: (r["route"], r["error_code"]) for r in S.routed(spark.createDataFrame([("x/a.DOCM",), ("b.tif",), ("c.exe",), ("d",)], "path string")).collect()}
    assert routes == {"x/a.DOCM": ("office", None), "b.tif": ("ocr", None), "c.exe": (None, "UNSUPPORTED_FORMAT"), "d": (None, "UNSUPPORTED_FORMAT")}
    pages, bad = S.text_pages(spark, str(root))
    assert sorted(r["text"] for r in pages.collect() if r["text"]) == ["# hi", "hello"]
    assert [r["error_code"] for r in bad.collect()] == ["PARSE_FAILED"]


def test_worker_events_and_pages(spark):
    page = lambda n, c=None: {"page_number": n, "text": "t", "origin": "ocr", "ocr_confidence": c}
    good = {"protocol_version": 1, "request_id": "r", "event": {"type": "parsed", "document": {"pages": [page(1, 99.6), page(2, 140.0)]}}}
    lines = [json.dumps(good), json.dumps(good | {"protocol_version": 2}), "{bad", json.dumps({"protocol_version": 1, "request_id": "h", "event": {"type": "hello"}})]
    events, rejects = S.worker_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rejects.count() == 2 and events.count() == 2
    pages = S.parsed_pages(events).withColumn("doc_id", F.lit(1))
    twice = pages.unionByName(pages.withColumn("doc_id", F.lit(2)).withColumn("page_number", F.lit(1)))
    kept, bad = S.checked_pages(twice)
    assert sorted(r["ocr_confidence"] for r in kept.collect()) == [100, 100] and [r["doc_id"] for r in bad.collect()] == [2]
    images = spark.createDataFrame([(1, 3, "image/png")], "doc_id int, page_number int, media_type string")
    assert S.checked_pages(pages, images)[0].count() == 0


def test_gold_and_coordination(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"schema_version": 2, "fixtures": [{"file": "a", "parties": []}, {"file": "b"}]}, indent=1))
    rows = {r["file"]: r["parties"] for r in S.gold(spark, str(tmp_path / "gold.json")).collect()}
    assert rows == {"a": [], "b": None}
    (tmp_path / "claims").mkdir()
    for name, body in {"k1.json": {"version": 1, "key": "k1"}, "k2.json": {"version": 9, "key": "k2"}}.items():
        (tmp_path / "claims" / name).write_text(json.dumps(body))
    (tmp_path / "claims" / "k3.json").write_text("{broken")
    (tmp_path / "claims" / ".dot.json").write_text("{}")
    assert {r["file_name"]: r["readable"] for r in S.coordination(spark, str(tmp_path), "claims").collect()} == {"k1.json": True, "k2.json": False, "k3.json": False}


def test_lifecycle_and_defaults(spark, tmp_path):
    spark.createDataFrame([("s", 1)], "session_id string, heartbeat_at long").write.parquet(str(tmp_path / "queue_sessions"))
    assert S.lifecycle(spark, str(tmp_path), "queue_sessions").collect() == [("s", 1)]
    spark.createDataFrame([(1, "p")], "id long, source_path string").write.parquet(str(tmp_path / "queue_items"))
    items = S.lifecycle(spark, str(tmp_path), "queue_items")
    assert items.first()["status"] is None and len(items.columns) == 15
    assert S.with_defaults(items.select("id"), {"applying_epoch": 0, "id": 5}).collect() == [(1, 0)]


def make_scorer():
    def scorer(prompts):
        """Answers a fenced object, and nonsense for documents that ask for it."""
        out = []
        for p in prompts:
            marker = "Calibration Notice" if "CALIBRATION" in p else "Invoice"
            body = {"document_type": marker, "document_date": "2024-01-02", "date_role": "notice", "parties": ["Alpha LLC"] if "Alpha" in p else [], "party_relation": "from", "description": "Invoice for Alpha LLC about several goods and more.", "confidence": 0.9}
            out.append("nonsense" if "REFUSE" in p else "```json\n" + json.dumps(body) + "\n```")
        return out

    return scorer


def test_analysis_from_pages_to_names(spark):
    scorer = make_scorer()  # a closure, so that the workers need no test module
    pages = spark.createDataFrame([(1, 1, "INVOICE\n\nAlpha LLC\nDate: January 2, 2024\nInvoice for several goods."), (2, 1, "INVOICE\n\nAlpha LLC on 2024-01-02"), (3, 1, "REFUSE"), (4, 1, "nothing here")], "doc_id long, page_number int, text string")
    places = pages.select("doc_id", F.lit("f").alias("folder"), F.lit(".PDF").alias("extension"))
    listing = spark.createDataFrame([("f", "2024-01-02 invoice from alpha llc.pdf")], "folder string, name string")
    done, lost = jobs.analyze(pages, scorer, listing, places)
    rows = {r["doc_id"]: r for r in done.collect()}
    assert rows[1]["filename"] == "2024-01-02 Invoice from Alpha LLC (2).pdf" and rows[2]["filename"] == "2024-01-02 Invoice from Alpha LLC (3).pdf"
    assert rows[1]["status"] == "ready" and rows[4]["status"] == "needs_review" and rows[4]["filename"] == "Document.pdf"
    assert rows[4]["reasons"] == ["TYPE_UNSUPPORTED", "DATE_UNSUPPORTED", "DESCRIPTION_UNSUPPORTED"]
    assert [r["doc_id"] for r in lost.collect()] == [3]
    out = json.loads(S.analysis_json(done).filter("doc_id = 1").first()["json"])
    assert out["proposal"]["documentType"] == "Invoice" and out["reviewReasons"] == []
    assert jobs.probe(pages, scorer).first()["passed"] is True


def test_extract(spark):
    def read(content):
        if content == b"bad":
            raise ValueError("no")
        return content.decode().split("|")

    got = jobs.extract(spark.createDataFrame([("a", bytearray(b"x|y")), ("b", bytearray(b"bad"))], "path string, content binary"), read).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, "x", None, None), ("a", 2, "y", None, None), ("b", None, None, "PARSE_FAILED", False)], key=str)


def test_review_rows(spark):
    receipts = spark.createDataFrame([(7, 1, "apply", "published")], "id long, queue_item_id long, direction string, stage string")
    items = spark.createDataFrame([(1, "C:\\in\\a.pdf", "needs_review", "SOURCE_DELETE_FAILED"), (2, "b.pdf", "queued", None)], "id long, source_path string, status string, error_code string")
    props = spark.createDataFrame([(1, "{}"), (2, "{}")], "queue_item_id long, proposal_json string")
    view = L.item_view(items, props, receipts).withColumns({"document_type": F.lit("T"), "document_date": F.lit("D"), "parties": F.array(F.lit("a"), F.lit("b")), "reasons": F.array().cast("array<string>"), "filename": F.lit("n.pdf")})
    rows = {r["id"]: tuple(r) for r in L.review_rows(view).collect()}
    assert rows[1] == (1, "a.pdf", "needs_review", "n.pdf", "T", "D", "a; b", "SOURCE_DELETE_FAILED", 7)
    assert rows[2][3:7] == (None, None, None, None)
    assert schemas.PAGES.startswith("doc_id")


def counted(folder, bad=lambda prompt, n: False):
    """A scorer that leaves a file for each call's prompts; bad says which of a prompt's replies are nonsense."""

    def scorer(prompts):
        import hashlib
        import uuid

        out = []
        for p in prompts:
            name = hashlib.sha256(p.encode()).hexdigest()
            before = len([f for f in os.listdir(folder) if f.startswith(name)])
            open(f"{folder}/{name}-{len(prompts)}-{uuid.uuid4().hex}", "w").close()
            out.append("nonsense" if bad(p, before) else json.dumps({"document_type": p, "confidence": 0.5}))
        return out

    return scorer


def test_each_prompt_is_asked_once(spark, tmp_path):
    prompts = spark.createDataFrame([(k, f"prompt {k}") for k in range(20)] + [(None, "prompt without an id")], "doc_id long, prompt string")
    calls = tmp_path / "calls"
    calls.mkdir()
    scorer = counted(str(calls), lambda p, n: p.endswith(" 7") or (p.endswith(" 8") and n == 0))
    ledger = str(tmp_path / "ledger")
    good, lost = jobs.propose(prompts.limit(15), scorer, ledger, at_once=4)
    assert len(os.listdir(calls)) == 15 + 2  # one for each, and one more for each of the two bad replies
    for _ in range(3):
        assert good.count() == 14 and [(r["doc_id"], r["reason"]) for r in lost.collect()] == [(7, "NO_JSON")]
    assert len(os.listdir(calls)) == 17 and all(int(f.split("-")[1]) <= 4 for f in os.listdir(calls))
    # started again with more prompts: only the new ones
    good, lost = jobs.propose(prompts, scorer, ledger, at_once=4)
    assert good.count() == 20 and lost.count() == 1 and len(os.listdir(calls)) == 23
    assert {r["attempt"] for r in jobs.ledger_of(spark, ledger).collect()} == {1, 2}
    one = spark.createDataFrame([(1, "p")], "doc_id long, prompt string")
    with pytest.raises(Exception, match="1 prompts, 0 replies"):
        jobs.propose(one, lambda prompts: [])


def test_reject_reasons(spark):
    rows = [(1, "no object"), (2, '{"document_type": '), (3, '{"date_role": "due"}'), (4, '{"confidence": 1.5}'), (5, "{}"), (6, None), (7, '{"a": }')]
    good, bad = R.decode(spark.createDataFrame(rows, "doc_id long, reply string"))
    assert [r["doc_id"] for r in good.collect()] == [5]
    assert {r["doc_id"]: r["reason"] for r in bad.collect()} == {1: "NO_JSON", 2: "NO_JSON", 3: "UNKNOWN_CODE", 4: "BAD_CONFIDENCE", 6: "NO_JSON", 7: "BAD_JSON"}


def test_legacy_reply(spark):
    text = '```json\n{"document_type": "Deed", "party": "A", "confidence": 0.25, "needs_review": true, "language": "en", "other": 1}\n```'
    got = spark.createDataFrame([(text,), ("none",)], "reply string").select(R.legacy_reply(F.col("reply")).alias("r")).collect()
    assert got[0]["r"].asDict() == dict.fromkeys(("document_date", "date_kind", "subject", "description", "date_evidence", "type_evidence", "subject_evidence", "party_evidence")) | {"document_type": "Deed", "party": "A", "confidence": 0.25, "needs_review": True, "language": "en"}
    assert got[1]["r"] is None


def test_reports_are_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    records = lambda n: spark.range(n).select(F.col("id").alias("file"))
    summary = spark.createDataFrame([("new", "date", 3, 4, 0.75), ("new", "type", 1, 4, 0.25), ("old", "date", 0, 4, 0.0)], "pipeline string, flag string, correct long, total long, rate double")
    with pytest.raises(FileNotFoundError):
        S.read_report(spark, path)
    S.write_report(records(5), summary, path, "new", "m", 100)
    with pytest.raises(Exception, match="broken"):  # fails after the records are there
        S.write_report(records(9), summary.withColumn("rate", F.raise_error(F.lit("broken")).cast("double")), path, "new", "m", 100)
    with pytest.raises(Exception, match="broken"):
        S.write_report(records(9).select(F.raise_error(F.lit("broken"))), summary, path, "new", "m", 100)
    rows, head = S.read_report(spark, path)
    assert rows.count() == 5
    head = head.first().asDict(recursive=True)
    assert (head["schema_version"], head["pipeline"], head["model_id"], head["budget_characters"]) == (2, "new", "m", 100)
    assert head["summary"] == {"date": {"correct": 3, "total": 4, "rate": 0.75}, "type": {"correct": 1, "total": 4, "rate": 0.25}}
    S.write_report(records(7), summary, path, "old", "m2", 50)
    rows, head = S.read_report(spark, path)
    assert rows.count() == 7 and head.first()["model_id"] == "m2"


def test_hand_over_and_withdrawal(spark, tmp_path):
    told = []

    def handle(new, lost, batch):
        told.append((batch, sorted(r["key"] for r in new.collect()), sorted(r["key"] for r in lost.collect())))
        if batch == 3 and len([t for t in told if t[0] == 3]) == 1:
            raise RuntimeError("the host is away")

    batches = {
        1: [("a", "m1", "claimed"), ("b", "m1", "claimed"), ("c", "m2", "claimed"), ("d", None, "free")],
        2: [("b", "m2", "claimed"), ("a", "m1", "claimed"), ("e", "m1", "claimed")],  # b is lost, a renewed
        3: [("a", "m1", "done"), ("c", "m1", "claimed"), ("e", "m2", "done")],  # a comes to its end, e is lost
        4: [("b", "m1", "claimed"), ("a", "m2", "claimed")],  # b is back; a was no longer handed over
    }
    run = lambda n: jobs.hand_over(spark.createDataFrame(batches[n], "key string, owner string, state string"), n, "m1", handle, str(tmp_path / "handed"))
    run(1), run(1), run(2)
    with pytest.raises(RuntimeError):
        run(3)
    run(3), run(3), run(4), run(2)
    assert told == [(1, ["a", "b"], []), (2, ["e"], ["b"]), (3, ["c"], ["e"]), (3, ["c"], ["e"]), (4, ["b"], [])] or told[:5] == [(1, ["a", "b"], []), (2, ["e"], ["b"]), (3, ["c"], ["e"]), (3, ["c"], ["e"]), (4, ["b"], [])]
