"""Composed jobs: analysis with a scorer, replay, evaluation, the older head-and-tail method, a known-answer probe."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import replies as R
from ..functions import text as T
from ..operators import distill as D
from ..operators import evaluate as E
from ..operators import naming, validate as V
from ..staging import release, shared_dir, stage

HEAD, TAIL = 14_000, 8_000
LEGACY_READY, LEGACY_WORDS, LEGACY_STEM = 0.86, 30, 139

_WHOLE = "You see the whole file."
_CONDENSED = "You see a condensation of the file; [...] stands for text that was left out, and section headings come first."
_ASK = (
    "Name this document for filing. {scope}\n\n"
    "Answer with one JSON object with the keys type_evidence, document_type, date_evidence, document_date, date_role, parties, party_evidence, party_relation, description, "
    "confidence and needs_review. Copy evidence word for word; answer null or [] where the document is silent.\n\n--- BEGIN DOCUMENT ---\n"
)


# X21
def prompts(digests: DataFrame) -> DataFrame:
    """doc_id, prompt, prompt_sha256, prompt_characters; our own wording around the digest's text."""
    before, after = _ASK.split("{scope}")
    scope = F.when(F.col("compressed"), _CONDENSED).otherwise(_WHOLE)
    prompt = F.concat(F.lit(before), scope, F.lit(after), F.col("text"), F.lit("\n--- END DOCUMENT ---\n"))
    return digests.select("doc_id", prompt.alias("prompt")).select("*", F.sha2("prompt", 256).alias("prompt_sha256"), F.char_length("prompt").alias("prompt_characters"))


# U01
def extract(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_number, text, error_code, retryable: the pages that reader makes of each file's content, or its error as a row.

    An exception's attributes code and retryable are used if there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, k, text, None, None) for k, text in enumerate(reader(content), 1)]
                except Exception as e:  # noqa: BLE001 - whatever a reader raises is this file's error
                    rows.append((path, None, None, getattr(e, "code", "PARSE_FAILED"), bool(getattr(e, "retryable", False))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "page_number", "text", "error_code", "retryable"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, text string, error_code string, retryable boolean")


# U02
Scorer = Callable[[list[str]], list[str]]
LEDGER = "key string, doc_id long, attempt int, reply string, reason string"


def ask(prompts_: DataFrame, scorer: Scorer, at_once: int = 8) -> DataFrame:
    """prompts_ (prompt last) with reply instead of prompt; scorer is called on the executors with so many prompts at a time."""
    others = prompts_.drop("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                some = batch.slice(a, at_once)
                replies = scorer(some.column(some.num_columns - 1).to_pylist())
                if len(replies) != some.num_rows:
                    raise ValueError(f"{some.num_rows} prompts, {len(replies)} replies")
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(replies, pa.string())], names=[*some.schema.names[:-1], "reply"])

    return prompts_.select(*others.columns, "prompt").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in others.dtypes) + ", reply string")


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """LEDGER as it is now; an empty one is made where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def propose(prompts_: DataFrame, scorer: Scorer, ledger: str | None = None, attempts: int = 2, at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """(proposals, rejects): replies decoded, and the last replies of those that stay bad after so many attempts, with the reason.

    Each reply is written once to the ledger, with the number of its attempt and why it is rejected.  An attempt asks for the
    prompts that the ledger has no good reply to and that were asked less often; both results are read from the ledger.  So n
    prompts cost n calls and one for each bad reply whatever is done with the results, and a job that starts again with the same
    ledger asks only for what is open.  A prompt is known by its document and its text.
    """
    spark = prompts_.sparkSession
    path = ledger or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2("prompt", 256)).alias("key")
    asked = stage(prompts_.select(key, "doc_id", "prompt").dropDuplicates(["key"]), "prompts")
    for attempt in range(1, attempts + 1):
        done = ledger_of(spark, path).filter(F.col("reason").isNull() | (F.col("attempt") >= attempt)).select("key")
        open_ = asked.join(done, "key", "left_anti")
        if not open_.isEmpty():
            replies = R.with_reason(ask(open_.select("key", "doc_id", F.lit(attempt).alias("attempt"), "prompt"), scorer, at_once))
            replies.select("key", "doc_id", "attempt", "reply", "reason").write.mode("append").parquet(path)
    mine = ledger_of(spark, path).join(asked.select("key"), "key", "left_semi")
    last = mine.groupBy("key", "doc_id").agg(F.max_by(F.struct("reply", "reason"), F.struct(F.col("reason").isNull(), "attempt")).alias("r")).select("doc_id", "r.*")
    return R.decode(last.filter("reason is null"))[0], last.filter("reason is not null")


# U03
def replay(proposals: DataFrame, digests: DataFrame, listing: DataFrame, places: DataFrame) -> DataFrame:
    """Validation and naming of stored proposals without a scorer; places: doc_id, folder, extension."""
    checked = stage(V.validate(proposals, digests), "checked")
    named = naming.compose_names(checked.join(places, "doc_id"), listing)
    return checked.join(named.select("doc_id", "filename", "collision_index"), "doc_id", "left")


# C04
def analyze(pages: DataFrame, scorer: Scorer, listing: DataFrame, places: DataFrame, budget: int = D.BUDGET, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(analyses, rejects) of pages: distil, ask, validate, name, with the prompt's hash and length."""
    digests = stage(D.distill(pages, budget), "digests")
    asked = stage(prompts(digests), "asked")
    proposals, lost = propose(asked, scorer, ledger)
    return replay(proposals, digests, listing, places).join(asked.drop("prompt"), "doc_id"), lost


# U04
def _handed(spark: SparkSession, folder: str) -> dict[int, str]:
    """What was handed over after each batch that came to its end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = [str(x.getPath()) for x in fs.listStatus(root)]
    return {int(p.rsplit("=", 1)[1]): p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}


def hand_over(states: DataFrame, batch: int, machine: str, handle: Callable[[DataFrame, DataFrame, int], None], folder: str) -> None:
    """Tell the caller of a batch's claims: handle(new, withdrawn, batch) with the keys that are `machine`'s now and those that it lost.

    states: key, owner, state of the keys that changed, one row for each.  What was handed over is a table for each batch in
    folder, the last two of which stay; a batch that is repeated after it came to its end does nothing, and one that failed before
    is handed over again under its number.
    """
    spark = states.sparkSession
    done = _handed(spark, folder)
    if batch in done:
        return
    before = max((b for b in done if b < batch), default=None)
    held = spark.read.schema("key string").parquet(done[before]) if before is not None else spark.createDataFrame([], "key string")
    now = stage(states.select("key", (F.col("owner").eqNullSafe(machine) & (F.col("state") == "claimed")).alias("mine"), (F.col("owner") != machine).alias("others")), "claims")
    new = stage(now.filter("mine").select("key").join(held, "key", "left_anti"), "new")
    lost = stage(held.join(now.filter("others").select("key"), "key", "left_semi"), "withdrawn")
    handle(new, lost, batch)
    held.join(now.select("key"), "key", "left_anti").unionByName(now.filter("mine").select("key")).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    release(now, new, lost)
    for b in sorted(done)[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(done[b])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def per_batch(stream: DataFrame, machine: str, handle: Callable[[DataFrame, DataFrame, int], None], folder: str, checkpoint: str, trigger: dict):
    """Start a stream of claim states (update mode) whose new and withdrawn claims are handed to the caller batch by batch."""
    write = stream.writeStream.outputMode("update").foreachBatch(lambda states, batch: hand_over(states, batch, machine, handle, folder))
    return write.option("checkpointLocation", checkpoint).trigger(**trigger).start()


# C05
def evaluate(results: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    scored = E.scores(results, gold)
    return {"records": scored, "flags": E.by_flag(scored), "review": E.review_rate(scored), "latency": E.latency(scored), "named": E.date_when_named(scored), "named_wrong": E.wrong_when_named(scored), "failures": E.gate_failures(scored)}


# X18
def legacy_digest(pages: DataFrame) -> DataFrame:
    """doc_id, segments: the pages in one text, or its first 14,000 and last 8,000 characters."""
    page = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text"))
    docs = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", page.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    long = F.char_length("t") > HEAD + TAIL
    return docs.select("doc_id", F.when(long, F.array(F.left("t", F.lit(HEAD)), F.right("t", F.lit(TAIL)))).otherwise(F.array("t")).alias("segments"))


# X19
def legacy_validate(proposals: DataFrame, digests: DataFrame) -> DataFrame:
    """proposals (doc_id, document_type, document_date, date_kind, subject, description, confidence, type_evidence, date_evidence, subject_evidence) with reasons and status.

    A field stands only if its quote holds it and stands in one segment.
    """
    n = T.evidence_text
    df = proposals.join(V.normal_segments(digests), "doc_id", "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<string>")))
    fields = ["document_type", "subject"]
    df = df.withColumns({f"n_{k}": n(F.col(k)) for k in (*fields, "type_evidence", "date_evidence", "subject_evidence")})
    quote = {"document_type": "n_type_evidence", "subject": "n_subject_evidence"}
    ok = {k: V.value_in_quote(F.col("segs"), F.col(q), F.col(f"n_{k}")) for k, q in quote.items()}
    dated = T.is_iso_date(F.col("document_date")) & (F.coalesce("date_kind", F.lit("")) != "due") & V.date_supported(F.array("n_date_evidence"), F.col("document_date")) & V.contained(F.col("segs"), F.col("n_date_evidence"))
    df = df.withColumns({f"ok_{k}": v for k, v in ok.items()} | {"ok_date": F.coalesce(dated, F.lit(False))})
    flags = [
        ("TYPE_UNSUPPORTED", ~F.col("ok_document_type")), ("DATE_UNSUPPORTED", ~F.col("ok_date")), ("PARTY_UNSUPPORTED", ~F.col("ok_subject")),
        ("DESCRIPTION_INVALID", T.n_tokens(F.coalesce("description", F.lit(""))) > LEGACY_WORDS), ("LOW_CONFIDENCE", F.coalesce(F.col("confidence") < F.lit(LEGACY_READY).cast("float"), F.lit(True))),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, k) for k, c in flags)))
    keep = lambda k, c: F.when(F.col(c), F.col(k)).alias(k)
    out = df.select("doc_id", keep("document_type", "ok_document_type"), keep("document_date", "ok_date"), keep("subject", "ok_subject"), "description", reasons.alias("reasons"))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "ready").otherwise("needs_review"))


# X20
def legacy_filename(ext: Column) -> Column:
    """The file name of a checked proposal: date, type and subject joined by ' - ', cut to fit."""
    clean = N.extension(ext)
    parts = F.array_compact(F.array(N.segment(F.col("document_date")), N.segment(F.col("document_type")), N.segment(F.col("subject"))))
    stem = F.coalesce(F.nullif(F.array_join(parts, " - "), F.lit("")), F.lit("Document"))
    return F.concat(T.rtrim(F.left(stem, F.lit(LEGACY_STEM) - F.char_length(clean))), F.lit("."), clean)


# C06
def legacy(pages: DataFrame, proposals: DataFrame, ext: str = "pdf") -> DataFrame:
    checked = legacy_validate(proposals, legacy_digest(pages))
    return checked.withColumn("filename", legacy_filename(F.lit(ext)))


# C07
def probe(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """passed: whether a scorer finds the date 2024-01-02 and the marker in the first line of a fixed notice; docs gives the session only."""
    page = docs.sparkSession.createDataFrame([(0, 1, "CALIBRATION NOTICE ZX-41\n\nNotice date: January 2, 2024\n\nThis notice concerns the calibration of instrument ZX-41.")], "doc_id long, page_number int, text string")
    proposals, _ = propose(prompts(D.distill(page)), scorer)
    good = (F.col("document_date") == "2024-01-02") & F.contains(F.coalesce("document_type", F.lit("")), F.lit("Calibration"))
    return proposals.agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("passed"))
