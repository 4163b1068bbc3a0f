"""Model replies: JSON recovery, typed proposals, chat envelopes, domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .text import bound, is_iso_date, trim

# The code sets.
DATE_ROLES = ["effective", "execution", "notice", "termination", "amendment", "invoice", "filing", "issuance", "other"]
RELATIONS = ["between", "for", "with", "from", "to", "none"]
REASONS = ["TYPE_UNSUPPORTED", "TYPE_MISSING", "DATE_UNSUPPORTED", "DATE_MISSING", "PARTY_UNSUPPORTED", "DESCRIPTION_INVALID", "DESCRIPTION_UNSUPPORTED", "LOW_CONFIDENCE", "MODEL_REQUESTED_REVIEW", "PARSER_WARNING"]
ITEM_STATES = ["queued", "extracting", "analyzing", "ready", "needs_review", "failed", "canceled", "applying", "completed"]
STAGES = ["planned", "copied", "verified", "published", "rollback_required", "rolled_back", "complete"]
OUTCOMES = ["renamed", "kept_original", "failed", "unknown"]
CODES = {"date_role": DATE_ROLES, "party_relation": RELATIONS, "reason": REASONS, "status": ITEM_STATES, "stage": STAGES, "outcome": OUTCOMES}
MOST_PARTIES = 3

LEGACY_REPLY = (
    "document_type string, document_date string, date_kind string, subject string, party string, description string, confidence float, needs_review boolean, "
    "date_evidence string, type_evidence string, subject_evidence string, party_evidence string, language string"
)


# K01
def json_text(reply: Column) -> Column:
    """The JSON object of a reply: inside a closed fence, or from the first { to the last }; null if there is none."""

    def body(t: Column) -> Column:
        fenced = t.rlike(r"\A```(?:json|JSON)?\s") & t.endswith("```")
        return F.when(fenced, F.regexp_replace(F.regexp_replace(t, r"\A```(?:json|JSON)?", ""), r"```\z", "")).otherwise(t)

    def inner(text: Column) -> Column:
        first, last = F.instr(text, "{"), F.char_length(text) - F.instr(F.reverse(text), "}") + 1
        return F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))

    return bound(bound(trim(reply), body), inner)


def with_reason(replies: DataFrame) -> DataFrame:
    """replies (reply and others) with p, the parsed reply, and reason, why it is rejected; null for a good one."""
    parsed = F.from_json(json_text(F.col("reply")), schemas.REPLY + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # the generator parses each reply once, however many of its fields are used
    df = replies.select("*", F.explode(F.array(parsed)).alias("p"))
    p = lambda k: F.col(f"p.{k}")
    known = lambda k, codes: p(k).isNull() | p(k).isin(codes)
    sure = F.coalesce(p("confidence"), F.lit(0.0).cast("float"))
    reason = (
        F.when(F.col("p").isNull(), "NO_JSON").when(p("_corrupt").isNotNull(), "BAD_JSON").when(~(known("date_role", DATE_ROLES) & known("party_relation", RELATIONS)), "UNKNOWN_CODE")
        .when(F.isnan(sure) | ~sure.between(0, 1), "BAD_CONFIDENCE")
    )
    return df.withColumn("reason", reason)


# K02
def decoded(replies: DataFrame) -> DataFrame:
    """doc_id, reply, reason and the fields of a proposal for each of replies (doc_id, reply); where reason isn't null, the fields mean nothing.

    A reply is rejected that holds no JSON object (NO_JSON, BAD_JSON), an unknown code (UNKNOWN_CODE), or a confidence outside
    0..1 (BAD_CONFIDENCE).  Missing fields default; a date that isn't one goes with its role; of parties three stay.
    """
    df = with_reason(replies)
    p = lambda k: F.col(f"p.{k}")
    sure = F.coalesce(p("confidence"), F.lit(0.0).cast("float"))
    dated = is_iso_date(p("document_date"))
    some = lambda k: F.slice(F.coalesce(p(k), F.array().cast("array<string>")), 1, MOST_PARTIES)
    return df.select(
        "doc_id", "reply", "reason", p("document_type").alias("document_type"), F.when(dated, p("document_date")).alias("document_date"), F.when(dated, p("date_role")).alias("date_role"), some("parties").alias("parties"),
        F.coalesce(p("party_relation"), F.lit("none")).alias("party_relation"), F.coalesce(p("description"), F.lit("")).alias("description"), sure.alias("confidence"),
        F.coalesce(p("needs_review"), F.lit(False)).alias("needs_review"),
        F.struct(p("date_evidence").alias("date"), p("type_evidence").alias("document_type"), some("party_evidence").alias("parties")).alias("evidence"),
    )


def decode(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, rejects) of replies (doc_id, reply), rejects with a reason; who needs both at once has them in one pass from decoded."""
    df = decoded(replies)
    return df.filter("reason is null").drop("reply", "reason"), df.filter("reason is not null").select("doc_id", "reply", "reason")


# K03
def chat_content(body: Column) -> Column:
    """Text of a chat completion's first choice, given as text or as parts; null unless it stopped of itself."""
    choice = "struct<choices:array<struct<finish_reason:string,message:struct<content:{}>>>>"
    of = lambda kind: F.get(F.from_json(body, choice.format(kind))["choices"], F.lit(0))
    plain, parts = of("string"), of("array<struct<type:string,text:string>>")
    listed = parts["message"]["content"]
    text = F.array_join(F.transform(F.filter(listed, lambda x: x["type"] == "text"), lambda x: x["text"]), "")
    stopped = plain["finish_reason"].isNull() | (plain["finish_reason"] == "stop")
    return F.when(stopped, F.when(F.size(listed) > 0, text).otherwise(plain["message"]["content"]))


# K04
def legacy_reply(c: Column) -> Column:
    return F.from_json(json_text(c), LEGACY_REPLY)


# K05
def domain_rejects(df: DataFrame, coded: dict[str, str]) -> DataFrame:
    """Rows with column, value where a column isn't null and holds none of its set's codes; coded: column -> key of CODES."""
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~F.col(c).isin(CODES[k]), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, k in coded.items())))
    return df.withColumn("bad", F.explode(bad)).select("*", "bad.column", "bad.value").drop("bad")
