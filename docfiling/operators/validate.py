"""Validation: every fact of a proposal literally against the digest's segments, a row for each proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

READY_CONFIDENCE, TYPE_SHARE, MOST_PARTIES = 0.6, 0.6, 2


def normal_segments(digests: DataFrame) -> DataFrame:
    """doc_id, segs: the segments in evidence form, each normalised once."""
    return digests.select("doc_id", T.evidence_texts(F.col("segments")).alias("segs"))


# J01
def contained(segs: Column, value: Column) -> Column:
    """Whether a normalised value isn't empty and stands in one normalised segment."""
    return F.coalesce((value != "") & F.exists(segs, lambda s: F.contains(s, value)), F.lit(False))


# J02
def value_in_quote(segs: Column, quote: Column, value: Column) -> Column:
    return F.coalesce((value != "") & F.contains(quote, value), F.lit(False)) & contained(segs, quote)


# J03
def date_supported(segs: Column, iso: Column) -> Column:
    """Whether a rendering of the date stands in one segment."""
    month = F.substring(iso, 6, 2).try_cast("int")
    stands = lambda r: F.exists(segs, lambda s: F.contains(s, r))

    def found(p: Column) -> Column:
        # written out only until one is found, and with the month's name first
        named = F.exists(p["months"], lambda w: F.exists(T.dates_by_name(p, w), stands))
        return F.coalesce(named, F.lit(False)) | F.exists(T.dates_by_number(iso, p), stands)

    return F.coalesce((F.octet_length(iso) == 10) & month.between(1, 12) & T.bound(T.date_parts(iso), found), F.lit(False))


# J04
def type_supported(segs: Column, kind: Column) -> Column:
    """Whether 0.6 of the significant words of a normalised type stand in segments; false if it has none."""
    words = F.filter(T.tokens(kind), lambda w: (F.octet_length(w) > 2) & ~w.isin(T.GENERIC_WORDS))
    found = lambda ws: F.size(F.filter(ws, lambda w: contained(segs, w)))
    return T.bound(words, lambda ws: (F.size(ws) > 0) & (found(ws).cast("float") >= F.size(ws).cast("float") * F.lit(TYPE_SHARE).cast("float")))


# J06
def claims(sentence: Column) -> Column:
    """Array of (index, token) that claim something: digits, or a capital that isn't the first word's nor a generic word's."""
    edge = r"^[^\p{IsAlphabetic}\p{N}]+|(?<![^\p{IsAlphabetic}\p{N}])[^\p{IsAlphabetic}\p{N}]+$"
    cut = lambda w: F.when(w.rlike(r"\A[A-Za-z0-9]+\z"), w).otherwise(F.regexp_replace(w, edge, ""))
    all_ = F.transform(T.tokens(sentence), lambda w, i: F.struct(i.alias("index"), cut(w).alias("token")))
    capital = lambda x: (x["index"] > 0) & x["token"].rlike(r"\A\p{IsUppercase}") & ~T.ascii_lower(x["token"]).isin(T.GENERIC_WORDS)
    return F.filter(all_, lambda x: (F.char_length(x["token"]) >= 3) & (x["token"].rlike("[0-9]") | capital(x)))


# T05
def distinct_union(*values: Column) -> Column:
    """The different values of some arrays, in order of their first appearance; nulls left out."""
    return F.array_distinct(F.array_compact(F.concat(*values)))


# A07, M03, X15-X17, C02
def validate(proposals: DataFrame, digests: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Checked proposals with status (ready, needs_review) and ordered reasons.

    proposals: schemas.PROPOSALS.  digests: doc_id, segments.  warnings: doc_id, field_affecting; any true one adds
    PARSER_WARNING.  A proposal without a digest keeps nothing that needs support.
    """
    texts = proposals.withColumn("parties", F.coalesce("parties", F.array().cast("array<string>")))
    # what is used several times is a column of its own
    texts = texts.withColumn("first", T.first_sentence(F.coalesce("description", F.lit(""))))
    sentence, over = T.capped_sentence(F.col("first"))
    texts = texts.withColumns({"too_long": over, "said": sentence})
    texts = texts.withColumn("claimed", F.transform(claims(F.col("said")), lambda x: x["token"]))
    # the words to be looked for, and their evidence forms: those of a row's texts are made in one go
    none = F.array().cast("array<string>")
    texts = texts.withColumn("asked", distinct_union(F.col("claimed"), F.transform("parties", T.trim)))
    df = texts.join(digests.select("doc_id", F.col("segments").alias("segs")), "doc_id", "left")
    kind = F.nullif(T.trim(F.col("document_type")), F.lit(""))
    date = F.nullif(T.trim(F.col("document_date")), F.lit(""))
    df = df.withColumns({"kind": kind, "date": date, "n_asked": F.size("asked")})
    df = df.withColumn("all", F.concat(F.array("kind"), "asked", F.coalesce("segs", none))).withColumn("all", T.evidence_texts(F.col("all")))
    asked, segs = F.slice("all", 2, F.col("n_asked")), F.slice("all", F.col("n_asked") + 2, F.size("all"))
    df = df.withColumns({"kind_normal": F.get("all", F.lit(0)), "normals": F.map_from_arrays("asked", asked), "segs": segs})
    has_kind = F.col("kind").isNotNull()
    type_ok = ~has_kind | type_supported(F.col("segs"), F.col("kind_normal"))
    date_ok = F.col("date").isNull() | (T.is_iso_date(F.col("date")) & date_supported(F.col("segs"), F.col("date")))
    df = df.withColumns({"type_ok": type_ok, "date_ok": date_ok})
    supported = lambda name: T.bound(F.element_at("normals", name), lambda v: contained(F.col("segs"), v))
    df = df.withColumn("good", F.filter("parties", lambda p: T.bound(T.trim(p), lambda name: (name != "") & supported(name))))
    df = df.withColumn("kept", F.slice(F.array_distinct(F.transform("good", T.trim)), 1, MOST_PARTIES))
    unsupported = F.exists("claimed", lambda token: ~supported(token))
    relation = F.when(F.size("kept") == 0, "none").when((F.col("party_relation") == "between") & (F.size("kept") < 2), "with").otherwise(F.col("party_relation"))
    warned = F.lit(False)
    if warnings is not None:
        affecting = warnings.filter("field_affecting").select("doc_id").distinct().withColumn("warned", F.lit(True))
        df = df.join(affecting, "doc_id", "left")
        warned = F.coalesce("warned", F.lit(False))
    low = F.isnan("confidence") | F.col("confidence").isNull() | (F.abs("confidence") == float("inf")) | (F.col("confidence") < F.lit(READY_CONFIDENCE).cast("float"))
    flags = [
        ("TYPE_UNSUPPORTED", ~F.col("type_ok")), ("TYPE_MISSING", F.col("type_ok") & ~has_kind), ("DATE_UNSUPPORTED", ~F.col("date_ok")), ("DATE_MISSING", F.col("date_ok") & F.col("date").isNull()),
        ("PARTY_UNSUPPORTED", F.size("good") < F.size("parties")), ("DESCRIPTION_INVALID", F.col("too_long") | ~T.is_usable_sentence(F.col("said"))), ("DESCRIPTION_UNSUPPORTED", unsupported),
        ("LOW_CONFIDENCE", low), ("MODEL_REQUESTED_REVIEW", F.coalesce("needs_review", F.lit(False))), ("PARSER_WARNING", warned),
    ]
    df = df.withColumn("reasons", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags))))
    return df.select(
        "doc_id",
        F.when(F.col("type_ok"), F.col("kind")).alias("document_type"),
        F.when(F.col("date_ok"), F.col("date")).alias("document_date"),
        F.when(F.col("date_ok") & F.col("date").isNotNull(), F.col("date_role")).alias("date_role"),
        F.col("kept").alias("parties"),
        relation.alias("party_relation"),
        F.col("said").alias("description"),
        "confidence",
        F.when(F.size("reasons") == 0, "ready").otherwise("needs_review").alias("status"),
        "reasons",
    )


# A08
def reason_histogram(validated: DataFrame) -> DataFrame:
    """status, reason, n: documents by status and reason, with subtotals (reason null) and the total (both null)."""
    return validated.select("doc_id", "status", F.explode_outer(F.transform("reasons", lambda r: r)).alias("r")).select(
        "status", F.coalesce("r", F.lit("NONE")).alias("reason")
    ).rollup("status", "reason").agg(F.count("*").alias("n"))
