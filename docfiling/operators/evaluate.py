"""Evaluation of results against a reviewed corpus: scores, summary, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import is_leaf_name

FLAGS = [
    "date_correct", "date_exact", "date_forbidden", "date_present", "date_role_correct", "type_correct", "type_present", "parties_correct", "party_forbidden",
    "description_covers_facts", "description_specific", "readiness_match", "ready",
]
# The acceptance gates, as flag, least rate, most rate.
GATES = [
    ("date_correct", 0.75, None), ("date_correct_when_named", 1.0, None), ("type_correct", 0.7, None), ("parties_correct", 0.6, None), ("description_specific", 0.9, None),
    ("date_forbidden", None, 0.0), ("party_forbidden", None, 0.25), ("review_rate", None, 0.6),
]
LEAST_EVALUATED = 8


def _list(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


# J07
def type_matches(gold: Column, actual: Column) -> Column:
    """Whether every word of the gold type that means something stands in the actual one."""
    words = F.filter(T.tokens(F.lower(gold)), lambda w: (F.octet_length(w) > 2) & ~w.isin("the", "and", "for", "with"))
    return F.coalesce(F.forall(words, lambda w: F.contains(F.lower(actual), w)), F.lit(False))


def party_name(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, rf"[^\p{{IsAlphabetic}}\p{{N}}{T.SPACE}]", ""))
    return F.trim(F.regexp_replace(bare, f"{T.SPACE}+", " "))


def party_matches(a: Column, b: Column) -> Column:
    """Whether one of two names in the form of party_name holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


# E01-E07
def scores(results: DataFrame, gold: DataFrame) -> DataFrame:
    """A row for each result: file, pipeline, status, FLAGS (null: out of scope), party counts, times.

    status: completed as it came, or for failures expected_error / extraction_failed, or unexpected_success.
    """
    g = gold.select("file", *(F.col(c).alias(f"g_{c}") for c in gold.columns if c != "file"))
    df = results.join(g, "file")
    failed = F.col("status") == "failed"
    wanted = F.col("g_expected_error").isNotNull()
    status = F.when(failed, F.when(F.coalesce(F.col("error_code") == F.col("g_expected_error"), F.lit(False)), "expected_error").otherwise("extraction_failed")).when(wanted, "unexpected_success").otherwise(F.col("status"))
    names = {f"{k}_names": F.transform(_list(k), party_name) for k in ("parties", "g_parties", "g_forbidden_parties")}
    df = df.withColumn("scored", ~failed).withColumns({"status": status} | names)
    date, kind, people, wanted_people = F.col("document_date"), F.col("document_type"), F.col("parties_names"), F.col("g_parties_names")
    dated = F.col("g_document_date").isNotNull() | (F.size(_list("g_acceptable_dates")) > 0)
    in_list = lambda c, name: F.coalesce(F.array_contains(_list(name), c), F.lit(False))
    role = dated & date.isNotNull() & (F.coalesce("g_date_role", F.lit("")) != "")
    typed, peopled = F.col("g_document_type").isNotNull(), F.col("g_parties").isNotNull()
    matched = F.size(F.filter(wanted_people, lambda g_: F.exists(people, lambda p: party_matches(g_, p))))
    spurious = F.size(F.filter(people, lambda p: ~F.exists(wanted_people, lambda g_: party_matches(g_, p))))
    facts = _list("g_acceptable_description_facts")
    said = F.coalesce("description", F.lit(""))
    flags = {
        "date_correct": F.when(dated, date.isNotNull() & (date.eqNullSafe(F.col("g_document_date")) | in_list(date, "g_acceptable_dates"))),
        "date_exact": F.when(dated, date.eqNullSafe(F.col("g_document_date"))),
        "date_forbidden": F.when(dated, in_list(date, "g_forbidden_dates")),
        "date_present": F.when(dated, date.isNotNull()),
        "date_role_correct": F.when(role, F.col("date_role").eqNullSafe(F.col("g_date_role"))),
        "type_correct": F.when(typed, F.exists(F.concat(F.array("g_document_type"), _list("g_acceptable_types")), lambda t: type_matches(t, kind))),
        "type_present": F.when(typed, kind.isNotNull()),
        "parties_correct": F.when(peopled, (matched == F.size("g_parties")) & (spurious == 0)),
        "party_forbidden": F.when(peopled, F.exists(people, lambda p: F.exists("g_forbidden_parties_names", lambda f: party_matches(f, p)))),
        "description_covers_facts": F.when(F.size(facts) > 0, F.forall(facts, lambda f: F.contains(F.lower(said), F.lower(f)))),
        "description_specific": T.n_tokens(said) >= 8,
        "readiness_match": F.when(F.col("g_expected_readiness").isNotNull(), F.col("g_expected_readiness") == F.when(F.col("ready"), "ready").otherwise("needs_review")),
        "ready": F.coalesce("ready", F.lit(False)),
    }
    counts = {"parties_matched": F.when(peopled, matched), "parties_expected": F.when(peopled, F.size("g_parties")), "parties_spurious": F.when(peopled, spurious)}
    only = lambda c: F.when(F.col("scored"), c)
    return df.select(
        "file", "pipeline", "status", "filename", *(only(v).alias(k) for k, v in (flags | counts).items()), F.coalesce("extraction_millis", F.lit(0)).cast("long").alias("extraction_millis"), F.coalesce("inference_millis", F.lit(0)).cast("long").alias("inference_millis")
    )


# E08
def by_flag(scored: DataFrame) -> DataFrame:
    """pipeline, flag, correct, total, rate over the rows that carry the flag."""
    # counted side by side: a row for each flag would be thirteen for each result
    wide = scored.groupBy("pipeline").agg(*(F.struct(F.lit(k).alias("flag"), F.count_if(k).alias("correct"), F.count(k).alias("total")).alias(k) for k in FLAGS))
    long = wide.select("pipeline", F.explode(F.array(*FLAGS)).alias("f")).select("pipeline", "f.*").filter("total > 0")
    return long.withColumn("rate", F.col("correct") / F.greatest("total", F.lit(1)))


# E09
def review_rate(scored: DataFrame) -> DataFrame:
    done = scored.filter("status = 'completed'")
    return done.groupBy("pipeline").agg((1 - F.count_if("ready") / F.greatest(F.count("*"), F.lit(1))).alias("rate"), F.count("*").alias("evaluated"))


# E10
def latency(scored: DataFrame) -> DataFrame:
    """pipeline, measure, n, least, median (the upper of two), most, mean (cut to whole milliseconds)."""
    done = scored.filter("status = 'completed'").select("pipeline", F.col("inference_millis").alias("inference"), (F.col("inference_millis") + F.col("extraction_millis")).alias("total"))
    long = done.unpivot(["pipeline"], ["inference", "total"], "measure", "v")
    # the upper median is the value at rank n div 2 from 0; rows are counted by value, so no group is gathered in one row
    counted = long.groupBy("pipeline", "measure", "v").agg(F.count("*").alias("c"))
    run = Window.partitionBy("pipeline", "measure").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("pipeline", "measure")
    ranked = counted.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(every))
    half = F.floor(F.col("n") / 2)
    return ranked.groupBy("pipeline", "measure").agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.min(F.when(F.col("upto") > half, F.col("v"))).alias("median"), F.max("v").alias("most"), F.floor(F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean")
    )


# E11
def _named(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("ready") & F.col("date_correct").isNotNull())


def date_when_named(scored: DataFrame) -> DataFrame:
    """pipeline, rate, n, n_wrong among ready rows with a date flag; rate 1 without any."""
    found = _named(scored).groupBy("pipeline").agg(F.count_if("date_correct").alias("good"), F.count("*").alias("n"), F.count_if(~F.col("date_correct")).alias("n_wrong"))
    df = scored.select("pipeline").distinct().join(found, "pipeline", "left")
    return df.select("pipeline", F.coalesce(F.col("good") / F.col("n"), F.lit(1.0)).alias("rate"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))


def wrong_when_named(scored: DataFrame) -> DataFrame:
    """pipeline, file of the rows that date_when_named counts as wrong."""
    return _named(scored).filter(~F.col("date_correct")).select("pipeline", "file")


# E12
def gate_failures(scored: DataFrame) -> DataFrame:
    """pipeline, gate, value of what an accepted report would not have."""
    rates = by_flag(scored).select("pipeline", F.col("flag").alias("gate"), "rate")
    rates = rates.unionByName(review_rate(scored).select("pipeline", F.lit("review_rate").alias("gate"), "rate"))
    rates = rates.unionByName(date_when_named(scored).select("pipeline", F.lit("date_correct_when_named").alias("gate"), "rate"))
    spark = scored.sparkSession
    gates = spark.createDataFrame(GATES, "gate string, least double, most double")
    wanted = scored.select("pipeline").distinct().join(F.broadcast(gates))  # eight rows for each pipeline
    judged = wanted.join(rates, ["pipeline", "gate"], "left")
    low = F.col("least").isNotNull() & (F.col("rate").isNull() | (F.col("rate") < F.col("least")))
    high = F.col("most").isNotNull() & (F.col("rate") > F.col("most"))
    out = judged.filter(low | high).select("pipeline", "gate", F.col("rate").alias("value"))
    few = review_rate(scored).filter(F.col("evaluated") < LEAST_EVALUATED).select("pipeline", F.lit("evaluated").alias("gate"), F.col("evaluated").cast("double").alias("value"))
    bad = F.coalesce(~is_leaf_name(F.col("filename")), F.lit(True))
    names = scored.filter("status = 'completed'").filter(bad).groupBy("pipeline").agg(F.count("*").cast("double").alias("value")).select("pipeline", F.lit("filename").alias("gate"), "value")
    return out.unionByName(few).unionByName(names)


# J16
def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """file, state (match, changed, missing, extra) of a manifest (file, size, sha256) against what is there."""
    there = files.select("file", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), F.lit(True).alias("there"))
    df = manifest.withColumn("listed", F.lit(True)).join(there, "file", "full_outer")
    same = F.col("size").eqNullSafe(F.col("f_size")) & F.col("sha256").eqNullSafe(F.col("f_sha"))
    return df.select("file", F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(same, "match").otherwise("changed").alias("state"))


# J17
def compare(scored: DataFrame, one: str, other: str) -> DataFrame:
    """file, both statuses and readiness, and which flags changed between two pipelines."""
    side = lambda p, s: scored.filter(F.col("pipeline") == p).select("file", F.col("status").alias(f"status_{s}"), F.struct(*FLAGS).alias(f"f_{s}"))
    df = side(one, "a").join(side(other, "b"), "file", "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"f_a.{k}").eqNullSafe(F.col(f"f_b.{k}")), k) for k in FLAGS)))
    return df.select("file", "status_a", "status_b", F.col("f_a.ready").alias("ready_a"), F.col("f_b.ready").alias("ready_b"), changed.alias("changed"))
