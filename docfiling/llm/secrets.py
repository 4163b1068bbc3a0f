"""Secret scan with ownership frequency, in DataFrame functions only.

Patterns find candidates in whole texts.  The hash of each candidate's value is counted over the corpus by distinct
repository and owner: a value that many owners have is a copied example, one that belongs to a single owner and looks
random is taken as live.  Long random-looking words that no base pattern covers are candidates too; they are reported only
if owner-specific.

Edge cases: null texts count as empty; a null repository or owner is a repository or owner of its own.  Repeated rows
and rows without an id each get their own row.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: kind -> pattern, group with the value, least length of the value.  Kinds rank as listed.
BASE = {"assign": (ASSIGN, 1, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: Kinds that the method adds when a value is owner-specific.
ADDED = {
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    "issued": (r"(?:gh[pousr]_|sk_live_|sk_test_|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    "random": (r"[A-Za-z0-9+/_-]{28,}", 0, 28),
}
KINDS = [*BASE, *ADDED]


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of a struct for each match of one pass from the left, in order.

    gap and size are the code points before it (from the match before) and in it, good says whether its value is long
    enough (and random enough); a match that isn't still uses up its characters.  name is the value's hash, varied says
    whether it has eight different characters.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(whole))

    def one(x: Column) -> Column:
        v = x["v"]
        good = F.char_length(v) >= least
        if kind == "random":
            good &= (F.regexp_count(v, F.lit("[0-9]")) >= 3) & v.rlike("[A-Za-z]")
        varied = F.size(F.array_distinct(F.split(v, ""))) >= 8
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["g"].alias("gap"), F.char_length(x["m"]).alias("size"), good.alias("good"), F.when(good, F.sha2(v, 256)).alias("name"), varied.alias("varied"))

    found = F.transform(F.arrays_zip(whole.alias("m"), value.alias("v"), gaps.alias("g")), one)
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,good:boolean,name:string,varied:boolean>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _placed(found: DataFrame) -> DataFrame:
    """row, owner, repository, start, end, kind, name, varied of good matches; of the added kinds those that no base span overlaps.

    Places are running sums over a row's matches, and overlaps are told by running extremes, so that a text with many
    matches costs a sort of them.
    """
    each = found.filter(F.size("all") > 0).select("row", "owner", "repository", F.posexplode("all").alias("pos", "m")).select("row", "owner", "repository", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("pos")).cast("int")
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("good").drop("pos", "gap", "size", "good")
    base = F.col("kind") < len(BASE)
    to_here = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach, ahead = F.max(F.when(base, F.col("end"))).over(to_here), F.min(F.when(base, F.col("start"))).over(from_here)
    each = each.withColumn("reach", reach).withColumn("ahead", ahead)
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    return each.filter(base | apart).drop("reach", "ahead")


def scan(
    df: DataFrame,
    owner: Column,
    repository: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_owners: int = 1,
    most_repositories: int = 3,
) -> DataFrame:
    """doc_id, base (array of spans), spans (array with the added ones), live, copied (counts of spans) for each row.

    Only the matches' hashes and places shuffle.  A value that very many rows hold is one key of the last join alone, which
    Spark splits where it is skewed; its owners are counted from partial counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), text.alias("text"))
    every = F.concat(*(matches(F.col("text"), k, *p) for k, p in (BASE | ADDED).items()))
    found = stage(named.select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), every.alias("all")), "candidates")

    each = stage(_placed(found), "spans")
    owned = each.select("name", "owner", "repository").distinct().groupBy("name", "owner").agg(F.count("*").alias("repositories"))
    owned = stage(owned.groupBy("name").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "ownership")
    judged = each.drop("repository").join(owned, "name")
    specific = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = judged.withColumn("live", specific & F.col("varied")).filter((F.col("kind") < len(BASE)) | F.col("live"))
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("copied"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    without = found.filter(F.size("all") == 0).select("doc_id", none.alias("spans"), F.lit(0).cast("long").alias("live"), F.lit(0).cast("long").alias("copied"))
    some = found.filter(F.size("all") > 0).select("row", "doc_id").join(by_row, "row", "left")
    some = some.select("doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("live", F.lit(0)).cast("long").alias("live"), F.coalesce("copied", F.lit(0)).cast("long").alias("copied"))
    return without.unionByName(some).select("doc_id", F.filter("spans", lambda s: s["kind"] < len(BASE)).alias("base"), "spans", "live", "copied")


def as_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
