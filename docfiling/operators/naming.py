"""File names for validated proposals, without clashes in a folder or in the batch."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..staging import release, stage

#: Suffixes have at most so many digits.
DIGITS = 9
_PARTS = ["date", "kind", "people", "party_relation", "ext"]


def parts(validated: DataFrame) -> DataFrame:
    """validated with clean date, kind, people and ext."""
    ext = N.extension(F.coalesce("extension", F.lit("")))
    df = validated.withColumn("ext", ext)
    kind = F.coalesce(N.segment(N.without_extension(F.col("document_type"), F.col("ext"))), F.lit("Document"))
    people = F.filter(F.transform("parties", N.segment), lambda p: p.isNotNull())
    return df.withColumns({"date": F.coalesce(N.segment(F.col("document_date")), F.lit("")), "kind": kind, "people": people})


def name_with(k: Column) -> Column:
    """The name with the k-th suffix, over the columns of parts."""
    suffix = F.when(k == 1, "").otherwise(F.concat(F.lit(" ("), k.cast("string"), F.lit(")")))
    return N.fitted(F.col("date"), F.col("kind"), F.col("people"), F.col("party_relation"), suffix, F.col("ext"))


#: A name's key without suffix and extension, the suffix's number (over 1), the extension.
_KEY = rf"(?s)\A(.*?)(?: \((?!1\))([1-9][0-9]{{0,{DIGITS - 1}}})\))?(\.[a-z0-9]{{1,16}})?\z"


def _space(folder: Column, key: Column) -> Column:
    """(space, n) of a name's key: n is the number of its suffix, or 1, and space the folder and what is left; null folders are alike."""
    base, number, ext = (F.regexp_extract(key, _KEY, k) for k in (1, 2, 3))
    n = F.when(number == "", 1).otherwise(number.try_cast("long"))
    return F.struct(F.to_json(F.struct(folder.alias("f"), base.alias("b"), ext.alias("e"))).alias("space"), n.cast("long").alias("n"))


def _widths() -> Column:
    """The numbers of a family's first name and of its last suffix of each width."""
    return F.array(*(F.lit(10**d - 1 if d else 1).cast("long") for d in range(DIGITS + 1)))


def _spaces(families: DataFrame) -> DataFrame:
    """family, first (the first name's space and n), wide, spaces of families (family, folder and the columns of parts).

    A name that fits beside the widest suffix has the same space, wide, with all suffixes; for others wide is null, and spaces has
    those of suffixes of each width, the first name's first.
    """
    tail = F.when(F.col("ext") == "", "").otherwise(F.concat(F.lit("."), F.col("ext")))
    widest = f" ({10**DIGITS - 1})"
    df = families.withColumns({"full": N.whole_stem(F.col("date"), F.col("kind"), F.col("people"), F.col("party_relation")), "tail": tail})
    df = df.withColumn("fits", F.char_length("full") <= N.room_beside(F.concat(F.lit(widest), F.col("tail"))))
    # what stands before the suffix, as it is in a key; a plain first name differs by the suffix alone
    base = T.bound(F.lower(F.concat(F.col("full"), F.lit(widest), F.col("tail"))), lambda key: F.left(key, F.char_length(key) - F.char_length("tail") - len(widest)))
    df = df.withColumn("wide", F.when(F.col("fits"), F.to_json(F.struct(F.col("folder").alias("f"), base.alias("b"), F.col("tail").alias("e")))))
    plain = F.col("fits") & (F.col("tail") != "") & T.is_ascii(F.col("full")) & ~F.contains("full", F.lit(" ("))
    of = lambda k: _space(F.col("folder"), N.name_key(name_with(k)))
    first = F.when(plain, F.struct(F.col("wide").alias("space"), F.lit(1).cast("long").alias("n"))).otherwise(of(F.lit(1).cast("long")))
    return df.select("family", first.alias("first"), "wide", F.when(F.col("wide").isNull(), F.transform(_widths(), of)).alias("spaces"))


def running(df: DataFrame, key: str, order: list[Column], flag: Column, name: str) -> DataFrame:
    """df with the sum of flag over the key's rows up to each row, in order; df's order must be total but for rows that are alike.

    Rows are dealt by ranges of (key, order), so that no key is one task's: each range is summed on its own and told what
    the key's earlier ranges have.
    """
    df = df.withColumns({"_flag": flag.cast("long")} | {f"_by{i}": c for i, c in enumerate(order)})
    by = [f"_by{i}" for i in range(len(order))]
    dealt = stage(df.repartitionByRange(key, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(key, "_range").agg(F.sum("_flag").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("_flag").over(Window.partitionBy(key, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_own", upto).join(sums.select(key, "_range", earlier.alias("_before")), [key, "_range"])
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_flag", "_range", "_own", "_before", *by)


class _Taken:
    """Numbers that are taken, as runs."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, n: int) -> int:
        """The smallest free number from n on."""
        at = bisect_right(self.starts, n) - 1
        return self.ends[at] + 1 if at >= 0 and n <= self.ends[at] else n

    def add(self, n: int) -> None:
        if self.free(n) != n:
            return
        at = bisect_right(self.starts, n)
        left, right = at > 0 and self.ends[at - 1] == n - 1, at < len(self.starts) and self.starts[at] == n + 1
        if left and right:
            self.ends[at - 1] = self.ends.pop(at)
            self.starts.pop(at)
        elif left:
            self.ends[at - 1] = n
        elif right:
            self.starts[at] = n
        else:
            self.starts.insert(at, n)
            self.ends.insert(at, n)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k for each document, in order within a folder; a folder's names that are there come first."""
    for batch_rows in _by_folder(batches):
        taken: dict[str, _Taken] = {}
        next_k: dict[str, int] = {}
        carried, ks, kind = [], [], None
        for own, kind, family, spaces in batch_rows:
            if family is None:
                taken.setdefault(spaces[0]["space"], _Taken()).add(spaces[0]["n"])
                continue
            k = next_k.get(family, 1)
            if k == 1:
                first = taken.setdefault(spaces[0]["space"], _Taken())
                k = 1 if first.free(spaces[0]["n"]) == spaces[0]["n"] else 2
            if k == 1:
                first.add(spaces[0]["n"])
            else:
                while True:
                    there = taken.setdefault(spaces[len(str(k))]["space"], _Taken())
                    free = there.free(k)
                    if len(str(free)) == len(str(k)):
                        break
                    k = 10 ** len(str(k))  # the next width has a space of its own
                k = free
                there.add(k)
            next_k[family] = k + 1
            carried.append(own)
            ks.append(k)
            if len(ks) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(carried, kind), pa.array(ks, pa.int64())], names=["own", "k"])
                carried, ks = [], []
        if ks:
            yield pa.RecordBatch.from_arrays([pa.array(carried, kind), pa.array(ks, pa.int64())], names=["own", "k"])


def _by_folder(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows (own, its type, family, spaces) of each folder as they come."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            kind = batch.schema.field("own").type
            for folder, own, family, spaces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield folder, own, kind, family, spaces

    for _, members in groupby(rows(), key=lambda r: r[0]):
        yield (r[1:] for r in members)


# X08-X13, J15, W13, C03
def compose_names(validated: DataFrame, listing: DataFrame) -> DataFrame:
    """doc_id, folder, filename, collision_index, a row for each row of validated.

    validated: doc_id, folder, extension, document_type, document_date, parties, party_relation.  listing: folder, name of what is
    there already.  In a folder documents take their turn by doc_id (those without one last), and each gets the smallest suffix
    whose name nobody has.  A null folder is a folder of its own.

    Documents whose names have the same parts are a family: they share a sequence of names, and the n-th of them gets the n-th
    free suffix, which is n and the number of taken suffixes that have fewer than n free ones before them.  Both are ranks, and
    no family is one task's.  Families that could clash with another (one's second name is another's first, or names cut to fit
    are alike) are rare; they are named one by one in order, in a pass over their folder's rows that holds runs of taken numbers.
    """
    df = parts(validated).select("doc_id", "folder", *_PARTS)
    df = stage(df.withColumn("family", F.to_json(F.struct("folder", *_PARTS))), "unnamed")
    # the spaces of a family's first name, and of suffixes of each width
    families = stage(_spaces(df.select("family", "folder", *_PARTS).dropDuplicates(["family"])), "families")
    each = F.when(F.col("spaces").isNull(), F.array("first.space", "wide")).otherwise(F.transform("spaces", lambda s: s["space"]))
    spaces = families.select("family", F.explode(F.array_distinct(each)).alias("space"))
    shared = spaces.groupBy("space").agg(F.count("*").alias("families"), F.min("family").alias("family"))
    tangled = stage(spaces.join(shared.filter("families > 1").select("space"), "space").select("family").distinct(), "tangled")
    there = stage(listing.filter(F.col("name").isNotNull()).select(_space(F.col("folder"), N.name_key(F.col("name"))).alias("s"), "folder").select("s.*", "folder").distinct(), "there")
    own = F.struct("doc_id", "folder", *_PARTS)

    # families on their own: the taken suffixes of each
    free = families.join(tangled, "family", "left_anti")
    # a space with the width of its suffixes: 0 for the first name, null for all widths
    row = lambda width, space, only: F.struct(width.cast("int").alias("width"), space.alias("space"), only.cast("long").alias("only"))
    none = F.lit(None)
    by_width = F.transform("spaces", lambda s, width: row(width, s["space"], F.when(width == 0, s["n"])))
    rows = F.when(F.col("spaces").isNull(), F.array(row(F.lit(0), F.col("first.space"), F.col("first.n")), row(none, F.col("wide"), none))).otherwise(by_width)
    asked = free.select("family", F.explode(rows).alias("r")).select("family", "r.*")
    fits = F.when(F.col("width") == 0, F.col("n") == F.col("only")).otherwise((F.col("n") > 1) & (F.col("width").isNull() | (F.char_length(F.col("n").cast("string")) == F.col("width"))))
    taken = asked.join(there, "space").filter(fits).select("family", F.when(F.col("width") == 0, 1).otherwise(F.col("n")).cast("long").alias("taken")).distinct()
    taken = running(taken, "family", [F.col("taken")], F.lit(1), "rank")
    alone = running(df.join(tangled, "family", "left_anti"), "family", [F.col("doc_id").isNull(), F.col("doc_id")], F.lit(1), "turn")
    docs = alone.select("family", own.alias("own"), F.col("turn").alias("place"), F.lit(0).alias("is_taken"))
    gaps = taken.select("family", F.lit(None).cast(docs.schema["own"].dataType).alias("own"), (F.col("taken") - F.col("rank") + 1).alias("place"), F.lit(1).alias("is_taken"))
    both = running(docs.unionByName(gaps), "family", [F.col("place"), -F.col("is_taken")], F.col("is_taken"), "passed")
    simple = both.filter("is_taken = 0").select("own", (F.col("place") + F.col("passed")).alias("k"))

    # the others, one by one
    whole = F.concat(F.array("first"), F.transform(F.slice(_widths(), 2, DIGITS), lambda k: F.struct(F.col("wide").alias("space"), k.alias("n"))))
    held = df.join(tangled, "family", "left_semi").join(families, "family").select("folder", own.alias("own"), "family", F.coalesce("spaces", whole).alias("spaces"), F.lit(1).alias("turn"))
    known = spaces.join(tangled, "family", "left_semi").select("space").distinct()
    before = there.join(known, "space", "left_semi").select("folder", F.lit(None).cast(docs.schema["own"].dataType).alias("own"), F.lit(None).cast("string").alias("family"), F.array(F.struct("space", "n")).alias("spaces"), F.lit(0).alias("turn"))
    dealt = held.unionByName(before).repartition("folder").sortWithinPartitions("folder", "turn", F.col("own.doc_id").asc_nulls_last(), "family")
    ordered = dealt.select("folder", "own", "family", "spaces").mapInArrow(_one_by_one, f"own {docs.schema['own'].dataType.simpleString()}, k long")

    named = simple.unionByName(ordered).select("own.*", "k")
    out = stage(named.select("doc_id", "folder", name_with(F.col("k")).alias("filename"), F.col("k").cast("int").alias("collision_index")), "named")
    release(df, families, tangled, there)
    return out
