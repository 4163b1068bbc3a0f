"""Exact dedup by two passes over Bloom filters.

Pass one counts to two: each task sets the bits of its texts' hashes in its own filter, and the filters are merged by
segment.  Pass two looks every hash up; a text whose bits were not all set twice has no equal and passes straight
through.  Only the others' hashes and ids shuffle, never a text.  The filter has 16 bits a row up to `most_bytes`
(32 MiB); with more rows it fills up and more hashes shuffle, but the result stays exact, as groups are made by SHA-256.

Edge cases: a null text counts as empty, so null and empty texts are equal.  Rows without an id rank below all rows
with one.  Rows that repeat an id and a text are all marked as kept by `annotate`; `unique` returns one of them.
An empty table gives an empty result.  Further columns of the input are ignored by `annotate`, kept by `unique`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import free_name, slot_count, stage


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (binary), key (64 bits of it), once written to the shared folder."""
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return stage(df.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("sha")).withColumn("key", F.xxhash64("sha")), "fingerprints")


def _filter(prints: DataFrame, most_bytes: int) -> tuple[DataFrame, int]:
    """Pass one: the filter of keys that occur twice, and its number of segments."""
    segments = slot_count(prints.count(), most_bytes=most_bytes)
    return stage(bloom.build(prints.select("key"), lambda b: [b.column(0).to_numpy().astype(np.uint64)], segments), "filter"), segments


def _groups(again: DataFrame) -> DataFrame:
    """For each hash of the rows that may be repeated its largest id and its size."""
    return stage(again.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 25) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = fingerprints(df, id_col, text_col)
    flagged = stage(bloom.maybe_twice(prints, "key", *_filter(prints, most_bytes), "again"), "flagged")
    sizes = _groups(flagged.filter("again"))
    alone = flagged.filter(~F.col("again")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = flagged.filter("again").select("doc_id", "sha").join(sizes, "sha").select("doc_id", "sha", "keep_id", "group_size")
    return alone.unionByName(again).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 25) -> DataFrame:
    """df without rows whose text another row with a larger id has; of rows equal in id and text one stays."""
    prints = fingerprints(df, id_col, text_col)
    filters, segments = _filter(prints, most_bytes)
    sizes = _groups(bloom.maybe_twice(prints, "key", filters, segments, "again").filter("again"))
    sha, key, twice, keep = map(free_name, ("sha", "key", "twice", "keep"))
    keyed = df.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))).withColumn(key, F.xxhash64(sha))
    flagged = bloom.maybe_twice(keyed, key, filters, segments, twice)
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = flagged.filter(~F.col(twice)).select(*columns)
    again = flagged.filter(twice).join(sizes.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep)), sha)
    first = again.filter(F.col(id_col).cast("long").eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return alone.unionByName(first.select(*columns))
