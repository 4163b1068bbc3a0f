"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

A document's set holds the hashes (64 bits) of its distinct word shingles.  For each element SuperMinHash draws a
permutation of the slots; the value for a slot is the slot's rank in it plus a uniform fraction, and the signature
keeps the least value of each slot.  Ranks are drawn round by round for all elements of a document at once, and the
rounds stop as soon as every slot holds a value below the next rank.  Equal bands of slots make candidates; a link
counts only if the full sets say so.

Documents with equal sets form one class; classes, not documents, are banded.  In each bucket all classes are compared
with one of them, the hub (the class with the most neighbours).  What else a bucket links is found without making its
pairs.  Let d be the size of a set's difference from the hub's set and f = d - c * size, c = (100 - percent) / (100 +
percent).  Two sets are linked if and only if their differences from the hub have (f1 + f2) / 2 elements or more in
common, and a set is linked with the hub if f is at most c times the hub's size.  Sets are put into classes of f, half of
that wide; by the prefix principle a set and its partners of one class must share one of the set's first differences,
rarest first, as many as the least f of that class allows.  So sets meet by hub, both classes of f and difference, and what
all copies of a text have in common (a third of them may lack the same shingle) is never looked up, unless a partner
could have nothing else.  Where only a few sets meet they are compared; a larger meeting is a group with a hub of its
own, from which differences are taken anew.  Hubs follow one order of all classes, so each group's hub ranks below
that of the group it came from, and the rounds end.  Groups whose sets are linked already are left out.  No candidate that
could join two components is left out, and a group of copies costs about its size, not its square.

Edge cases: null, empty and blank texts have the empty set, are linked with nothing and are kept.  A row without an id
counts as one with an id above all real ones (component_id is null if no member has an id).  Rows that share an id but not
a text are documents of their own; all rows that share an id and a text are kept or not together, and `unique` returns one
of them.  An empty table gives an empty result.  Further columns are ignored by `groups`, kept by `unique`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import bloom
from .common import BLANK, LOWER, SURROGATE, chunks, free_name, gram_hashes, mix, real_id, release, row_id, slot_count, small_batches, stage, word_hashes
from .components import components

_SLOT = np.uint64(0xFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 1025, dtype=np.uint64) * _STEP


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of each row's shingle hashes; with fewer words the whole sequence is one."""
    for a, b, data, offsets in chunks(column):
        hashes, first, _, _ = word_hashes(data, offsets, LOWER, BLANK)
        grams = gram_hashes(hashes, words)
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            if y - x >= words:
                yield np.unique(grams[x : y - words + 1])
            else:
                yield gram_hashes(hashes[x:y], y - x, salt=int(y - x)) if y > x else np.zeros(0, np.uint64)


def signature(items: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of a set that isn't empty: rank in the upper, fraction in the lower 32 bits of each slot."""
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(items), 1))
    row = np.arange(len(items))
    for j in range(slots):
        if (least.max() >> np.uint64(32)) < j:
            break
        draw = mix(items + _STEPS[j])
        k = j + ((draw >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(least, slot, (np.uint64(j) << np.uint64(32)) | (mix(draw) & _SLOT))
    return least


def features(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """rid, n, set_hash, bands for each row of rid, text."""
    place = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, keys = [], [], []
            for items in shingle_sets(batch.column(1), words):
                n.append(len(items))
                names.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                if len(items):
                    slots = signature(items, bands * rows).reshape(bands, rows)
                    key = place.copy()
                    for r in range(rows):
                        key = mix(key ^ slots[:, r]) * _STEP
                    keys.append(key)
                else:
                    keys.append(np.zeros(bands, np.uint64))
            keys = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), lists], names=["rid", "n", "set_hash", "bands"])

    return df.mapInArrow(run, "rid long, n long, set_hash binary, bands array<long>")


def _named(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows of rid, set_hash with `a`, the class's name: its rid, or one above all others where that names another set."""
    made = F.lit(SURROGATE) + F.lit(1 << 61) + F.xxhash64("set_hash").bitwiseAND(F.lit((1 << 61) - 1))
    return rows.join(shared, "rid", "left").withColumn("a", F.when(F.col("first") != F.col("set_hash"), made).otherwise(F.col("rid"))).drop("first")


def _sets(df: DataFrame, words: int, wanted: DataFrame, shared: DataFrame) -> DataFrame:
    """a, items of the rows of df (rid, text) whose rid may be in `wanted`: a filter of at most 32 MiB leaves the others out.

    shared: rid, first set_hash of the ids that several rows have.
    """
    segments = slot_count(wanted.count())
    rows = bloom.build(wanted, lambda b: [mix(b.column(0).to_numpy().astype(np.uint64))], segments).select("seg", "once").collect()
    probe = df.sparkSession.sparkContext.broadcast(bloom.Probe(rows, segments, "once"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = probe.value(mix(batch.column(0).to_numpy().astype(np.uint64)))
            part = batch.filter(pa.array(hit))
            for a in range(0, part.num_rows, 500):
                some = part.slice(a, 500)
                items = list(shingle_sets(some.column(1), words))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items).view(np.int64)))
                names = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in items], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), names, lists], names=["rid", "set_hash", "items"])

    made = df.mapInArrow(run, "rid long, set_hash binary, items array<long>")
    if shared.isEmpty():
        return made.select(F.col("rid").alias("a"), "items")
    single, many = made.join(shared, "rid", "left_anti"), made.join(shared, "rid", "left_semi").dropDuplicates(["rid", "set_hash"])
    return single.select(F.col("rid").alias("a"), "items").unionByName(_named(many, shared).select("a", "items"))


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select("a", F.col("items").alias("x")), "a")
    return both.join(sets.select(F.col("a").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[2:]]
    for i in range(batch.num_rows):
        yield tuple(v[o[i] : o[i + 1]] for v, o in sides)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets' similarity is percent or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in _sides(batch):
                merged = np.sort(np.concatenate([x, y]))
                same = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return _paired(pairs, sets).mapInArrow(run, "a long, b long")


def _against_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, hub, linked, apart (the differences), own (class of f), reach (by class of f of a partner, how many of the rarest differences matter).

    Classes below 0 hold the sets linked with the hub, which are one component; two of these never look for each other.
    """
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, every, own, reach = [], [], [], []
            for x, hub in _sides(batch):
                merged = np.sort(np.concatenate([x, hub]))
                twin = np.zeros(len(merged) + 1, bool)
                twin[1:-1] = merged[1:] == merged[:-1]
                apart = merged[~(twin[1:] | twin[:-1])]
                d, f, at = len(apart), len(apart) - c * len(x), c * len(hub)
                wide = max(at / 2, 0.5)
                linked.append((100 - percent) * (len(x) + len(hub)) >= (100 + percent) * d)
                own.append(min(-1, int(np.floor((f - at) / wide))) if linked[-1] else max(0, int(np.floor((f - at) / wide))))
                # a partner has as many of the differences as both need, so its f is at most 2 d - f
                some = np.arange(0 if linked[-1] else -int(np.ceil(2 * at / wide)) - 2, int(np.floor((2 * d - f - at) / wide)) + 1)
                least = np.where(some == 0, at, at + some * wide)
                need = np.maximum(1, np.ceil((f + least) / 2 - 1e-6)).astype(np.int64)
                upto = np.maximum(0, d - need + 1)
                reach.append([{"f": int(k), "upto": int(n)} for k, n in zip(some[upto > 0], upto[upto > 0], strict=True)])
                every.append(apart)
            ends = np.concatenate([[0], np.cumsum([len(v) for v in every])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *every])))
            kind = pa.list_(pa.struct([("f", pa.int32()), ("upto", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), lists, pa.array(own, pa.int32()), pa.array(reach, kind)], names=["a", "hub", "linked", "apart", "own", "reach"]
            )

    return _paired(pairs, sets).mapInArrow(run, "a long, hub long, linked boolean, apart array<long>, own int, reach array<struct<f:int,upto:int>>")


def _with_component(rows: DataFrame, label: DataFrame, col: str, name: str) -> DataFrame:
    found = label.select(F.col("node").alias(col), F.col("component").alias(name))
    return rows.join(found, col, "left").withColumn(name, F.coalesce(name, col))


def _meetings(seen: DataFrame, label: DataFrame) -> DataFrame:
    """meeting, a, weight, comp: the sets of different components that share a difference which matters to both."""
    inside = stage(_with_component(seen, label, "a", "comp"), "inside")
    # the hub itself has been compared with all
    mixed = stage(inside.groupBy("hub").agg((F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").select("hub"), "mixed")
    inside = inside.join(mixed, "hub", "left_semi")
    each = inside.select("hub", "a", "comp", F.explode("apart").alias("item"))
    often = each.groupBy("hub", "item").agg(F.count("*").alias("times"), (F.min("comp") != F.max("comp")).alias("across"))
    place = F.row_number().over(Window.partitionBy("hub", "a").orderBy("times", "item"))
    placed = each.join(often, ["hub", "item"]).withColumn("place", place).filter("across").select("hub", "a", "item", "place")
    rows = placed.join(inside.select("hub", "a", "comp", "own", "reach"), ["hub", "a"])
    rows = rows.select("hub", "a", "comp", "own", "item", F.explode(F.filter("reach", lambda r: r["upto"] >= F.col("place"))["f"]).alias("other"))
    name = F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other"), "item")
    rows = stage(rows.select(name.alias("meeting"), "a", "comp", "own", "other"), "met")
    # both sides have to be there, and two components
    both = rows.groupBy("meeting").agg((F.min("own") == F.max("own")).alias("one_side"), F.min(F.col("own") == F.col("other")).alias("same"), (F.min("comp") != F.max("comp")).alias("mixed"))
    both = both.filter("mixed and (same or not one_side)").select("meeting")
    return rows.join(both, "meeting", "left_semi").select("meeting", "a", "comp").distinct()


#: Sets of a meeting that are compared with each other; more get a hub.
FEW = 64


def _linked_components(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component of all linked pairs in the buckets (meeting, a, weight)."""
    links, label, tried = [], None, None
    weights = buckets.select("a", "weight").distinct()
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    while True:
        # the most central class of each group; the smaller id if two are equally central
        best = F.max(F.struct("weight", (-F.col("a")).alias("minus")))
        hubs = buckets.groupBy("meeting").agg(best.alias("h")).select("meeting", (-F.col("h.minus")).alias("b"))
        first = buckets.join(hubs, "meeting").filter("a <> b").select("a", "b").distinct()
        seen = stage(_against_hubs(first, sets, percent), "hubs")
        links.append(seen.filter("linked").select("a", F.col("hub").alias("b")))
        if label is None or not links[-1].isEmpty():
            label = components(union(links))
        met = stage(_meetings(seen, label), "meetings")
        if met.isEmpty():
            return label
        done = seen.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"))
        tried = done if tried is None else tried.unionByName(done)
        large = met.groupBy("meeting").agg(F.count("*").alias("size")).filter(F.col("size") > FEW).select("meeting")
        large = stage(large, "large")
        few = met.join(large, "meeting", "left_anti").groupBy("meeting").agg(F.sort_array(F.collect_list(F.struct("a", "comp"))).alias("all"))
        pairs = few.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, FEW), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
        pairs = pairs.filter("p.x.comp <> p.y.comp").select(F.col("p.x.a").alias("a"), F.col("p.y.a").alias("b")).distinct()
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = stage(_linked(pairs, sets, percent), "more")
        if not more.isEmpty():
            links.append(more)
            label = components(union(links))
        if large.isEmpty():
            return label
        tried = tried.unionByName(pairs)
        buckets = stage(met.join(large, "meeting", "left_semi").select("meeting", "a").join(weights, "a"), "groups")


def groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, bands: int = 24, rows: int = 5
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rid, set_hash: one row for each row of df.

    With 24 bands of 5 slots a pair of similarity 0.85 misses all bands once in 1.3 million cases, one of 0.8 once in
    13,700, if slots count as independent.
    """
    small_batches(df)
    named = df.select(row_id(id_col, text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stage(features(named.select("rid", "text"), words, bands, rows), "features")
    words_in = found.filter("n > 0")
    classes = words_in.groupBy("set_hash").agg(F.min(F.struct("rid", "bands")).alias("c")).select("set_hash", "c.rid", "c.bands")
    shared = words_in.groupBy("rid").agg(F.count("*").alias("rows"), F.min("set_hash").alias("first")).filter("rows > 1").select("rid", "first")
    shared = stage(shared, "shared-ids")
    classes = stage(_named(classes, shared), "classes")

    banded = classes.select("a", F.explode("bands").alias("meeting"))
    full = banded.groupBy("meeting").agg(F.count("*").alias("size")).filter("size > 1")
    sized = stage(banded.join(full, "meeting"), "sized")
    central = sized.groupBy("a").agg(F.sum("size").alias("weight"))
    buckets = stage(sized.select("meeting", "a").join(central, "a"), "buckets")
    release(sized)
    wanted = buckets.select("a").distinct().join(classes, "a").select("rid").distinct()
    sets = stage(_sets(named.select("rid", "text"), words, wanted, shared), "sets")
    label = _linked_components(buckets, sets, percent)

    of_class = stage(_with_component(classes.select("set_hash", "rid", "a"), label, "a", "component"), "of-class")
    release(buckets, sets, classes, shared)
    least = of_class.groupBy("component").agg(F.min("rid").alias("least"))
    of_class = of_class.join(least, "component").select("set_hash", "least")
    joined = found.select("rid", "n", "set_hash").join(of_class, "set_hash", "left")
    least = F.coalesce("least", "rid")
    return joined.select(real_id(F.col("rid")).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(least).alias("component_id"), (F.col("rid") == least).alias("kept"), "rid", "set_hash")


def unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of df: that of the smallest id.  Rows without words are no group and all stay."""
    found = stage(groups(df, id_col, text_col, **options).select("rid", "n_shingles", "kept", "set_hash"), "kept")
    rid, name = free_name("rid"), free_name("set")
    # what goes is told by id; ids that have rows of both kinds, or more rows than one, are told by text as well
    by_id = found.groupBy("rid").agg(F.count("*").alias("rows"), F.max("kept").alias("some"), F.max("n_shingles").alias("most"))
    repeated = stage(by_id.filter("some and rows > 1 and most > 0").select(F.col("rid").alias(rid)), "repeated")
    dropped = stage(by_id.filter("not some").select(F.col("rid").alias(rid)), "dropped")
    left = df.withColumn(rid, row_id(id_col, text_col)).join(dropped, rid, "left_anti")
    if repeated.isEmpty():
        return left.drop(rid)
    words = options.get("words", 5)
    single, many = left.join(repeated, rid, "left_anti").drop(rid), left.join(repeated, rid, "left_semi")
    keep = found.filter("kept and n_shingles > 0").select(F.col("rid").alias(rid), F.col("set_hash").alias(name)).distinct()
    many = _with_set_hash(many, text_col, name, words)
    blank = many.filter(F.col(name).isNull())
    return single.unionByName(blank.drop(rid, name)).unionByName(many.join(keep, [rid, name], "left_semi").dropDuplicates([rid, name]).drop(rid, name))


def _with_set_hash(df: DataFrame, text_col: str, name: str, words: int) -> DataFrame:
    """df with the name of each text's set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text_col)), words)
            names = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))
