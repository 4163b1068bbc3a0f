"""Vector codes: product quantisation by Lloyd's rounds over two trees, all in integers.

Vectors become integers (4096ths, rounded down) and are cut into equal parts; each part position has a codebook.  Blocks of
vectors are laid out once and staged: for each part position a balanced tree halves the block's parts by the widest side, and
each node knows the box around its parts and their sums.  A second tree does so for the entries of a codebook.  A round goes
down both trees together.  For a pair of nodes the boxes bound all distances between them; a pair goes if the lower bound is
over the least upper bound of that node of parts, and an entry goes if another is nearer wherever in the box a part lies.
A node with one entry left is assigned whole, by its cached sums; leaves with several compare their parts with these entries.
All bounds are whole numbers and exact, and only strictly farther entries go, so ties are decided among the entries themselves.

A round is one pass over the staged blocks, whose sums (a row for each entry and component) meet in one grouping.  The driver
gets these sums, entries times dimension, whatever the number of vectors, and the tasks get the codebooks.

Edge cases: vectors that are null, or have null or non-finite components, are dropped, as are vectors of another length than that
of the smallest vec_id, or of one that doesn't divide into the parts.  Rows without a vec_id come last when seeds are taken,
repeated vec_ids by their components.  With fewer vectors than entries a codebook has as many entries.  Components too large for sums
of squares in 64 bits (46,340 for 64 components) are an error.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and parts of a leaf.
BLOCK, LEAF = 4096, 32


# input


def most_whole(dimension: int) -> int:
    """Integers up to this have sums of squared differences within 64 bits."""
    return math.isqrt((1 << 61) // dimension)


def usable(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The rows that are kept, with `whole` (their integers), and the seeds: the integers of the first `entries` rows."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    kept = kept.withColumn("whole", F.transform(v, lambda x: F.floor(x.cast("double") * scale)))
    order = [F.col(vec_id).asc_nulls_last(), F.col("whole")]
    first = kept.select("whole", vec_id).orderBy(*order).limit(1).collect()
    if not first:
        return kept, np.zeros((0, parts), np.int64)
    size = len(first[0]["whole"])
    kept = kept.filter(F.size(v) == size)
    most = most_whole(size)
    large = F.exists("whole", lambda x: (x > most) | (x < -most))
    kept = kept.withColumn("whole", F.when(large, F.raise_error(F.lit(f"a component is over {most // scale}"))).otherwise(F.col("whole")))
    seeds = kept.select("whole", vec_id).orderBy(*order).limit(entries).collect()
    return kept, np.array([r["whole"] for r in seeds], np.int64)


# trees


class Tree:
    """Points halved again and again by their widest side: level l has 2**l nodes, each with its places, box and sums."""

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        self.depth = max(0, (n // leaf).bit_length() - 1)
        self.bounds = [n * np.arange((1 << level) + 1) >> level for level in range(self.depth + 1)]
        self.order = self._halved(points) if order is None else order
        self.points = points[self.order]
        starts = self.bounds[-1][:-1]
        self.low, self.high, self.sums = ([f.reduceat(self.points, starts)] for f in (np.minimum, np.maximum, np.add))
        for _ in range(self.depth):
            for found, f in ((self.low, np.minimum), (self.high, np.maximum), (self.sums, np.add)):
                found.insert(0, f(found[0][::2], found[0][1::2]))

    def _halved(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(len(points))
        for level in range(self.depth):
            for k, (a, b) in enumerate(zip(self.bounds[level][:-1], self.bounds[level][1:], strict=True)):
                own = points[order[a:b]]
                side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[a:b] = order[a:b][np.argpartition(own[:, side], self.bounds[level + 1][2 * k + 1] - a)]
        return order


class Entries:
    """The tree over a codebook's entries: of each level the boxes of its nodes, and where their children are."""

    def __init__(self, codebook: np.ndarray):
        tree = Tree(codebook, 1)
        bounds, self.low, self.high = list(tree.bounds), list(tree.low), list(tree.high)
        if len(bounds[-1]) <= len(codebook):  # leaves of two
            bounds.append(np.arange(len(codebook) + 1))
            self.low.append(tree.points)
            self.high.append(tree.points)
        self.children = [np.searchsorted(after, at) for at, after in zip(bounds[:-1], bounds[1:], strict=True)]
        self.last = len(bounds) - 1
        self.order, self.points = tree.order, tree.points
        self.square = (self.points**2).sum(axis=1)


def _groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's pairs begin, and the group of each pair; p in order."""
    new = np.concatenate([[True], p[1:] != p[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def assigned(tree: Tree, entries: Entries) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nodes that are assigned whole, as (level, nodes, entries), and the rest as points and their entries; entries by number, places by the tree."""
    whole = []
    p, e, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(p):
        low, high, elow, ehigh = tree.low[level][p], tree.high[level][p], entries.low[depth][e], entries.high[depth][e]
        least = (np.maximum(0, np.maximum(elow - high, low - ehigh)) ** 2).sum(axis=1)
        most = (np.maximum(high - elow, ehigh - low) ** 2).sum(axis=1)
        starts, group = _groups(p)
        stays = least <= np.minimum.reduceat(most, starts)[group]
        single = depth == entries.last
        if single:  # an entry also goes if the likeliest is nearer at every place of the box
            order = np.lexsort((most, group))
            likeliest = e[order[starts]][group]
            towards = entries.points[e] - entries.points[likeliest]
            gain = 2 * np.maximum(low * towards, high * towards).sum(axis=1)
            stays &= entries.square[e] - entries.square[likeliest] <= gain
        p, e, group = p[stays], e[stays], group[stays]
        if single:
            alone = np.bincount(group)[group] == 1
            if alone.any():
                whole.append((level, p[alone], entries.order[e[alone]]))
                p, e = p[~alone], e[~alone]
            if level == tree.depth:
                break
        else:
            first, end = entries.children[depth][e], entries.children[depth][e + 1]
            count = end - first
            p, e = np.repeat(p, count), np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            depth += 1
        if level < tree.depth:
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            order = np.argsort(p, kind="stable")
            p, e, level = p[order], e[order], level + 1
    if not len(p):
        none = np.zeros(0, np.int64)
        return whole, none, none
    # leaves in doubt: each of their points with each entry that is left
    starts, group = _groups(p)
    nodes = p[starts]
    a, size = tree.bounds[level][nodes], np.diff(tree.bounds[level])[nodes]
    points = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
    far = np.full((len(points), len(entries.order)), np.iinfo(np.int64).max)
    begin = np.cumsum(size) - size
    count = size[group]
    row = np.repeat(begin[group] - np.cumsum(count) + count, count) + np.arange(count.sum())
    which = np.repeat(e, count)
    far[row, entries.order[which]] = ((tree.points[points[row]] - entries.points[which]) ** 2).sum(axis=1)
    return whole, points, far.argmin(axis=1)  # the first of equal ones


# blocks


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """own (a list), points (integers of 32 bits), orders (of each part position's tree, 16 bits) of each block of vectors."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            own, vectors = batch.column(0).slice(a, BLOCK), batch.column(1).slice(a, BLOCK)
            n = len(own)
            points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            orders = np.stack([Tree(part, LEAF).order for part in np.split(points, parts, axis=1)])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own), pa.array([points.astype(np.int32).tobytes()]), pa.array([orders.astype(np.uint16).tobytes()])],
                names=["own", "points", "orders"],
            )


def blocks(kept: DataFrame, own: Column, parts: int = PARTS) -> DataFrame:
    """kept (with `whole`) laid out in blocks, staged; own: what to carry with each vector."""
    small_batches(kept)
    given = kept.select(own.alias("own"), "whole")
    kind = given.schema["own"].dataType.simpleString()
    return stage(given.mapInArrow(lambda b: _blocks(b, parts), f"own array<{kind}>, points binary, orders binary"), "vector-blocks")


def _trees(points: bytes, orders: bytes, parts: int) -> list[Tree]:
    orders = np.frombuffer(orders, np.uint16).reshape(parts, -1).astype(np.int64)
    points = np.frombuffer(points, np.int32).reshape(orders.shape[1], -1).astype(np.int64)
    return [Tree(part, LEAF, order) for part, order in zip(np.split(points, parts, axis=1), orders, strict=True)]


# rounds


def _sums(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, at (component), total, n of what the task's parts add up to; codebooks: part, entry, component."""
    total = np.zeros_like(codebooks)
    n = np.zeros(codebooks.shape[:2], np.int64)
    entries = [Entries(book) for book in codebooks if len(book)]  # no entries: no vectors either
    for batch in batches:
        for points, orders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, tree in enumerate(_trees(points, orders, len(codebooks))):
                whole, loose, entry = assigned(tree, entries[k])
                for level, nodes, codes in whole:
                    np.add.at(total[k], codes, tree.sums[level][nodes])
                    np.add.at(n[k], codes, np.diff(tree.bounds[level])[nodes])
                np.add.at(total[k], entry, tree.points[loose])
                np.add.at(n[k], entry, 1)
    part, entry, at = (x.ravel() for x in np.indices(total.shape))
    if n.any():
        yield pa.RecordBatch.from_arrays([*map(pa.array, (part, entry, at, total.ravel(), np.repeat(n.ravel(), total.shape[2])))], names=["part", "entry", "at", "total", "n"])


def fit(laid: DataFrame, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after so many rounds over the blocks, from the seeds' parts on."""
    books = np.stack(np.split(seeds, parts, axis=1)).astype(np.int64) if len(seeds) else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if len(seeds) else 0):
        now = books
        found = laid.select("points", "orders").mapInArrow(lambda b, now=now: _sums(b, now), "part long, entry long, at long, total long, n long")
        # entries times dimension rows, whatever the number of vectors
        sums = found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").collect()
        books = books.copy()
        for r in sums:
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def _codes(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    entries = [Entries(book) for book in codebooks if len(book)]  # no entries: no vectors either
    for batch in batches:
        for row in range(batch.num_rows):
            own = batch.column(0).slice(row, 1).flatten()
            codes, error = np.zeros((len(own), len(codebooks)), np.uint8), np.zeros(len(own), np.int64)
            for k, tree in enumerate(_trees(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), len(codebooks))):
                whole, loose, entry = assigned(tree, entries[k])
                found = np.empty(len(own), np.int64)
                found[loose] = entry
                for level, nodes, which in whole:
                    for node, code in zip(nodes, which, strict=True):
                        found[tree.bounds[level][node] : tree.bounds[level][node + 1]] = code
                codes[tree.order, k] = found
                error[tree.order] += ((tree.points - codebooks[k][found]) ** 2).sum(axis=1)
            text, step = codes.tobytes().hex(), 2 * len(codebooks)
            yield pa.RecordBatch.from_arrays([own, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=["own", "code", "error"])


def encoded(laid: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """own, code (two hex digits a part), error (squared distance to what the code stands for) of each vector of the blocks."""
    kind = laid.schema["own"].dataType.elementType.simpleString()
    return laid.mapInArrow(lambda b: _codes(b, codebooks), f"own {kind}, code string, error long")


def decoded(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: the components that the codes stand for."""
    books = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in codebooks))
    entry = lambda k: F.conv(F.substring("code", 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.transform(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(codebooks) - 1)), lambda k: F.get(F.get(books, k), entry(k)))), lambda x: x / F.lit(scale)))


def compressed(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (error summed over the label), codebooks_sha256 of each vector that is kept."""
    kept, seeds = usable(df, vector, vec_id, parts, entries, scale)
    laid = blocks(kept, F.struct(F.col(vec_id).alias("vec_id"), F.col(label).alias("label")), parts)
    books = fit(laid, seeds, parts, rounds)
    codes = stage(encoded(laid, books).select("own.vec_id", "own.label", "code", "error"), "vector-codes")
    release(laid)
    sums = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "same")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.join(sums, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
