"""Removal of repeated passages by an FM-index for each shard.

A window is `window` consecutive words of one document.  Each window has an anchor, its run of `gram` words with the
least hash, and equal windows have equal anchors; a segment is a longest run of windows of one place that share their
anchor.  Only segments whose anchor may occur twice (Bloom filter that counts to two, at most 32 MiB) go on; equal
segments are united and the distinct ones are dealt to shards by anchor, so that all places of a window meet in one
shard.  An anchor with very many distinct segments (a common passage between different neighbours) is dealt by whole
windows instead, by the hash of the window.

Each shard builds an FM-index: Burrows-Wheeler transform of its words, kept in a wavelet matrix of packed bits with
rank counts.  Its segments stream through: backward search extends a match to the left as long as it occurs at
least twice, which gives matching statistics, and windows inside a match of sufficient length are repeated.

Edge cases: null texts have no words; documents of fewer words than a window keep all.  Rows without an id are
documents like any other; rows that repeat an id and a text are different documents, so their windows are
repeated.  An empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import BLANK, SAME, binary, chunks, gram_hashes, mix, row_id, slot_count, small_batches, stage, word_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of a word's hash that a segment carries (its names h1 and h2 are made of all eight).
KEPT_BYTES = 5


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT_BYTES)
    return out.view(np.uint64).ravel()


def segments(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor of each segment of a slice of rows.

    words: hashes of all rows in order; first: each row's first word (one longer).
    """
    span = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(words, gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    place = np.arange(n) + least[:n]
    row = np.searchsorted(first, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= first[np.minimum(row + 1, len(first) - 1)]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(change)
    size = np.diff(np.append(at, n))
    keep = inside[at]
    at, size = at[keep], size[keep]
    return row[at], at, size, grams[place[at]]


class WaveletMatrix:
    """Symbols as packed bit planes; counts a symbol before many places at once."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = max(1, int(kinds - 1).bit_length())
        self.n = len(symbols)
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            raw = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw[: len(packed)] = packed
            raw = raw.view(np.uint64)
            self.words.append(raw)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        # where each symbol's run begins in the last order
        self.start = np.zeros(kinds, np.int64)
        self.start = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before that place."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search over a list of word sequences.

    Suffixes are sorted by their first `depth` words, which is exact for patterns shorter than that.
    """

    def __init__(self, parts: list[np.ndarray], depth: int):
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.alphabet, coded = np.unique(flat, return_inverse=True)
        ends = np.cumsum([len(p) for p in parts])
        # symbol 0 ends each sequence
        text = np.insert(coded + 1, ends, 0) if len(parts) else np.zeros(1, np.int64)
        n, kinds = len(text), len(self.alphabet) + 1
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        step = 1
        while step < depth:
            ahead = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
            key = rank * (int(rank.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, 2 * step
            if rank.max() == n - 1:
                break
        self.n = n
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.tree = WaveletMatrix(text[order - 1], kinds)
        self.coded = coded + 1
        self.begin = ends - [len(p) for p in parts]

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + self.less[np.concatenate([symbol, symbol])]
        return both[: len(symbol)], both[len(symbol) :]

    def repeated(self, sizes: np.ndarray, queries: np.ndarray, window: int) -> np.ndarray:
        """For each query (index of a sequence) a bit for each of its windows that occurs at least twice.

        A match is extended to the left while it occurs twice.  When it ends at f, the windows inside it are repeated;
        the next search ends at the last word that can still matter.  If the four words from f - 1 on occur only
        once, no window over them can be repeated, and the search goes on left of them.
        """
        lane = np.arange(len(queries))
        begin, mask = self.begin[queries], np.zeros(len(queries), np.uint64)
        end = sizes[queries].astype(np.int64)
        left = end.copy()
        goal = np.zeros(len(queries), np.int64)  # a search stops there
        resume = np.zeros(len(queries), np.int64)  # over 0: a look at a few words; where to go on if they are repeated
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.n, np.int64)
        live = end >= window
        while True:
            lane, begin, end, left, goal, resume, low, high = (x[live] for x in (lane, begin, end, left, goal, resume, low, high))
            if not len(lane):
                return mask
            a, b = self.back(self.coded[begin + left - 1], low, high)
            good = b - a >= 2
            low, high, left = np.where(good, a, low), np.where(good, b, high), left - good
            stop = ~good | (left == goal)
            at = np.flatnonzero(stop)
            if len(at):
                look = resume[at] > 0
                # looks that have ended
                seen = at[look]
                again = good[seen]
                nxt_end = np.where(again, resume[seen], goal[seen] + 3)
                end[seen], left[seen], goal[seen], resume[seen], low[seen], high[seen] = nxt_end, nxt_end, 0, 0, 0, self.n
                # searches that have ended
                done = at[~look]
                f, e = left[done], end[done]
                runs = np.maximum(e - window - f + 1, 0).astype(np.uint64)
                mask[lane[done]] |= ((np.uint64(1) << runs) - np.uint64(1)) << f.astype(np.uint64)
                after = np.minimum(e - 1, f + window - 1)
                end[done] = np.where(good[done], 0, after)  # at the first word: all that is left is known
                probe = ~good[done] & (f + 3 < after) & (f > 0)
                p = done[probe]
                goal[p], resume[p] = f[probe] - 1, after[probe]
                left[done] = end[done]
                left[p] = f[probe] + 3
                low[done], high[done] = 0, self.n
            live = (end >= window) | (resume > 0)


def repeated_windows(df: DataFrame, window: int, gram: int, shard_words: int) -> DataFrame:
    """rid, tkey, runs (array of first window, bits of the windows from there that are repeated) of rows of rid, tkey, text."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = slot_count(size // (4 * (window - gram + 1)) + 1)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in chunks(batch.column(2)):
            words, first, _, _ = word_hashes(data, offsets, SAME, BLANK)
            yield segments(words, first, window, gram)[3]

    rows = bloom.build(df, anchors, buckets).select("seg", "twice").collect()
    probe = df.sparkSession.sparkContext.broadcast(bloom.Probe(rows, buckets, "twice"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for a, _, data, offsets in chunks(batch.column(2)):
                words, first, _, _ = word_hashes(data, offsets, SAME, BLANK)
                row, at, many, anchor = segments(words, first, window, gram)
                hit = probe.value(anchor)
                row, at, many, anchor = row[hit], at[hit], many[hit], anchor[hit]
                # two hashes of a segment's words, by differences of running sums
                power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(window + 64, _STEP)]))
                h1, h2, texts = [], [], []
                for x, m in zip(at.tolist(), many.tolist(), strict=True):
                    part = words[x : x + m + window - 1]
                    p = int((part * power[: len(part)]).sum())
                    q = int((mix(part) * power[: len(part)]).sum()) ^ len(part)
                    h1.append(p)
                    h2.append(q)
                    if (p, q) in sent:
                        texts.append(None)
                    else:
                        if len(sent) > 1_000_000:
                            sent.clear()
                        sent.add((p, q))
                        texts.append(part.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes())
                take = pa.array(a + row)
                as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((at - first[row]).astype(np.int32)), as_long(h1), as_long(h2), pa.array(anchor.view(np.int64)), pa.array(texts, pa.binary())],
                    names=["rid", "tkey", "start", "h1", "h2", "anchor", "words"],
                )

    found = stage(df.mapInArrow(places, "rid long, tkey long, start int, h1 long, h2 long, anchor long, words binary"), "places")
    times = found.groupBy("h1", "h2").agg(F.count("*").alias("times"))
    texts = found.filter(F.col("words").isNotNull()).select("h1", "h2", "anchor", "words").dropDuplicates(["h1", "h2"])
    distinct = stage(texts.join(times, ["h1", "h2"]), "segments")
    total = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-total // (KEPT_BYTES * shard_words)))
    # an anchor with more distinct segments than a part of a shard can take is dealt by windows
    wide = max(1, shard_words // (8 * window))
    crowds = distinct.groupBy("anchor").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > wide).select("anchor", F.lit(True).alias("hot"))
    crowds = stage(crowds, "crowds")  # written, so that Spark knows its size before it chooses the join
    marked = distinct.join(crowds, "anchor", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hot segments as single windows; the number of the window in its segment goes along."""
        for batch in batches:
            out = []
            for h1, h2, raw, times_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpacked(raw)
                for k, name in enumerate(gram_hashes(words, window).view(np.int64).tolist()):
                    out.append((h1, h2, k, name, raw[k * KEPT_BYTES : (k + window) * KEPT_BYTES], times_))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["h1", "h2", "k", "name", "words", "times"])

    single = marked.filter(F.col("hot")).select("h1", "h2", "words", "times").mapInArrow(cut, "h1 long, h2 long, k int, name long, words binary, times long")
    single = stage(single, "windows")
    # equal windows of different segments are one entry of the index that counts as often as they occur
    n_windows = single.groupBy("name").agg(F.min("words").alias("words"), F.sum("times").alias("times"))
    unit = marked.filter(F.col("hot").isNull()).select("h1", "h2", F.lit(-1).alias("k"), "anchor", "words", "times")
    window_unit = n_windows.select(F.col("name").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).alias("k"), F.col("name").alias("anchor"), "words", "times")
    more = -(-(single.count() * window) // shard_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one partition, dealt by anchor, are one shard."""
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        parts = [unpacked(x.as_py()) for x in table["words"]]
        often = table["times"].to_numpy() > 1
        own = np.arange(len(parts))
        index = FMIndex(parts + [parts[i] for i in np.flatnonzero(often)], 64)
        sizes = np.array([len(p) for p in parts])
        mask = np.concatenate([index.repeated(sizes, q, window) for q in np.array_split(own, max(1, len(own) // 50_000))])
        keep = np.flatnonzero(mask)
        found = table.select(["h1", "h2", "k"]).take(pa.array(keep)).append_column("bits", pa.array(mask[keep].view(np.int64)))
        yield from found.to_batches()

    # a partition is a shard: its number is set, so that none grows with the input
    shard = unit.unionByName(window_unit).select("h1", "h2", "k", "words", "times", "anchor").repartition(shards + more, "anchor").drop("anchor")
    masks = shard.mapInArrow(search, "h1 long, h2 long, k int, bits long")
    masks = stage(masks, "masks")
    of_windows = single.join(masks.filter("k = 0").select(F.col("h1").alias("name")), "name").groupBy("h1", "h2").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).alias("bits"))
    every = masks.filter("k < 0").select("h1", "h2", "bits").unionByName(of_windows)
    marks = found.select("rid", "tkey", "start", "h1", "h2").join(every, ["h1", "h2"])
    return marks.groupBy("rid", "tkey").agg(F.collect_set(F.struct("start", "bits")).alias("runs"))


def cleaned(df: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of df."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small_batches(df)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col, text_col).alias("rid"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    runs = repeated_windows(docs.select("rid", "tkey", "text"), window, gram, shard_words)
    joined = docs.join(runs, ["rid", "tkey"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text_, marks in zip(binary(batch.column(1)), batch.column(2), strict=True):
                words = text_.as_py().split()
                n_words.append(len(words))
                if marks.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    start = np.asarray(marks.values.field("start"), np.int64)
                    bits = np.asarray(marks.values.field("bits"), np.int64).view(np.uint64)
                    for k in range(64):
                        at = start[(bits >> np.uint64(k)) & np.uint64(1) == 1] + k
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
