"""Quality rules: statistics of single texts, and lines that too many documents of a host share.

A line is normalised (A-Z in lower case, digits as 0, blanks as one) and hashed.  For each host and line the different
documents are counted: equal texts are one document, so copies make no line common.  A line that over `most_documents`
documents of a host have, and over `most_percent` percent of them, is furniture and goes.  A document that keeps too few of
its words is depleted and rejected, as is one that fails the rules on its own text.

Each text is read once, in a task, to its statistics and the hashes of its lines, which are staged (12 bytes a line).  Lines
are counted in two groupings, first to (line, text), then to line, with sums before each exchange, so a line that a third of
all documents have is no hot group.  Lines that are furniture are joined with the staged lines: by broadcast where Spark sees
that they are few, else by an exchange whose large partitions it splits.  Hashes have 64 bits.

Edge cases: a null text counts as empty and has no words, so it fails.  A null host is a host of its own.  Rows are judged one
by one, whether or not they repeat an id.  Lines without words count for nothing.  An empty table gives an empty result.
Further columns of the input are ignored by `judged`, kept by `cleaned`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, SAME, _grown, binary, chunks, free_name, gram_hashes, mix, small_batches, stage, word_hashes

LEAST_WORDS, MOST_REPEATED = 50, 50
MOST_DOCUMENTS, MOST_PERCENT, LEAST_LEFT = 10, 1, 50
NORMAL = LOWER.copy()
NORMAL[ord("0") : ord("9") + 1] = ord("0")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
IN_LINE = np.ones(256, bool)
IN_LINE[0x0A] = False
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "lines array<long>, line_words array<int>"


def _repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes stand in their row twice or more, and which stand earlier in it, too."""
    order = np.lexsort((hashes, row))  # equal ones keep their order
    same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again, earlier = np.zeros((2, len(hashes)), bool)
    earlier[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, earlier


class Lines:
    """The lines with words of a slice of texts: row, first byte, byte after the last, number of words, hash as normalised."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, _, word_starts, _ = word_hashes(data, offsets, NORMAL, BLANK)
        self.raw, at, self.start, self.end = word_hashes(data, offsets, SAME, IN_LINE)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        a, b = np.searchsorted(word_starts, self.start), np.searchsorted(word_starts, self.end)
        full = b > a
        self.raw, self.start, self.end, self.row = (x[full] for x in (self.raw, self.start, self.end, self.row))
        a, self.n = a[full], (b - a)[full]
        up, down = _grown(len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        self.hash = mix((total[a + self.n] - total[a]) * down[a] + self.n.astype(np.uint64))


def _numbers(data: np.ndarray, offsets: np.ndarray, lines: Lines) -> list[np.ndarray]:
    """STATISTICS of the texts of a slice."""
    rows = len(offsets) - 1

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    def of(row: np.ndarray) -> np.ndarray:
        return np.bincount(row, minlength=rows).astype(np.int64)

    words, at, _, _ = word_hashes(data, offsets, SAME, BLANK)
    row = np.repeat(np.arange(rows), np.diff(at))
    grams = gram_hashes(words, 3)
    windows = np.flatnonzero(row[2:] == row[: max(0, len(row) - 2)])  # none over the end of a text
    again, _ = _repeats(row[windows], grams[windows])
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[windows[again] + k] = True
    _, earlier = _repeats(lines.row, lines.raw)
    # a code point has one byte that doesn't go on from another
    return [np.diff(at).astype(np.int64), bytes_of(BLANK[data] & ((data & 0xC0) != 0x80)), bytes_of(SYMBOL[data]), of(lines.row[earlier]), of(row[covered])]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in f"carried, {STATISTICS}, {LINES}".split(", ")]
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            lines = Lines(data, offsets)
            numbers = _numbers(data, offsets, lines)
            # each line once a text, with the words of all its places
            order = np.lexsort((lines.hash, lines.row))
            row, hashes, n = lines.row[order], lines.hash[order], lines.n[order]
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(row) else np.zeros(0, np.int64)
            sums = np.add.reduceat(n, starts) if len(starts) else n
            at = pa.array(np.searchsorted(row[starts], np.arange(end - first + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (hashes[starts].view(np.int64), sums.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *map(pa.array, numbers), *lists], names=names)


def statistics(docs: DataFrame, host: Column, carried: Column, text_col: str = "text") -> DataFrame:
    """row (a number of its own), carried (host and text as numbers, own: what the caller gives), STATISTICS, LINES; staged."""
    small_batches(docs)
    told = F.struct(F.xxhash64(F.lit("host"), host).alias("host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("same"), carried.alias("own"))
    given = docs.select(told.alias("carried"), F.col(text_col).alias("text"))
    kind = given.schema["carried"].dataType.simpleString()
    return stage(given.mapInArrow(_statistics, f"carried {kind}, {STATISTICS}, {LINES}").withColumn("row", F.monotonically_increasing_id()), "line-hashes")


def furniture(read: DataFrame, most_documents: int = MOST_DOCUMENTS, most_percent: float = MOST_PERCENT) -> DataFrame:
    """host, line of the lines that more documents of the host have than both limits allow; read: as of statistics."""
    host, same = F.col("carried.host"), F.col("carried.same")
    found = read.select(host, same, F.explode("lines").alias("line")).distinct()
    often = found.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > most_documents)
    sizes = read.select(host, same).distinct().groupBy("host").agg(F.count("*").alias("of"))
    return stage(often.join(sizes, "host").filter(100 * F.col("n") > most_percent * F.col("of")).select("host", "line"), "furniture")


def verdicts(read: DataFrame, gone: DataFrame, least_left: int = LEAST_LEFT) -> DataFrame:
    """row, own, STATISTICS, n_removed_words, removed (lines, null for none), base_failed, depleted, kept."""
    lines = read.select("row", F.col("carried.host").alias("host"), F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    marked = lines.join(gone, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed"))
    out = read.drop("lines", "line_words").join(marked, "row", "left").fillna(0, ["n_removed_words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < least_left * F.col("n_words")
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    return out.select("row", F.col("carried.own").alias("own"), *names, "n_removed_words", "removed", failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"))


def judged(docs: DataFrame, host: Column, carried: Column, text_col: str = "text", most_documents: int = MOST_DOCUMENTS, most_percent: float = MOST_PERCENT, least_left: int = LEAST_LEFT) -> DataFrame:
    """verdicts of each row of docs; own is what `carried` is there."""
    read = statistics(docs, host, carried, text_col)
    return verdicts(read, furniture(read, most_documents, most_percent), least_left)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """carried, and the text without the lines of the third column."""
    for batch in batches:
        out = []
        for text, gone in zip(binary(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if gone:
                lines = Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                drop = np.isin(lines.hash.view(np.int64), np.array(gone, np.int64))
                kept, at = [], 0
                for a, b in zip(lines.start[drop].tolist(), lines.end[drop].tolist(), strict=True):
                    kept.append(text[at:a])
                    at = b + 1  # with the line's end
                text = b"".join([*kept, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["carried", "text"])


def cleaned(docs: DataFrame, host: Column, text_col: str = "text", most_documents: int = MOST_DOCUMENTS, most_percent: float = MOST_PERCENT, least_left: int = LEAST_LEFT) -> DataFrame:
    """The rows of docs that are kept, their texts without furniture; all columns as they are."""
    row = free_name("row")
    given = stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = judged(given, host, F.col(row), text_col, most_documents, most_percent, least_left).filter("kept").select(F.col("own").alias(row), "removed")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    joined = given.join(found, row).select(rest.alias("carried"), F.col(text_col).alias("text"), "removed")
    out = joined.mapInArrow(_without, f"carried {joined.schema['carried'].dataType.simpleString()}, text string")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("carried")[c].alias(c) for c in docs.columns))
