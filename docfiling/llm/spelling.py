"""Spelling variants: words one letter apart, each led to its common form by a bit-sliced position index.

Words are counted in one pass over the texts, pre-counted by task.  Two words one letter apart agree before and after the
place of the letter, so each word goes to a bucket for each half of its places: the bucket has what stands before and after
that half, and the half is free.  Buckets of too many words or letters halve their free places again, for as long as there
are two; a bucket that can't be halved holds words that differ in two neighbouring letters at most.  So no bucket grows
with the vocabulary, and each pair of near words meets in exactly one bucket: that of the first place where they differ.

In a task buckets are searched together.  For each (place, letter) a bitset tells which words have that letter there.  For
all words of a tile at once, letter by letter, three bitsets are carried: the words that agree so far (`exact`), those with
one letter replaced (`swapped`), and those with one letter more, whose places are read shifted by one (`longer`).

Edge cases: a null or empty text has no words; a null id counts as an empty one where slips are made.  Rows that repeat an
id and a text count each.  A run of letters of any length is one word.  Of near words that are equally common the smallest
in code-point order is the form.  An empty table, or one without words, gives an empty result.  Further columns of the
input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, release, small_batches, stage

#: A run of letters once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS, TIMES, RATIO = 7, 2, 10
#: Words that a task counts before it sends them on.
HELD = 1 << 18
#: A bucket of more words or free letters is halved.
MOST_WORDS, MOST_LETTERS = 4096, 1 << 18
#: Words that are searched together, and of these the ones that ask at a time.
SHARD, TILE = 2048, 1024
KEY = ["free", "short", "start", "head", "tail"]


# words


def _counts(batches: Iterator[pa.RecordBatch], least: int, slip: int | None) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            # bytes.lower changes A-Z only
            found = Counter(map(itemgetter(0), RUN.finditer(text.lower().decode(errors="replace"))))
            for run, n in found.items():
                if slip and (h := zlib.crc32(run.encode(), start)) % slip == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= least:
                    held[run] += n
            if len(held) > HELD:
                yield sent()
    if held:
        yield sent()


def vocabulary(docs: DataFrame, least_letters: int = LETTERS, least_times: int = TIMES, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words with so many letters that occur so often.

    slip: every slip-th run of a document, by a checksum, loses a letter first; for tests of the grouping on clean texts.
    """
    small_batches(docs)
    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda b: _counts(b, least_letters, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


# buckets


def _dealt(df: DataFrame, spans: Column) -> DataFrame:
    """df (word, n, short) once for each (start, end) of free places of a word of `short` letters; one of a letter more has one more free."""
    df = df.select("word", "n", "short", F.explode(spans).alias("at")).select("word", "n", "short", F.col("at")["start"].cast("int").alias("start"), F.col("at")["end"].cast("int").alias("end"))
    size = F.char_length("word")
    more = size - F.col("short")
    return df.select(
        (F.col("end") - F.col("start")).alias("free"),
        "short",
        "start",
        F.left("word", F.col("start")).alias("head"),
        F.substring("word", F.col("end") + more + 1, size).alias("tail"),
        F.substring("word", F.col("start") + 1, F.col("end") - F.col("start") + more).alias("middle"),
        "n",
    )


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def buckets(words: DataFrame, least_letters: int, most_words: int = MOST_WORDS, most_letters: int = MOST_LETTERS) -> DataFrame:
    """KEY, middle, n: each word in the buckets in which it can meet a near one of its length, of one letter less, of one more."""
    size, short = F.char_length("word"), F.col("short")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).filter(short >= least_letters)
    done = _dealt(each, F.array(_span(F.lit(0), F.floor(short / 2)), _span(F.floor(short / 2), short)))
    while True:
        sizes = done.filter("free > 1").groupBy(*KEY).agg(F.count("*").alias("words"), F.sum(F.char_length("middle")).alias("letters"))
        large = stage(sizes.filter((F.col("words") > most_words) | (F.col("letters") > most_letters)).select(*KEY, F.lit(True).alias("large")), "large-buckets")
        if large.isEmpty():
            return done
        told = done.join(large, KEY, "left")
        start, cut, end = F.col("start"), F.col("start") + F.floor(F.col("free") / 2), F.col("start") + F.col("free")
        whole = told.filter("large").select(F.concat("head", "middle", "tail").alias("word"), "n", "short", F.array(_span(start, cut), _span(cut, end)).alias("spans"))
        done = told.filter("large is null").select(*KEY, "middle", "n").unionByName(_dealt(whole, F.col("spans")))


# the index


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """Buckets of two words or more, of rows that come in order."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, members in groupby(rows, key=itemgetter(0, 1, 2, 3, 4)):
        found = [row[5:] for row in members]
        if len(found) > 1:
            yield key, found


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple, list[tuple[str, int]]]]]:
    """Buckets to be searched together, their letters in a matrix of bounded size."""
    held, words, longest = [], 0, 0
    for key, members in _groups(batches):
        if held and (words + len(members) > SHARD or (words + len(members)) * max(longest, key[0] + 1) > MOST_LETTERS):
            yield held
            held, words, longest = [], 0, 0
        held.append((key, members))
        words, longest = words + len(members), max(longest, key[0] + 1)
    if held:
        yield held


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis, a multiple of 64 of them, as words of 64 bits."""
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


def _pairs(shard: list[tuple[tuple, list[tuple[str, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of a shard, in both directions."""
    middles = np.array([m for _, members in shard for m, _ in members], np.str_)
    n, width = len(middles), middles.dtype.itemsize // 4
    letters, coded = np.unique(middles.view(np.uint32).reshape(n, width), return_inverse=True)
    coded = coded.reshape(n, width)
    sizes = np.array([len(members) for _, members in shard])
    bucket = np.repeat(np.arange(len(shard)), sizes)
    free = np.repeat([key[0] for key, _ in shard], sizes)
    last = np.repeat([key[2] + key[0] == key[1] for key, _ in shard], sizes)  # the free places are the word's last
    more = np.array([len(m) for _, members in shard for m, _ in members]) - free  # 1 for a word of one letter more
    room = -(-n // 64) * 64
    there = np.zeros((width + 1, len(letters), room), bool)
    there[np.arange(width)[:, None], coded.T, np.arange(n)] = True
    index = _packed(there)
    longer_words = np.zeros(room, bool)
    longer_words[:n] = more == 1
    longer_words = _packed(longer_words)
    ask = np.flatnonzero(more == 0)
    ones, others = [], []
    for a in range(0, len(ask), TILE):
        at = ask[a : a + TILE]
        mates = np.zeros((len(at), room), bool)
        mates[:, :n] = bucket[at][:, None] == bucket
        exact = _packed(mates)
        swapped, longer = np.zeros_like(exact), np.zeros_like(exact)
        for k in range(int(free[at].max())):
            on = int(np.searchsorted(free[at], k, "right"))  # shards come in order of free places
            letter = coded[at[on:], k]
            here, next_ = index[k][letter], index[k + 1][letter]
            swapped[on:] = (swapped[on:] & here) | (exact[on:] & ~here)
            longer[on:] = (longer[on:] | exact[on:]) & next_
            exact[on:] &= here
        # a word that only has a letter more at the end of the free places belongs to the bucket that goes on from there
        longer = np.where(last[at][:, None], longer | exact, longer & ~exact) & longer_words
        # whole bytes first, as most are empty
        found = ((swapped & ~longer_words) | longer).view(np.uint8)
        row, byte = np.nonzero(found)
        which, bit = np.nonzero(np.unpackbits(found[row, byte][:, None], axis=1, bitorder="little"))
        ones.append(at[row[which]])
        others.append(byte[which] * 8 + bit)
    one, other = np.concatenate([np.zeros(0, np.int64), *ones]), np.concatenate([np.zeros(0, np.int64), *others])
    back = more[other] == 1  # words of equal length have found each other
    return np.concatenate([one, other[back]]), np.concatenate([other, one[back]])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word with near words in a bucket: how many, and the first of the most common of them."""
    for shard in _shards(batches):
        one, other = _pairs(shard)
        if not len(one):
            continue
        words = [key[3] + m + key[4] for key, members in shard for m, _ in members]
        n = np.array([n for _, members in shard for _, n in members], np.int64)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], one))
        one, other = one[order], other[order]
        found, first, count = np.unique(one, return_index=True, return_counts=True)
        best = other[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in found], pa.string()), pa.array(count, pa.int64()), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )


# groups


def near_words(words: DataFrame, least_letters: int = LETTERS, most_words: int = MOST_WORDS, most_letters: int = MOST_LETTERS) -> DataFrame:
    """word, n_near, best (minus its count, near word): the words of (word, n) that have near ones."""
    small_batches(words)
    dealt = buckets(words, least_letters, most_words, most_letters).repartition(*KEY).sortWithinPartitions(*KEY)
    found = dealt.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) lead.  Each step is to a word of another count, so it ends; chains are short, as counts multiply."""
    follow = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    now = links.select("word", F.col("form").alias("root"))
    while True:
        step = stage(now.join(follow, "root", "left"), "roots")
        now = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.filter("next is not null").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = LETTERS, least_times: int = TIMES, ratio: int = RATIO, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form: of the near words the most common, if it is `ratio` times as common.  root: the last of the forms from a word on.
    """
    words = stage(vocabulary(docs, least_letters, least_times, slip, id_col, text_col), "vocabulary")
    joined = words.join(near_words(words, least_letters), "word", "left")
    best_n = -F.col("best.minus")
    led = best_n >= ratio * F.col("n")
    formed = stage(joined.select("word", F.when(led, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, best_n).alias("form_n")), "forms")
    release(words)
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
