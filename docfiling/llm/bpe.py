"""Byte-level BPE by padded matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of a batch that are new are sorted into buckets by their
length in bytes, each bucket one matrix of token ids padded at the right.  In every round each row looks all its
neighbouring pairs up in a hash table, merges its leftmost pair of the least rank, and is compacted; rows without a
pair leave the matrix.  A piece of over LONG bytes (a text of one endless word) is a matrix of one row, and a round does as
many of its merges as come one after another with the same rank, so that rounds are as many as ranks, not as bytes.  Pieces
that are tokens themselves need no merging, as in tiktoken.

Edge cases: a null or empty text has no tokens and decodes to no bytes.  A null list of ids decodes as an empty one.
Ids that the vocabulary lacks raise ValueError.  Only the id and the text are read, so no further column can clash.
Very long texts are cut as a whole; memory follows the longest text and the cache of pieces, which is bounded in
bytes and ends with its task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

#: Bytes, about, of the pieces and ids that a task keeps; beyond that it starts anew.
CACHE_BYTES = 24 << 20
#: What a piece takes in the cache beside its characters and ids.
PIECE_BYTES = 220
#: Bytes of text that are encoded together.
BATCH_BYTES = 1 << 19
MATRIX_CELLS = 1 << 19
#: Bytes from which a piece is a matrix of its own.
LONG = 2048
#: White space beside a blank.
_BESIDE = re.compile(r" \s|\s ").search


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's tokens by rank, from a file of base64 token and rank a line."""
    found = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[k] for k in range(len(found))]


class PairTable:
    """Hash table with open addressing: two token ids to the rank of their union."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: k for k, t in enumerate(tokens)}
        pairs = [(rank[t[:i]], rank[t[i:]], k) for k, t in enumerate(tokens) if len(t) > 1 for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.none = len(tokens)
        self.bits = max(4, (4 * len(left) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, self.none, np.int32)
        key = (left << 32) | right
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.made[slot[put]] = key[put], made[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, made, slot = key[rest], made[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        out = np.full(key.shape, self.none, np.int32)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.made[slot[hit]]
        open_ = np.nonzero(~hit & (found != -1))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            where = tuple(x[hit] for x in open_)
            out[where] = self.made[slot[where]]
            open_ = tuple(x[~hit & (found != -1)] for x in open_)
        return out


class _Numbers(dict):
    """Units to numbers; one that is new gets the next number and goes to the owner's `fresh`, with the blank that stood before it."""

    def __init__(self, owner: Codec, before: str) -> None:
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, unit: str) -> int:
        n = self[unit] = self.owner.count
        self.owner.count = n + 1
        self.owner.fresh.append(self.before + unit)
        return n


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat from start on, one after another, and where each begins (one longer)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends


class Decoder:
    """Decodes by one vocabulary."""

    def __init__(self, path: str):
        tokens = read_ranks(path)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of texts whose ids begin at ends (one longer), and where each text's bytes begin (one longer)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id that the vocabulary lacks")
        raw, at = _gather(self.raw, self.start[ids], self.size[ids])
        return raw, at[ends]


class Codec:
    """Encodes by one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.tokens = read_ranks(path)
        self.rank = {t: k for k, t in enumerate(self.tokens)}
        self.cut = regex.compile(pattern).findall
        self.pairs = PairTable(self.tokens)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        """Empty cache: numbers of units that begin a text or follow a blank; by number where a unit's ids start in `flat`, and how many they are."""
        self.count, self.fresh, self.used = 0, [], 0
        self.bare, self.spaced = _Numbers(self, ""), _Numbers(self, " ")
        self.flat, self.start, self.size = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _merge(self, table: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the order in which they end, their numbers of ids, and all ids, of a padded matrix of the ids of single bytes."""
        rows, sizes, flat = [], [], []
        row, none = np.arange(len(table)), self.pairs.none
        ranks = self.pairs(table[:, :-1], table[:, 1:])
        ranks[np.arange(1, table.shape[1]) >= size[:, None]] = none
        while len(row):
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), best]
            done = np.flatnonzero(least == none)
            if len(done):
                own = size[done]
                rows.append(row[done])
                sizes.append(own)
                flat.append(table[done][np.arange(table.shape[1]) < own[:, None]])
            live = np.flatnonzero(least != none)
            if not len(live):
                break
            row, size, best, least = row[live], size[live] - 1, best[live], least[live]
            width = int(size.max())
            # compaction: all cells right of the merged pair move one to the left, ranks with them
            old, old_ranks, at = table[live], ranks[live], np.arange(width)
            table = np.where(at[None, :] <= best[:, None], old[:, :width], old[:, 1 : width + 1])
            k = np.arange(len(row))
            table[k, best] = least
            at = at[: max(width - 1, 0)]
            ranks = np.where(at[None, :] <= best[:, None], old_ranks[:, : len(at)], old_ranks[:, 1 : len(at) + 1])
            if not len(at):
                ranks = np.full((len(row), 1), none, np.int32)
                continue
            # only the pairs beside the merged token are new
            two, p = np.concatenate([k, k]), np.concatenate([best - 1, best])
            ok = np.flatnonzero((p >= 0) & (p + 1 < np.concatenate([size, size])))
            r, p = two[ok], p[ok]
            ranks[r, p] = self.pairs(table[r, p], table[r, p + 1])
            off = np.flatnonzero((best + 1 >= size) & (best < len(at)))
            ranks[off, best[off]] = none
        return np.concatenate(rows), np.concatenate(sizes), np.concatenate(flat)

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one long piece, a matrix of one row, by the same merges in fewer rounds.

        A round takes all places of the row's least rank from left to right, as rounds of one merge would: until a merge makes a
        pair of a lesser rank with what then stands beside it, which has to be merged before the next place.
        """
        none = self.pairs.none
        ids = self.byte[np.frombuffer(raw, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := int(ranks.min())) != none:
            at = np.flatnonzero(ranks == least)
            # of places that overlap (aaa) every second one, from the first of their run on
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))) % 2 == 0]
            # beside a merged token: to the left what is merged already, to the right what isn't yet
            new = np.full(len(at), least, ids.dtype)
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(ids) - 1)
            follows = np.diff(at, prepend=-3) == 2
            lower = (at > 0) & (self.pairs(np.where(follows, least, ids[left]).astype(ids.dtype), new) < least)
            lower |= (at + 2 < len(ids)) & (self.pairs(new, ids[right]) < least)
            at = at[: int(lower.argmax()) + 1] if lower.any() else at
            ids[at] = least
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids = ids[stays]
            now = at - np.arange(len(at))  # where the merged tokens stand
            ranks = np.append(ranks, none)[stays][:-1]
            beside = np.unique(np.concatenate([now - 1, now]))
            beside = beside[(beside >= 0) & (beside + 1 < len(ids))]
            ranks[beside] = self.pairs(ids[beside], ids[beside + 1])
        return ids

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct pieces; by piece where they start, and how many they are."""
        size, start, flat = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)]
        length = 0
        whole: list[tuple[int, int]] = []
        long: list[tuple[int, np.ndarray]] = []
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            token = self.rank.get(raw)
            if token is not None:
                whole.append((k, token))
            elif len(raw) > LONG:
                long.append((k, self._merge_long(raw)))
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((k, raw))
        if whole:
            k, tokens = np.array(whole, np.int64).T
            start[k] = np.arange(len(k))
            flat.append(tokens.astype(np.int32))
            length = len(k)
        for k, ids in long:
            size[k], start[k] = len(ids), length
            flat.append(ids.astype(np.int32))
            length += len(ids)
        for found in buckets.values():
            step = max(1, MATRIX_CELLS // max(len(raw) for _, raw in found))
            for a in range(0, len(found), step):
                part = found[a : a + step]
                wide = np.array([len(raw) for _, raw in part])
                table = np.zeros((len(part), int(wide.max())), np.int32)
                table[np.arange(table.shape[1]) < wide[:, None]] = self.byte[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                rows, own, ids = self._merge(table, wide)
                k = np.array([k for k, _ in part])[rows]
                size[k], start[k] = own, length + np.cumsum(own) - own
                flat.append(ids)
                length += len(ids)
        return np.concatenate(flat), start, size

    def learn(self) -> None:
        """Find the ids of the units that are numbered, but not known."""
        units, self.fresh = self.fresh, []
        pieces = [self.cut(u) for u in units]
        number: dict[str, int] = {}
        order = np.array([number.setdefault(p, len(number)) for ps in pieces for p in ps], np.int64)
        flat, start, size = self._ids_of(list(number))
        ids, ends = _gather(flat, start[order], size[order])
        ends = ends[np.cumsum([0, *map(len, pieces)])]
        self.used += PIECE_BYTES * len(units) + sum(map(len, units)) + 4 * len(ids)
        self.start, self.size, self.flat = np.concatenate([self.start, len(self.flat) + ends[:-1]]), np.concatenate([self.size, np.diff(ends)]), np.concatenate([self.flat, ids])

    def _numbers(self, text: str) -> np.ndarray:
        """Numbers of a text's units.

        A blank between two characters that are no white space always begins a piece, so the text may be cut there first,
        and each word with its blank is a unit that is cut by the pattern once.  A text with other white space beside a blank
        is cut by the pattern as a whole; its pieces are the units.
        """
        if _BESIDE(text):
            return np.fromiter(map(self.bare.__getitem__, self.cut(text)), np.int64)
        first, *rest = text.split(" ")
        return np.fromiter(chain((self.bare[first],), map(self.spaced.__getitem__, rest)), np.int64, 1 + len(rest))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (one longer)."""
        if self.used > CACHE_BYTES:
            self.forget()
        found = [self._numbers(text) for text in texts]
        if self.fresh:
            self.learn()
        unit = np.concatenate([np.zeros(0, np.int64), *found])
        ids, ends = _gather(self.flat, self.start[unit], self.size[unit])
        return ids, ends[np.cumsum([0, *map(len, found)])]


#: The worker's vocabularies, without what tasks cache.
_codecs: dict[tuple[str, str], Codec] = {}
_decoders: dict[str, Decoder] = {}


def _codec(name: str, pattern: str) -> Codec:
    key = (name, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(SparkFiles.get(name), pattern)
    return _codecs[key]


def _decoder(name: str) -> Decoder:
    if name not in _decoders:
        _decoders[name] = Decoder(SparkFiles.get(name))
    return _decoders[name]


def _file(df: DataFrame, path: str) -> str:
    """Send the vocabulary to the executors; its name there."""
    small_batches(df)
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) for each row of df."""
    name, kind = _file(df, path), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        try:
            for batch in batches:
                for a, b, _, _ in chunks(batch.column(1), BATCH_BYTES):
                    part = batch.slice(a, b - a)
                    ids, ends = codec.encode([x or "" for x in part.column(1).to_pylist()])
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])
        finally:
            codec.forget()  # the worker may be used for other stages

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, decoded (binary): encode and decode in one pass, which takes half the Python workers of one after the other."""
    name, kind = _file(df, path), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decoder = _codec(name, pattern), _decoder(name)
        try:
            for batch in batches:
                for a, b, _, _ in chunks(batch.column(1), BATCH_BYTES):
                    part = batch.slice(a, b - a)
                    ids, ends = codec.encode([x or "" for x in part.column(1).to_pylist()])
                    raw, at = decoder.decode(ids, ends)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], names=["id", "ids", "decoded"])
        finally:
            codec.forget()

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids, decoded (binary) for each row of df."""
    name, kind = _file(df, path), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(name)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                ends = lists.offsets.to_numpy()
                raw, at = decoder.decode(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0])
                texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["id", "ids", "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)
