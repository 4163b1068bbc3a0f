"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of the normalised items.  Each document streams through it once: a state and
the length of the longest run that ends here are carried from word to word, so a match is found whatever its length and
however items overlap.  A window of `window` item words inside such a run marks the words it covers; an item shorter than
that is a window itself.

An automaton has at most about `shard_words` item words and is built in a task, as arrays (a state has one arc nearly
always; the others' arcs are in a dictionary): about 100 bytes an item word, at most 20 MB.  A larger benchmark makes several,
by item, all built in one pass over it (an item of more words in pieces that share nine words), and kept in the shared
folder.  The documents are read once for TOGETHER of them, which are broadcast for that pass and then destroyed, and the marks of
the documents that are hit are united; so memory doesn't grow with the benchmark, and time is linear in its words.

Edge cases: null texts have no words; items without words are ignored; equal items are all reported.  An item without
an id is matched, but not named.  An empty benchmark leaves all documents as they are.  Repeated rows each get their
own row.  Further columns are ignored by `matches` and kept by `clean`, with n_chars set anew where the text changes.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, binary, free_name, release, small_batches, stage

#: Bytes to lower-case letters and digits, all else to blanks.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (PLAIN[b] or 65 <= b <= 90) else 32 for b in range(256))


#: Item words of one automaton, and automata that a task holds together.
SHARD_WORDS, TOGETHER = 200_000, 8


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.word.setdefault(w, len(self.word)) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        owners = [set() for _ in self.next]
        #: state -> items of fewer words than a window that end there, with their length
        self.short: dict[int, list[tuple[int, object]]] = {}
        for name, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= window:
                    at = state
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                    owners[at].add(name)
            if len(ids) < window:
                at = state
                while self.length[self.link[at]] >= len(ids):
                    at = self.link[at]
                self.short.setdefault(at, []).append((len(ids), name))
        #: state -> the state for its last `window` words, if it has as many
        self.head = list(range(len(self.next)))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: state -> nearest state up the links (itself included) that ends a short item, or -1
        self.ends = [-1] * len(self.next)
        for s in by_length:
            up = self.link[s]
            if self.length[up] >= window:
                self.head[s] = self.head[up]
            self.ends[s] = s if s in self.short else self.ends[up]
        self._pack(owners)

    def _pack(self, owners: list[set]) -> None:
        """States as arrays: the first arc's word and target, and the item whose window ends there; dictionaries where there are several."""
        number = {name: k for k, name in enumerate({name for x in owners for name in x})}
        self.names = list(number)
        self.owner = array("i", (number[next(iter(x))] if len(x) == 1 else -1 for x in owners))
        self.owners = {s: tuple(number[name] for name in x) for s, x in enumerate(owners) if len(x) > 1}
        self.arc = array("i", (next(iter(x)) if x else -1 for x in self.next))
        self.to = array("i", (next(iter(x.values())) if x else -1 for x in self.next))
        self.arcs = {s: x for s, x in enumerate(self.next) if len(x) > 1}
        self.link, self.length, self.head, self.ends = (array("i", x) for x in (self.link, self.length, self.head, self.ends))
        del self.next

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        now = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return now

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = made
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = made
            p = link[p]
        return made

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (end exclusive, apart from each other) and the items that occur."""
        code, link, length, window = self.word.get, self.link, self.length, self.window
        first, to, arcs = self.arc, self.to, self.arcs
        ends, head, none = self.ends, self.head, {}
        spans: list[tuple[int, int]] = []
        found: set = set()
        state = size = 0
        seen = -1
        for i, w in enumerate(map(code, words)):
            if w is None:
                state = size = 0
                continue
            while (after := to[state] if first[state] == w else arcs.get(state, none).get(w, -1)) < 0:
                if not state:
                    break
                state = link[state]
                size = length[state]
            else:
                state = after
                size += 1
                start = i + 1
                if size >= window:
                    at = state
                    while length[link[at]] >= size:
                        at = link[at]
                    if head[at] != seen:
                        seen = head[at]
                        if (one := self.owner[seen]) >= 0:
                            found.add(self.names[one])
                        else:
                            found.update(self.names[k] for k in self.owners.get(seen, ()))
                    start = i + 1 - window
                if (at := ends[state]) >= 0:
                    while at >= 0:
                        for long, name in self.short[at]:
                            if long <= size:
                                found.add(name)
                                start = min(start, i + 1 - long)
                        at = ends[link[at]] if link[at] > 0 else -1
                if start <= i:
                    a = start
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, found


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """item, words (in one text) of each item; one of over most_words words in pieces that share window - 1 words, so that each window is in one."""
    for batch in batches:
        items, texts = [], []
        for name, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist(), strict=True):
            words = normal_words(text)
            for a in range(0, max(1, len(words) - window + 1), max(1, most_words - window + 1)):
                items.append(name)
                texts.append(b" ".join(words[a : a + most_words]))
        yield pa.RecordBatch.from_arrays([pa.array(items, batch.column(0).type), pa.array(texts, pa.binary()).cast(pa.string())], names=["item", "words"])


def automata(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(shard, automaton as bytes), staged, and how many shards there are: each of about shard_words item words at most, built in a task of its own.

    The benchmark is read once for its size and once for its words.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(items)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // (2 * shard_words)))  # a word and its blank are two bytes at least
    kind = items.schema["item"].dataType.simpleString()
    pieces = items.mapInArrow(lambda b: _pieces(b, window, max(shard_words, 2 * window)), f"item {kind}, words string")

    def build(table: pa.Table) -> pa.Table:
        coded = [(name, words.encode().split()) for name, words in zip(table["item"].to_pylist(), table["words"].to_pylist(), strict=True)]
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(Automaton(coded, window))], pa.binary())})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
    return stage(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata"), shards


def _told(built: DataFrame, shards: range) -> list:
    """Automata as the tasks read them; the driver has one of them at a time, of a bounded size, and passes it on as it is."""
    out = []
    for k in shards:
        rows = built.filter(F.col("shard") == k).select("automaton").collect()
        if rows:
            out.append(built.sparkSession.sparkContext.broadcast(bytes(rows[0]["automaton"])))
    return out


MATCH = "key long, n_words long, starts array<int>, ends array<int>, items array<string>"


def _united_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Spans in any order as their union, starts and ends."""
    if not spans:
        return [], []
    a, b = np.array(spans, np.int64).T
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new].tolist(), b[np.concatenate([new[1:], [True]])].tolist()


def _scan(df: DataFrame, told: list, only_hits: bool = False) -> DataFrame:
    """For each row of key, text: its words, hit spans and items by all the given automata, which a task holds together."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = [pickle.loads(x.value).scan for x in told]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                words = normal_words(text.as_py())
                spans, items = [], set()
                for scan in scans:
                    some, found = scan(words)
                    spans += some
                    items |= found
                if spans or not only_hits:
                    rows.append((key, len(words), *_united_spans(spans), sorted({str(x) for x in items if x is not None})))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=["key", "n_words", "starts", "ends", "items"])

    return df.mapInArrow(run, MATCH)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, starts, ends, items with the spans united."""
    for batch in batches:
        united = [_united_spans(list(zip(a, b, strict=True))) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in united], kind), pa.array([b for _, b in united], kind), batch.column(3)], names=batch.schema.names)


def _marks(keyed: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """key, starts, ends, items of the rows (unique key, text) that are hit, by all automata: one pass over the rows for TOGETHER of them."""
    parts = []
    for a in range(0, shards, TOGETHER):
        told = _told(built, range(a, min(a + TOGETHER, shards)))
        parts.append(stage(_scan(keyed, told, only_hits=True).drop("n_words"), "marks"))
        for x in told:
            x.destroy()
    every = reduce(DataFrame.unionByName, parts)
    joined = every.groupBy("key").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    out = stage(joined.mapInArrow(_merged, "key long, starts array<int>, ends array<int>, items array<string>"), "marks")
    release(*parts)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans (array of start, end in words), one row for each row of docs."""
    built, shards = automata(benchmark, window, shard_words=shard_words)
    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    if shards == 1:
        found = _scan(narrow, _told(built, range(1)))
    else:
        keyed = stage(narrow.select(F.monotonically_increasing_id().alias("row"), "key", "text"), "rows")
        marks = _marks(keyed.select(F.col("row").alias("key"), "text"), built, shards).withColumnRenamed("key", "row")
        words = F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
        ints, strings = (F.array().cast(f"array<{k}>") for k in ("int", "string"))
        found = keyed.select("row", "key", F.coalesce(words, F.lit(0)).cast("long").alias("n_words")).join(marks, "row", "left")
        found = found.select("key", "n_words", *(F.coalesce(c, none).alias(c) for c, none in (("starts", ints), ("ends", ints), ("items", strings))))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("int"), lambda x, y: x + y).cast("long")
    return found.select(
        F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.arrays_zip("starts", "ends").alias("spans")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without contaminated spans: hit words go, with what stands between them in the text.

    A document goes as a whole if hit words are more than most_coverage of its words.  What is left of any other keeps
    its bytes; removal can't join two words, as a blank takes the span's place.  n_chars, if there, is set anew.
    """
    built, shards = automata(benchmark, window, shard_words=shard_words)
    small_batches(docs)
    names = docs.columns
    schema = docs.schema
    spans, told = None, []
    if shards == 1:
        told = _told(built, range(1))
    else:
        # the marks of all automata beside each row
        row, starts, ends = map(free_name, ("row", "starts", "ends"))
        keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = _marks(keyed.select(F.col(row).alias("key"), F.col(text_col).cast("string").alias("text")), built, shards)
        docs = keyed.join(found.select(F.col("key").alias(row), F.col("starts").alias(starts), F.col("ends").alias(ends)), row, "left").drop(row)
        spans = (starts, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(told[0].value) if told else None
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            marks = None
            if spans:
                marks = [list(zip(a or (), b or (), strict=True)) for a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in spans), strict=True)]
                batch = batch.select(names)
            texts, keep, changed = [], [], False
            for k, text in enumerate(batch.column(at)):
                raw = text.as_py()
                left = None if raw is None else _without(raw, marks[k] if marks else None, automaton, most_coverage)
                keep.append(raw is None or left is not None)
                texts.append(raw if left is None else left)
                changed |= left is not None and left != raw
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast(schema["n_chars"].dataType)))
    return out


def _without(text: str, spans: list[tuple[int, int]] | None, automaton: Automaton | None, most_coverage: float) -> str | None:
    """The text without the spans (those that the automaton finds, if spans is None; neither: none); None if too much of it is hit."""
    raw = text.encode()
    words = normal_words(raw)
    hit = np.zeros(len(words) + 1, bool)
    for a, b in spans if spans is not None else automaton.scan(words)[0] if automaton else ():
        hit[a:b] = True
    if not hit.any():
        return text
    if hit.sum() > most_coverage * len(words):
        return None
    inside = PLAIN[np.frombuffer(raw.lower(), np.uint8)]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : first[a]])
        at = last[b - 1]
    out.append(raw[at:])
    return b" ".join(out).decode()
