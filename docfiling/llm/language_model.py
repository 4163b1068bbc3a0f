"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model (trigrams unless asked otherwise) with Dirichlet smoothing, order by order:
p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), h being the words before w and h' the same without the first;
p(w) = (c + 1) / (N + V + 1).  Its automaton has a state for each known history of fewer words than the order and a root.
A state has an arc for each known n-gram that continues it, weighted with the smoothed log probability, and one failure
arc to the history without its first word, weighted with log10(mu / (c(h) + mu)); at the root every word has an arc.  An
arc leads to the longest known history that ends with its word.  A text is one left-to-right traversal that carries its state:
a token takes the state's arc, or follows failure arcs until a state has one.  All texts of a block go side by side, a
token of each at a time; long texts are cut into pieces, and as a state is at most order - 1 words, a piece that first reads
the order - 1 tokens before it from the root begins in the very state that the piece before ends in.

The model grows with the corpus, so it is never in one place.  Texts are dealt into blocks of about `block_bytes`, packed
in chunks, as they are both written and shuffled; a block sends the hashes of its distinct n-grams with its own counts, by ranges of the hash, and gets back the corpus
counts of those that are known elsewhere too, by their places in what it sent.  So each block builds just the part of the
automaton that its texts walk through.  Counts cover all training rows of the corpus.  Words are told apart by 64 bits of
hash, longer n-grams by as many as gram_bits says.

Edge cases: null and empty texts are one end token.  A row without an id is a training row.  Repeated rows count
each time.  Without training rows N and V are 0 and each token has probability 1 (1 / (0 + 0 + 1)).  An empty table gives an
empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, binary, chunks, distinct, mix, small_batches, stage, word_hashes

#: Hash of the token that ends each text; as a history it stands for the text's start.
END = np.uint64(0x5BD1E9955BD1E995)
_STEP = np.uint64(0x9E3779B97F4A7C15)

MOST_PARTITIONS = 100_000
#: Tokens of a text that one walk reads; the rest of a longer text is read beside them.
PIECE = 256
#: Most ones that a number takes in Rice's code.
FAR = np.uint64(31)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order 1.. the hash of the n-gram that ends at each token (0: none), and each row's first token (one longer).

    The history before a text's first token is one END.
    """
    tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b, data, offsets in chunks(column):
        hashes, first, _, _ = word_hashes(data, offsets, LOWER, BLANK)
        tokens.append(np.insert(hashes, first[1:], END))
        sizes.append(np.diff(first) + 1)
    words = np.maximum(np.concatenate(tokens), np.uint64(1))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    out, now = [words], words
    place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(n - 1, np.uint64), words[: len(words) - n + 1]])[: len(words)]
        before[place == n - 2] = END
        now = np.maximum(mix(now * _STEP + before + np.uint64(n)), np.uint64(1))
        now[place < n - 2] = 0
        out.append(now)
    return out, ends


def gram_bits(size: int) -> int:
    """Bits of a hash of two words or more that count, for a corpus of so many bytes.

    48 at least, and so many that about one n-gram in a million shares its hash with another.  Words have all 64.
    """
    return min(64, max(48, (size // 6 + 1).bit_length() + 20))


def _coded(values: np.ndarray) -> bytes:
    """Whole numbers in Rice's code: low bits as they are, the rest in unary; what would take FAR ones or more follows in full.

    The gaps of sorted hashes come within a tenth of a bit of their entropy, whatever their number, unlike in whole bytes.
    """
    values, n = values.astype(np.uint64), len(values)
    if not n:
        return bytes(5)
    middle = int(np.partition(values, n // 2)[n // 2]).bit_length()

    def bits(k: int) -> int:
        high = values >> np.uint64(k)
        return n * k + int(np.minimum(high, FAR).sum()) + 64 * int((high >= FAR).sum())

    k = min({max(0, middle - 1), min(middle, 63)}, key=bits)
    high = np.minimum(values >> np.uint64(k), FAR)
    whole, rest = divmod(k, 8)
    low = values.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(n + int(high.sum()), np.uint8)
    ones[np.cumsum(high.astype(np.int64) + 1) - 1] = 1
    parts = [low[:, :whole].T, np.packbits(np.unpackbits(low[:, whole, None], axis=1)[:, 8 - rest :]), np.packbits(ones), values[high == FAR]]
    return bytes([k]) + n.to_bytes(4, "little") + b"".join(x.tobytes() for x in parts)


def _decoded(raw: bytes) -> np.ndarray:
    k, n = raw[0], int.from_bytes(raw[1:5], "little")
    if not n:
        return np.zeros(0, np.uint64)
    whole, rest = divmod(k, 8)
    body = np.frombuffer(raw, np.uint8, offset=5)
    low = np.zeros((n, 8), np.uint8)
    low[:, :whole] = body[: n * whole].reshape(whole, n).T
    at = n * whole + -(-n * rest // 8)
    if rest:
        low[:, whole] = np.packbits(np.unpackbits(body[n * whole : at], count=n * rest).reshape(n, rest), axis=1)[:, 0] >> (8 - rest)
    ends = np.flatnonzero(np.unpackbits(body[at:]))[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    out = low.view(np.uint64).ravel() | (high << np.uint64(k))
    far = high == FAR
    out[far] = body[at + ends[-1] // 8 + 1 :].view("<u8")
    return out


def _packed(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the gaps between them."""
    return sorted_hashes[:1].tobytes() + _coded(np.diff(sorted_hashes))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1), _decoded(raw[8:])]), dtype=np.uint64)


def _shut(rows: pa.RecordBatch) -> bytes:
    """Rows as an Arrow stream under zstd; a shuffle's own lz4 leaves texts half as large again."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3), use_threads=False)) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _opened(column: pa.Array | pa.ChunkedArray) -> pa.Table:
    alone = pa.ipc.IpcReadOptions(use_threads=False)
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer(), options=alone).read_all() for x in column])


def _edges(names: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range of hashes begins among sorted names, and the end of the last."""
    shift = np.uint64(bits - ranges.bit_length() + 1)
    inner = np.searchsorted(names, np.arange(1, ranges, dtype=np.uint64) << shift) if ranges > 1 else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(names)]])


def _cut(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits) if n > 1 else hashes


def _asked(column: pa.Array, training: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, distinct hashes (sorted) and the counts of them in training rows."""
    found, ends = grams(column, order)
    learn = np.repeat(training, np.diff(ends))
    for n, hashes in enumerate(found, 1):
        there = hashes != 0
        hashes = _cut(hashes, n, bits)
        # a pair of sorts is cheaper than unique with an inverse
        names = distinct(hashes[there])
        known, times = np.unique(hashes[there & learn], return_counts=True)
        counts = np.zeros(len(names), np.int64)
        counts[np.searchsorted(names, known)] = times
        yield n, names, counts


class Automaton:
    """The part of the backoff automaton that one block's texts walk through.

    found: at each token the number of the n-gram of each order that ends there (-1: none); counts: of those n-grams in the
    corpus's training rows; ends: each text's first token (one longer).  States are numbered: the root, words, pairs and so on.
    """

    def __init__(self, total: int, distinct: int, mu: Sequence[float], counts: list[np.ndarray], found: list[np.ndarray], ends: np.ndarray):
        self.order, self.counts, self.words = len(counts), counts, len(counts[0])
        weights = [np.log10(counts[0] + 1) - np.log10(total + distinct + 1)]
        #: number of the first state with a history of 0, 1, .. words; the last one is no state's
        self.base = np.concatenate([[0], 1 + np.cumsum([0, *(len(c) for c in counts[:-1])])])
        fail, fail_to, self.keys, self.arcs = [np.zeros(1)], [np.zeros(1, np.int64)], [], []
        last = found[0][ends[1:] - 1]  # the start is the END of the text before it
        for n in range(2, self.order + 1):
            there = np.flatnonzero(found[n - 1] >= 0)
            grams_, before = found[n - 1][there], np.concatenate([[-1], found[n - 2][:-1]])
            if n == 2:
                before[ends[:-1]] = last
            history, shorter, word = (np.zeros(len(counts[n - 1]), np.int64) for _ in range(3))
            history[grams_], shorter[grams_], word[grams_] = before[there], found[n - 2][there], found[0][there]
            own, m = counts[n - 2], mu[n - 2]
            weights.append(np.log10((counts[n - 1] + m * 10 ** weights[-1][shorter]) / (own[history] + m)))
            fail.append(np.log10(m / (own + m)))
            # the history of n - 1 words without its first: a pair's second word, and so on
            fail_to.append(np.zeros(len(own), np.int64) if n == 2 else self.base[n - 2] + ends_with)
            known = np.flatnonzero(counts[n - 1] > 0)
            keys = history[known] * self.words + word[known]
            by = np.argsort(keys)
            self.keys.append(keys[by])
            self.arcs.append(known[by])
            ends_with = shorter
        self.weights, self.longest = weights, ends_with
        self.fail, self.fail_to = np.concatenate(fail), np.concatenate(fail_to)
        self.start = self.base[1] + int(last[0]) if len(last) and counts[0][last[0]] > 0 else 0

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token each, and the log10 probabilities of these tokens."""
        states, score, after = states.copy(), np.zeros(len(words)), np.zeros(len(words), np.int64)
        for n in range(self.order, 1, -1):
            keys, arcs = self.keys[n - 2], self.arcs[n - 2]
            here = np.flatnonzero(states >= self.base[n - 1])
            wanted = (states[here] - self.base[n - 1]) * self.words + words[here]
            at = np.searchsorted(keys, wanted)
            taken = np.zeros(len(here), bool)
            if len(keys):
                at = np.minimum(at, len(keys) - 1)
                taken = keys[at] == wanted
            go, arc = here[taken], arcs[at[taken]]
            score[go] += self.weights[n - 1][arc]
            after[go] = self.base[n] + arc if n < self.order else self.base[n - 1] + self.longest[arc]
            states[go] = -1
            stay = here[~taken]
            score[stay] += self.fail[states[stay]]
            states[stay] = self.fail_to[states[stay]]
        rest = np.flatnonzero(states == 0)
        score[rest] += self.weights[0][words[rest]]
        after[rest] = np.where(self.counts[0][words[rest]] > 0, self.base[1] + words[rest], 0)
        return after, score

    def walk(self, words: np.ndarray, ends: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Log10 probability of each token: one traversal of each text from its start, all texts side by side."""
        out, lead = np.zeros(len(words)), self.order - 1
        many = -(-np.diff(ends) // piece)
        text = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        own = ends[text] + nth * piece
        first = np.maximum(own - lead, ends[text])
        stop = np.minimum(own + piece, ends[text + 1])
        by = np.argsort(first - stop, kind="stable")
        own, first, size = own[by], first[by], (stop - first)[by]
        states = np.where(first == ends[text[by]], self.start, 0)
        for k in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -k))
            at = first[:active] + k
            states, score = self.step(states[:active], words[at])
            mine = at >= own[:active]
            out[at[mine]] = score[mine]
        return out


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: Sequence[float] = (64.0, 16.0), block_bytes: int = 8 << 20, range_items: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    mu: weight of the shorter history for pairs, triples and so on; their number sets the order, two or more.
    """
    order = len(mu) + 1
    if order < 2:
        raise ValueError("mu needs a weight for pairs at least")
    small_batches(df)
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, used = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for a, b, data, _ in chunks(batch.column(2)):
                if used + len(data) > block_bytes and used:
                    block, used = block + 1, 0
                used += len(data)
                rows = _shut(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + block]), pa.array([len(data)]), pa.array([rows], pa.binary())], names=["block", "size", "rows"])

    # written once: a block must hold the same texts whenever a task is run again
    path_df = stage(narrow.mapInArrow(dealt, "block long, size long, rows binary"), "blocks", compression="uncompressed")
    size, blocks_there = path_df.agg(F.sum("size"), F.count_distinct("block")).first()
    size = size or 0
    ranges = 1 << max(0, (-(-size // (6 * range_items)) - 1).bit_length())
    bits = gram_bits(size)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(block: int, rows: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            table = _opened(pa.chunked_array(rows))
            column, training = binary(table["text"]), ~table["held"].to_numpy()
            for n, names, counts in _asked(column, training, order, bits):
                cut = _edges(names, ranges, bits if n > 1 else 64)
                out = [(k, _packed(names[x:y]), _coded(counts[x:y])) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([n] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())],
                    names=["range", "block", "n", "names", "counts"],
                )

        now, rows = None, []
        for batch in batches:
            names = batch["block"].to_numpy()
            edges = np.flatnonzero(np.diff(names, prepend=names[:1] - 1))
            for a, b in zip(edges, [*edges[1:], len(names)], strict=True):
                if names[a] != now and rows:
                    yield from sent(now, rows)
                    rows = []
                now = int(names[a])
                rows.append(batch["rows"].slice(a, b - a))
        if rows:
            yield from sent(now, rows)

    asked = path_df.mapInArrow(ask, "range long, block long, n int, names binary, counts binary")

    def answer(table: pa.Table) -> pa.Table:
        """For each block which of the n-grams that it sent in one range have other counts in the corpus, and these."""
        at = table["range"][0].as_py()
        out = {"block": [], "n": [], "range": [], "other": [], "counts": [], "total": [], "distinct": []}
        for n in range(1, order + 1):
            part = table.filter(pa.compute.equal(table["n"], n))
            if not part.num_rows:
                continue
            names = [_unpacked(x.as_py()) for x in part["names"]]
            own = [_decoded(x.as_py()).astype(np.int64) for x in part["counts"]]
            every, sums = np.concatenate(names), np.concatenate(own)
            order_ = np.argsort(every, kind="stable")
            every, sums = every[order_], sums[order_]
            first = np.flatnonzero(np.diff(every, prepend=every[:1] - np.uint64(1)))
            every, sums = every[first], np.add.reduceat(sums, first)
            blocks_ = part["block"].to_pylist()
            merged: dict[int, list[int]] = {}
            for i, block in enumerate(blocks_):
                merged.setdefault(block, []).append(i)
            for block, parts in merged.items():
                if len(parts) > 1:  # a block that two tasks have read
                    name = distinct(np.concatenate([names[i] for i in parts]))
                    mine = np.full(len(name), -1)  # each knows its share only: answer all
                else:
                    name, mine = names[parts[0]], own[parts[0]]
                total = sums[np.searchsorted(every, name)]
                new = total != mine
                if new.any():
                    out["block"].append(block), out["n"].append(n), out["range"].append(at), out["other"].append(np.packbits(new).tobytes()), out["counts"].append(_coded(total[new]))
                    out["total"].append(0), out["distinct"].append(0)
            if n == 1:
                out["block"].append(-1), out["n"].append(0), out["range"].append(at), out["other"].append(b""), out["counts"].append(b"")
                out["total"].append(int(sums.sum())), out["distinct"].append(int((sums > 0).sum()))
        kinds = {"block": pa.int64(), "n": pa.int32(), "range": pa.int64(), "other": pa.binary(), "counts": pa.binary(), "total": pa.int64(), "distinct": pa.int64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    # partitions follow the numbers of ranges and blocks, twice as many, so that few meet in one
    parts = lambda n: max(1, min(2 * n, MOST_PARTITIONS))
    asked = asked.repartition(parts(ranges), "range")
    answers = asked.groupBy("range").applyInArrow(answer, "block long, n int, range long, other binary, counts binary, total long, distinct long")
    answers = stage(answers, "answers", compression="zstd", drop_shuffles=True)
    model = answers.filter("block < 0").agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = model[0] or 0, model[1] or 0

    def walk(key: tuple, chunks_: pa.Table, known: pa.Table) -> pa.Table:
        texts = _opened(chunks_["rows"])
        column = binary(texts["text"])
        held = texts["held"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        found, ends = grams(column, order)
        learn = ~np.repeat(held, np.diff(ends))
        counts, places = [], []
        for n in range(1, order + 1):
            hashes, found[n - 1] = found[n - 1], None  # the automaton needs the memory
            there = hashes != 0
            names, inverse = np.unique(_cut(hashes[there], n, bits), return_inverse=True)
            place = np.full(len(hashes), -1)
            place[there] = inverse
            own = np.bincount(place[there & learn], minlength=len(names)).astype(np.int64)
            edges = _edges(names, ranges, bits if n > 1 else 64)
            part = known.filter(pa.compute.equal(known["n"], n))
            for at, other, count in zip(part["range"].to_pylist(), part["other"], part["counts"], strict=True):
                other = np.unpackbits(np.frombuffer(other.as_py(), np.uint8), count=edges[at + 1] - edges[at])
                own[edges[at] + np.flatnonzero(other)] = _decoded(count.as_py())
            counts.append(own)
            places.append(place)
            del hashes, names, inverse
        automaton = Automaton(total, distinct, mu, counts, places, ends)
        smooth, alone = automaton.walk(places[0], ends), automaton.weights[0][places[0]]
        counts = [counts[0][places[0]]]
        both = [np.add.reduceat(x, ends[:-1]) for x in (alone, smooth)]
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held"],
                "n_tokens": pa.array(np.diff(ends), pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), ends[:-1])),
                "train_tokens": pa.array(np.full(len(ends) - 1, total, np.int64)),
                "base_score": pa.array(both[0]),
                "score": pa.array(both[1]),
            }
        )

    def walk_some(key: tuple, chunks_: pa.Table, known: pa.Table) -> pa.Table:
        return walk(key, chunks_, known) if chunks_.num_rows else OUT.empty_table()

    given = answers.filter("block >= 0").select("block", "n", "range", "other", "counts")
    texts, known_ = (d.repartition(parts(blocks_there), "block") for d in (path_df, given))
    return texts.groupBy("block").cogroup(known_.groupBy("block")).applyInArrow(walk_some, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
