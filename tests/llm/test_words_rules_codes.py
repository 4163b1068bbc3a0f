"""Spelling variants, quality rules and vector codes against brute force, on the smallest tables and on planted cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EDGE, frame, sha

from docfiling.llm import quality_rules, queries, spelling, vector_codes


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# spelling


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(rows, slip):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute_variants(n):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, str(form.get(w)), root(w), n[w], len(near[w]), str(n[form[w]] if w in form else None)) for w in n)


def told(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in df.collect())


def test_spelling(spark, small):
    base = ["counting", "countings", "countimg", "couting", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "éléments", "elements", "ÉLEMENTS", "abcdefghij" * 9, "abcdefghij" * 9 + "x"]
    planted = [(k, " ".join([base[0]] * 120 + [base[1]] * 11 + [base[3]] + [base[3] + "s"]) + " " + " ".join(2 * base)) for k in range(4)]
    planted += [(None, "Counting countinG"), (None, None), (9, "")]
    for df, rows in ((frame(spark, EDGE), EDGE), (frame(spark, planted), planted), (small, [(r["doc_id"], r["text"]) for r in small.collect()])):
        for slip in (31, None):
            assert told(spelling.variants(df, slip=slip)) == brute_variants(words_of(rows, slip))
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short")])).count() == 0
    long = "x" * 100_000 + "y" * 100_000
    rows = [(1, f"{long} {long} " * 10 + f"{long}y {long}y x{long} x{long} {long[1:-1]}z {long[1:-1]}z")]
    found = sorted((r["n"], r["n_near"], r["word"] == long, r["form"] == long) for r in spelling.variants(frame(spark, rows)).collect())
    assert found == [(2, 0, False, False), (2, 2, False, True), (2, 2, False, True), (20, 2, True, False)]


def test_near_words(spark):
    """All pairs of a dense vocabulary, whatever the size of the buckets; chains of forms."""
    rng = random.Random(3)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): 10 ** rng.randint(0, 4) for _ in range(1500)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(w, k) for w, _, _, _, k, _ in brute_variants(n) if k}
    for most_words, most_letters in ((4096, 1 << 18), (40, 1 << 18), (2, 1 << 18), (4096, 60)):
        got = spelling.near_words(df, 7, most_words, most_letters).collect()
        assert {(r["word"], r["n_near"]) for r in got} == want and len(got) == len(want)
    # a large bucket is cut, and none holds more than what differs in its free places
    sizes = spelling.buckets(df, 7, 40).groupBy(*spelling.KEY).count().filter("count > 40").select("free").distinct().collect()
    assert {r["free"] for r in sizes} <= {1}
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w20"}


# quality rules

SPACE = "[\x20\x09-\x0d]+"


def brute_rules(rows, most=10, percent=1, left=50):
    """rows: (id, host, text)."""
    split = lambda t: [w for w in re.split(SPACE, t) if w]
    normal = lambda line: tuple(split(re.sub("[0-9]", "0", lower(line))))
    texts, have = defaultdict(set), defaultdict(set)
    for _, host, t in rows:
        texts[host].add(t or "")
        for line in (t or "").split("\n"):
            have[host, normal(line)].add(t or "")
    out = []
    for doc, host, t in rows:
        t = t or ""
        w = split(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        gone = sum(len(normal(x)) for x in lines if (n := len(have[host, normal(x)])) > most and 100 * n > percent * len(texts[host]))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        numbers = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), gone)
        out.append((str(doc), *numbers, failed, not failed and 100 * (len(w) - gone) >= left * len(w)))
    return sorted(out)


def rules(df, **limits):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    found = quality_rules.judged(df, F.col("source"), F.col("doc_id"), **limits)
    return sorted((str(r["own"]), *(r[k] for k in names)) for r in found.collect())


def menus():
    """A host whose pages share a menu, one whose copies share all, and one of few pages."""
    rng, out = random.Random(8), []
    prose = lambda k, n: " ".join(f"w{rng.randint(0, 5000)}x{k}" for _ in range(n))
    for k in range(30):
        out.append((k, "a", f"Home | About | Page {k} of 99\n{prose(k, 60)}\r\n\n  Contact & imprint # {k % 10}\nCopyright"))
        out.append((100 + k, "b", "The same page here again\n" + " ".join(f"v{j}" for j in range(70))))
        out.append((200 + k, "a", f"HOME | about |  page {k} of 99\n" * 3 + prose(k, 20)))
    out += [(300, "c", "Home | About | Page 1 of 99\n" + prose(1, 60)), (301, None, prose(2, 80)), (301, None, prose(2, 80)), (302, None, None), (303, "c", ""), (304, "c", "\n \n\t\n")]
    out += [(305, "c", "a b c " * 40), (306, "c", "é漢\U0001f600 " * 60), (307, "c", f"{prose(5, 9)}\n" * 2 + prose(6, 200)), (None, "c", prose(7, 55))]
    return out


def test_quality_rules(spark, small):
    assert rules(small) == brute_rules([(r["doc_id"], r["source"], r["text"]) for r in small.collect()])
    rows = menus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("row", "lines", "host", "own", "carried")})
    found = rules(df)
    assert found == brute_rules(rows)
    kept = {r[0] for r in found if r[-1]}
    assert kept >= {str(k) for k in range(30)} | {str(100 + k) for k in range(30)} and not kept & {str(200 + k) for k in range(30)}
    assert rules(df, most_documents=1, most_percent=20) == brute_rules(rows, 1, 20)
    edge = frame(spark, EDGE)
    assert rules(edge) == brute_rules([(i, f"s{k % 3}", t) for k, (i, t) in enumerate(EDGE)])
    assert rules(df.limit(0)) == []
    left = quality_rules.cleaned(df, F.col("source"))
    assert left.columns == df.columns and quality_rules.cleaned(df.limit(0), F.col("source")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    by_id = {i: t for i, _, t in rows}
    assert {str(i) for i in texts} == kept
    assert all(texts[k] == by_id[k].split("\n", 1)[1].split("  Contact")[0] for k in range(30)) and all(texts[100 + k] == by_id[100 + k] for k in range(30))


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, label, vector)."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[2]]))
    good = [r for r in good if len(r[2]) == len(good[0][2])]
    whole = [[math.floor(4096 * x) for x in r[2]] for r in good]
    size = len(whole[0]) // parts
    cut = lambda v: [tuple(v[k * size : (k + 1) * size]) for k in range(parts)]
    pieces = [cut(v) for v in whole]
    books = [[p[k] for p in pieces[:entries]] for k in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda k, x: min((far(x, e), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            own = defaultdict(list)
            for p in pieces:
                own[near(k, p[k])[1]].append(p[k])
            new.append([tuple(sum(c) // len(own[i]) for c in zip(*own[i], strict=True)) if own[i] else e for i, e in enumerate(books[k])])
        books = new
    found = [[near(k, p[k]) for k in range(parts)] for p in pieces]
    errors = Counter()
    for r, f in zip(good, found, strict=True):
        errors[r[1]] += sum(d for d, _ in f)
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), errors[r[1]], digest) for r, f in zip(good, found, strict=True))


def codes(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(df).collect())


VECTORS = "vec_id long, embedding array<float>, label int, whole string, own int, points int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, label, v in rows], VECTORS)


def test_vector_codes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert codes(df) == brute_codes([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 3
    clustered = [(int(i), int(i % 3), (centres[i % 6] + rng.normal(size=16) * 0.01).astype(np.float32).tolist()) for i in range(900)]  # whole nodes
    ties = [(i, None if i % 2 else 1, [float(x) for x in rng.integers(-1, 2, 8)]) for i in range(300)]
    bad = [(1000, 1, None), (1001, 1, [float("nan")] * 16), (1002, 1, [float("inf")] * 16), (1003, 1, [None] + [0.0] * 15), (1004, 1, [0.0] * 8), (1005, 1, []), (1006, 1, [1.0] * 15)]
    odd = [(None, None, [-0.00001] * 16), (None, 2, [0.5] * 16), (7, 2, [0.25] * 16), (7, None, [0.125] * 16), (1, 2, [2000.0] * 16)]
    few = [(i, 1, [i / 3] * 8) for i in range(5)]
    for rows in (clustered + bad + odd, ties, few, [(3, None, [1.5] * 8)] * 40):
        assert codes(vectors(spark, rows)) == brute_codes(rows)
    assert codes(vectors(spark, [])) == codes(vectors(spark, [(1, 1, None)])) == []
    with pytest.raises(Exception, match="a component is over"):
        codes(vectors(spark, [(1, 1, [1e30] * 8)]))


def test_trees_assign_whole_nodes():
    rng = np.random.default_rng(9)
    points = (rng.normal(size=(40, 1, 8)) * 40_000 + rng.normal(size=(40, 60, 8)) * 50).astype(np.int64).reshape(-1, 8)
    book = points[::157][:16]
    tree, entries = vector_codes.Tree(points, vector_codes.LEAF), vector_codes.Entries(book)
    whole, loose, entry = vector_codes.assigned(tree, entries)
    found = np.full(len(points), -1)
    found[loose] = entry
    for level, nodes, which in whole:
        for node, code in zip(nodes, which, strict=True):
            assert (found[tree.bounds[level][node] : tree.bounds[level][node + 1]] == -1).all()
            found[tree.bounds[level][node] : tree.bounds[level][node + 1]] = code
    assert (found == ((tree.points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(loose) < len(points) // 2


def test_decoded(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kept, seeds = vector_codes.usable(df)
    laid = vector_codes.blocks(kept, F.col("vec_id"))
    books = vector_codes.fit(laid, seeds)
    back = {r["own"]: (r["error"], r["vector"]) for r in vector_codes.decoded(vector_codes.encoded(laid, books), books).collect()}
    for r in df.collect():
        error, vector = back[r["vec_id"]]
        assert error == sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(r["embedding"], vector, strict=True))


def test_registered():
    assert {"op11_spelling", "op12_quality_rules", "op13_vector_codes"} <= set(queries.queries())
