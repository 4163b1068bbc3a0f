"""Names without clashes against naming one document after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docfiling.operators import naming

SCHEMA = "doc_id long, folder string, extension string, document_type string, document_date string, parties array<string>, party_relation string"


def brute(spark, rows, there):
    """Each document in order of its id gets the first name that nobody has; names are those of the library's own expression."""
    df = naming.parts(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"row long, {SCHEMA}"))
    most = len(rows) + len(there) + 2
    names = {r["row"]: r["names"] for r in df.select("row", F.transform(F.sequence(F.lit(1), F.lit(most)), naming.name_with).alias("names")).collect()}
    key = lambda n: n.rstrip(" .").lower()
    taken = {(f, key(n)) for f, n in there if n is not None}
    out = []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, repr(rows[k]))):
        i, folder = rows[k][:2]
        n = next(n for n in range(1, most + 1) if (folder, key(names[k][n - 1])) not in taken)
        taken.add((folder, key(names[k][n - 1])))
        out.append((str(i), str(folder), names[k][n - 1], n))
    return sorted(out)


def named(spark, rows, there):
    got = naming.compose_names(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(there, "folder string, name string"))
    return sorted((str(r["doc_id"]), str(r["folder"]), r["filename"], r["collision_index"]) for r in got.collect())


def doc(i, folder="in", kind="Invoice", date="2024-01-02", parties=(), relation="none", ext="pdf"):
    return (i, folder, ext, kind, date, list(parties), relation)


LONG = "A very long kind of document that goes on and on so that its name has to be cut to fit into the room that there is for names here"
CASES = {
    "one name": ([doc(i) for i in range(40)], [("in", "2024-01-02 Invoice.pdf"), ("in", "2024-01-02 INVOICE (2).PDF"), ("in", "2024-01-02 Invoice (9).pdf"), ("in", "2024-01-02 Invoice (10).pdf"), ("in", "2024-01-02 Invoice (44).pdf"), ("out", "2024-01-02 Invoice (3).pdf")]),
    "nulls": ([doc(None), doc(None, None), doc(1, None), doc(2, None), doc(None), doc(3, None, None, None), (4, None, None, None, None, None, None)], [(None, "2024-01-02 Invoice.pdf"), ("in", None)]),
    "an id in two folders": ([doc(1, "a"), doc(1, "b"), doc(1, "b"), doc(2, "b")], [("b", "2024-01-02 Invoice.pdf")]),
    "second names that are first names": ([doc(1, kind="Deed (2)"), doc(2, kind="Deed"), doc(3, kind="Deed"), doc(4, kind="DEED"), doc(5, kind="Deed (2)"), doc(6, kind="Deed (1)"), doc(7, kind="Deed (1)")], [("in", "2024-01-02 Deed (3).pdf")]),
    "names with another's extension": ([doc(1, kind="note.pdf", ext=""), doc(2, kind="note"), doc(3, kind="note.pdf", ext=""), doc(4, kind="note.pdf", ext=""), doc(5, kind="note")], [("in", "2024-01-02 note.pdf (2)")]),
    "cut names": ([doc(i, kind=LONG + f" {i % 3}", parties=["Alpha", "Beta"], relation="between") for i in range(30)], []),
    "parties that go": ([doc(i, kind="K" * 50, parties=["P" * 40 + str(i % 2), "Q" * 20], relation="between") for i in range(24)], []),
    "none": ([], []),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rows, there = CASES[case]
    assert named(spark, rows, there) == brute(spark, rows, there)


def test_any_batch(spark):
    rng = random.Random(11)
    kinds = ["Deed", "Deed (2)", "Deed (2) (3)", "deed", "Lease", LONG, LONG + " x", "Lease.", "Lease.pdf"]
    rows = [doc(rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), rng.choice(kinds), rng.choice(["2024-01-02", None]), ext=rng.choice(["pdf", "pdf", ""])) for _ in range(160)]
    there = [(rng.choice(["a", "b", None]), f"{rng.choice(['2024-01-02 ', ''])}{rng.choice(['Deed', 'deed', 'Lease'])}{rng.choice(['', ' (2)', ' (3)', ' (5)', ' (12)', ' (1)'])}{rng.choice(['.pdf', ''])}") for _ in range(30)]
    assert named(spark, rows, there) == brute(spark, rows, there)


def test_many_equal_names(spark):
    """A million documents of one name, beside ten thousand taken suffixes: ranks, no round for each."""
    n = 1_000_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("in").alias("folder"), F.lit("pdf").alias("extension"), F.lit("Invoice").alias("document_type"), F.lit("2024-01-02").alias("document_date"), F.array().cast("array<string>").alias("parties"), F.lit("none").alias("party_relation"))
    there = spark.range(10_000).select(F.lit("in").alias("folder"), F.concat(F.lit("2024-01-02 Invoice ("), (F.col("id") * 3 + 2).cast("string"), F.lit(").pdf")).alias("name"))
    began = time.time()
    got = naming.compose_names(docs, there)
    r = got.agg(F.count("*").alias("n"), F.count_distinct("collision_index").alias("d"), F.max("collision_index").alias("most"), F.count_if((F.col("collision_index") % 3 == 2) & (F.col("collision_index") < 30_000)).alias("wrong")).first()
    assert (r["n"], r["d"], r["most"], r["wrong"]) == (n, n, n + 10_000, 0)
    assert time.time() - began < 120


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), k, rng.randint(0, 3)) for k in range(3000)]
    got = naming.running(spark.createDataFrame(rows, "key string, k long, x long"), "key", [F.col("k")], F.col("x"), "sum").collect()
    sums, want = {}, {}
    for key, k, x in rows:
        want[k] = sums[key] = sums.get(key, 0) + x
    assert {r["k"]: r["sum"] for r in got} == want
