"""Column functions on literal cases and on random text."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfiling.functions import names as N
from docfiling.functions import replies as R
from docfiling.functions import text as T


def values(spark, rows, *columns, schema="v string"):
    return [tuple(r) for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(*columns).collect()]


def one(spark, rows, f, schema="v string"):
    return [r[0] for r in values(spark, rows, f(F.col("v")), schema=schema)]


def test_date_signals(spark):
    cases = {"April 1, 2026": 1, "2026-04-01": 1, "3/14/2026": 1, "the 1st day of April, 2026": 1, "3/14/26": 1, "no date": 0, "1899 and 2200": 0, "May 5 2020 and 2021": 2, "12-31-99, 20261": 1, "": 0}
    assert one(spark, list(cases), T.date_signals) == list(cases.values())


def test_iso_and_ordinals(spark):
    cases = {"2024-02-29": True, "2023-02-29": False, "0999-01-01": False, "3000-01-01": False, "2024-1-01": False, " 2024-01-01": False, "2024-13-01": False, "x": False}
    assert one(spark, list(cases), T.is_iso_date) == list(cases.values())
    assert one(spark, [(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 22, 23, 31)], T.ordinal, "v int") == "st nd rd th th th th st nd rd st".split()


def test_renderings(spark):
    (found,) = one(spark, ["2025-09-05"], T.date_renderings)
    for x in ("2025-09-05", "9/5/2025", "5/9/2025", "september 5, 2025", "sept. 5th, 2025", "sep-5-2025", "5th day of september, 2025", "5 sept 2025"):
        assert x in found
    assert one(spark, ["2025-05-01"], lambda v: F.size(T.date_renderings(v))) == [7 + 2 * 8]


def test_evidence(spark):
    assert one(spark, ["  “Quote”\u00a0—  ‘x’\n STRASSE ß ﬁ ", None, ""], T.evidence_text) == ["\"quote\" - 'x' strasse ss fi", None, ""]


def test_identifier_and_money(spark):
    assert one(spark, ["see (INV-2048).", "A1B", "abcdefghijkl1234567890123", "AB12"], T.has_identifier) == [True, False, False, True]
    assert one(spark, ["$ 5", "£12", "$abc5", "pay USD 5", "eur x", "usd"], T.has_money) == [True, True, False, True, True, False]


def test_sentences(spark):
    assert one(spark, ["Acme Inc. filed it. Then more.", "Hi! There", "J. Smith won. Yes", "No end", "One."], T.first_sentence) == ["Acme Inc. filed it.", "Hi!", "J. Smith won.", "No end", "One."]
    assert one(spark, ["The fee covers all of it.", "the fee covers all of it.", "Too short.", "The fee covers all of it"], T.is_usable_sentence) == [True, False, False, False]
    long = " ".join(f"w{k}," for k in range(50))
    assert values(spark, [long], *T.capped_sentence(F.col("v"))) == [(" ".join(f"w{k}," for k in range(42))[:-1] + ".", True)]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?;\n\u00e9", max_size=120), min_size=200, max_size=200))
def test_split_is_lossless(spark, texts):
    from test_distill import split

    got = values(spark, [(t,) for t in texts], F.col("v"), T.split_sentences(F.col("v"), 20))
    assert [(v, list(p)) for v, p in got] == [(t, split(t, 20)) for t in texts]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=300, max_size=300))
def test_evidence_is_idempotent(spark, texts):
    texts = [t for t in texts if not re.search("[\ud800-\udfff]", t)]
    for t, n in zip(texts, one(spark, [(t,) for t in texts], T.evidence_text), strict=True):
        assert "  " not in n and n == n.strip(" ")
        if t.isascii():
            assert n == " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def test_segments(spark):
    cases = {" a  b ": "a b", "x<>:\"/\\|?*y": "xy", "end. . ": "end", "...": None, "": None, "con": "_con", "LPT1.txt": "_LPT1.txt", "COM0": "COM0", "a\u202eb\u0007c": "abc", "a\tb": "a b", "com10": "com10"}
    assert one(spark, list(cases), N.segment) == list(cases.values())


def test_names(spark):
    fit = lambda d, k, p, r, s="", e="pdf": values(spark, [(d, k, p, r, s, e)], N.fitted(*map(F.col, "dkprse")), schema="d string, k string, p array<string>, r string, s string, e string")[0][0]
    assert fit("2024-01-02", "Agreement", ["A", "B"], "between") == "2024-01-02 Agreement between A and B.pdf"
    assert fit("", "Notice", ["A", "B"], "for") == "Notice for A.pdf"
    assert fit("", "Notice", ["A"], "none", " (2)", "") == "Notice - A (2)"
    assert fit("", "Agreement", ["A" * 60, "B" * 60], "between") == f"Agreement with {'A' * 60}.pdf"
    assert fit("", "Agreement", ["A" * 120], "with") == "Agreement.pdf"
    assert fit("", "T" * 200, [], "none") == "T" * 116 + ".pdf"
    assert one(spark, ["Name. . ", "A.PDF"], N.name_key) == ["name", "a.pdf"]
    assert one(spark, ["C:/In/X//", "C:\\a\\"], N.path_key) == ["c:\\in\\x", "c:\\a"]
    assert one(spark, [".PDF ", "tar.gz", "x" * 20], N.extension) == ["pdf", "targz", "x" * 16]
    assert one(spark, ["a.pdf.PDF", "a.pdfx", "pdf"], lambda v: N.without_extension(v, F.lit("pdf"))) == ["a", "a.pdfx", "pdf"]
    assert one(spark, ["ok.pdf", "a/b", "..", "x.", " ", "a\u0001", "n" * 600, "a?b"], N.is_leaf_name) == [True] + [False] * 7
    assert values(spark, [("a.PDF", "b.pdf"), ("a.txt", "b.pdf"), ("a", "b")], N.keeps_extension(F.col("a"), F.col("b")), schema="a string, b string") == [(True,), (False,), (False,)]


def test_replies(spark):
    body = '{"document_type": "Invoice", "document_date": "2024-02-30", "date_role": "invoice", "parties": ["a", "b", "c", "d"], "confidence": 0.9}'
    rows = [(1, body), (2, f"```json\n{body}\n```"), (3, f"Sure: {body} done"), (4, "no object"), (5, '{"confidence": 1.5}'), (6, '{"date_role": "due"}'), (7, "{}"), (8, '{"a": '), (9, None)]
    good, bad = R.decode(spark.createDataFrame(rows, "doc_id long, reply string"))
    found = {r["doc_id"]: r for r in good.collect()}
    assert sorted(found) == [1, 2, 3, 7] and {r["doc_id"] for r in bad.collect()} == {4, 5, 6, 8, 9}
    assert found[1]["document_date"] is None and found[1]["date_role"] is None and found[1]["parties"] == ["a", "b", "c"] and found[7]["party_relation"] == "none"
    chats = ['{"choices":[{"finish_reason":"stop","message":{"content":"hi"}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"x","text":"b"},{"type":"text","text":"c"}]}}]}', '{"choices":[{"finish_reason":"length","message":{"content":"hi"}}]}']
    assert one(spark, chats, R.chat_content) == ["hi", "ac", None]


def test_bytes_and_long_words(spark):
    """Money by bytes, the end of a first sentence after a word of any length, and evidence forms of arrays."""
    long = "ab" * 24
    rows = [("ã1", True), ("$é€1", False), ("£1", True), ("$12", True), ("$é1", True), ("$éa1", False), ("x 1", False), ("usd 5", True), ("Eur", False), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [(r["t"], r["got"]) for r in df.select("t", T.has_money(F.col("t")).alias("got")).collect()] == rows
    for t, want in rows[:-1]:
        raw = t.encode()
        assert want == (any(b in b"$\xa3" and any(48 <= x < 58 for x in raw[k + 1 : k + 4]) for k, b in enumerate(raw)) or "usd " in t.lower() or "eur " in t.lower())
    said = [(f"See {long}. Then more words follow here.", f"See {long}."), ("Mr. Smith came. He left.", "Mr. Smith came."), ("From the U.S. it came. So it is.", "From the U.S. it came."), (f"A {'x' * 500}. b", f"A {'x' * 500}."), ("One. ", "One."), ("a\u00a0b. c", "a\u00a0b. c"), ("", "")]
    got = spark.createDataFrame(said, "t string, want string").select("t", T.first_sentence(F.col("t")).alias("s"), "want").collect()
    assert [(r["t"], r["s"]) for r in got] == said
    forms = spark.createDataFrame([(["A  b", "C–d"],), (["Straße", None, " ﬁn "],), ([],), (None,), (["X Y ", "z"],)], "a array<string>").select(T.evidence_texts(F.col("a")).alias("n"), F.transform("a", lambda x: x).alias("a")).collect()
    assert [r["n"] for r in forms] == [["a b", "c-d"], ["strasse", None, "fin"], [], None, ["x y", "z"]]
