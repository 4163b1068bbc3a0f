"""Distillation: pages to a digest under a budget, a row for each document.

A page is taken apart where it is, by array functions over its lines; pages meet once, as a row for each document, and what
follows stays in that row.  So lines and blocks are never dealt or sorted as rows.  Each step is linear in a document, but for
sorts.  Nothing leaves the JVM.

Arrays that a lambda looks up by place are bound first (`T.bound`): the optimizer would move their making into the lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BUDGET = 12_000
BLOCK_CHARACTERS, RUNNING_CHARACTERS = 700, 120
DATE_LINES, DATE_LINE_CHARACTERS = 14, 150
BLOCK = "struct<index:int,page:int,text:string>"


def _places(values: Column) -> Column:
    return F.transform(values, lambda _, i: i)


def _slices(values: Column, first: Column) -> Column:
    """values cut at the places in first, which begins with 0."""
    return T.bound(first, lambda at: F.transform(at, lambda a, k: F.slice(values, a + 1, F.coalesce(F.get(at, k + 1), F.size(values)) - a)))


# W01
# blanks but the line's end, and lines that can't be headings: a table's without capitals, others without two capitals in a row
_IN = T.BLANKS.replace("\n", "")
_TABLE = rf"[{_IN}]*+\|(?:[ -@\[-~]++|[^\n\p{{IsUppercase}}])*+(?=\n|\z)"
_BODY = rf"[{_IN}]*+(?![#|\n])(?:[ -@\[-~]++|[A-Z](?=[a-z])|[^\n\p{{IsUppercase}}]|\p{{IsUppercase}}[\P{{IsAlphabetic}}&&[^\n]]*+(?!\p{{IsUppercase}}))++(?=\n|\z)"
_PIECES = rf"\n*+(?:{_TABLE}(?:\n{_TABLE})*+|{_BODY}(?:\n{_BODY})*+|[^\n]++)|\n++"


def page_runs(text: Column) -> Column:
    """Array of (kind, joined) of a page: lines that belong together; blank lines and changes of kind part them.

    Most lines are taken by the pattern of pieces, many at a time; only lines that may be headings are looked at one by one.
    """
    # few texts have blanks before a line's end, and looking back from there is cheap
    clean = F.when(F.concat(text, F.lit("\n")).rlike(f"\n(?<=[{_IN}]\n)"), F.regexp_replace(text, rf"[{_IN}](?<![{_IN}][{_IN}])[{_IN}]*+(?=\n|\z)", "")).otherwise(text)
    pieces = F.filter(F.regexp_extract_all(clean, F.lit(_PIECES), F.lit(0)), lambda x: ~x.endswith("\n"))

    def piece(x: Column) -> Column:
        kind = lambda t: F.when(~F.contains(t, F.lit("\n")) & T.is_trimmed_heading(t), "heading").when(t.startswith("|"), "table").otherwise("body")
        return T.bound(F.ltrim(x, F.lit("\n")), lambda t: F.struct(x.startswith("\n\n").alias("apart"), T.bound(T.ltrim(t), kind).alias("kind"), t.alias("raw")))

    def islands(found: Column) -> Column:
        new = lambda x, i: (i == 0) | x["apart"] | (x["kind"] == "heading") | (x["kind"] != F.get(found, i - 1)["kind"])
        return _slices(found, F.array_compact(F.transform(found, lambda x, i: F.when(new(x, i), i))))

    def run(part: Column) -> Column:
        return F.struct(F.get(part, F.lit(0))["kind"].alias("kind"), F.array_join(F.transform(part, lambda x: x["raw"]), "\n").alias("joined"))

    return F.transform(T.bound(F.transform(pieces, piece), islands), run)


def runs(pages: DataFrame) -> DataFrame:
    """doc_id, page, kind (heading, table, body), joined: the runs of all pages."""
    return pages.select("doc_id", F.col("page_number").alias("page"), F.explode(page_runs(F.col("text"))).alias("r")).select("doc_id", "page", "r.*")


def page_blocks(text: Column, page: Column) -> Column:
    """Array of (page, kind, text) of a page: runs cut at sentences into blocks of 700 characters; headings whole.  A page without text has none."""

    def cut(r: Column) -> Column:
        block = lambda t: F.struct(page.alias("page"), r["kind"].alias("kind"), t.alias("text"))
        long = F.filter(F.transform(T.split_sentences(r["joined"], BLOCK_CHARACTERS), lambda c: block(T.rtrim(c))), lambda b: b["text"] != "")
        return F.when(r["kind"] == "heading", F.array(block(T.trim(r["joined"])))).when(F.char_length(r["joined"]) <= BLOCK_CHARACTERS, F.array(block(r["joined"]))).otherwise(long)

    return F.coalesce(F.flatten(F.transform(page_runs(text), cut)), F.array().cast("array<struct<page:int,kind:string,text:string>>"))


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, last_page, source_characters, found (array of page, kind, text: the blocks in order) of pages (doc_id, page_number, text)."""
    docs = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.max("page_number").alias("last_page"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("source_characters"),
        F.collect_list(F.struct(F.col("page_number").alias("page"), "text")).alias("pages"),
    )
    found = F.transform(F.array_sort("pages"), lambda p: page_blocks(p["text"], p["page"].cast("int")))
    return docs.select("doc_id", "n_pages", "last_page", "source_characters", F.flatten(found).alias("found"))


# A01
def without_running_lines(found: Column, n_pages: Column) -> Column:
    """Blocks without repeats of headers and footers: short shapes on max(pages div 2, 3) pages, in documents of 3 pages or more."""
    shape = lambda b, i: F.when(F.char_length(b["text"]) <= RUNNING_CHARACTERS, F.struct(T.digit_mask(T.trim(b["text"])).alias("shape"), i.alias("place"), b["page"].alias("page")))

    def by_shape(s: Column) -> Column:
        return _slices(s, F.array_compact(F.transform(s, lambda x, k: F.when((k == 0) | (x["shape"] != F.get(s, k - 1)["shape"]), k))))

    def repeats(group: Column) -> Column:
        """The places of a shape's blocks but the first, if it runs."""
        on_pages = F.size(F.filter(group, lambda x, k: (k == 0) | ~x["page"].eqNullSafe(F.get(group, k - 1)["page"])))
        return F.when(on_pages >= F.greatest(F.floor(n_pages / 2), F.lit(3)), F.transform(F.slice(group, 2, F.size(group)), lambda x: x["place"])).otherwise(F.array().cast("array<int>"))

    def left(blocks: Column) -> Column:
        groups = T.bound(F.array_sort(F.array_compact(F.transform(blocks, shape))), by_shape)
        return F.transform(F.array_except(_places(blocks), F.flatten(F.transform(groups, repeats))), lambda i: F.get(blocks, i))

    return F.when(n_pages >= 3, T.bound(found, left)).otherwise(found)


# W02, M01, M02
def scored(blocks: Column, last_page: Column) -> Column:
    """Array of (score, mandatory), one for each block."""

    def judged(b: Column, i: Column) -> Column:
        t = b["text"]
        heading, opening, closing = b["kind"] == "heading", i < 4, i + 3 >= F.size(blocks)
        one = lambda c, points: F.when(c, points).otherwise(0)

        def of(found: Column) -> Column:
            n = {k: found["cues"][k] for k in T.CUES} | {"date": found["date"]}
            size = found["size"]
            has = lambda k: n[k] > 0
            score = (
                n["date"] * 30 + n["date_role"] * 45 + n["party"] * 22 + n["type"] * 26 + n["subject"] * 24 + n["signature"] * 14
                + one(heading, 40) + one(b["kind"] == "table", 10) + one(T.has_identifier(t), 14) + one(T.has_money(t), 8) + one(opening, 60) + one(closing, 25)
                + one(b["page"] == 1, 12) + one(b["page"] == last_page, 8) + one(has("boilerplate") & ~heading, -70) + one(size < 25, -8) + one(size > 400, -6)
            )
            mandatory = ~has("boilerplate") & (
                opening | has("date_role") | (has("date") & (b["page"] == 1)) | (has("party") & has("type")) | has("subject")
                | (closing & has("signature")) | (heading & (has("type") | has("date")))
            )
            return F.struct(score.cast("int").alias("score"), F.coalesce(mandatory, F.lit(False)).alias("mandatory"))

        return T.bound(F.struct(T.cue_counts(t).alias("cues"), T.date_signals(t).alias("date"), F.char_length(t).alias("size")), of)

    return F.transform(blocks, judged)


# W03, W04
def candidates(blocks: Column, scores: Column) -> Column:
    """Array of (rank, index, cost) without blocks whose first 80 characters look like those of an earlier non-mandatory one."""

    def entry(b: Column, i: Column) -> Column:
        s = F.get(scores, i)
        look = F.when(~s["mandatory"], T.digit_mask(F.left(b["text"], F.lit(80))))
        return F.struct((~s["mandatory"]).alias("late"), (-s["score"]).alias("minus"), i.alias("index"), (F.char_length(b["text"]) + 2).alias("cost"), look.alias("look"))

    def wanted(ranked: Column) -> Column:
        looks = F.array_sort(F.array_compact(F.transform(ranked, lambda x, rank: F.when(x["look"].isNotNull(), F.struct(x["look"].alias("look"), rank.alias("rank"))))))
        repeats = T.bound(looks, lambda s: F.transform(F.filter(s, lambda x, k: (k > 0) & (x["look"] == F.get(s, k - 1)["look"])), lambda x: x["rank"]))
        return F.transform(F.array_except(_places(ranked), repeats), lambda rank: T.bound(F.get(ranked, rank), lambda x: F.struct(rank.alias("rank"), x["index"].alias("index"), x["cost"].alias("cost"))))

    return T.bound(F.array_sort(F.transform(blocks, entry)), wanted)


# W05
def filled(candidates: Column, budget: int) -> Column:
    """Indices that a greedy fill keeps; candidates: array of (rank, index, cost), in any order.

    A block that doesn't fit is skipped, not the end; the first is kept whatever its size.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        take = (s["used"] < budget) & ((s["used"] + x["cost"] <= budget) | (F.size(s["kept"]) == 0))
        return F.when(take, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x["index"])).alias("kept"))).otherwise(s)

    return F.aggregate(F.array_sort(candidates), start, step)["kept"]


# W07
def date_lines(kept: Column) -> Column:
    """The first 14 different lines with a date of the kept blocks (array of BLOCK in order)."""
    lines = F.flatten(F.transform(kept, lambda b: F.split(b["text"], "\n")))
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.char_length(x) > DATE_LINE_CHARACTERS, T.split_sentences(x, DATE_LINE_CHARACTERS)).otherwise(F.array(x))))
    dated = F.filter(F.transform(parts, T.trim), T.has_date)
    return F.slice(F.array_distinct(F.transform(dated, lambda x: F.left(x, F.lit(DATE_LINE_CHARACTERS)))), 1, DATE_LINES)


# W06
def emitted(kept: Column) -> Column:
    """The kept blocks' text with page and gap marks."""

    def one(b: Column, i: Column) -> Column:
        before = F.get(kept, i - 1)
        page = F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("[Page "), b["page"].cast("string"), F.lit("]\n"))
        mark = F.when((i == 0) | (before["page"] != b["page"]), page).when(before["index"] + 1 != b["index"], "[...]\n").otherwise("")
        return F.concat(mark, b["text"], F.lit("\n\n"))

    return F.array_join(F.transform(kept, one), "")


# A06
def heading_text(c: Column) -> Column:
    return F.regexp_replace(T.trim(F.regexp_replace(T.trim(c), "^#+", "")), "(?<!:):+$", "")


# A05
def sizes(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, source_characters."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("source_characters"))


# C01
def distill(pages: DataFrame, budget: int = BUDGET, passthrough: int = BUDGET) -> DataFrame:
    """A digest for each document of pages (doc_id, page_number, text).

    Columns: doc_id, text, segments, outline, date_lines, page_count, source_characters, digest_characters, ratio, compressed, block_count.
    Documents without any block have empty texts and arrays; pages without a doc_id belong to no document and are left out.
    Blocks are scored in documents over passthrough only, as the others keep all.
    """
    docs = documents(pages.filter(F.col("doc_id").isNotNull()))
    df = docs.select("doc_id", F.col("n_pages").alias("page_count"), "last_page", "source_characters", (F.col("source_characters") > passthrough).alias("compressed"), without_running_lines(F.col("found"), F.col("n_pages")).alias("blocks"))
    block = lambda b, i: F.struct(i.cast("int").alias("index"), b["page"].alias("page"), b["text"].alias("text"))

    def picked(blocks: Column) -> Column:
        wanted = T.bound(scored(blocks, F.col("last_page")), lambda scores: candidates(blocks, scores))
        return F.transform(F.array_sort(filled(wanted, budget)), lambda i: T.bound(F.get(blocks, i), lambda b: block(b, i)))

    df = df.withColumn("kept", F.when(F.col("compressed"), T.bound(F.col("blocks"), picked)).otherwise(F.transform("blocks", block)))
    headings = F.transform(F.filter("blocks", lambda b: b["kind"] == "heading"), lambda b: heading_text(b["text"]))
    df = df.withColumns({"outline": F.filter(headings, lambda h: h != ""), "block_count": F.size("blocks").cast("long")}).drop("blocks", "last_page")
    df = df.withColumn("date_lines", date_lines(F.col("kept")))
    sections = F.when(F.col("compressed") & (F.size("outline") > 0), F.concat(F.lit("SECTIONS: "), F.array_join("outline", " | "), F.lit("\n\n"))).otherwise("")
    dates = F.concat(F.lit("EVERY DATE IN THIS DOCUMENT, WITH ITS OWN WORDS:\n"), F.array_join(F.transform("date_lines", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))
    df = df.withColumn("text", T.rtrim(F.concat(sections, F.when(F.size("date_lines") > 1, dates).otherwise(""), T.bound(F.col("kept"), emitted))))
    ratio = F.when(F.col("source_characters") == 0, F.lit(1.0)).otherwise(F.char_length("text") / F.col("source_characters")).cast("float")
    return df.select(
        "doc_id", "text", F.transform("kept", lambda b: b["text"]).alias("segments"), "outline", "date_lines", "page_count", "source_characters",
        F.char_length("text").cast("long").alias("digest_characters"), ratio.alias("ratio"), "compressed", "block_count",
    )


# S13
def report(digests: DataFrame) -> DataFrame:
    """The distill-only report."""
    return digests.select("doc_id", F.col("page_count").alias("pages"), "source_characters", "digest_characters", "ratio", "compressed", "outline", F.col("text").alias("digest"))
