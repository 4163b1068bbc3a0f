"""License scan by ordered signature rules, in DataFrame functions only.

Texts become normal words.  One pattern of all keywords lets a few texts on to the rules; there each rule's keyword is
looked for first, and only then its regular expression, all of them literals of the query that Spark compiles once.  Of overlapping detections one that lies within another of higher
priority, or of equal priority and greater length, is suppressed.  Base phrases are reported in any case.  Places are
running sums over a text's matches and containment is told by running extremes of each priority, so that a text with many
matches costs a sort of them; only matches shuffle.

Edge cases: null texts count as empty and have no labels.  Repeated rows and rows without an id each get their own row.
An empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .license_rules import gate, rules

#: Fixed values of the contract: label of each base phrase.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What keeps words apart.
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Priority of the phrases.
BASE = 99


def normal(text: Column) -> Column:
    """' word word ': A-Z lower-cased, words apart by one blank; two blanks if there are no words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), _APART, " ")), F.lit(" "))


def _blanks(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


_BLANKS = "(char_length({0}) - char_length(replace({0}, ' ', '')))"


def matches(number: int, pattern: str) -> str:
    """SQL over `words`: array of a struct for each match of one pass over normal words.

    It holds the rule's number, the words before the match (from the match before) and those in it.  SQL text, as building
    hundreds of such columns one by one takes the driver longer than the query.
    """
    whole, gaps = f"regexp_extract_all(words, r'{pattern}', 0)", f"split(words, r'{pattern}', -1)"
    pairs = f"zip_with({whole}, {gaps}, (m, g) -> named_struct('rule', {number}, 'gap', {_BLANKS.format('g')} - 1, 'size', {_BLANKS.format('m')} + 1))"
    # a piece of the text follows the last match
    return f"CASE WHEN words RLIKE r'{pattern}' THEN filter({pairs}, x -> x.size IS NOT NULL) ELSE {NONE} END"


NONE = "CAST(array() AS array<struct<rule:int,gap:int,size:int>>)"


def _unsuppressed(each: DataFrame, priorities: list[int]) -> DataFrame:
    """each (row, start, end, priority) without what lies in a match of higher priority, or in a longer one of its own."""
    to_here = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    reach = {p: (F.max(F.when(F.col("priority") == p, F.col("end"))).over(to_here), F.max(F.when(F.col("priority") == p, F.col("end"))).over(before)) for p in priorities}
    each = each.select("*", *(c.alias(f"reach_{name}_{p}") for p, pair in reach.items() for name, c in zip(("here", "before"), pair, strict=True)))
    hidden = F.lit(False)
    for p in priorities:
        here, earlier = F.coalesce(f"reach_here_{p}", F.lit(-1)), F.coalesce(f"reach_before_{p}", F.lit(-1))
        hidden |= ((F.col("priority") < p) & (here >= F.col("end"))) | ((F.col("priority") == p) & ((here > F.col("end")) | (earlier >= F.col("end"))))
    return each.filter((F.col("priority") == BASE) | ~hidden)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of start, end, label, priority, sure of the phrases), detections (array of the rules', suppressed ones left out)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = [(label, phrase.split()[0], f"(?<= ){phrase}(?= )", BASE, 1.0) for phrase, label in PHRASES.items()] + rules()
    words = F.col("words")
    by_keyword: dict[str, list[int]] = {}
    for k, rule in enumerate(table):
        by_keyword.setdefault(rule[1], []).append(k)
    there = lambda keyword: " OR ".join(f"contains(words, ' {k}')" for k in keyword.split("/"))
    parts = [f"CASE WHEN {there(keyword)} THEN concat({', '.join(matches(k, table[k][2]) for k in own)}) ELSE {NONE} END" for keyword, own in by_keyword.items()]
    found = F.expr(f"CASE WHEN words RLIKE r'{gate(list(by_keyword))}' THEN concat({', '.join(parts)}) ELSE {NONE} END")
    first = df.select(F.col(id_col).cast("long").alias("doc_id"), normal(text).alias("words"))
    n_words = F.when(F.char_length(words) > 2, _blanks(words) - 1).otherwise(0).cast("long")
    first = stage(first.select("doc_id", F.monotonically_increasing_id().alias("row"), n_words.alias("n_words"), found.alias("all")), "matches")

    each = first.filter(F.size("all") > 0).select("row", F.posexplode("all").alias("pos", "m")).select("row", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rule").orderBy("pos")).cast("int")
    of_rule = lambda n: F.expr(f"element_at(array({', '.join(repr(r[n]) + 'D' * (n == 4) for r in table)}), rule + 1)")
    each = each.select("row", (end - F.col("size")).alias("start"), end.alias("end"), of_rule(0).alias("label"), of_rule(3).alias("priority"), of_rule(4).alias("sure"))
    kept = _unsuppressed(each, sorted({r[3] for r in table} - {BASE}))
    match, is_base = F.struct("start", "end", "label", "priority", "sure"), F.col("priority") == BASE
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.when(is_base, match))).alias("base"), F.array_sort(F.collect_list(F.when(~is_base, match))).alias("detections"))
    kind = "array<struct<start:int,end:int,label:string,priority:int,sure:double>>"
    without = first.filter(F.size("all") == 0).select("doc_id", "n_words", F.array().cast(kind).alias("base"), F.array().cast(kind).alias("detections"))
    some = first.filter(F.size("all") > 0).select("row", "doc_id", "n_words").join(by_row, "row").select("doc_id", "n_words", "base", "detections")
    return without.unionByName(some)
