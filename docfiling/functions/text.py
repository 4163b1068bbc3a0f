"""Column functions over document text: signals, cues, splitting, evidence normalisation, dates, sentences.

Each takes and returns Columns and stays in the JVM, but for evidence_text, which needs NFKC and full case-folding.
Lengths are code points, except where a name says bytes.  A null argument gives null unless stated otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"\p{IsWhite_Space}"

# The cue vocabularies.
TYPE_CUES = ["agreement", "amendment", "addendum", "assignment", "certificate", "complaint", "consent", "contract", "deed", "engagement letter", "invoice", "lease", "letter of intent", "memorandum", "motion", "notice of", "order form", "packing slip", "policy", "purchase order", "quote", "receipt", "release", "resolution", "settlement", "statement of work", "subpoena", "term sheet", "termination", "waiver", "work order"]
PARTY_CUES = ["by and between", "by and among", "between", "among", "this agreement is", "the parties", "attn:", "attention:", "to:", "from:", "client:", "customer:", "vendor:", "supplier:", "contractor:", "employer:", "employee:", "landlord:", "tenant:", "bill to:", "sold to:", "remit to:", "d/b/a", " inc", " llc", " l.l.c", " ltd", " llp", " plc", " corporation", " corp", " company", " gmbh", " co."]
DATE_ROLE_CUES = ["effective date", "effective as of", "dated as of", "made as of", "entered into as of", "commencement date", "start date", "end date", "expiration date", "termination date", "terminates on", "notice date", "date of this notice", "invoice date", "issue date", "issued on", "date of issuance", "filed on", "filing date", "executed on", "signed on", "date signed", "as of the", "amendment date", "amended as of"]
SUBJECT_CUES = ["re:", "subject:", "matter:", "project:", "regarding", "invoice no", "invoice #", "sow no", "sow #", "order no", "case no", "matter no", "reference:", "purpose", "scope of work", "services to be provided", "deliverables"]
SIGNATURE_CUES = ["in witness whereof", "signature", "signed:", "by: ", "name: ", "title: ", "printed name", "authorized representative", "/s/"]
BOILERPLATE_CUES = ["governing law", "severability", "entire agreement", "counterparts", "force majeure", "no waiver", "waiver of", "assignment and", "successors and assigns", "third-party beneficiaries", "third party beneficiaries", "headings", "survival", "notices shall be", "dispute resolution", "arbitration", "limitation of liability", "indemnification", "compliance with law", "further assurances", "relationship of the parties", "independent contractor status", "no partnership", "interpretation", "construction"]
CUES = {"type": TYPE_CUES, "party": PARTY_CUES, "date_role": DATE_ROLE_CUES, "subject": SUBJECT_CUES, "signature": SIGNATURE_CUES, "boilerplate": BOILERPLATE_CUES}
# Words that are no claim, abbreviations that end no sentence, months.
GENERIC_WORDS = ["a", "an", "and", "as", "at", "between", "by", "for", "from", "in", "of", "on", "the", "this", "to", "with", "it", "its", "their"]
ABBREVIATIONS = ["inc", "llc", "ltd", "corp", "co", "no", "mr", "mrs", "ms", "dr", "jr", "sr", "st", "u.s"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def words_of(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


#: The characters of SPACE, for functions that take them as they are.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def n_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    # translate makes a string of each character: only for texts that need it
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


# X02
def digit_mask(c: Column) -> Column:
    """Runs of ASCII digits as one #, the rest lower-cased."""
    return F.lower(F.regexp_replace(c, "[0-9]+", "#"))


# X03, X04
def cue_count(c: Column, cues: list[str]) -> Column:
    """How many of the cues stand in the text, each once; ASCII case apart.

    A loop over the cues: written out as a sum of 140 terms, the generated method is too large for the JVM's compiler.
    """
    return F.when(c.isNotNull(), bound(ascii_lower(c), lambda low: F.size(F.filter(words_of(cues), lambda cue: F.contains(low, cue)))))


def _some(characters: Iterable[str]) -> str:
    return f"[{''.join(map(re.escape, sorted(characters)))}]"


def _longest(words: list[str]) -> str:
    """A pattern of the longest of words that stands at a place: a tree whose branches are halved, so that few are tried."""
    rests: dict[str, list[str]] = {}
    for w in sorted(words):
        rests.setdefault(w[0], []).append(w[1:])

    def branch(first: str) -> str:
        longer = _longest([w for w in rests[first] if w]) if any(rests[first]) else ""
        return re.escape(first) + (f"(?:{longer})?" if longer and "" in rests[first] else longer)

    def halves(firsts: list[str]) -> str:
        if len(firsts) < 4:
            return "|".join(map(branch, firsts))
        one, other = firsts[: len(firsts) // 2], firsts[len(firsts) // 2 :]
        return f"(?={_some(one)})(?:{halves(one)})|{halves(other)}"

    return branch(*rests) if len(rests) == 1 else f"(?:{halves(list(rests))})"


_ALL_CUES = sorted({cue for cues in CUES.values() for cue in cues})
#: Where a cue may begin: most places fail by their first two characters.
_CUE = f"(?={_some({x[0] for x in _ALL_CUES})}{_some({x[1] for x in _ALL_CUES})})(?=({_longest(_ALL_CUES)}))"
#: Cues that other cues begin with, by the longer one.
_SHORTER = {cue: [x for x in _ALL_CUES if cue.startswith(x)] for cue in _ALL_CUES if sum(map(cue.startswith, _ALL_CUES)) > 1}


def cue_counts(c: Column) -> Column:
    """cue_count for each of CUES, as a struct: the text is read once, for the longest cue at each place."""
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(c), F.lit(_CUE), F.lit(1)))
    shorter = F.create_map(*(x for cue, begun in _SHORTER.items() for x in (F.lit(cue), words_of(begun))))
    whole = lambda hits: F.when(F.exists(hits, lambda x: x.isin(list(_SHORTER))), F.array_distinct(F.flatten(F.transform(hits, lambda x: F.coalesce(F.try_element_at(shorter, x), F.array(x)))))).otherwise(hits)
    n_of = lambda hits, cues: F.size(F.filter(hits, lambda x: x.isin(cues)))
    counted = lambda hits: F.struct(*(n_of(hits, cues).alias(name) for name, cues in CUES.items()))
    none = F.struct(*(F.lit(0).alias(name) for name in CUES))
    return F.when(c.isNotNull(), bound(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(bound(whole(hits), counted))))


# X05
def has_identifier(c: Column) -> Column:
    """Whether a word, cut to its ASCII letters' and digits' ends, has two of each and 24 bytes at most."""

    def fits(w: Column) -> Column:
        # the ends hold no letters or digits, and matter for long words only
        cut = F.regexp_replace(w, "^[^0-9A-Za-z]+|(?<![^0-9A-Za-z])[^0-9A-Za-z]+$", "")
        return w.rlike("[A-Za-z][^A-Za-z]*+[A-Za-z]") & w.rlike("[0-9][^0-9]*+[0-9]") & ((F.octet_length(w) <= 24) | (F.octet_length(cut) <= 24))

    # only words with a digit and a letter are cut up, each met once from its first character on; few texts have any
    mixed = F.regexp_extract_all(c, F.lit(f"(?<![^{SPACE}])(?=[^{SPACE}A-Za-z]*+[A-Za-z])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"), F.lit(0))
    beside = c.rlike(f"[A-Za-z](?![A-Za-z ])[^A-Za-z0-9{SPACE}]*+[0-9]|[0-9](?![0-9 ])[^A-Za-z0-9{SPACE}]*+[A-Za-z]")
    return beside & F.exists(mixed, fits)


# X06
def has_money(c: Column) -> Column:
    """A dollar sign or a byte 0xA3 of the UTF-8 form with a digit within three bytes, or USD or EUR before a blank.

    The byte ends the pound sign, but other characters too, and these count.
    """
    as_bytes = F.when(is_ascii(c), c).otherwise(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))
    sign = (F.contains(c, F.lit("$")) | ~is_ascii(c)) & as_bytes.rlike(r"[$\xA3][\s\S]{0,2}[0-9]")
    return sign | bound(F.lower(c), lambda low: F.contains(low, F.lit("usd ")) | F.contains(low, F.lit("eur ")))


# X07
def split_sentences(c: Column, most: int) -> Column:
    """The text in chunks of whole sentences that have at most `most` characters; nothing is lost but a blank last chunk.

    A text that fits is one chunk.  Sentences end with . ! ? ; or a line break.  What follows the last end joins the last
    chunk, and only that chunk is cut by length, while it has more than twice `most` characters.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"[^.!?;\n]*[.!?;\n]|[^.!?;\n]+"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        full = (s["now"] != "") & x.rlike(r"[.!?;\n]\z") & (F.char_length(s["now"]) + F.char_length(x) > most)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], x).alias("now")))

    def last(now: Column) -> Column:
        """The last chunk, its heads cut off while it is too long; nothing if it is blank."""
        peels = F.greatest(F.ceil((F.char_length(now) - 2 * most) / most).cast("int"), F.lit(0))
        heads = F.transform(F.sequence(F.lit(0), peels - 1), lambda k: F.substring(now, k * most + 1, F.lit(most)))
        rest = F.substring(now, peels * most + 1, F.char_length(now))
        return F.concat(F.when(peels > 0, heads).otherwise(none), F.when(trim(rest) != "", F.array(rest)).otherwise(none))

    def whole(s: Column) -> Column:
        return F.concat(s["done"], bound(s["now"], last))

    def cut(text: Column) -> Column:
        out = bound(F.aggregate(pieces, start, step), whole)
        return bound(out, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))

    return F.when(F.char_length(c) <= most, F.array(c)).otherwise(cut(c))


# P05
def is_heading(c: Column) -> Column:
    """A short line that starts with # or is nearly all capitals and no long sentence."""
    return bound(trim(c), is_trimmed_heading)


def is_trimmed_heading(t: Column) -> Column:
    """is_heading of a line without blanks at its ends."""
    # what isn't counted is taken out by runs; all upper-case characters are alphabetic
    letters = F.char_length(F.regexp_replace(t, r"\P{IsAlphabetic}+", ""))
    capitals = F.char_length(F.regexp_replace(t, r"\P{IsUppercase}+", ""))
    loud = bound(letters, lambda n: (n >= 3) & (capitals * 10 >= n * 8))
    # where four of five letters are capitals, two of them follow each other: most lines need no counting
    two = t.rlike(r"\p{IsUppercase}\P{IsAlphabetic}*+\p{IsUppercase}")
    return (t != "") & (F.char_length(t) <= 90) & (t.startswith("#") | (two & loud & ~(t.endswith(".") & (n_tokens(t) > 6))))


# D01
# each looks back when it has met a digit, not at each character
_YEAR = r"[12](?:(?<=1)9|(?<=2)[01])(?<![0-9]..)[0-9]{2}(?![0-9])"
_SHORT = r"[0-9](?<![0-9].)[0-9]?[/-][0-9]{1,2}[/-][0-9]{2}(?![0-9])"


# a short date uses its parts up; what it leaves behind must not look like another
_SHORT_DATE = f"{_SHORT}(?![/-][0-9]{{1,2}}(?:[/-]|[0-9]))(?:[/-][0-9/-]*)?"


def _may_be_short(c: Column) -> Column:
    return F.contains(c, F.lit("/")) | F.contains(c, F.lit("-"))


def date_signals(c: Column) -> Column:
    """Years from 1900 to 2199 and short dates such as 3/14/26 in the text."""
    return F.regexp_count(c, F.lit(_YEAR)) + F.when(_may_be_short(c), F.regexp_count(c, F.lit(_SHORT_DATE))).otherwise(0)


def has_date(c: Column) -> Column:
    """Whether there are date signals."""
    return c.rlike(_YEAR) | (_may_be_short(c) & c.rlike(_SHORT_DATE))


# D02
def is_iso_date(c: Column) -> Column:
    """A real day from the years 1000 to 2999, as dddd-dd-dd."""
    return F.coalesce(c.rlike(r"\A[12][0-9]{3}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


# D04
def ordinal(day: Column) -> Column:
    """th, st, nd or rd for a day's number."""
    return F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")


# D03
def date_parts(iso: Column) -> Column:
    """y, m, d, mu and du (without leading noughts), nth and months (the month's names) of an ISO date, as a struct to be bound."""
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    month = F.try_element_at(words_of(MONTHS), F.greatest(m.try_cast("int"), F.lit(1)))
    spelt = lambda w: F.array_distinct(F.array_compact(F.array(w, F.substring(w, 1, 3), F.when(F.char_length(w) > 4, F.substring(w, 1, 4)))))
    dotted = F.flatten(F.transform(bound(month, spelt), lambda w: F.array(w, F.concat(w, F.lit(".")))))
    mu, du = F.ltrim(m, F.lit("0")), F.ltrim(d, F.lit("0"))
    nth = F.concat(du, bound(d.try_cast("int"), ordinal))
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), mu.alias("mu"), du.alias("du"), nth.alias("nth"), dotted.alias("months"))


def dates_by_name(p: Column, w: Column) -> Column:
    """The renderings of a date's parts with the name w of its month."""
    y, du, nth, j, s = p["y"], p["du"], p["nth"], F.concat, F.lit
    return F.array(
        j(w, s(" "), du, s(", "), y), j(w, s(" "), du, s(" "), y), j(w, s(" "), nth, s(", "), y), j(w, s("-"), du, s("-"), y), j(du, s(" "), w, s(" "), y), j(du, s("-"), w, s("-"), y),
        j(nth, s(" day of "), w, s(", "), y), j(nth, s(" day of "), w, s(" "), y),
    )


def dates_by_number(iso: Column, p: Column) -> Column:
    y, m, d, mu, du, j, s = p["y"], p["m"], p["d"], p["mu"], p["du"], F.concat, F.lit
    return F.array(
        iso, j(y, s("/"), m, s("/"), d), j(m, s("/"), d, s("/"), y), j(mu, s("/"), du, s("/"), y), j(m, s("-"), d, s("-"), y), j(mu, s("-"), du, s("-"), y), j(du, s("/"), mu, s("/"), y)
    )


def date_renderings(iso: Column) -> Column:
    """The ways in which people write an ISO date, in lower case."""

    def of(p: Column) -> Column:
        by_name = F.flatten(F.transform(p["months"], lambda w: dates_by_name(p, w)))
        return F.concat(dates_by_number(iso, p), F.coalesce(by_name, F.array().cast("array<string>")))

    return bound(date_parts(iso), of)


# X01
_SINGLE, _DOUBLE, _DASH = "‘’‚‛′", "“”„‟″", "‐‑‒–—―−"


def _fold(v: str | None) -> str | None:
    return None if v is None else unicodedata.normalize("NFKC", v).casefold()


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(_fold)


@F.pandas_udf(ArrayType(StringType()))
def _folded_all(c: pd.Series) -> pd.Series:
    return c.map(lambda values: None if values is None else [_fold(v) for v in values])


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, _SINGLE + _DOUBLE + _DASH, "'" * 5 + '"' * 5 + "-" * 7), f"{SPACE}+", " "))


def evidence_text(c: Column) -> Column:
    """NFKC, full case-fold, plain quotes and dashes, single blanks, none at the ends.

    It and evidence_texts alone leave the JVM, as there is no built-in for NFKC.  Plain ASCII is folded without it: for such
    a text Python gets a null.
    """
    return _plain(F.coalesce(F.when(is_ascii(c), F.lower(c)), _folded(F.when(~is_ascii(c), c))))


def evidence_texts(c: Column) -> Column:
    """evidence_text of each element of an array, which should be a column as it is used several times."""
    plain = is_ascii(F.array_join(c, ""))
    # ASCII has neither quotes nor dashes to be made plain, and single blanks stay as they are
    single = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\t-\r][\t-\r ]*+| [\t-\r ]++", " "))
    return F.when(plain, F.transform(c, single)).otherwise(F.transform(_folded_all(F.when(~plain, c)), _plain))


# X15
def first_sentence(c: Column) -> Column:
    """Up to the first . ! ? that ends neither the text nor an abbreviation nor a single letter; trimmed."""

    def cut(t: Column) -> Column:
        # what follows the last end is a piece of its own, so that the pattern reads the text once
        ends = F.filter(F.regexp_extract_all(t, F.lit(r"[^.!?]*[.!?]|[^.!?]+"), F.lit(0)), lambda x: x.rlike(r"[.!?]\z"))
        start = F.struct(F.lit(False).alias("found"), F.lit("").alias("text"), F.lit("").alias("word"), F.char_length(t).alias("size"))

        def step(s: Column, x: Column) -> Column:
            # the word that ends here may have begun in an earlier piece
            word = F.when(x.rlike(SPACE), F.regexp_replace(x, f"(?s)\\A.*{SPACE}", "")).otherwise(F.concat(s["word"], x))

            def judged(w: Column) -> Column:
                before, text = F.left(w, F.char_length(w) - 1), F.concat(s["text"], x)
                short = ascii_lower(before).isin(ABBREVIATIONS) | (F.regexp_count(before, F.lit("[A-Za-z]")) == 1)
                return F.struct((~short & (F.char_length(text) < s["size"])).alias("found"), text.alias("text"), w.alias("word"), s["size"].alias("size"))

            return F.when(s["found"], s).otherwise(bound(word, judged))

        return bound(F.aggregate(ends, start, step), lambda s: F.when(s["found"], s["text"]).otherwise(t))

    return bound(trim(c), cut)


# X16
MOST_WORDS = 42


def capped_sentence(c: Column) -> tuple[Column, Column]:
    """The sentence with at most 42 words, and whether it had more."""
    over = n_tokens(c) > MOST_WORDS
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(tokens(c), 1, MOST_WORDS), " "), "[,;.!?]+$", ""), F.lit("."))
    return F.when(over, cut).otherwise(c), over


# X17
def is_usable_sentence(c: Column) -> Column:
    n = lambda t: bound(n_tokens(t), lambda k: k.between(6, MOST_WORDS))
    return bound(trim(c), lambda t: t.rlike(r"[.!?]\z") & n(t) & t.rlike(r"\A\P{IsAlphabetic}*+(?=\p{IsAlphabetic})\p{IsUppercase}"))
