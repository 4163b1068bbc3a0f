"""Column functions for file names, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound, trim

MOST_CHARACTERS, LEAST_STEM = 120, 4
_BIDI = "؜‎‏‪-‮⁦-⁩"
_HOSTILE = '<>:"/\\\\|?*'


# X08
def segment(c: Column) -> Column:
    """Text that may stand in a file name: single blanks, no hostile characters, no reserved name; null if nothing is left."""
    # white space counts even where control characters stand beside it, so it is folded after they have gone
    bare = F.regexp_replace(c, f"[\\p{{Cc}}{_BIDI}{_HOSTILE}](?<![{SPACE}])", "")
    cut = F.regexp_replace(trim(F.regexp_replace(bare, f"{SPACE}+", " ")), "(?<![ .])[ .]+$", "")

    def named(t: Column) -> Column:
        reserved = F.upper(F.trim(F.substring_index(t, ".", 1))).rlike(r"\A(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z")
        return F.when(t.rlike(r"\A[ .]*\z"), F.lit(None)).when(reserved, F.concat(F.lit("_"), t)).otherwise(t)

    return bound(cut, named)  # each step once, however often the next uses it


# X09
def extension(c: Column) -> Column:
    """Lower-case ASCII letters and digits of an extension, 16 at most."""
    return F.left(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(16))


# X10
def without_extension(c: Column, ext: Column) -> Column:
    """The text without any number of .ext at its end, in any case."""
    return F.when(ext == "", c).otherwise(F.regexp_replace(c, F.concat(F.lit("(?i)(?:\\."), ext, F.lit(")+\\z")), F.lit("")))


# X11
def party_clause(parties: Column, relation: Column) -> Column:
    """'between A and B' for two, the relation and the first party for others, '- A' without a relation; null without parties."""
    first, second = F.get(parties, F.lit(0)), F.get(parties, F.lit(1))
    names = F.when((relation == "between") & second.isNotNull(), F.concat(first, F.lit(" and "), second)).otherwise(first)
    return F.when(F.size(parties) > 0, F.concat(F.when(relation == "none", "-").otherwise(relation), F.lit(" "), names))


def _stem(date: Column, kind: Column, clause: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(date, F.lit("")), kind, clause))


def whole_stem(date: Column, kind: Column, parties: Column, relation: Column) -> Column:
    """A name without its suffix and extension, and with all its parts, whatever its length."""
    return _stem(date, kind, party_clause(parties, relation))


def room_beside(tail: Column) -> Column:
    return F.greatest(F.lit(MOST_CHARACTERS) - F.char_length(tail), F.lit(LEAST_STEM))


# X12
def fitted(date: Column, kind: Column, parties: Column, relation: Column, suffix: Column, ext: Column) -> Column:
    """The file name in 120 characters: parties go first, then the end of the rest."""
    tail = F.concat(suffix, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    room = room_beside(tail)
    one = F.slice(parties, 1, 1)
    full = whole_stem(date, kind, parties, relation)
    fewer = _stem(date, kind, party_clause(one, F.when(relation == "between", "with").otherwise(relation)))
    bare = _stem(date, kind, F.lit(None).cast("string"))
    cut = F.regexp_replace(F.left(bare, room), "[ .]+$", "")
    pick = F.when(F.char_length(full) <= room, full).when(F.char_length(fewer) <= room, fewer).when(F.char_length(bare) <= room, bare).otherwise(F.coalesce(F.nullif(cut, F.lit("")), F.lit("Document")))
    return F.concat(pick, tail)


# X13
def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<![ .])[ .]+$", ""))


def path_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(c, "/", "\\"), r"(?<!\\)\\+$", ""))


# X14
def document_key(relative_path: Column, size: Column, modified: Column) -> Column:
    """SHA-256 of the path in lower case and with slashes, the size and the time, joined by |."""
    return F.sha2(F.concat_ws("|", F.lower(F.translate(relative_path, "\\", "/")), size.cast("string"), modified.cast("string")), 256)


# X22
def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_extension(path: Column) -> Column:
    """Lower-case extension of the leaf; empty if it has none."""
    return F.lower(F.regexp_extract(leaf(path), r"[^.]\.([^.]+)\z", 1))


def relative_path(path: Column, root: str) -> Column:
    return F.translate(F.regexp_replace(path, "^" + root.rstrip("/\\").replace("\\", "\\\\").replace(".", "\\.") + r"[/\\]+", ""), "\\", "/")


# P10
def is_leaf_name(c: Column) -> Column:
    """A name that a folder can hold: 512 bytes, one component, no hostile, control or bidi character, no dot at the end."""
    t = trim(c)
    return (t != "") & (F.octet_length(t) <= 512) & ~t.rlike(f"[{_HOSTILE}\\p{{Cc}}{_BIDI}]") & ~t.isin(".", "..") & ~t.endswith(".")


# P11
def keeps_extension(name: Column, source: Column) -> Column:
    a, b = path_extension(name), path_extension(source)
    return (a == b) & (a != "")


