"""Normal forms and tokens of text fields, as Column expressions and, for operands, in plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = "_null"
# The characters that the normal form drops.
NOT_PRINTABLE = r"[^ -~]\]"
SYMBOLS = r"[!@#$%^&*()/_=`'+,.:;\"\-?~<>{}\[\]\\|]"
BLANKS = r"[ \t\n\x0B\f\r]{2,}"
TRIM = r"^[\x00-\x20]+|[\x00-\x20]+\Z"
ORDINAL = r"^([0-9]+)(st|nd|rd|th)$"
# Leading zeros of a term, of zeros alone all but one; and the suffix of a term that is an ordinal number.  A term
# begins at the start or after a space, and ends before a space or the end, a line end before these not counted.
ZEROS = r"(?<![^ ])0+(?=[^ ])"
SUFFIX = r"(?<![^ ])([0-9]+)(?:st|nd|rd|th)(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?(?: |\z))"
_ENDS = "".join(map(chr, range(0x21)))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.btrim(c, F.lit(_ENDS))


def clean_text(c: Column) -> Column:
    """The normal form of a text field; _null and null are empty.

    One chain that names each step's input once, so that no step is evaluated again, whatever Catalyst inlines.
    """
    s = F.regexp_replace(c, f"{NOT_PRINTABLE}|{SYMBOLS}", " ")
    s = F.lower(trimmed(F.regexp_replace(s, BLANKS, " ")))
    s = trimmed(F.regexp_replace(F.regexp_replace(s, ZEROS, ""), SUFFIX, "$1"))
    return F.when(c.isNull() | (F.lower(c) == NULL), F.lit("")).otherwise(s)


def tokens(cleaned: Column) -> Column:
    """Distinct terms of a cleaned text, which splits at spaces only; an empty text has the empty term."""
    return F.array_distinct(F.split(cleaned, " ", -1))


def clean_text_value(s: str) -> str:
    """clean_text of an operand."""
    if s.lower() == NULL:
        return ""
    s = re.sub(SYMBOLS, " ", re.sub(NOT_PRINTABLE, " ", s))
    s = re.sub(TRIM, "", re.sub(BLANKS, " ", s)).lower()
    if re.search("[0-9]", s):
        terms = [(re.sub("^0+", "", t) or ("0" if t else "")) for t in s.split(" ")]
        s = re.sub(TRIM, "", " ".join(re.sub(ORDINAL, r"\1", t) for t in terms))
    return s
