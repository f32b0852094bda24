"""Column functions for text: folding, line and blank handling, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Code points whose full case folding has ASCII letters that lower-casing alone doesn't give.
FOLDS = (
    ("\u00df", "ss"), ("\u0149", "\u02bcn"), ("\u017f", "s"), ("\u01f0", "j\u030c"), ("\u1e96", "h\u0331"), ("\u1e97", "t\u0308"),
    ("\u1e98", "w\u030a"), ("\u1e99", "y\u030a"), ("\u1e9a", "a\u02be"), ("\u1e9e", "ss"), ("\ufb00", "ff"), ("\ufb01", "fi"),
    ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"),
)
#: Unicode white space and line boundaries.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Possessive, so that long dotted tokens don't overflow the stack of Java's matcher.
TOKEN = r"[a-z0-9]++(?:[.#/-]++[a-z0-9]++|[+#]++)*+"


def fold(text: Column) -> Column:
    """Case folding as far as it bears on ASCII tokens."""
    plain = F.octet_length(text) == F.char_length(text)  # far cheaper than a pattern, and true of most texts
    odd = ~plain & text.rlike("[" + "".join(a for a, _ in FOLDS) + "]")
    return F.lower(F.when(odd, reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), FOLDS, text)).otherwise(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def first_two_tokens(text: Column) -> Column:
    """The first two tokens, or none if there are fewer; the rest of the text isn't cut up."""
    return F.regexp_extract_all(F.regexp_extract(fold(text), rf"^[^a-z0-9]*+{TOKEN}[^a-z0-9]*+{TOKEN}", 0), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Blank runs become one space; none at the ends."""
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """All lines without their ends; a final line end opens no line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def missing(value: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(value, F.lit(""))


def suffix(filename: Column) -> Column:
    """The folded last suffix of a path's last part, with its dot; empty if there is none."""
    name = F.regexp_extract(F.regexp_replace(filename, r"/+(\./*)*$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"[^.](\.[^.]+)$", 1))
