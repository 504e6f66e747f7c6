"""Text functions on columns: tokens, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER_UPPER = r"(?<=\p{Ll})(?=\p{Lu})"
_UPPER_WORD = r"(?<=.)(?=\p{Lu}\p{Ll})"


def split_camel(col: Column) -> Column:
    """A blank before each upper-case letter that begins a word within a name."""
    return F.regexp_replace(F.regexp_replace(col, _LOWER_UPPER, " "), _UPPER_WORD, " ")


def tokenize(col: Column) -> Column:
    """Lower-case runs of letters, digits and '_', of more than one byte or beginning with a digit; null gives []."""
    runs = F.regexp_extract_all(split_camel(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda t: (F.octet_length(t) > 1) | F.rlike(t, F.lit(r"^\p{Nd}")))


def normalized(col: Column) -> Column:
    return F.array_join(tokenize(col), " ")


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"[^/]*$", 0)


def dirname(col: Column) -> Column:
    return F.regexp_replace(col, r"/?[^/]*$", "")


def extension(col: Column) -> Column:
    """The ending of a name with its dot, lower-case; '' without one."""
    return F.lower(F.regexp_extract(basename(col), r"\.[^.]*$", 0))


def slugify(col: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash; no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def strip_markdown(col: Column) -> Column:
    return F.trim(F.translate(col, "`*_#", ""))


def line_count(col: Column) -> Column:
    """Lines of a text; a trailing line feed begins no line, an empty text has none."""
    feeds = F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(col, F.lit("")) == "", 0).otherwise(feeds + F.when(col.endswith("\n"), 0).otherwise(1))


def joined(*cols: Column, sep: str = "\n") -> Column:
    """The non-empty values, joined."""
    return F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: x != ""), sep)


def first_filled(*cols: Column) -> Column:
    """The first value that isn't blank, or ''."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols], F.lit(""))
