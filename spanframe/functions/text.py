"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe import lexicon

ASCII = "".join(chr(c) for c in range(0x20, 0x7F))
FULLWIDTH = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
#: Unicode white space for Java's engine: `(?U)\s` leaves out the four separators.
SPACE = r"\s\x1c-\x1f"


def to_fullwidth(text: Column) -> Column:
    """Printable ASCII in its fullwidth form, a space as the ideographic space."""
    return F.translate(text, ASCII, FULLWIDTH)


def to_halfwidth(text: Column) -> Column:
    return F.translate(text, FULLWIDTH, ASCII)


def strip_punctuation(text: Column) -> Column:
    """The text without spaces, tabs and common punctuation."""
    return F.translate(text, lexicon.STRIPPED, "")


def strip_marker(token: Column) -> Column:
    """A sub-word token without its leading continuation or word mark; one mark at most."""
    return F.regexp_replace(token, "^(##|▁)", "")


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))


def is_calendar_date(text: Column) -> Column:
    """Whether the text is YYYY-MM-DD and names a day that exists; false for null."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounding of ties to even, as IEEE rounding functions of scripting languages do."""
    return F.bround(value, digits)


def slot_count(template: Column, labels: tuple[str, ...]) -> Column:
    """Slots of a template that are labelled entities."""
    slots = F.regexp_extract_all(template, F.lit(r"\{([A-Z_]+)\}"), F.lit(1))
    return F.size(F.filter(slots, lambda s: s.isin(*labels)))


def tier_counts(spec: Column) -> Column:
    """map<string,int> of 'tier=count,tier=count'; an entry without a name or a count is an error."""
    items = F.transform(F.split(spec, ","), lambda x: F.split(x, "=", 2))
    bad = F.exists(items, lambda p: (F.size(p) < 2) | (F.trim(p[0]) == "") | (F.coalesce(F.trim(p[1]), F.lit("")) == ""))
    pairs = F.transform(items, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(F.try_element_at(p, F.lit(2))).cast("int").alias("v")))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid tier count entry in: "), spec)).cast("map<string,int>")).otherwise(F.map_from_entries(pairs))


def upper_bound_percent(rows: Column) -> Column:
    """One-sided 95 % upper bound of an error rate when none of the rows shows an error, in percent."""
    return F.round(100 * (1 - F.pow(F.lit(0.05), 1 / rows)), 1)
