"""Span functions: finding, locating, checking and showing spans. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe import lexicon
from spanframe.functions.arrays import let, running_sums
from spanframe.functions.batches import span_lists, values_of
from spanframe.functions.text import SPACE
from spanframe.model import SPANS

OPEN, CLOSE = "⟦", "⟧"
MARK = "\x01"


def alternation(words) -> str:
    """Words as alternatives, longer ones first, so that no word hides one that it begins."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def person_pattern() -> str:
    title = f"(?:{alternation(lexicon.HONORIFICS)})"
    return f"(?:{alternation(lexicon.TOP_SURNAMES)})(?:[一-鿿]{{1,2}}{title}?|{title})"


def address_pattern(other: str = f"[^{SPACE}{lexicon.PUNCTUATION}]", flags: str = "(?U)") -> str:
    return f"{flags}(?:{alternation(lexicon.DIVISIONS)}){other}{{1,3}}[區鄉鎮市](?:{other}{{1,10}}(?:路|街|大道){other}{{0,15}}號)?"


def org_pattern(other: str = f"[^{SPACE}{lexicon.PUNCTUATION}]", flags: str = "(?U)") -> str:
    return f"{flags}{other}{{2,8}}(?:{alternation(lexicon.DETECTED_SUFFIXES)})"


def span_struct(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"))


def find_matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>>: all leftmost non-overlapping matches of a pattern that matches no empty string.

    One pass of the pattern puts a mark on either side of each match, and the marks cut the text into what is between the
    matches and the matches in turn; the running sums of their lengths are the offsets. The mark is U+0001, in whose place
    a text's own U+0001 counts as U+0002.
    """
    marked = F.regexp_replace(F.translate(text, MARK, "\x02"), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    found = lambda pieces, ends: F.transform(
        F.sequence(F.lit(1), F.floor(F.size(pieces) / 2).cast("int")),
        lambda i: F.struct(ends[2 * i - 2].alias("start"), ends[2 * i - 1].alias("end"), pieces[2 * i - 1].alias("text")),
    )
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    cut = let(F.split(marked, MARK, -1), lambda x: F.when(F.size(x) > 1, let(running_sums(F.transform(x, F.length)), lambda ends: found(x, ends))).otherwise(none))
    return F.coalesce(cut, none)


def find_spans(text: Column, pattern: str, label: str) -> Column:
    """find_matches() as spans of a label."""
    return F.transform(find_matches(text, pattern), lambda m: span_struct(m["start"], m["end"], F.lit(label)))


def each_span(rows: DataFrame, column: str) -> DataFrame:
    """A row (column s) for each span of an array column, in place of it.

    An outer generator: from a plain one Spark infers that the array isn't empty, and would push that with all that the array
    is computed from below, to be computed once more there.
    """
    return rows.select("*", F.explode_outer(column).alias("s")).drop(column).where(F.col("s").isNotNull())


def pattern_finder() -> Callable[[str], list[tuple[int, int, str]]]:
    """A function of one text: the spans of the three lexicon patterns, sorted by start, end and label.

    Every match of an organization ends in a suffix, and to look for suffixes costs a twentieth of what the pattern does, so
    that a text without any is not looked through by it.
    """
    person, address, org = (re.compile(p).finditer for p in (person_pattern(), address_pattern(flags=""), org_pattern(flags="")))
    suffix = re.compile(alternation(lexicon.DETECTED_SUFFIXES)).search

    def find(text: str) -> list[tuple[int, int, str]]:
        found = [(*m.span(), "PERSON") for m in person(text)] + [(*m.span(), "ADDRESS") for m in address(text)]
        if suffix(text):
            found += [(*m.span(), "ORG") for m in org(text)]
        found.sort()
        return found

    return find


def pattern_spans(text: Column) -> Column:
    """pattern_finder() over Arrow batches, where a text costs about a twentieth of what marks and folds in the row do."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        find = pattern_finder()
        return span_lists([find(t) if t else [] for t in values_of(texts)])

    return run(text)


def locate_items(text: Column, items: Column, longest: int = 100) -> Column:
    """Place reported surface texts (array<struct<text,label>>) in a text.

    Each is looked for from a cursor on, and if it is not there from the start (relocated); the cursor moves to the end
    of what was found last, also after a relocation. Items that are empty or over `longest` characters are ignored.
    Gives struct<spans, unlocated, relocated, ignored>; spans are distinct and sorted.
    """
    zero = F.struct(
        F.lit(0).alias("cursor"), F.array().cast(SPANS).alias("spans"), F.lit(0).alias("unlocated"), F.lit(0).alias("relocated"), F.lit(0).alias("ignored")
    )

    def step(acc: Column, item: Column) -> Column:
        n = F.coalesce(F.length(item["text"]), F.lit(0))
        usable = (n >= 1) & (n <= longest)
        ahead = F.call_function("locate", item["text"], text, acc["cursor"] + 1)
        anywhere = F.call_function("locate", item["text"], text, F.lit(1))
        at = F.when(ahead > 0, ahead).otherwise(anywhere)
        hit = usable & (at > 0)
        found = span_struct(at - 1, at - 1 + n, item["label"])
        return F.struct(
            F.when(hit, at - 1 + n).otherwise(acc["cursor"]).alias("cursor"),
            F.when(hit, F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"),
            (acc["unlocated"] + F.when(usable & (at <= 0), 1).otherwise(0)).alias("unlocated"),
            (acc["relocated"] + F.when(hit & (ahead <= 0), 1).otherwise(0)).alias("relocated"),
            (acc["ignored"] + F.when(usable, 0).otherwise(1)).alias("ignored"),
        )

    def end(acc: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(acc["spans"])).alias("spans"), acc["unlocated"], acc["relocated"], acc["ignored"])

    return F.aggregate(F.coalesce(items, F.array().cast("array<struct<text:string,label:string>>")), zero, step, end)


def hits_to_spans(text: Column, hits: Column) -> Column:
    """Spans of hits (array<struct<text,start,end,label>>): given offsets as they are, else the text's next occurrence.

    A text is looked for from the end of the last one placed and then from the start; what is nowhere is left out.
    """
    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, hit: Column) -> Column:
        given = hit["start"].isNotNull() & hit["end"].isNotNull()
        n = F.coalesce(F.length(hit["text"]), F.lit(0))
        ahead = F.call_function("locate", hit["text"], text, acc["cursor"] + 1)
        at = F.when(n == 0, acc["cursor"] + 1).when(ahead > 0, ahead).otherwise(F.call_function("locate", hit["text"], text, F.lit(1)))
        start, end = F.when(given, hit["start"]).otherwise(at - 1), F.when(given, hit["end"]).otherwise(at - 1 + n)
        placed = given | (hit["text"].isNotNull() & (at > 0))
        return F.struct(
            F.when(placed & ~given, end).otherwise(acc["cursor"]).alias("cursor"),
            F.when(placed, F.concat(acc["spans"], F.array(span_struct(start, end, hit["label"])))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(hits, zero, step, lambda acc: F.array_sort(acc["spans"]))


def map_labels(spans: Column, mapping: dict[str, str]) -> Column:
    """Spans under our labels; those whose label the mapping lacks go."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    moved = F.transform(spans, lambda s: span_struct(s["start"], s["end"], F.try_element_at(table, s["label"])))
    return F.filter(moved, lambda s: s["label"].isNotNull())


def mark_spans(text: Column, spans: Column) -> Column:
    """The text with each span in brackets."""
    zero = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["cursor"] + 1, s["start"] - acc["cursor"])
        inside = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["end"].alias("cursor"), F.concat(acc["out"], before, F.lit(OPEN), inside, F.lit(CLOSE)).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["cursor"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(spans), zero, step, rest)


def span_form(label: Column, surface: Column) -> Column:
    """The surface form of a labelled span, the unit of audit coverage."""
    return let(F.struct(label.alias("label"), surface.alias("surface")), lambda x: _form(x["label"], x["surface"]))


def _form(label: Column, surface: Column) -> Column:
    titled, street = surface.rlike(f"(?:{alternation(lexicon.HONORIFICS)})\\z"), surface.endswith("號")
    return (
        F.when((label == "PERSON") & ~titled, F.concat(F.lit("PERSON: "), F.length(surface).cast("string"), F.lit("-character name")))
        .when((label == "PERSON") & (F.length(surface) == 3), F.lit("PERSON: surname + honorific"))
        .when(label == "PERSON", F.lit("PERSON: full name + honorific"))
        .when((label == "ADDRESS") & ~street, F.lit("ADDRESS: city and district only"))
        .when((label == "ADDRESS") & surface.rlike("[０-９]"), F.lit("ADDRESS: street, fullwidth digits"))
        .when(label == "ADDRESS", F.lit("ADDRESS: street, ASCII digits"))
        .otherwise(label)
    )


def overlapping(spans: Column) -> Column:
    """The spans that begin before the end of an earlier one of the row, in order; there is nothing to shuffle."""
    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        found = F.when(s["start"] < acc["reach"], F.concat(acc["found"], F.array(s))).otherwise(acc["found"])
        return F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), found.alias("found"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["found"])


def surface_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def coverage_cells(text: Column, spans: Column, tier: Column, template: Column) -> Column:
    """The audit cells of a row: tier, template, the form of each span, and removed punctuation in rows with spans."""
    forms = F.transform(spans, lambda s: span_form(s["label"], surface_of(text, s)))
    removed = F.when((F.size(spans) > 0) & ~text.contains("。"), F.array(F.lit("text: punctuation removed"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("tier: "), tier), F.concat(F.lit("template: "), template)), forms, removed))


def display_problem(text: Column, spans: Column) -> Column:
    """'markup' if the text holds a character that forms use, 'span' if spans are empty, out of range or overlap, or null."""
    zero = F.struct(F.lit(0).alias("cursor"), F.lit(True).alias("ok"))
    step = lambda acc, s: F.struct(s["end"].alias("cursor"), (acc["ok"] & (acc["cursor"] <= s["start"]) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))).alias("ok"))
    return F.when(text.rlike("[⟦⟧`\\n\\r]"), F.lit("markup")).when(~F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["ok"]), F.lit("span"))
