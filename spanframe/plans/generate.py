"""Labelled synthetic sentences: the exact set of a seed, and any number of rows from keys.

The exact set is one sequence of draws of one generator, so it is made on the driver (a few hundred rows). The scaled
form takes every choice from arithmetic on a key, rows independent of each other, and is made in Arrow batches.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe import lexicon
from spanframe.functions.batches import span_lists, values_of
from spanframe.functions.text import ASCII, FULLWIDTH
from spanframe.model import EXAMPLE, LABELS, SPANS, TIERS

SLOT = re.compile(r"\{([A-Z_]+)\}")
ATTEMPTS = 50
#: Rows of the keyed form.
KEYED = f"k long, id string, text string, entities {SPANS}, tier string, template_id string"
_WIDE, _BARE = str.maketrans(ASCII, FULLWIDTH), str.maketrans("", "", lexicon.STRIPPED)


def pieces(template: str) -> list[tuple[str, str | None]]:
    """A template as (literal, slot that follows it), the last slot being None."""
    cut = SLOT.split(template)
    return list(zip(cut[::2], [*cut[1::2], None], strict=True))


def entity_count(template: str) -> int:
    return sum(slot in LABELS for _, slot in pieces(template))


def pools() -> dict[str, list[tuple[str, str, str]]]:
    """Templates by tier; pools overlap."""
    fits: dict[str, Callable[[int], bool]] = {"easy": lambda n: n == 1, "medium": lambda n: n >= 2, "hard": lambda n: n >= 1, "negative": lambda n: n == 0}
    return {tier: [t for t in lexicon.TEMPLATES if fits[tier](entity_count(t[2]))] for tier in TIERS}


class RowDraws:
    """The values of one row's slots, drawn in the order in which they are asked for."""

    def __init__(self, rng: random.Random, tier: str, blocked: frozenset[str] = frozenset()):
        self.rng, self.blocked = rng, blocked
        self.strip, self.honorific, self.wide, self.partial = [rng.random() < chance for chance in lexicon.NOISE[tier]]

    def value(self, slot: str) -> str:
        made = getattr(self, slot.lower(), None)
        if made is None:
            raise ValueError(f"no such slot: {slot}")
        text = made()
        return text.translate(_WIDE) if self.wide and slot not in ("PERSON", "ORG") else text

    def name(self) -> str:
        pick = self.rng.choice
        for _ in range(ATTEMPTS):
            name = pick(lexicon.SURNAMES)
            for _ in range(pick((1, 2))):
                name += pick(lexicon.GIVEN_CHARACTERS)
            if name not in self.blocked:
                return name
        raise RuntimeError(f"every one of {ATTEMPTS} names drawn is blocked")

    def person(self) -> str:
        name = self.name()
        if self.honorific:
            title = self.rng.choice(lexicon.HONORIFICS)
            name = (name[:1] if self.rng.random() < 0.7 else name) + title
        return name

    def address(self) -> str:
        city = self.rng.choice(list(lexicon.DISTRICTS))
        place = city + self.rng.choice(lexicon.DISTRICTS[city])
        if self.partial:
            return place
        street = self.rng.choice(lexicon.ROADS) + self.rng.choice(lexicon.ROAD_SUFFIXES)
        return place + street + "{}段{}號".format(self.rng.randint(1, 3), self.rng.randint(1, 300))

    def org(self) -> str:
        return self.rng.choice(lexicon.ORG_WORDS) + self.rng.choice(lexicon.ORG_SUFFIXES)

    def date(self) -> str:
        return "{}年{:02d}月{:02d}日".format(*[self.rng.randint(*span) for span in ((2024, 2026), (1, 12), (1, 28))])

    def amount(self) -> str:
        return f"NT${self.rng.randint(100, 99999):,}"

    def order_no(self) -> str:
        return self.rng.choice("ABCDEFGH") + str(self.rng.randint(100_000_000, 999_999_999))

    def product_code(self) -> str:
        return f"P{self.rng.randint(1000, 9999)}-" + self.rng.choice("ABCDEFGH")

    def number(self) -> str:
        return str(self.rng.randint(1, 500))


def render(template: str, rng: random.Random, tier: str, blocked: frozenset[str] = frozenset()) -> tuple[str, list[dict]]:
    """(text, spans): noise takes punctuation from the literals only, so spans hold by construction."""
    row, text, spans = RowDraws(rng, tier, blocked), "", []
    for literal, slot in pieces(template):
        text += literal.translate(_BARE) if row.strip else literal
        if slot is not None:
            value = row.value(slot)
            if slot in LABELS:
                spans.append({"start": len(text), "end": len(text) + len(value), "label": slot})
            text += value
    return text, spans


def exact_examples(seed: int = 42, counts: dict[str, int] | None = None, blocked: frozenset[str] = frozenset()) -> list[dict]:
    """The rows of a seed, tier after tier, all from one generator."""
    rng, of_tier, rows = random.Random(seed), pools(), []
    for tier in TIERS:
        for i in range((lexicon.TIER_COUNTS if counts is None else counts).get(tier, 0)):
            name, _, template = rng.choice(of_tier[tier])
            text, spans = render(template, rng, tier, blocked)
            rows.append({"id": f"{tier}_{i + 1:03d}", "text": text, "entities": spans, "tier": tier, "seed": seed, "template_id": name})
    return rows


def to_lines(rows: list[dict]) -> str:
    """The byte-exact line form: JSON with plain characters, one row a line, keys in the order of the rows."""
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def exact_frame(spark: SparkSession, seed: int = 42, counts: dict[str, int] | None = None) -> DataFrame:
    rows = [(r["id"], r["text"], [(s["start"], s["end"], s["label"]) for s in r["entities"]], r["tier"], r["seed"], r["template_id"], i) for i, r in enumerate(exact_examples(seed, counts))]
    return spark.createDataFrame(rows, EXAMPLE + ", ord int")


def _pick(values, turn: str) -> str:
    """SQL for one of some texts by the remainder of a number; the same in Spark and in other engines."""
    return f"CASE ({turn}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def slot_sql(k: str = "k", tier: str = "tier") -> dict[str, str]:
    """SQL of each slot's value, of a key and a tier; noise by the key's remainders, about as often as in the exact form."""
    name = f"substr('{lexicon.SURNAMES}', CAST({k} * 11 % 39 + 1 AS INT), 1)"
    given = f"substr('{lexicon.GIVEN_CHARACTERS}', CAST({k} * 7 % 40 + 1 AS INT), CAST(1 + {k} % 2 AS INT))"
    title = _pick(lexicon.HONORIFICS, k)
    polite = f"(({tier} = 'medium' AND {k} % 5 < 2) OR ({tier} = 'hard' AND {k} % 10 < 7))"
    person = f"CASE WHEN {polite} AND {k} % 3 < 2 THEN concat({name}, {title}) WHEN {polite} THEN concat({name}, {given}, {title}) ELSE concat({name}, {given}) END"
    cities = list(lexicon.DISTRICTS)
    place = f"CASE ({k}) % {len(cities)} " + " ".join(f"WHEN {i} THEN concat('{c}', {_pick(lexicon.DISTRICTS[c], f'{k} * 3')})" for i, c in enumerate(cities)) + " END"
    street = f"concat({_pick(lexicon.ROADS, f'{k} * 3')}, {_pick(lexicon.ROAD_SUFFIXES, k)}, CAST({k} % 3 + 1 AS VARCHAR(20)), '段', CAST({k} % 300 + 1 AS VARCHAR(20)), '號')"
    partial = f"({tier} = 'hard' AND {k} % 5 < 3)"
    wide = wide_sql(k, tier)
    narrow = "".join(c for c in ASCII if c not in "'\\\\")
    broad = narrow.translate(_WIDE)
    full = lambda sql: f"CASE WHEN {wide} THEN translate({sql}, '{narrow}', '{broad}') ELSE {sql} END"
    return {
        "PERSON": person,
        "ADDRESS": full(f"CASE WHEN {partial} THEN {place} ELSE concat({place}, {street}) END"),
        "ORG": f"concat({_pick(lexicon.ORG_WORDS, k)}, {_pick(lexicon.ORG_SUFFIXES, k)})",
        "DATE": full(f"concat(CAST(2024 + {k} % 3 AS VARCHAR(20)), '年', lpad(CAST({k} % 12 + 1 AS VARCHAR(20)), 2, '0'), '月', lpad(CAST({k} % 28 + 1 AS VARCHAR(20)), 2, '0'), '日')"),
        "AMOUNT": full(f"concat('NT$', CAST(100 + {k} * 37 % 99900 AS VARCHAR(20)))"),
        "ORDER_NO": full(f"concat(substr('ABCDEFGH', CAST({k} % 8 + 1 AS INT), 1), CAST(100000000 + {k} % 900000000 AS VARCHAR(20)))"),
        "PRODUCT_CODE": full(f"concat('P', CAST(1000 + {k} % 9000 AS VARCHAR(20)), '-', substr('ABCDEFGH', CAST({k} % 8 + 1 AS INT), 1))"),
        "NUMBER": full(f"CAST({k} % 500 + 1 AS VARCHAR(20))"),
    }


def wide_sql(k: str = "k", tier: str = "tier") -> str:
    return f"(({tier} = 'medium' AND {k} % 5 >= 3) OR ({tier} = 'hard' AND {k} % 5 >= 1) OR ({tier} = 'negative' AND {k} % 10 < 3))"


def strip_sql(k: str = "k", tier: str = "tier") -> str:
    return f"(({tier} = 'medium' AND {k} % 7 < 3) OR ({tier} = 'hard' AND {k} % 7 < 6) OR ({tier} = 'negative' AND {k} % 7 < 1))"


def template_rows() -> list[tuple[str, int, str, list[tuple[str, str | None]]]]:
    """(tier, place in its pool, template id, pieces) of every pool."""
    return [(tier, i, t[0], pieces(t[2])) for tier, pool in pools().items() for i, t in enumerate(pool)]


def _plain_values() -> dict[str, Callable[[int, str], str]]:
    """slot_sql() as plain functions of a key and a tier: the same values."""
    turn = lambda values, k: values[k % len(values)]
    cities = list(lexicon.DISTRICTS)

    def person(k: int, tier: str) -> str:
        name, at = lexicon.SURNAMES[k * 11 % 39], k * 7 % 40
        polite = (tier == "medium" and k % 5 < 2) or (tier == "hard" and k % 10 < 7)
        given = "" if polite and k % 3 < 2 else lexicon.GIVEN_CHARACTERS[at : at + 1 + k % 2]
        return name + given + turn(lexicon.HONORIFICS, k) if polite else name + given

    def address(k: int, tier: str) -> str:
        city = turn(cities, k)
        place = city + turn(lexicon.DISTRICTS[city], k * 3)
        return place if tier == "hard" and k % 5 < 3 else f"{place}{turn(lexicon.ROADS, k * 3)}{turn(lexicon.ROAD_SUFFIXES, k)}{k % 3 + 1}段{k % 300 + 1}號"

    def full(made: Callable[[int, str], str]) -> Callable[[int, str], str]:
        return lambda k, tier: made(k, tier).translate(_KEYED_WIDE) if _is_wide(k, tier) else made(k, tier)

    return {
        "PERSON": person,
        "ADDRESS": full(address),
        "ORG": lambda k, tier: turn(lexicon.ORG_WORDS, k) + turn(lexicon.ORG_SUFFIXES, k),
        "DATE": full(lambda k, tier: f"{2024 + k % 3}年{k % 12 + 1:02d}月{k % 28 + 1:02d}日"),
        "AMOUNT": full(lambda k, tier: f"NT${100 + k * 37 % 99900}"),
        "ORDER_NO": full(lambda k, tier: f"{'ABCDEFGH'[k % 8]}{100000000 + k % 900000000}"),
        "PRODUCT_CODE": full(lambda k, tier: f"P{1000 + k % 9000}-{'ABCDEFGH'[k % 8]}"),
        "NUMBER": full(lambda k, tier: str(k % 500 + 1)),
    }


_KEYED_WIDE = str.maketrans({c: w for c, w in zip(ASCII, FULLWIDTH, strict=True) if c not in "'\\"})


def _is_wide(k: int, tier: str) -> bool:
    return (tier == "medium" and k % 5 >= 3) or (tier == "hard" and k % 5 >= 1) or (tier == "negative" and k % 10 < 3)


def _is_bare(k: int, tier: str) -> bool:
    return (tier == "medium" and k % 7 < 3) or (tier == "hard" and k % 7 < 6) or (tier == "negative" and k % 7 < 1)


def keyed_row() -> Callable[[int], tuple]:
    """A function from a key to (id, text, spans, tier, template id)."""
    made = _plain_values()
    parts = lambda template: [(lit, lit.translate(_BARE), slot, made.get(slot)) for lit, slot in pieces(template)]
    of_tier = [(tier, [(t[0], parts(t[2])) for t in pool]) for tier, pool in pools().items()]

    def row(k: int) -> tuple:
        tier, pool = of_tier[k % 4]
        name, filled = pool[k // 4 % len(pool)]
        bare, text, spans = _is_bare(k, tier), "", []
        for literal, stripped, slot, value in filled:
            text += stripped if bare else literal
            if slot is not None:
                start = len(text)
                text += value(k, tier)
                if slot in LABELS:
                    spans.append((start, len(text), slot))
        return f"{tier}_{k}", text, spans, tier, name

    return row


def synthesize(keys: DataFrame, key: str) -> DataFrame:
    """Example rows (k, id, text, entities, tier, template_id) of non-negative integer keys, one each.

    A row is made by plain code where its key is read, with nothing to join. As column expressions, folds over the parts cost
    about ten times as much, and a filter on the text would be pushed below them, to make each row twice.
    """

    def run(batches):
        row = keyed_row()
        for b in batches:
            found = [(None,) * 5 if k is None or k < 0 else row(k) for k in values_of(b.column(0))]
            ids, texts, spans, tiers, names = zip(*found, strict=True) if found else [[]] * 5
            columns = [pa.array(x, pa.string()) for x in (ids, texts, tiers, names)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns[:2], span_lists(list(spans)), *columns[2:]], names=["k", "id", "text", "entities", "tier", "template_id"])

    return keys.select(F.col(key).cast("long").alias("k")).mapInArrow(run, KEYED)
