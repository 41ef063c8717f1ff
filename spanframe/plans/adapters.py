"""Systems that predict spans, and their registry.

A system is a column function from a text column to array<struct<start,end,label>>, or a table of stored predictions or
of stored responses of a language model. Models that are not here (NER, zero-shot) plug in as pandas UDFs of the same
type; what is known of a system is its metadata, and one that can't load says why. Latency is that of one sentence at a
time, which a plan over columns doesn't have: a system that can answer for one sentence is timed in a pass of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe import lexicon
from spanframe.functions.spans import map_labels, pattern_finder, pattern_spans
from spanframe.model import CALLS, LABELS, RESULT, SPANS, no_spans
from spanframe.operators.responses import bytes_sent, few_shot_messages, located_responses
from spanframe.sources.files import exists, optional_json, predictions

Spans = list[tuple[int, int, str]]


class Unavailable(Exception):
    """A system that can't run here, with the reason."""


@dataclass(frozen=True)
class Metadata:
    model_id: str
    model_version: str
    size_mb: float | None = None
    data_leaves_machine: bool = False
    bytes_sent: int | None = None
    package_versions: dict[str, str] = field(default_factory=dict)


class System:
    """The interface: load() gives metadata or raises Unavailable, spans(text) is the prediction column."""

    name = ""
    label_mapping: dict[str, str] = {x: x for x in LABELS}
    params: dict[str, object] = {}

    def load(self) -> Metadata:
        raise NotImplementedError

    def spans(self, text: Column) -> Column:
        raise NotImplementedError

    def predict(self, rows: DataFrame) -> DataFrame:
        """(system, id, spans) of rows (id, text)."""
        return rows.select(F.lit(self.name).alias("system"), "id", self.spans(F.col("text")).alias("spans"))

    def counters(self, rows: DataFrame) -> dict[str, object]:
        """What the system counts besides its spans, for its metadata."""
        return {}

    def one(self) -> Callable[[], Callable[[str], Spans]] | None:
        """What makes, in a worker, a function of one sentence; None where the system answers for tables alone."""
        return None

    def calls(self, rows: DataFrame) -> DataFrame | None:
        """(system, ord, ms) of one call a row (ord, text), one after the other in a task; None where there is nothing to time."""
        make, name = self.one(), self.name
        if make is None:
            return None

        def run(batches):
            answer = make()
            for b in batches:
                ms = []
                for text in b["text"]:
                    began = time.perf_counter()
                    answer(text or "")
                    ms.append(1000 * (time.perf_counter() - began))
                yield pd.DataFrame({"system": name, "ord": b["ord"], "ms": ms})

        return rows.select(F.col("ord").cast("long").alias("ord"), "text").mapInPandas(run, CALLS)


class PatternSystem(System):
    """The lexicon patterns: a lower bound without any model."""

    name = "regex"
    params = {"surname_count": len(lexicon.TOP_SURNAMES), "county_city_count": len(lexicon.DIVISIONS), "org_suffix_count": len(lexicon.DETECTED_SUFFIXES)}

    def load(self) -> Metadata:
        return Metadata("lexicon-patterns", "1.0.0")

    def spans(self, text: Column) -> Column:
        return F.when(F.length(text) > 0, pattern_spans(text)).otherwise(no_spans())

    def one(self) -> Callable[[], Callable[[str], Spans]]:
        return pattern_finder


class ReplaySystem(System):
    """Stored predictions (id, spans) of a system that ran elsewhere."""

    def __init__(self, name: str, stored: DataFrame, metadata: Metadata, timed: DataFrame | None = None):
        self.name, self.stored, self.metadata, self.timed = name, stored, metadata, timed

    def calls(self, rows: DataFrame) -> DataFrame | None:
        return None if self.timed is None else self.timed.select(F.lit(self.name).alias("system"), "ord", "ms")

    def load(self) -> Metadata:
        return self.metadata

    def predict(self, rows: DataFrame) -> DataFrame:
        found = rows.select("id").join(self.stored.select("id", "spans"), "id", "left")
        return found.select(F.lit(self.name).alias("system"), "id", F.coalesce("spans", no_spans()).alias("spans"))


class ResponseSystem(System):
    """A language model whose responses (id, response) are stored: few-shot messages out, items located in the text back.

    Items that are nowhere in the text, found before the cursor, or of no usable length are counted, and so are responses
    that are not JSON, and the bytes that the messages had.
    """

    def __init__(self, name: str, responses: DataFrame, metadata: Metadata, examples: list[tuple[str, str]] = (), prompt: str = ""):
        self.name, self.responses, self.metadata, self.examples, self.prompt = name, responses, metadata, list(examples), prompt
        self.params = {"few_shot_examples": len(self.examples)}

    def load(self) -> Metadata:
        return self.metadata

    def located(self, rows: DataFrame) -> DataFrame:
        joined = rows.select("id", "text").join(self.responses.select("id", "response"), "id", "left")
        return located_responses(joined.withColumn("response", F.coalesce("response", F.lit(""))))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.located(rows).select(F.lit(self.name).alias("system"), "id", "spans")

    def counters(self, rows: DataFrame) -> dict[str, object]:
        sums = {"parse_failures": F.col("failed").cast("int"), "unlocated_spans": F.col("unlocated"), "relocated_spans": F.col("relocated"), "ignored_spans": F.col("ignored")}
        found = self.located(rows).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]).first()
        sent = rows.agg(F.sum(bytes_sent(few_shot_messages(F.col("text"), self.examples), self.prompt))).first()[0]
        return found.asDict() | {"span_location": "surface-text", "bytes_sent": sent or 0}


class PandasSystem(System):
    """A Python model over Arrow batches. build() runs in a worker, once a batch stream, and gives text -> list of (start, end, label)."""

    def __init__(self, name: str, build: Callable[[], Callable[[str], list[tuple[int, int, str]]]], metadata: Metadata, label_mapping: dict[str, str] | None = None):
        self.name, self.build, self.metadata = name, build, metadata
        self.label_mapping = label_mapping or self.label_mapping

    def load(self) -> Metadata:
        try:
            self.build()
        except ImportError as e:
            raise Unavailable(str(e)) from e
        return self.metadata

    def spans(self, text: Column) -> Column:
        build = self.build

        @F.pandas_udf(SPANS)
        def run(batches: pd.Series) -> pd.Series:
            predict = build()
            return batches.map(lambda t: [dict(zip(("start", "end", "label"), s, strict=True)) for s in (predict(t) if t else [])])

        return F.array_sort(map_labels(run(text), self.label_mapping))

    def one(self) -> Callable[[], Callable[[str], Spans]]:
        return self.build


class Registry:
    """Systems by key, with groups of keys; heavy imports wait until a system is built."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[], System]] = {}
        self.groups: dict[str, tuple[str, ...]] = {}

    def add(self, key: str, factory: Callable[[], System], *groups: str) -> None:
        self.factories[key] = factory
        for g in groups:
            self.groups[g] = (*self.groups.get(g, ()), key)

    def build(self, key: str) -> System:
        return self.factories[key]()

    def resolve(self, selectors: list[str]) -> list[str]:
        """Keys of selectors - a key, a group or 'all' - each once, in order; KeyError for an unknown one."""
        keys: dict[str, None] = {}
        for s in selectors:
            if s != "all" and s not in self.factories and s not in self.groups:
                raise KeyError(f"unknown system: {s}")
            keys |= dict.fromkeys(self.factories if s == "all" else self.groups.get(s, (s,)))
        return list(keys)


#: The published systems, in the order of the report, and the selectors that stand for several.
KEYS = ("regex", "presidio", "gliner2_en", "gliner2_zh", "llm")
GROUPS = {"gliner2": ("gliner2_en", "gliner2_zh")}


def _group_of(key: str) -> list[str]:
    return [g for g, keys in GROUPS.items() if key in keys]


class _Absent(System):
    def __init__(self, name: str, reason: str):
        self.name, self.reason = name, reason

    def load(self) -> Metadata:
        raise Unavailable(self.reason)


def default_registry() -> Registry:
    """The published systems; those that need a model's runtime say so when they are loaded."""
    registry = Registry()
    registry.add("regex", PatternSystem)
    for key in KEYS[1:]:
        registry.add(key, lambda key=key: _Absent(key, f"{key} needs a model that is not installed; stored_registry() replays what it predicted"), *_group_of(key))
    return registry


def stored_registry(spark: SparkSession, folder: str) -> Registry:
    """The published systems by their predictions (folder/predictions/<key>.jsonl) and result documents (folder/<key>.json)."""
    registry = Registry()
    for key in KEYS:
        registry.add(key, lambda key=key: _stored(spark, folder, key), *_group_of(key))
    return registry


def _stored(spark: SparkSession, folder: str, key: str) -> System:
    if not exists(spark, f"{folder}/predictions/{key}.jsonl"):
        return _Absent(key, f"no stored predictions of {key}")
    document = optional_json(spark, f"{folder}/{key}.json", RESULT).select("metadata.*").first()
    known = document.asDict() if document else {}
    metadata = Metadata(known.get("model_id") or key, known.get("model_version") or "", known.get("size_mb"), bool(known.get("data_leaves_machine")), known.get("bytes_sent"), known.get("package_versions") or {})
    return ReplaySystem(key, predictions(spark, {key: f"{folder}/predictions/{key}.jsonl"}), metadata)
