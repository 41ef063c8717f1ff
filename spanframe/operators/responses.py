"""Around a language model: the messages that go to it and the items in what comes back. The call itself is not here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.spans import locate_items
from spanframe.model import LABELS

MESSAGES = "array<struct<role:string,content:string>>"


def few_shot_messages(text: Column, examples: list[tuple[str, str]]) -> Column:
    """array<struct<role,content>>: each example as a user and an assistant message, then the text as the user's."""
    shots = [F.struct(F.lit(role).alias("role"), F.lit(content).alias("content")) for pair in examples for role, content in zip(("user", "assistant"), pair, strict=True)]
    return F.array(*shots, F.struct(F.lit("user").alias("role"), text.alias("content")))


def bytes_sent(messages: Column, system: str = "") -> Column:
    """UTF-8 bytes of the system prompt and of all contents."""
    return F.aggregate(messages, F.lit(len(system.encode())), lambda acc, m: acc + F.octet_length(m["content"]))


def parse_items(response: Column) -> Column:
    """struct<failed, items>: items (text, label) of {"spans":[...]} in order; failed when the response is not JSON.

    An item that is no object, lacks a field or has a label outside the domain goes; a value that is no string counts as
    the text of it. An item's fields are read one by one, so a bad item costs itself alone.
    """
    doc = F.try_parse_json(response)
    spans = F.try_variant_get(doc, "$.spans", "array<variant>")
    read = F.transform(spans, lambda s: F.struct(F.try_variant_get(s, "$.text", "string").alias("text"), F.try_variant_get(s, "$.label", "string").alias("label")))
    items = F.filter(read, lambda s: s["text"].isNotNull() & s["label"].isin(*LABELS))
    return F.struct(doc.isNull().alias("failed"), F.coalesce(items, F.array().cast("array<struct<text:string,label:string>>")).alias("items"))


def located_responses(rows: DataFrame) -> DataFrame:
    """(id, spans, failed, unlocated, relocated, ignored) of rows (id, text, response); sum the counters as columns."""
    parsed = rows.withColumn("parsed", parse_items(F.col("response")))
    placed = parsed.withColumn("found", locate_items(F.col("text"), F.col("parsed.items")))
    return placed.select("id", "found.spans", F.col("parsed.failed").alias("failed"), "found.unlocated", "found.relocated", "found.ignored")
