"""The corpus pipeline: language ID, exact dedup, near dedup on word shingles, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents, and whatever other columns there are, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanframe.llm.byte_bpe import round_trip
from spanframe.llm.common import Scratch, release_driver, table
from spanframe.llm.exact_dedup import drop_copies
from spanframe.llm.language_id import drop_unidentified
from spanframe.llm.mixing import draw_mix
from spanframe.llm.ngram_join import drop_near_copies
from spanframe.llm.queries import quality_weight


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a likely language; the classifier learns from the training rows of docs.

    Texts that are null, empty or without a letter go; rows that repeat stay or go alike; a null doc_id, lang or source does
    not matter. Where no row is labelled there is no language, and every row goes.
    """
    release_driver(spark)
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest doc_id, a null one last.

    Null texts are equal to empty ones. Of rows that repeat an id and a text one stays; rows of one id and other texts are
    documents of their own.
    """
    release_driver(spark)
    return drop_copies(docs)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that Jaccard links of 5-word shingles, of 0.8 or more, join.

    Texts without words link with nothing and stay, and so does a null doc_id; rows of one id are one document, and stay or go
    together.
    """
    release_driver(spark)
    return drop_near_copies(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it does not take go.

    A null source is a source of its own. Rows that are alike in source, id and size are taken as often as each other; a text
    without words comes with complete passes only.
    """
    release_driver(spark)
    return draw_mix(docs, quality_weight())


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to; a null text is an empty one."""
    release_driver(spark)
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_dedup", ngram_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]
#: A trained classifier and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
