"""Token counts by a two-tier lookup without a shuffle.

Tier one is a broadcast table of frequent pre-token lengths (at most `entries` entries, so its size is bounded).
Tier two is each Python worker's own cache, bounded in entries and in the length of a pre-token: a miss is encoded by
the library once and kept. What the table holds decides speed alone, never a result, so it is filled from a few rows, of
bounded length, that the driver reads. Texts of every script go through both tiers.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept; repeated rows give repeated
rows; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bounded_batches, portions, text_or_empty
from spanframe.llm.pretokens import TABLE_ROWS, frequent_pretokens, sample_texts, worker_table

#: Entries of the broadcast table.
ENTRIES = 32_768


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, entries: int = ENTRIES, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; tokenizer is the path of a .json or .model file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    schema = f"{id_col} {kept.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long"
    if tokenizer.endswith(".model"):
        run = _pieces(spark.sparkContext.broadcast(Path(tokenizer).read_bytes()))
    else:
        definition = Path(tokenizer).read_text(encoding="utf-8")
        run = _pretokens(spark.sparkContext.broadcast((definition, frequent_pretokens(sample_texts(kept, table_rows), definition, len, entries))))
    return kept.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def _pretokens(shared):
    def run(batches):
        definition, frequent = shared.value
        key = "count-" + hashlib.sha256(definition.encode()).hexdigest()
        found = worker_table(key, frequent, len, definition)
        for b in portions(batches, 1):
            yield _rows(b, list(found.lookup(b.column(1).to_pylist(), sum)))

    return run


def _pieces(shared):
    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in portions(batches, 1):
            yield _rows(b, [len(x) for x in model.encode(b.column(1).to_pylist(), num_threads=1)] if b.num_rows else [])

    return run


def _rows(b: pa.RecordBatch, counts: list[int]) -> pa.RecordBatch:
    n_bytes = pc.cast(pc.binary_length(b.column(1)), pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(counts, pa.int64())], names=[b.schema.names[0], "n_bytes", "n_tokens"])
