"""Token-ID files: ids of all documents in ascending doc_id order, in independently coded, checksummed blocks.

A file set is a Parquet folder of blocks (so Spark's commit protocol makes writes whole and the folder can lie in any
store): shard and block give the order, start is the place of the block's first id within its shard, doc_ids and ends
index its documents, data is the coded block (id_coder). Shards are the ranges of one range partitioning by doc_id, so
no task sees more than its range; a block holds whole documents, closed once it has BLOCK_IDS ids. Reading needs the
number of ids of each shard, one row a shard, to place a shard in the whole.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id comes first; rows that repeat a
doc_id are all written, in no fixed order among themselves; other columns are ignored; an empty table gives an empty
file set and an empty result; a block that was changed fails its checksum when it is read.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.byte_bpe import ENTRIES, id_bytes
from spanframe.llm.common import bounded_batches, checked_broadcast, portions, text_or_empty
from spanframe.llm.id_coder import register
from spanframe.llm.pretokens import frequent_pretokens, sample_texts, worker_table

BLOCK_IDS = 1 << 17
#: Pre-tokens that a worker keeps.
CACHE_ENTRIES = 350_000
SCHEMA = "shard int, block long, start long, doc_ids array<long>, ends array<long>, ids binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts by a .json tokenizer, close each with end_id, and write the file set to path."""
    spark, definition = docs.sparkSession, Path(tokenizer).read_text(encoding="utf-8")
    bounded_batches(spark)
    encode, _ = register(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # read before the rows are dealt out, so that only these are
    shared = spark.sparkContext.broadcast((definition, frequent_pretokens(sample_texts(rows), definition, id_bytes, ENTRIES)))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blocks = ranged.mapInArrow(_packer(shared, block_ids, id_bytes([end_id])), SCHEMA)
    blocks.select("shard", "block", "start", "doc_ids", "ends", F.expr(f"{encode}(ids)").alias("data")).write.mode("overwrite").parquet(path)


def _packer(shared, block_ids: int, tail: bytes):
    """Encode texts and pack their ids into blocks, in one pass."""

    def run(batches):
        definition, frequent = shared.value
        found = worker_table("ids-" + hashlib.sha256(definition.encode()).hexdigest(), frequent, id_bytes, definition, CACHE_ENTRIES)
        shard, block, start, held, docs, ends = TaskContext.get().partitionId(), 0, 0, [], [], [0]

        def close():
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64())]
            columns += [pa.array([docs], pa.list_(pa.int64())), pa.array([ends[1:]], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "start", "doc_ids", "ends", "ids"])

        for b in portions(batches, 1, 256, 2 << 20):
            for doc_id, ids in zip(b.column(0).to_pylist(), found.lookup(b.column(1).to_pylist(), b"".join), strict=True):
                held.append(ids)
                held.append(tail)
                docs.append(doc_id)
                ends.append(ends[-1] + (len(ids) + len(tail)) // 4)
                if ends[-1] >= block_ids:
                    yield close()
                    block, start, held, docs, ends = block + 1, start + ends[-1], [], [], [0]
        if docs:
            yield close()

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le) of each document of a file set; start counts all ids before it."""
    _, decode = register(spark)
    blocks = spark.read.schema("shard int, block long, start long, doc_ids array<long>, ends array<long>, data binary").parquet(path)
    sizes = blocks.groupBy("shard").agg(F.max(F.col("start") + F.element_at("ends", -1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select(F.col("shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = blocks.join(checked_broadcast(shards), "shard").select((F.col("first") + F.col("start")).alias("at"), "doc_ids", "ends", F.expr(f"{decode}(data, ends)").alias("ids"))

    def document(doc_id: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(0)).otherwise(F.col("ends")[i - 1])
        return F.struct(doc_id.alias("doc_id"), (F.col("at") + first).alias("start"), (F.col("ends")[i] - first).alias("n_tokens"), F.col("ids")[i].alias("ids_le"))

    return placed.select(F.inline(F.transform("doc_ids", document)))
