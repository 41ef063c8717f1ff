"""Byte-level BPE by the ranks of a file: encoding with offsets, and decoding.

The rank file becomes a tokenizer of the tokenizers library: bytes are written as the 256 printable characters of
the byte table, and every split of an entry into two entries becomes a merge of the entry's rank, so that the
library merges the pairs that the ranks order. Decoding reverses the byte table: the characters of each entry of that
tokenizer's vocabulary become bytes again, and a character whose bytes lie in several tokens comes back whole, as the
bytes of all tokens are joined before anyone reads them as UTF-8. Offsets map tokens to code points through the lengths
of these bytes; a character that several tokens share is in the offsets of each.

Defined cases: a null text counts as empty (no ids, no bytes); a null doc_id is kept; repeated rows give repeated
rows; other columns of the input are ignored; an empty table gives an empty result; an unknown id is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bounded_batches, portions, release, text_or_empty
from spanframe.llm.pretokens import TABLE_ROWS, byte_characters, frequent_pretokens, sample_texts, vocabulary, worker_table

ENTRIES = 32_768


def read_ranks(path: str) -> dict[bytes, int]:
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def tokenizer_definition(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers definition that encodes each match of the pattern by the ranks."""
    char = byte_characters()
    as_text = lambda b: "".join(char[x] for x in b)
    merges = [
        [as_text(token[:k]), as_text(token[k:])]
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {as_text(t): r for t, r in ranks.items()}, "merges": merges,
    }
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model,
    })


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


def character_offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first code point, end exclusive) of each token of so many bytes; a token that holds part of a character covers it."""
    char_of_byte = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char_of_byte[ends - lengths], char_of_byte[ends - 1] + 1


def split_characters(starts: np.ndarray, ends: np.ndarray) -> int:
    """How many code points lie in several tokens."""
    return len(np.unique(starts[1:][starts[1:] < ends[:-1]]))


def decoded(ids_le: bytes, table: list[bytes]) -> bytes:
    """The bytes that ids stand for; tokens are joined before anyone reads them as characters. An unknown id is an error."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids_le, "<u4").tolist()))


def encode_by_definition(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decode: bool = False, entries: int = ENTRIES, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, n_tokens, ids_le): ids_le are the ids as little-endian unsigned 32-bit integers.

    With offsets=True also offsets, array<struct<start:int,end:int>> in code points; with decode=True also decoded, the
    bytes that the ids stand for, read back from them in the same pass, and n_split, how many characters several tokens
    share by the offsets of what was decoded.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    shared = spark.sparkContext.broadcast((definition, frequent_pretokens(sample_texts(kept, table_rows), definition, id_bytes, entries)))
    release()  # what the table needed
    schema = f"{id_col} {kept.schema[0].dataType.simpleString()}, n_tokens long, ids_le binary"
    schema += ", offsets array<struct<start:int,end:int>>" * offsets + ", decoded binary, n_split long" * decode

    def run(batches):
        definition, frequent = shared.value
        found = worker_table("ids-" + hashlib.sha256(definition.encode()).hexdigest(), frequent, id_bytes, definition)
        table, lengths = found.bytes_of_ids() if offsets or decode else ([], None)
        for b in portions(batches, 1, 256, 2 << 20):
            texts = b.column(1).to_pylist()
            ids = list(found.lookup(texts, b"".join))
            columns = {b.schema.names[0]: b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_le": pa.array(ids, pa.binary())}
            if offsets:
                spans = [character_offsets(t.encode(), lengths[np.frombuffer(x, "<u4")]) for t, x in zip(texts, ids, strict=True)]
                flat = [pa.array(np.concatenate([np.zeros(0, np.int32), *[x[k] for x in spans]]), pa.int32()) for k in range(2)]
                ends = np.cumsum([0, *[len(x[0]) for x in spans]])
                columns["offsets"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=["start", "end"]))
            if decode:
                back = [decoded(x, table) for x in ids]
                columns["decoded"] = pa.array(back, pa.binary())
                columns["n_split"] = pa.array([split_characters(*character_offsets(t, lengths[np.frombuffer(x, "<u4")])) for t, x in zip(back, ids, strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(run, schema)


def encode_bpe(docs: DataFrame, ranks: str, pattern: str, **options) -> DataFrame:
    """encode_by_definition() by the ranks of a .tiktoken file, each match of the pattern separately."""
    return encode_by_definition(docs, tokenizer_definition(read_ranks(ranks), pattern), **options)


def decode_bpe(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with decoded in place of ids_le: the bytes that its ids stand for. An id outside the file is an error."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(tokenizer_definition(read_ranks(ranks), "")))
    at = encoded.columns.index("ids_le")
    schema = encoded.drop("ids_le").schema.add("decoded", "binary")

    def run(batches):
        for b in portions(batches, at):
            texts = [decoded(x, shared.value) for x in b.column(at).to_pylist()]
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Digests of the ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256; and n_split."""
    both = encode_bpe(docs, ranks, pattern, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
