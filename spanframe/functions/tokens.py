"""Token functions: unknown tokens, content tokens, and offsets rebuilt from token texts."""

from __future__ import annotations

import unicodedata
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.functions.batches import list_array, lists_of, offset_lists, values_of

OFFSETS = "array<struct<start:int,end:int>>"


def content_tokens(tokens: Column, special_mask: Column) -> Column:
    """Tokens that the mask of special tokens leaves, over Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array, masks: pa.Array) -> pa.Array:
        return _content(lists, masks)

    return run(tokens, special_mask)


def unknown_spans(text: Column, tokens: Column, offsets: Column, unknown: Column | str) -> Column:
    """array<struct<start,end,text>> of the tokens that are the unknown token; offsets are [start, end] arrays.

    The offsets are picked over Arrow batches; lambdas see only those of unknown tokens.
    """

    @F.arrow_udf("array<array<int>>")
    def run(lists: pa.Array, places: pa.Array, other: pa.Array) -> pa.Array:
        return _unknown(lists, places, other)

    cut = lambda o: F.substring(text, o[0] + 1, o[1] - o[0])
    picked = run(tokens, offsets, F.lit(unknown) if isinstance(unknown, str) else unknown)
    return F.transform(picked, lambda o: F.struct(o[0].alias("start"), o[1].alias("end"), cut(o).alias("text")))


def _content(lists: pa.ListArray, masks: pa.ListArray) -> pa.ListArray:
    if _even(lists, masks):
        return _picked(lists, lists, pc.equal(masks.flatten(), 0))
    pairs = zip(lists_of(lists), lists_of(masks), strict=True)
    rows = [None if t is None or m is None else [x for x, y in zip_longest(t, m) if y == 0] for t, m in pairs]
    return list_array(rows, lambda flat: pa.array(flat, pa.string()))


def _unknown(lists: pa.ListArray, places: pa.ListArray, other: pa.Array) -> pa.ListArray:
    kind = pa.list_(pa.int32())
    if _even(lists, places):
        return _picked(lists, places, pc.equal(lists.flatten(), other.take(pc.list_parent_indices(lists)))).cast(pa.list_(kind))
    rows = zip(lists_of(lists), lists_of(places, pa.Array.to_pylist), values_of(other), strict=True)
    found = [None if t is None or o is None else [y for x, y in zip_longest(t, o) if x is not None and x == u] for t, o, u in rows]
    return list_array(found, lambda flat: pa.array(flat, kind))


def _even(a: pa.ListArray, b: pa.ListArray) -> bool:
    """Whether the lists of each row are as long as each other, and none is null."""
    return a.null_count == 0 and b.null_count == 0 and pc.all(pc.equal(pc.list_value_length(a), pc.list_value_length(b)), min_count=0).as_py()


def _picked(like: pa.ListArray, lists: pa.ListArray, chosen: pa.Array) -> pa.ListArray:
    """The chosen values of lists that are as long as others."""
    keep = pc.fill_null(chosen, False)
    ends = np.cumsum(pc.list_value_length(like).to_numpy(), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[np.concatenate([[0], ends])], pa.int32()), lists.flatten().filter(keep))


def rebuild_offsets(text: Column, tokens: Column, unknown: tuple[str, ...] = ("[UNK]", "<unk>")) -> Column:
    """Offsets of content tokens from their texts alone, null where a token can't be found.

    A token's text is looked for from a cursor on. A token without text takes no characters. An unknown token reaches up
    to the next token's text: of the next two tokens the first that has text and is not unknown is looked for, and if it
    is found beyond the cursor the gap is the unknown token's; else it takes one character. After a token that is not
    found the cursor is at the end of the text.

    A row's walk is plain code over an Arrow batch, one step a token; a fold of column expressions would look up and strip
    each token some ten times a step and copy what it has.
    """

    @F.arrow_udf(OFFSETS)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return offset_lists([_walked(t, own or [], unknown) for t, own in zip(values_of(texts), lists_of(lists), strict=True)])

    return run(text, tokens)


def _walked(text: str | None, tokens: list[str | None], unknown: tuple[str, ...]) -> list[tuple[int, int] | None]:
    if text is None:
        return [None] * len(tokens)
    # None of an unknown token or none at all, else the text
    bare = [None if t is None or t in unknown else t[2:] if t.startswith("##") else t[1:] if t.startswith("▁") else t for t in tokens]
    size, at, out = len(text), 0, []
    for i, (token, piece) in enumerate(zip(tokens, bare, strict=True)):
        if piece is not None:
            start = text.find(piece, at) if piece else at
            out.append((start, start + len(piece)) if start >= 0 else None)
            at = start + len(piece) if start >= 0 else size
        elif token is None:
            out.append(None)
            at = size
        else:
            # what bounds an unknown token: the next token's text, or the one's after it where the next has none
            bound = bare[i + 1] if i + 1 < len(bare) else None
            if bound == "":
                bound = bare[i + 2] if i + 2 < len(bare) else None
            found = text.find(bound, at) if bound else -1
            end = found if found > at else min(at + 1, size)
            out.append((at, end))
            at = end
    return out


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC normalisation, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised_or_plain(text: Column) -> Column:
    """The NFKC text where that keeps the length, so that offsets still hold, else the text."""
    return F.when(F.length(nfkc(text)) == F.length(text), nfkc(text)).otherwise(text)


def covering_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """struct<start,end>: from the first to the last token that shares a character with [start, end); null if none does."""
    hits = F.filter(offsets, lambda o: o.isNotNull() & (o["start"] < end) & (o["end"] > start))
    return F.when(F.size(hits) > 0, F.struct(hits[0]["start"].alias("start"), F.element_at(hits, -1)["end"].alias("end")))
