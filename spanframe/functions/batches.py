"""Between Arrow arrays and plain values, for what Python does with a batch: spans and offsets as tuples, lists by their offsets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
OFFSET_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def values_of(array: pa.Array) -> list:
    """An array's values; bytes that are no UTF-8 count as U+FFFD, as they do in the JVM's strings."""
    if array.null_count == 0 and pa.types.is_integer(array.type):
        return array.to_numpy().tolist()
    try:
        # the fast way for texts
        return array.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(array.type) else array.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in array.cast(pa.binary()).to_pylist()]


def lists_of(array: pa.ListArray, values: Callable[[pa.Array], list] = values_of) -> list[list | None]:
    """Each row's list; null stays None."""
    cuts = array.offsets.to_numpy().tolist()
    first = cuts[0] if cuts else 0
    flat = values(array.values[first : cuts[-1]] if cuts else array.values)
    rows = [flat[a - first : b - first] for a, b in zip(cuts, cuts[1:])]
    return rows if array.null_count == 0 else [r if there else None for r, there in zip(rows, array.is_valid().to_pylist(), strict=True)]


def tuples_of(array: pa.StructArray) -> list[tuple]:
    """Structs as tuples of their fields, all None where a struct is null."""
    return list(zip(*map(values_of, array.flatten()), strict=True))


def list_array(rows: list[list | None], values: Callable[[list], pa.Array]) -> pa.ListArray:
    """lists_of() the other way."""
    cuts = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) if r else 0 for r in rows], out=cuts[1:])
    missing = pa.array([r is None for r in rows], pa.bool_()) if None in rows else None
    return pa.ListArray.from_arrays(pa.array(cuts), values([x for r in rows if r for x in r]), mask=missing)


def struct_array(rows: list[tuple | None], kind: pa.StructType) -> pa.StructArray:
    """tuples_of() the other way; a struct of None is null."""
    missing = pa.array([r is None for r in rows], pa.bool_()) if None in rows else None
    own = rows if missing is None else [(None,) * len(kind) if r is None else r for r in rows]
    columns = zip(*own, strict=True) if own else [[]] * len(kind)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind), mask=missing)


def span_lists(rows: list[list | None]) -> pa.ListArray:
    return list_array(rows, lambda flat: struct_array(flat, SPAN_TYPE))


def offset_lists(rows: list[list | None]) -> pa.ListArray:
    return list_array(rows, _offsets)


def _offsets(flat: list[tuple[int, int] | None]) -> pa.StructArray:
    # numbers in one pass, which costs about a tenth of columns of tuples
    missing = np.fromiter((x is None for x in flat), bool, len(flat)) if None in flat else None
    own = flat if missing is None else [(0, 0) if x is None else x for x in flat]
    start, end = np.fromiter(chain.from_iterable(own), np.int32, 2 * len(own)).reshape(-1, 2).T.copy()
    return pa.StructArray.from_arrays([pa.array(start, mask=missing), pa.array(end, mask=missing)], fields=list(OFFSET_TYPE), mask=None if missing is None else pa.array(missing))
