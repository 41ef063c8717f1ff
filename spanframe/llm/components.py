"""Connected components of a table of links, by alternating large and small stars; nothing goes to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanframe.llm.common import Scratch

#: Links up to which one task joins them all at once; beyond, stars do, however many there are.
IN_ONE_TASK = 10_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or no larger) neighbours to its smallest neighbour."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a hub's neighbours are split by AQE when they are joined to its one row of least
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.where(F.col("v") != F.col("m"))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _joined_at_once(batches):
    """(node, root) of the links of all batches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(np.asarray(b.column(0)).tolist(), np.asarray(b.column(1)).tolist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    found = [(x, r) for x in sorted(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["node", "root"])


def _saved(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """edges as a scratch table, and their number and a digest, observed as they are written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"))
    saved = scratch.save(marked, name)
    return saved, (seen.get["n"], seen.get["digest"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node that reaches a smaller one; root is the smallest that it reaches. Roots have no row.

    edges: columns u and v; repeated links, loops and both directions may occur, null ends don't count.
    """
    now = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now, here = _saved(now.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), scratch, f"{name}-0")
    if here[0] <= IN_ONE_TASK:
        return now.coalesce(1).mapInArrow(_joined_at_once, "node long, root long")
    before, step = None, 0
    while here != before:
        before, step = here, step + 1
        now, here = _saved(_star(_star(now, True), False), scratch, f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
