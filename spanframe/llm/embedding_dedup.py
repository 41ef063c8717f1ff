"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Equal vectors of a label are one class first, so that copies cost one row. In each table a class is rotated several times
by three rounds of sign flips and a Hadamard transform; a hash is the closest vertex of the cross-polytope, the largest
coordinate with its sign. Besides this bucket a class goes to the PROBES - 1 next likely ones, in which one hash takes its
second vertex. Classes of one label, length and bucket are compared by cosine in double precision, so no pair below the
threshold is ever linked; a pair that meets in several buckets counts in the first of them.

The index follows the data: the number of hashes is the least that leaves a bucket of the largest label about CROWD
classes, were they spread evenly, and the number of tables the least that lets a random pair at the very threshold miss
each other in all of them with a chance of at most MISS, by the share of such pairs that meet in one table (measured on
SAMPLE of them, per length and hashes; pairs above the threshold meet more often). Its recall is 1 - MISS, 0.9999.

A bucket is compared within the task that has it, and only counts of links and the edges of a spanning forest leave it.
Buckets of over BLOCK classes are dealt into blocks, and each pair of blocks is a group of its own, so that no task needs
more than two blocks and no pair is lost.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and those without a label or
vec_id, link with nothing, stay, and are their own component (null for a null vec_id); vectors of unequal length don't
compare; rows that repeat a vec_id count as vectors of their own and link like any others, and share the component of the
smallest vec_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm.common import Scratch, bounded_batches
from spanframe.llm.components import connected_components

PROBES, BLOCK, SEED = 2, 2048, 20_240_601
CROWD, MISS, SAMPLE, MOST_HASHES = 512, 1e-4, 4_000, 6


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """x times three rounds of sign flips and a normalised fast Hadamard transform; x has a power of two columns."""
    for flip in signs:
        x = x * flip
        n, width = x.shape
        step = 1
        while step < width:
            pairs = x.reshape(n, width // (2 * step), 2, step)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def vertices(width: int) -> int:
    """Vertices of the cross-polytope of vectors of a length, padded to a power of two."""
    return 2 << max(1, (width - 1).bit_length())


def bucket_keys(vectors: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The buckets of each unit vector, PROBES of them a table, as numbers of 32 bits that mean a bucket within its table."""
    (n, width), probes = vectors.shape, PROBES
    padded = np.zeros((n, vertices(width) // 2))
    padded[:, :width] = vectors
    rng = np.random.default_rng(SEED)
    keys = []
    for _ in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = rotate(padded, rng.choice([-1.0, 1.0], (3, padded.shape[1])))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            sizes = np.take_along_axis(np.abs(y), top, 1)
            top = np.where((sizes[:, :1] >= sizes[:, 1:]), top, top[:, ::-1])
            a, b = (np.take_along_axis(y, top[:, k : k + 1], 1)[:, 0] for k in range(2))
            first.append(2 * top[:, 0] + (a < 0))
            second.append(2 * top[:, 1] + (b < 0))
            loss.append(np.abs(a) - np.abs(b))
        order = np.argsort(np.array(loss), axis=0, kind="stable")
        for p in range(probes):  # two: with one hash there is no third
            code = np.zeros(n, np.uint32)
            for h in range(hashes):
                use = (order[p - 1] == h) if p else np.zeros(n, bool)
                # where the product is over 32 bits buckets fold onto each other, the same for every vector
                code = code * np.uint32(vertices(width)) + np.where(use, second[h], first[h]).astype(np.uint32)
            for earlier in keys[len(keys) - p :]:
                code = code + (code == earlier.view(np.uint32))  # no vector is twice in a bucket
            keys.append(code.astype(np.uint32).view(np.int32))
    return np.array(keys, np.int32).T


def meeting(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether vectors of the keys a and b share a bucket of a table."""
    x, y = (z[:, table * PROBES : (table + 1) * PROBES] for z in (a, b))
    return (x[:, :, None] == y[:, None, :]).any((1, 2))


def tables_for(width: int, hashes: int, threshold: float, miss: float = MISS) -> int:
    """Tables after which a random pair at the threshold has missed each other with a chance of at most `miss`."""
    rng, trial = np.random.default_rng(SEED + 1), 8
    x, z = rng.normal(size=(2, SAMPLE, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * np.divide(z, size, out=np.zeros_like(z), where=size > 1e-9)
    a, b = (bucket_keys(v / np.linalg.norm(v, axis=1, keepdims=True), trial, hashes) for v in (x, y))
    share = np.mean([meeting(a, b, t).mean() for t in range(trial)])
    return 1 if share >= 1 else min(64, math.ceil(math.log(miss) / math.log(1 - max(share, 0.05))))


def hashes_for(width: int, classes: int) -> int:
    return max(1, min(MOST_HASHES, math.ceil(math.log(max(classes, 1) / CROWD) / math.log(vertices(width)))))


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(index: dict[int, tuple[int, int]]):
    """Adds the keys to rows (class_id, width, embedding); index: (tables, hashes) by width."""

    def run(batches):
        for b in batches:
            widths, flat = np.asarray(b.column(1)), np.asarray(b.column(2).flatten())
            starts = np.concatenate([[0], np.cumsum(widths)])
            keys: list = [None] * b.num_rows
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                x = np.concatenate([flat[starts[r] : starts[r] + width] for r in rows])
                for r, k in zip(rows, bucket_keys(unit(x, width), *index[width]), strict=True):
                    keys[r] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int32()))], names=[*b.schema.names, "keys"])

    return run


def forest(pairs: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Pairs that join different components, in order; parent holds the components found so far."""
    kept = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _groups(batches) -> Iterator[list[np.ndarray]]:
    """Columns (group, side, at, class_id, mark, copies, embedding, keys) of one group after the other, of rows sorted by group.

    Lists become matrices: the vectors of a group have one length, and so have all lists of keys.
    """
    held: list[list] = []

    def close():
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return columns

    for b in batches:
        if not b.num_rows:
            continue
        plain = [np.asarray(b.column(k)) for k in range(6)]
        lists = [(np.asarray(b.column(k).flatten()), np.concatenate([[0], np.cumsum(np.diff(np.asarray(b.column(k).offsets)))])) for k in (6, 7)]
        cuts = np.flatnonzero(plain[0][1:] != plain[0][:-1]) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if held and held[-1][0][0] != plain[0][start]:
                yield close()
            held.append([*[x[start:stop] for x in plain], *[flat[at[start] : at[stop]].reshape(stop - start, -1) for flat, at in lists]])
    if held:
        yield close()


def _compare(threshold: float):
    def linked(left: np.ndarray, right: np.ndarray, same: bool):
        """(i, j) of the rows at or over the threshold, a strip of the matrix at a time."""
        for s in range(0, len(left), 512):
            i, j = np.nonzero(left[s : s + 512] @ right.T >= threshold)
            i += s
            if same:
                i, j = i[i < j], j[i < j]
            for t in range(0, len(i), 200_000):
                yield i[t : t + 200_000], j[t : t + 200_000]

    def compare(side, at, ids, marks, copies, vectors, keys, out):
        width = vectors.shape[1]
        x, n = unit(vectors, width), len(ids)
        parts = [np.flatnonzero(side == k) for k in range(3)]
        table, parent, total = int(at[0]) // PROBES, list(range(n)), np.zeros(n, np.int64)
        for lo, hi in ((parts[0], parts[0]), (parts[1], parts[2])):
            if not len(lo) or not len(hi):
                continue
            for i, j in linked(x[lo], x[hi], lo is hi):
                i, j = lo[i], hi[j]
                # a pair counts in the first table that it meets in, and there in the first of its buckets
                a, b = keys[i], keys[j]
                met = np.zeros(len(i), bool)
                for t in range(table):
                    met |= meeting(a, b, t)
                own = slice(table * PROBES, (table + 1) * PROBES)
                common = np.where((a[:, own, None] == b[:, None, own]).any(2), a[:, own].astype(np.int64), 1 << 40).min(1)
                here = keys[i, at[i]]
                ok = ~met & (common == here)
                i, j = i[ok], j[ok]
                np.add.at(total, i, copies[j])
                np.add.at(total, j, copies[i])
                out += [(int(ids[p]), int(ids[q]), 0, 0) for p, q in forest(np.stack([i, j], 1), parent)]
        out += [(int(ids[k]), None, int(marks[k]), int(total[k])) for k in np.flatnonzero(total)]

    def run(batches):
        out: list[tuple] = []

        def rows():
            found = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["u", "v", "mark", "links"])
            out.clear()
            return found

        for _, *columns in _groups(batches):
            if len(columns[0]) > 1:
                compare(*columns, out)
            if len(out) > 20_000:
                yield rows()
        yield rows()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "embeddings")
    e = F.col("embedding")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.cast(kind).alias("embedding"), usable.alias("usable"))
    # 0.0 and -0.0 are one value to the cosine
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind))
    rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    classes = rows.where("usable").groupBy("digest", "label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    # several classes have one class_id where rows repeat a vec_id; mark tells them apart
    classes = scratch.save(classes.withColumns({"width": F.size("embedding"), "mark": F.xxhash64("digest")}), "classes")
    largest = classes.groupBy("width", "label").agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("n")).collect()  # a row a length
    index = {r.width: (tables_for(r.width, hashes_for(r.width, r.n), threshold), hashes_for(r.width, r.n)) for r in largest}

    hashed = classes.select("class_id", "width", "embedding", "label", "copies", "mark")
    hashed = hashed.mapInArrow(_hashed(index), T.StructType([*hashed.schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType()))]))
    hashed = scratch.save(hashed, "hashed")
    placed = hashed.select("class_id", "mark", F.xxhash64("label", "width").alias("own"), F.posexplode("keys").alias("at", "key"))
    bucket = F.xxhash64("own", F.floor(F.col("at") / PROBES), "key").alias("bucket")
    placed = placed.select("class_id", "mark", bucket, "at")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("class_id", "mark"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("group")
    # a block with itself is side 0; in a pair of blocks the lower is side 1 and the higher side 2
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side")
    # vectors join what is light, and then move once for each group that they are in
    dealt = dealt.select(group, side, "at", "class_id", "mark").join(hashed.select("class_id", "mark", "copies", "embedding", "keys"), ["class_id", "mark"])
    dealt = dealt.select("group", "side", "at", "class_id", "mark", "copies", "embedding", "keys").repartition("group").sortWithinPartitions("group")
    found = scratch.save(dealt.mapInArrow(_compare(threshold), "u long, v long, mark long, links long"), "found")
    scratch.drop("hashed")

    roots = connected_components(found.where("v is not null").select("u", "v"), scratch)
    counted = found.where("v is null").groupBy(F.col("u").alias("class_id"), "mark").agg(F.sum("links").alias("links"))
    per_class = classes.select("digest", "class_id", "mark", "copies").join(counted, ["class_id", "mark"], "left").join(roots, F.col("class_id") == F.col("node"), "left")
    per_class = per_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "class_id").alias("root"))
    keyed = rows.select("vec_id", "usable", F.when(F.col("usable"), F.col("digest")).otherwise(F.concat(F.lit("alone"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))).alias("digest"))
    out = keyed.join(per_class, "digest", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
