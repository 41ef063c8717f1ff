"""N-gram Jaccard join by signature trees: documents whose sets of word shingles are nearly equal, and their groups.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, shingles are hashed to 64 bits. Texts of equal sets are one class.
Classes meet where they share a shingle of their prefix: in one order of all shingles, two sets that are similar enough
share one of their first |x| - ceil(t |x|) + 1. Any order keeps every link; this one is rarest first (by the frequency
of the words, from one pass over all texts) and puts shingles of many documents last, so that passages in many
documents bring nobody together unless they are most of a document.

Meeting classes are compared in two rounds, and no table of pairs is ever made. The first links each class to the
smallest class of its place (a linear number of pairs), checks these exactly and finds their components. The second is
the join proper, over the places where components still meet, each set of classes once:

- A signature tree over the classes of a place, by size, whose nodes hold the OR of their classes' token bitmaps and
  their size range, is traversed against itself; nodes of one component, of sizes too far apart or whose largest possible
  overlap is too small are pruned. Of the pairs left open a place gives the edges of a spanning forest alone, and the
  components of these edges over all places are families: every pair that is still open lies within one.
- The classes of a family come with their whole sets to one task (or, where that is cheaper, place by place), where the
  same trees, now over exact sets, are traversed: leaves of classes are compared by their shingles, a found link merges
  components at once so that pairs of one component are skipped from then on, and only forest edges leave the task.

A place or family of over BLOCK classes, or of many shingles, is dealt into blocks, and each pair of blocks is a tree
join of its own; so a task holds two blocks at most, and no pair is lost.

Defined cases: a text that is null, empty or white space has an empty set, links with nothing and is its own component;
with fewer words than a shingle the whole sequence is the one shingle; rows that repeat a doc_id are one node (each row
keeps its own n_shingles); a null doc_id is its own component (null); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import Scratch, bounded_batches, by_hot_key, checked_broadcast, kept_by_worker, portions, text_or_empty
from spanframe.llm.components import connected_components

#: Classes and shingles of a block, children of a node, and classes of a leaf over exact sets.
BLOCK, BLOCK_SHINGLES, LEAF, SET_LEAF = 2048, 2_000_000, 8, 32
#: What a shingle of a family that meets as a whole counts against one that meets place by place.
FAMILY_COST = 1.0
#: Shares from which words count as frequent and shingles as common, and bounds of the two broadcast tables.
FREQUENT, COMMON, MOST_ENTRIES = 1e-5, 1 / 512, 1 << 18
FILTER_BITS = 1 << 25
#: Words that a worker keeps the hashes of, and whose counts it holds.
CACHE, COUNTED = 150_000, 300_000


class Shingler:
    """Shingle sets of texts; words are hashed once and kept."""

    def __init__(self, width: int, frequent: dict[int, int] | None = None):
        self.width, self.frequent = width, frequent or {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hashes, self.scores = np.zeros(4096, np.uint64), np.zeros(4096, np.int64)

    def make_room(self) -> None:
        if len(self.index) > CACHE:
            self.reset()

    def words(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        try:
            return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        for w in set(words).difference(self.index):
            i = self.index[w] = len(self.index)
            if i == len(self.hashes):
                self.hashes, self.scores = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.scores, self.scores])
            h = xxhash.xxh3_64_intdigest(w)
            self.hashes[i], self.scores[i] = h, self.frequent.get(h, 0)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def all_shingles(self, at: np.ndarray) -> np.ndarray:
        """Hashes of a text's shingles in order, repeated ones too."""
        k = min(self.width, len(at))
        if not k:
            return np.zeros(0, np.uint64)
        words = self.hashes[at]
        h = np.full(len(at) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(at) - k + 1 + i]
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))

    def shingles(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct hashes, scores) of a text's words; a higher score is a more frequent shingle."""
        h = self.all_shingles(at)
        scores = np.cumsum(np.concatenate([[0], self.scores[at]]))
        k = min(self.width, len(at))
        h, first = np.unique(h, return_index=True)
        return h, scores[first + k] - scores[first]


def prefix(h: np.ndarray, scores: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that a similar set must share one of: rarest first, common ones last."""
    n = len(h)
    most = n - (percent * n + 99) // 100 + 1
    last = np.zeros(n, bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        last = common[at] == h
    rank = ((last.astype(np.uint64) << np.uint64(10)) + np.minimum(scores, 1023).astype(np.uint64)) << np.uint64(53)
    order = rank | (h >> np.uint64(11))
    return h[np.argpartition(order, most - 1)[:most]] if most < n else h


def bitmap(h: np.ndarray, per: int = 1) -> bytes:
    """The token bitmap: one bit a shingle, in a power of two of bits, more than `per` times as many as shingles.

    Of the shingles that another set lacks, a share of exp(-1/per) or more has a bit that the other has not, so one bit a
    shingle rules out sets that have little in common, and more bits leave few pairs open besides those near the threshold.
    """
    bits = max(256, per << len(h).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


#: Shingles that are counted together; with so many buckets few of them need exact counts.
CHUNK, BUCKET_BITS = 2_000_000, 20


def frequent_in(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of those that occur at least `least` times."""
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    h = h[np.bincount(bucket, minlength=1 << BUCKET_BITS)[bucket] >= least]
    h, n = np.unique(h, return_counts=True)
    return h[n >= least], n[n >= least]


def _statistics(width: int):
    """Counts of frequent words and of shingles that are common somewhere; every text counts, rare entries are left out."""

    def run(batches):
        own, words, total, out = kept_by_worker(("shingles", width), lambda: Shingler(width)), {}, 0, []
        held, docs, size, seen, rare = [], 0, 0, [], 1

        def count_words():
            if seen:
                n = np.bincount(np.concatenate(seen), minlength=len(own.index))
                for i in np.flatnonzero(n).tolist():
                    h = int(own.hashes[i])
                    words[h] = words.get(h, 0) + int(n[i])
                seen.clear()

        def close():
            nonlocal docs, size
            if held:
                h, n = frequent_in(np.concatenate(held), max(8, int(docs * COMMON)))
                out.extend(("shingle", a, c) for a, c in zip(h.view(np.int64).tolist(), n.tolist(), strict=True))
            held.clear()
            docs = size = 0

        for b in portions(batches, 0):
            for text in b.column(0).to_pylist():
                if len(own.index) > CACHE:
                    count_words()
                    own.reset()
                at = own.words(text)
                seen.append(at)
                total += len(at)
                held.append(own.all_shingles(at))
                docs, size = docs + 1, size + len(at)
                if size > CHUNK:
                    close()
                    count_words()
                    while len(words) > COUNTED:  # what frequent words count is short by little; only the order depends on it
                        words = {w: n for w, n in words.items() if n > rare}
                        rare *= 2
        close()
        count_words()
        least = max(2, total * FREQUENT / 4)
        out += [("word", int(np.uint64(w).view(np.int64)), n) for w, n in words.items() if n >= least] + [("words", 0, total)]
        columns = [pa.array([x[0] for x in out], pa.string()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "hash", "n"])

    return run


def _sketches(width: int, percent: int, shared):
    key = uuid.uuid4().hex

    def run(batches):
        frequent, common = shared.value
        own = kept_by_worker(("sketches", width, key), lambda: Shingler(width, frequent))
        for b in portions(batches, 1):
            found = []
            for text in b.column(1).to_pylist():
                own.make_room()
                h, s = own.shingles(own.words(text))
                if len(h):
                    found.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), prefix(h, s, common, percent).view(np.int64), bitmap(h)))
                else:
                    found.append((0, b"", np.zeros(0, np.int64), b""))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([x[k] for x in found], kinds[k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n", "digest", "prefix", "bits"])

    return run


def _leaders(percent: int):
    """Of the sorted rows of a place, the smallest class that each may be similar to; places of one row go."""

    def run(batches):
        held = None
        for b in [*_whole_places(batches)]:
            key, salt, n, rep = (np.asarray(b[k]) for k in range(4))
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.concatenate([new[1:], [len(key)]])
            lead = np.arange(len(key))
            several = ends - new > 1
            for s, e in zip(new[several].tolist(), ends[several].tolist(), strict=True):
                while s < e:
                    stop = s + int(np.searchsorted(n[s:e], n[s] * 100 // percent, side="right"))
                    lead[s:stop] = s
                    s = stop
            keep = np.repeat(several, ends - new) | (salt >= 0)
            held = [pa.array(x[keep], pa.int64()) for x in (key, n, rep, rep[lead], n[lead])]
            yield pa.RecordBatch.from_arrays(held, names=["key", "n", "rep", "lead", "lead_n"])

    return run


def _whole_places(batches):
    """Column arrays of batches cut where a place (key, salt) ends."""
    held = None
    for b in batches:
        now = [np.asarray(c) for c in b.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) < 50_000:
            continue
        cut = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(cut):
            yield [x[: cut[-1] + 1] for x in held]
            held = [x[cut[-1] + 1 :] for x in held]
    if held is not None and len(held[0]):
        yield held


def folded(bits: int, width: int, to: int) -> int:
    """A bitmap at a smaller width: halves laid over each other."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def bitmaps_allow(n: int, x: int, x_width: int, m: int, y: int, y_width: int, percent: int) -> bool:
    """Whether two sets of n and m shingles may overlap enough: a bit that one alone has is a shingle that the other lacks."""
    width = min(x_width, y_width)
    x, y = folded(x, x_width, width), folded(y, y_width, width)
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return most * (100 + percent) >= percent * (n + m)


def allowed(a: tuple, b: tuple, percent: int) -> bool:
    """bitmaps_allow() of two (size, id, root, width, bits) classes."""
    return bitmaps_allow(a[0], a[4], a[3], b[0], b[4], b[3], percent)


class Signature:
    """A node of a signature tree: classes by size, their size range, the OR of their bitmaps, their component if it is one."""

    def __init__(self, members: list, parts: list[Signature]):
        self.members, self.parts = members, parts
        self.low, self.high = members[0][0], members[-1][0]
        roots = {p.root for p in parts} if parts else {m[2] for m in members}
        self.root = roots.pop() if len(roots) == 1 else None
        self.width = min(p.width for p in parts) if parts else min(m[3] for m in members)
        self.made: dict[int, tuple[int, int]] = {}

    def at(self, width: int) -> tuple[int, int]:
        """(OR of the bitmaps, most shingles of a class that share a bit with others of it) at a width."""
        if width not in self.made:
            if self.parts:
                below = [p.at(width) for p in self.parts]
            else:
                below = []
                for size, _, _, own, bits in self.members:
                    bits = folded(bits, own, width)
                    below.append((bits, size - bits.bit_count()))
            union = 0
            for bits, _ in below:
                union |= bits
            self.made[width] = (union, max(s for _, s in below))
        return self.made[width]


def tree(members: list, leaf: int = 1) -> Signature:
    """The signature tree over (size, id, root, width, bits) classes, by size, with `leaf` of them in a leaf."""
    members = sorted(members, key=lambda m: m[:2])
    level = [Signature(members[i : i + leaf], []) for i in range(0, len(members), leaf)]
    while len(level) > 1:
        level = [Signature([m for p in level[i : i + LEAF] for m in p.members], level[i : i + LEAF]) for i in range(0, len(level), LEAF)]
    return level[0]


def may_overlap(a: Signature, b: Signature, percent: int) -> bool:
    """Whether some class below a may be similar to some class below b."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    if a.root is not None and a.root == b.root:
        return False
    width = min(a.width, b.width)
    (bits_a, slack_a), (bits_b, slack_b) = a.at(width), b.at(width)
    most = (bits_a & bits_b).bit_count() + min(slack_a, slack_b)
    return most * (100 + percent) >= percent * (a.low + b.low)


def dual_traversal(a: Signature, b: Signature, percent: int):
    """Pairs of leaves below two trees, or within one tree if both are the same, that may hold similar classes."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if x.root is None:
                if x.parts:
                    stack += [(p, q) for i, p in enumerate(x.parts) for q in x.parts[i:]]
                else:
                    yield x, y
        elif may_overlap(x, y, percent):
            if not x.parts and not y.parts:
                yield x, y
            elif x.parts and (not y.parts or len(x.members) >= len(y.members)):
                stack += [(p, y) for p in x.parts]
            else:
                stack += [(x, p) for p in y.parts]


class Forest:
    """Union-find over 0..n-1; what have one name are one from the start."""

    def __init__(self, names: list):
        first: dict = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(names)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if i and j were of different components until now."""
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def trees(side: list[int], make):
    """The trees to traverse against each other: block with itself (side 0), and the lower with the higher (1 and 2)."""
    for x, y in ((0, 0), (1, 2)):
        left, right = ([i for i, s in enumerate(side) if s == z] for z in (x, y))
        if left and right:
            one = make(left)
            yield one, (one if x == y else make(right))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b; only shingles of two sets or more need a column."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[place]
    out = np.zeros((len(a), len(b)), np.int64)
    for start in range(0, int(column.max(initial=-1)) + 1, 1 << 15):
        here = (column >= start) & (column < start + (1 << 15))
        m = np.zeros((len(a) + len(b), 1 << 15 if start or column.max() >= 1 << 15 else int(column.max()) + 1), np.float32)
        m[owner[here], column[here] - start] = 1
        out += (m[: len(a)] @ m[len(a) :].T).astype(np.int64)
    return out


def _grouped(columns: int, close):
    """mapInArrow function over rows (group, columns) sorted by group: close(lists of a group) gives edges (u, v)."""

    def run(batches):
        name, held, out = None, [[] for _ in range(columns)], []

        def rows():
            found, out[:] = sorted(set(out)), []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["u", "v"])

        for b in batches:
            for group, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != name:
                    if len(held[0]) > 1:
                        out.extend(close(*held))
                    for h in held:
                        h.clear()
                    name = group
                    if len(out) > 100_000:
                        yield rows()
                for h, x in zip(held, row, strict=True):
                    h.append(x)
        if len(held[0]) > 1:
            out.extend(close(*held))
        yield rows()

    return run


def place_join(percent: int):
    """Of a place's classes (side, rep, n, root, bits): a spanning forest of the pairs that bitmaps leave open."""

    def close(side, rep, n, root, bits):
        members = [(n[i], i, root[i], 8 * len(bits[i]), int.from_bytes(bits[i], "little")) for i in range(len(rep))]
        forest = Forest(range(len(rep)))
        for top, other in trees(side, lambda own: tree([members[i] for i in own])):
            for x, y in dual_traversal(top, other, percent):
                i, j = x.members[0][1], y.members[0][1]
                if root[i] != root[j] and forest.root(i) != forest.root(j) and allowed(x.members[0], y.members[0], percent):
                    forest.join(i, j)
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])

    return close


def family_join(percent: int):
    """Of a family's classes (side, rep, root, shingles): links, of exact sets, that join components."""

    def close(side, rep, root, shingles):
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        size = np.array([len(x) for x in sets])
        forest = Forest(root)

        def member(i):
            bits = bitmap(sets[i], 4)
            return len(sets[i]), i, root[i], 8 * len(bits), int.from_bytes(bits, "little")

        for top, other in trees(side, lambda own: tree([member(i) for i in own], SET_LEAF)):
            for x, y in dual_traversal(top, other, percent):
                a, b = ([m[1] for m in z.members] for z in (x, y))
                ra, rb = (np.array([forest.root(i) for i in z]) for z in (a, b))
                na, nb = size[a][:, None], size[b][None, :]
                still = (ra[:, None] != rb[None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                if x is y:
                    still &= np.triu(np.ones(still.shape, bool), 1)
                if still.sum() <= SET_LEAF // 2:
                    linked = [(i, j) for i, j in np.argwhere(still).tolist() if allowed(x.members[i], y.members[j], percent) and similar(sets[a[i]], sets[b[j]], percent)]
                else:
                    both = overlaps([sets[i] for i in a], [sets[i] for i in b])
                    linked = np.argwhere(still & (100 * both >= percent * (na + nb - both))).tolist()
                for i, j in linked:
                    if forest.join(a[i], b[j]):
                        yield min(rep[a[i]], rep[b[j]]), max(rep[a[i]], rep[b[j]])

    return close


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of shingles link."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def star_join(percent: int):
    """Links of a class to its leader: rows (group, side, rep, shingles), sorted so that a group's leader (side 0) is first."""

    def run(batches):
        name, leaders = None, []
        for b in batches:
            found = []
            for group, side, rep, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(shingles, np.uint64)
                if group != name:
                    name, leaders = group, []
                if side == 0:
                    leaders.append((rep, own))  # several only where rows repeat a doc_id
                else:
                    found += [(min(lead, rep), max(lead, rep)) for lead, theirs in leaders if similar(theirs, own, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["u", "v"])

    return run


def _sets(width: int, shared):
    def run(batches):
        own, wanted = kept_by_worker(("shingles", width), lambda: Shingler(width)), np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for b in portions(batches, 1):
            rows = np.flatnonzero(wanted[np.asarray(b.column(2))])
            texts = b.column(1).take(pa.array(rows)).to_pylist()
            own.make_room()
            sets = [np.unique(own.all_shingles(own.words(t))).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def sets_of(ids: DataFrame, docs: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """(rep, shingles) of at least the texts whose doc_id is in ids.rep: sets are made again only where they are needed."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    places = ids.select((slot("rep") + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    wanted = bytearray(FILTER_BITS // 8)  # a fixed size; where it fills up, more sets are made, and none is lost
    for row in places.collect():
        wanted[(row.k - 1) * 4096 : row.k * 4096] = row.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(wanted))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"), slot("doc_id").alias("slot"))
    return scratch.save(texts.mapInArrow(_sets(width, shared), "rep long, shingles binary"), name)


def _bitmaps_allow(percent: int):
    """Pairs whose bitmaps leave room for enough overlap."""

    def run(batches):
        for b in batches:
            ok = []
            for n, x, m, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                ok.append(bitmaps_allow(n, int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["lead", "rep"])

    return run


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (lead, rep) of classes that their bitmaps don't rule out."""
    side = lambda c, n, bits: classes.select(F.col("rep").alias(c), F.col("n").alias(n), F.col("bits").alias(bits))
    joined = pairs.join(side("rep", "m", "y"), "rep").join(side("lead", "n", "x"), "lead")
    return joined.select("lead", "rep", "n", "x", "m", "y").mapInArrow(_bitmaps_allow(percent), "lead long, rep long")


def star_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (lead, rep) whose whole sets are similar enough; a leader of many is copied to several groups."""
    many = checked_broadcast(pairs.groupBy("lead").count().where(F.col("count") > BLOCK).select("lead", F.ceil(F.col("count") / BLOCK).alias("parts")))
    salt = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    pairs = scratch.save(pairs.join(many, "lead", "left").select("lead", "rep", salt.alias("salt")), "stars")
    leads = pairs.select("lead", "salt").distinct()
    sets = sets_of(pairs.select("rep").unionByName(leads.select(F.col("lead").alias("rep"))), docs, width, scratch, "star-sets")
    group = F.xxhash64("lead", "salt").alias("group")
    members = pairs.select(group, F.lit(1).alias("side"), "rep").unionByName(leads.select(group, F.lit(0).alias("side"), F.col("lead").alias("rep")))
    dealt = members.join(sets, "rep").select("group", "side", "rep", "shingles").repartition("group").sortWithinPartitions("group", "side")
    links = scratch.save(dealt.mapInArrow(star_join(percent), "u long, v long").distinct(), "links")
    scratch.drop("stars")
    scratch.drop("star-sets")
    return links


def dealt_in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """(group, side, rep, columns) of members (place, blocks, rep, columns): a group for each pair of blocks of a place."""
    own = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return own.select(group.alias("group"), side.alias("side"), "rep", *columns).repartition("group").sortWithinPartitions("group")


def blocks_of(classes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")


def compared_together(families: DataFrame, members: DataFrame) -> DataFrame:
    """(place, blocks, rep, root): the groups in which the classes of families (rep, family, n, root) meet with their sets.

    A family meets as a whole, where each set goes once. One of several blocks may meet place by place (members) instead, if
    that moves fewer shingles: a chain of many classes of which few are alike would be far more pairs as a whole than its
    places have. Such families have over BLOCK classes or BLOCK_SHINGLES shingles each, so there are few to choose for.
    """
    large = families.groupBy("family").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"), F.sum("n").alias("total")).where(FAMILY_COST * F.col("blocks") > 1)
    here = members.select("place", F.col("blocks").alias("pairs"), "rep").join(families.join(checked_broadcast(large), "family"), "rep")
    apart = here.groupBy("family").agg(F.sum(F.col("n") * F.col("pairs")).alias("apart"), F.first("blocks").alias("as_whole"), F.first("total").alias("total"))
    chosen = checked_broadcast(apart.select("family", "as_whole", (FAMILY_COST * F.col("total") * F.col("as_whole") > F.col("apart")).alias("by_place")))
    marked = families.join(chosen, "family", "left")
    together = marked.where(~F.coalesce("by_place", F.lit(False))).select(F.col("family").alias("place"), F.coalesce("as_whole", F.lit(1).cast("long")).alias("blocks"), "rep", "root")
    split = here.join(chosen.where("by_place"), "family").select(F.xxhash64("family", "place").alias("place"), F.col("pairs").alias("blocks"), "rep", "root")
    return together.unionByName(split)


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.select("doc_id", text_or_empty().alias("text"))

    counts = texts.select("text").mapInArrow(_statistics(width), "kind string, hash long, n long")
    counts = scratch.save(counts.groupBy("kind", "hash").agg(F.sum("n").alias("n")), "counts")
    n_words = counts.where("kind = 'words'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_docs = texts.count()
    words = counts.where((F.col("kind") == "word") & (F.col("n") >= n_words * FREQUENT)).orderBy(F.desc("n"), "hash").limit(MOST_ENTRIES).toArrow()
    common = counts.where((F.col("kind") == "shingle") & (F.col("n") >= n_docs * COMMON)).orderBy(F.desc("n"), "hash").limit(MOST_ENTRIES).select("hash").toArrow()
    scores = np.ceil(4 * np.log2(np.asarray(words["n"], float) / max(1.0, n_words * FREQUENT))).astype(int) + 1
    frequent = dict(zip(np.asarray(words["hash"]).astype(np.int64).view(np.uint64).tolist(), np.minimum(scores, 120).tolist(), strict=True))
    last = np.sort(np.asarray(common["hash"]).astype(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((frequent, last))
    scratch.drop("counts")

    sketch = texts.mapInArrow(_sketches(width, percent, shared), "doc_id long, n long, digest binary, prefix array<long>, bits binary")
    sketch = scratch.save(sketch, "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    light = scratch.save(sketch.select("doc_id", "n", "digest"), "light")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = scratch.save(classes, "classes")
    scratch.drop("sketch")

    # round 1: each class and the smallest of its place; a place of many classes is dealt out by exact counts
    keyed = classes.select("rep", "n", F.explode("prefix").alias("key"))
    often = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > BLOCK), "often")
    placed = keyed.join(checked_broadcast(often), "key", "left")
    salt = F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("rep"), F.ceil(F.col("often") / BLOCK))).otherwise(F.lit(-1)).cast("long")
    placed = placed.select("key", salt.alias("salt"), "n", "rep").repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "rep")
    places = scratch.save(placed.mapInArrow(_leaders(percent), "key long, n long, rep long, lead long, lead_n long"), "places")
    leaders = places.select("key", "lead", "lead_n").where("rep = lead").distinct()
    first = leaders.groupBy("key").agg(F.min(F.struct("lead_n", "lead")).alias("least"), F.count("*").alias("many")).where("many > 1")
    across = leaders.join(first, "key").where((F.col("lead") != F.col("least.lead")) & (100 * F.col("least.lead_n") >= percent * F.col("lead_n")))
    pairs = places.where("rep != lead").select("lead", "rep").unionByName(across.select(F.col("least.lead").alias("lead"), F.col("lead").alias("rep"))).distinct()
    links = star_links(scratch.save(plausible(pairs, classes, percent), "pairs"), docs, width, percent, scratch)
    scratch.drop("pairs")
    roots = scratch.save(connected_components(links, scratch, "first"), "roots")

    # round 2: the tree join of places where components still meet; places of the same classes are one
    rooted = places.select("key", "rep", "n").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    scratch.drop("places")
    met = rooted.groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("many"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    ).where("a != b")
    met = met.groupBy("many", "total", "x", "y").agg(F.min("key").alias("key")).select("key", blocks_of(F.col("many"), F.col("total")).alias("blocks"))
    members = scratch.save(rooted.join(met, "key").withColumnRenamed("key", "place"), "members")
    scratch.drop("rooted")
    near = dealt_in_blocks(members.join(classes.select("rep", "bits"), "rep"), "n", "root", "bits").mapInArrow(_grouped(5, place_join(percent)), "u long, v long").distinct()
    near = scratch.save(near, "near")
    families = connected_components(near, scratch, "families").select(F.col("node").alias("rep"), F.col("root").alias("family"))
    families = families.unionByName(families.select(F.col("family").alias("rep"), "family").distinct())  # a root is of its own family
    families = families.join(classes.select("rep", "n"), "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    families = scratch.save(families.select("rep", "family", "n", F.coalesce("root", "rep").alias("root")), "families")
    members = compared_together(families, members).join(sets_of(families, docs, width, scratch, "sets"), "rep")
    more = scratch.save(dealt_in_blocks(members, "root", "shingles").mapInArrow(_grouped(4, family_join(percent)), "u long, v long").distinct(), "more")
    for name in ("sets", "members", "near"):
        scratch.drop(name)
    roots = connected_components(links.unionByName(more), scratch, "second")

    answers = classes.join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.col("copies").alias("rows"), F.coalesce("root", "rep").alias("component_id"))
    full = light.where("n > 0 and doc_id is not null")
    grouped = by_hot_key(full.select("doc_id", F.col("n").alias("n_shingles"), "digest"), answers, "digest", n_docs)
    alone = light.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all their columns."""
    groups = jaccard_groups(docs, width, percent)
    gone = Scratch(docs.sparkSession, "near").save(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
