"""Matching of gold and predicted spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions.arrays import let
from spanframe.functions.batches import list_array, lists_of, struct_array, tuples_of
from spanframe.model import LABELS, RULES


def exact_match(gold: Column, pred: Column) -> Column:
    return (gold["start"] == pred["start"]) & (gold["end"] == pred["end"])


def overlap_match(gold: Column, pred: Column) -> Column:
    """Half-open intersection: spans that only touch don't match."""
    return (gold["start"] < pred["end"]) & (pred["start"] < gold["end"])


MATCHERS = {"exact": exact_match, "overlap": overlap_match}


def greedy_match(gold: Column, preds: Column, rule: str) -> Column:
    """struct<tp,fp,fn>: each gold span in turn claims the first predicted span left that matches it."""
    return let(F.struct(gold.alias("gold"), preds.alias("preds")), lambda x: _claimed(x["gold"], x["preds"], rule))


def _claimed(gold: Column, preds: Column, rule: str) -> Column:
    matches = MATCHERS[rule]
    zero = F.struct(preds.alias("left"), F.lit(0).alias("tp"), F.lit(0).alias("fn"))

    def claim(acc: Column, g: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda p: matches(g, p)), True).cast("int")
        hit = at > 0
        rest = F.concat(F.slice(acc["left"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["left"], at + 1, F.size(acc["left"])))
        return F.struct(F.when(hit, rest).otherwise(acc["left"]).alias("left"), (acc["tp"] + hit.cast("int")).alias("tp"), (acc["fn"] + (~hit).cast("int")).alias("fn"))

    counts = F.aggregate(gold, zero, claim, lambda acc: F.struct(acc["tp"].alias("tp"), F.size(acc["left"]).alias("fp"), acc["fn"].alias("fn")))
    nothing = F.struct(F.lit(0).alias("tp"), F.size(preds).alias("fp"), F.size(gold).alias("fn"))
    return F.when((F.size(gold) == 0) | (F.size(preds) == 0), nothing).otherwise(counts)


def of_label(spans: Column, label: Column | str) -> Column:
    return F.filter(spans, lambda s: s["label"] == label)


COUNTS = "array<struct<rule:string,label:string,tp:int,fp:int,fn:int>>"
_COUNTS = pa.struct([("rule", pa.string()), ("label", pa.string()), ("tp", pa.int32()), ("fp", pa.int32()), ("fn", pa.int32())])


def label_counts(gold: Column, preds: Column, rules: tuple[str, ...] = RULES) -> Column:
    """greedy_match() of each label's spans under each rule, over Arrow batches; one pass of a row serves all of them."""

    @F.arrow_udf(COUNTS)
    def run(golds: pa.Array, found: pa.Array) -> pa.Array:
        return _batch_counts(golds, found, rules)

    return run(gold, preds)


def _batch_counts(golds: pa.ListArray, found: pa.ListArray, rules: tuple[str, ...]) -> pa.ListArray:
    """label_counts() of a batch: what a label has once on either side is compared as whole columns, the rest span by span."""
    if not (_whole(golds) and _whole(found)):
        rows = zip(lists_of(golds, tuples_of), lists_of(found, tuples_of), strict=True)
        return list_array([_row_counts(g, p, rules) for g, p in rows], lambda flat: struct_array(flat, _COUNTS))
    rows, kinds = len(golds), len(LABELS) * len(rules)
    (n_gold, first_gold, gold), (n_pred, first_pred, pred) = (_by_label(x) for x in (golds, found))
    met = (n_gold > 0) & (n_pred > 0)
    once = np.flatnonzero(met & (n_gold == 1) & (n_pred == 1))
    (start, end), (a, b) = gold[:, first_gold[once]], pred[:, first_pred[once]]
    tp = np.zeros((len(n_gold), len(rules)), np.int32)
    for at, rule in enumerate(rules):
        tp[once, at] = (start == a) & (end == b) if rule == "exact" else (start < b) & (a < end)
    met[once] = False
    for cell in np.flatnonzero(met).tolist():
        mine, theirs = ([(*x, None) for x in s[:, f[cell] : f[cell] + n[cell]].T.tolist()] for s, f, n in ((gold, first_gold, n_gold), (pred, first_pred, n_pred)))
        for at, rule in enumerate(rules):
            tp[cell, at] = _matched(mine, list(theirs), rule == "exact")
    repeated = lambda names: pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(kinds), rows)))
    counts = [tp.ravel(), (n_pred[:, None] - tp).ravel(), (n_gold[:, None] - tp).ravel()]
    columns = [repeated(list(rules) * len(LABELS)), repeated([x for x in LABELS for _ in rules]), *[pa.array(c, pa.int32()) for c in counts]]
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * kinds), pa.StructArray.from_arrays(columns, fields=list(_COUNTS)))


def _whole(lists: pa.ListArray) -> bool:
    """Whether nothing is null in any row."""
    return lists.null_count == 0 and (flat := lists.flatten()).null_count == 0 and all(c.null_count == 0 for c in flat.flatten())


def _by_label(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each label of each row how many spans it has and the place of the first; starts and ends, in order, in these places."""
    flat = lists.flatten()
    label = pc.fill_null(pc.index_in(flat.field("label"), pa.array(LABELS)), -1).to_numpy()
    cell = pc.list_parent_indices(lists).to_numpy() * len(LABELS) + label
    known = np.flatnonzero(label >= 0)
    order = known[np.argsort(cell[known], kind="stable")]
    n = np.bincount(cell[known], minlength=len(lists) * len(LABELS)).astype(np.int32)
    return n, np.cumsum(n) - n, np.stack([flat.field(c).to_numpy()[order] for c in ("start", "end")])


def _row_counts(gold: list[tuple] | None, preds: list[tuple] | None, rules: tuple[str, ...]) -> list[tuple]:
    out = []
    for label in LABELS:
        g = None if gold is None else [s for s in gold if s[2] == label]
        p = None if preds is None else [s for s in preds if s[2] == label]
        for rule in rules:
            if g is None or p is None:
                # a missing side has no count; neither has what would meet it
                known = g == [] or p == []
                out.append((rule, label, 0 if known else None, len(p) if known and p is not None else None, len(g) if known and g is not None else None))
            elif not g or not p:
                out.append((rule, label, 0, len(p), len(g)))
            else:
                tp = _matched(g, list(p), rule == "exact")
                out.append((rule, label, tp, len(p) - tp, len(g) - tp))
    return out


def _matched(gold: list[tuple], left: list[tuple], exact: bool) -> int:
    tp = 0
    for start, end, _ in gold:
        for i, (a, b, _) in enumerate(left):
            if None not in (start, end, a, b) and ((start == a and end == b) if exact else (start < b and a < end)):
                del left[i]
                tp += 1
                break
    return tp
