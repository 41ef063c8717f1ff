"""Run systems over a gold table and build their result documents. A system that fails gives an unevaluated result."""

from __future__ import annotations

import platform
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from spanframe.model import LABELS, RULES, SCORED_TIERS
from spanframe.operators.scoring import false_per_1000, join_predictions, latency_summary, negatives, row_counts, score_by_label, score_by_tier
from spanframe.plans.adapters import Metadata, Registry, System, Unavailable
from spanframe.sources.sinks import write_predictions, write_result

WARMUP = 10


def base_metadata(path: str, sha256: str, n: int) -> dict:
    now = datetime.now(UTC).isoformat(timespec="seconds")
    return {"hardware": platform.platform(), "python": platform.python_version(), "date_utc": now, "testset_path": path, "testset_sha256": sha256, "n_examples": n}


def unevaluated(reason: str, base: dict) -> dict:
    nothing = dict.fromkeys(("model_id", "model_version", "size_mb", "data_leaves_machine", "bytes_sent", "package_versions"))
    return {"status": "unevaluated", "reason": reason, "metadata": nothing | base, "config": None, "metrics": None, "latency_ms": None}


def metrics(gold: DataFrame, predictions: DataFrame) -> dict[str, dict]:
    """The metrics of every system, from three small results of one join."""
    joined = join_predictions(gold, predictions).persist()
    counts = row_counts(joined)
    rates = {"p": "precision", "r": "recall", "f1": "f1", "tp": "tp", "fp": "fp", "fn": "fn"}
    out: dict[str, dict] = {}
    for r in score_by_label(counts).collect():
        out.setdefault(r.system, {x: {} for x in RULES})[r.rule][r.label] = {short: r[k] for short, k in rates.items()}
    for r in negatives(joined).collect():
        out[r.system]["negatives"] = {"n": r.n, "examples_with_any_prediction": r.fired, "fpr": r.fpr}
    for r in false_per_1000(joined).collect():
        out[r.system]["false_entities_per_1000_chars"] = r.false_per_1000
    for r in score_by_tier(counts).collect():
        out[r.system].setdefault("by_tier", {t: {} for t in SCORED_TIERS})[r.tier][f"{r.rule}_micro_f1"] = r.f1
    joined.unpersist()
    return out


def latency(system: System, gold: DataFrame, n: int, warmup: int = WARMUP) -> dict | None:
    """Percentiles of the system's calls after the warm-up; None for a system that can't be timed a sentence at a time."""
    calls = system.calls(gold)
    row = None if calls is None else latency_summary(calls, min(warmup, n)).first()
    return {k: row[k] for k in ("p50", "p95", "mean", "n", "warmup")} if row else None


def evaluate(system: System, gold: DataFrame, base: dict, out: Path | None = None) -> dict:
    """One system's result document: scores, its own counters, and latencies of single sentences."""
    try:
        metadata: Metadata = system.load()
    except Unavailable as e:
        return unevaluated(str(e), base)
    try:
        found = system.predict(gold).persist()
        scores = metrics(gold, found)[system.name]
        if out is not None:
            write_predictions(gold, found, out / "predictions" / f"{system.name}.jsonl")
        found.unpersist()
        counted, timed = system.counters(gold), latency(system, gold, base["n_examples"])
    except Exception as e:  # one system's failure must not stop the others
        return unevaluated(f"{type(e).__name__}: {e}", base)
    document = {"status": "evaluated", "reason": None, "metadata": vars(metadata) | base | counted, "metrics": scores, "latency_ms": timed}
    return document | {"config": {"label_mapping": dict(system.label_mapping), "params": dict(system.params)}}


def run_all(registry: Registry, selectors: list[str], gold: DataFrame, out: Path, path: str, sha256: str, limit: int | None = None) -> int:
    """Evaluate the selected systems, write their results, and return 1 if any could not be evaluated.

    limit takes the first rows of the file; the hash is of the whole file.
    """
    rows = gold if limit is None else gold.where(gold.ord < limit)
    base, failed = base_metadata(path, sha256, rows.count()), 0
    for key in registry.resolve(selectors):
        try:
            result = evaluate(registry.build(key), rows, base, out)
        except Exception as e:
            result = unevaluated(f"{type(e).__name__}: {e}", base)
        failed |= result["status"] != "evaluated"
        write_result(result, out / f"{key}.json")
    return int(failed)


__all__ = ["LABELS", "base_metadata", "evaluate", "metrics", "run_all", "unevaluated"]
