"""Writers: byte-exact small files on the driver, tables by Spark."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.model import no_spans


def write_text(path: str | Path, text: str, force: bool = True) -> None:
    """Write a small file, its folder too; with force=False an existing one is an error."""
    target = Path(path)
    if target.exists() and not force:
        raise FileExistsError(f"{target} exists and may hold answers")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def completed_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ord, id, spans) of every gold row in its order, no spans where a prediction is missing."""
    out = gold.select("ord", "id").join(predictions.select("id", "spans"), "id", "left")
    return out.select("ord", "id", F.coalesce("spans", no_spans()).alias("spans")).orderBy("ord")


def write_predictions(gold: DataFrame, predictions: DataFrame, path: str | Path) -> None:
    """One system's predictions as JSON lines with sorted keys, written row by row and put in place when complete."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    unfinished = target.with_name(f".{target.name}.unfinished")
    with unfinished.open("w", encoding="utf-8") as out:
        for r in completed_predictions(gold, predictions).toLocalIterator():
            out.write(json.dumps({"id": r.id, "spans": [s.asDict() for s in r.spans]}, ensure_ascii=False, sort_keys=True) + "\n")
    unfinished.replace(target)


def write_result(result: dict, path: str | Path) -> None:
    write_text(path, json.dumps(result, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def write_dump(df: DataFrame, path: str, by: str) -> None:
    """Token dumps or timed runs as a table partitioned by tokenizer or model."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
