"""Scans of the file formats: JSON lines, word lists, result documents, forms, token dumps, timed runs."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.config import Settings
from spanframe.functions.spans import display_problem
from spanframe.model import EXAMPLE, RESULT, TIMED_RUN, TOKEN_DUMP, dimension
from spanframe.operators.relational import tagged_union


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, line) of each line, by "\n" alone and from 0 in each file.

    A large file is read in splits: a line's place in its split is counted among the lines of that split alone, and the
    lines of the splits before it come from one small row a split.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), "value")
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("turn")) - 1
    placed = lines.withColumn("turn", F.monotonically_increasing_id()).select("path", "block", "value", within.alias("within"))
    return placed.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("within")).cast("int").alias("ord"), F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """Rows of a JSON-lines file with their place (ord); blank lines are skipped, a bad line has null fields."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema).alias("row"), "ord").select("row.*", "ord")


def gold_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, spans, tier, ord), the columns that scoring needs."""
    return json_lines(spark, path).select("id", "text", F.col("entities").alias("spans"), "tier", "ord")


def validated_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns of an example file, or an error that names the first line that is not a valid row."""
    rows = json_lines(spark, path).withColumn("problem", F.when(F.col("id").isNull() | F.col("text").isNull() | F.col("entities").isNull(), "not a row").otherwise(display_problem(F.col("text"), F.col("entities"))))
    bad = rows.where("problem is not null").orderBy("ord").select("ord", "id", "problem").first()
    if bad is not None:
        raise ValueError(f"{path}:{bad.ord + 1} ({bad.id}): {bad.problem}")
    return rows.drop("problem")


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Words of a list, one a line; blank lines and those that begin with # (before any space) don't count."""
    trimmed = F.regexp_replace("value", r"^(?U)\s+|\s+$", "")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r\n|\n|\r")).alias("value"))
    return [r[0] for r in rows.where(~F.col("value").startswith("#")).select(trimmed).where(F.length(trimmed) > 0).collect()]


def word_table(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    return spark.createDataFrame([(w,) for w in word_list(spark, path)], f"{column} string")


def blocked_names(spark: SparkSession, path: str | None = None) -> frozenset[str]:
    """Names that must not be generated: the list at the path, which must exist, or the default one, if it does."""
    default = str(Settings().data_dir / "blocklist.txt")
    return frozenset(word_list(spark, path or default)) if path or exists(spark, default) else frozenset()


def predictions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(id, spans, ord, system) of prediction files by system."""
    schema = "id string, spans array<struct<start:int,end:int,label:string>>"
    return tagged_union({system: json_lines(spark, path, schema) for system, path in paths.items()}, "system")


def result_documents(spark: SparkSession, folder: str, order: Iterable[str]) -> DataFrame:
    """(key, rank, ...) of the result files named in order that exist, in that order, under a schema in which all may be missing."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("key"), "value")
    read = raw.select("key", F.from_json("value", RESULT).alias("r")).select("key", "r.*")
    return read.join(F.broadcast(dimension(spark, "key", tuple(order))), "key").orderBy("rank")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def folder_mib(spark: SparkSession, path: str) -> float | None:
    """Size of the files below a folder in MiB, two digits; None where it can't be read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.agg(F.round(F.sum("length") / 2**20, 2)).first()[0] or 0.0
    except Exception as e:  # a missing or unreadable folder is an answer here
        if "PATH_NOT_FOUND" in str(e) or "Permission" in str(e):
            return None
        raise


def first_sentences(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(ord, text) of the first n rows in file order: n is the feature."""
    return json_lines(spark, path).select("ord", "text").orderBy("ord").limit(n)


def source_union(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Example files by source, with columns that one lacks as null."""
    return tagged_union({name: json_lines(spark, path) for name, path in paths.items()})


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file under a schema; no rows where it does not exist."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def token_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_DUMP).json(path, multiLine=True)


def timed_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMED_RUN).json(path, multiLine=True)


def unknown_token(spark: SparkSession, path: str) -> str:
    """The unknown token of a tokenizer definition: its name, or the entry that its id has in the vocabulary."""
    model = json.loads(spark.read.text(path, wholetext=True).first()[0])["model"]
    if model.get("unk_token"):
        return model["unk_token"]
    if model.get("unk_id") is None:
        raise ValueError(f"{path} has no unknown token")
    return model["vocab"][model["unk_id"]][0]
