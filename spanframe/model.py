"""Schemas and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("PERSON", "ADDRESS", "ORG")
SCORED_TIERS = ("easy", "medium", "hard")
TIERS = (*SCORED_TIERS, "negative")
RULES = ("exact", "overlap")

SPAN = "struct<start:int,end:int,label:string>"
SPANS = f"array<{SPAN}>"
EXAMPLE = f"id string, text string, entities {SPANS}, tier string, seed int, template_id string"
GOLD = f"id string, text string, spans {SPANS}, tier string"
PREDICTIONS = f"id string, spans {SPANS}"
LABEL_SCORES = "struct<" + ",".join(f"{x}:struct<p:double,r:double,f1:double,tp:bigint,fp:bigint,fn:bigint>" for x in ("ADDRESS", "ORG", "PERSON", "micro")) + ">"
TIER_SCORES = "struct<" + ",".join(f"{t}:struct<exact_micro_f1:double,overlap_micro_f1:double>" for t in SCORED_TIERS) + ">"
#: A result document. Every field may be missing: unevaluated systems have few, and older files lack newer fields.
RESULT = f"""
  status string, reason string,
  metadata struct<model_id:string,model_version:string,size_mb:double,data_leaves_machine:boolean,bytes_sent:bigint,
    package_versions:map<string,string>,hardware:string,python:string,date_utc:string,testset_path:string,testset_sha256:string,
    n_examples:bigint,parse_failures:bigint,unlocated_spans:bigint,relocated_spans:bigint,ignored_spans:bigint,span_location:string>,
  config struct<label_mapping:map<string,string>,params:string>,
  metrics struct<exact:{LABEL_SCORES},overlap:{LABEL_SCORES},negatives:struct<n:bigint,examples_with_any_prediction:bigint,fpr:double>,
    false_entities_per_1000_chars:double,by_tier:{TIER_SCORES}>,
  latency_ms struct<p50:double,p95:double,mean:double,n:bigint,warmup:bigint>
"""
TOKEN_DUMP = f"""
  id string, source string, tier string, text string, text_len_chars int, entities {SPANS}, input_ids array<int>, tokens array<string>,
  offsets array<array<int>>, special_tokens_mask array<int>, content_tokens array<string>, num_ids int,
  unk_char_spans array<struct<start:int,end:int,text:string>>
"""
CALLS = "system string, ord long, ms double"
TIMED_RUN = "run_id string, model string, condition string, cold_load_ms double, first_inference_ms double, latencies_ms array<double>, error string, timed_out boolean"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def dimension(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    """A fixed list as (name, rank), to broadcast: results hold every member, also those without rows."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, rank int")
