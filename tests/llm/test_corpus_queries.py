"""The registered corpus queries against their oracles, and the pipeline against its own parts by brute force."""

import hashlib
import re
import sys
from collections import Counter

import compare
import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from spanframe.llm import byte_bpe
from spanframe.llm.common import release_driver
from spanframe.llm.queries import ORACLE_SQL, QUERIES

SF = f"{compare.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == []


def test_there_is_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def shingle_set(text, width=5):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = docs.collect()
        ids = {r.doc_id for r in after}
        assert ids <= set(before) and all(r == before[r.doc_id] for r in after)
        if name == "language_id":
            assert {i for i, r in before.items() if r.text and any(map(str.isalpha, r.text))} == ids
        elif name == "exact_dedup":
            assert Counter(re.sub("[ \t-\r]", "", before[i].text) for i in ids) == Counter({re.sub("[ \t-\r]", "", r.text): 1 for r in before.values()})
        elif name == "ngram_dedup":
            sets = {i: shingle_set(r.text) for i, r in before.items()}
            near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            gone = set(before) - ids
            assert not any(near(a, b) for a in ids for b in ids if a < b)
            assert all(any(near(a, b) for b in before if b != a) for a in gone)
        else:
            assert 0 < len(after) and max(Counter(r.doc_id for r in after).values()) <= 2
        docs, before = spark.createDataFrame(after, docs.schema), {r.doc_id: r for r in after}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())
    for r in last:
        assert r.n_tokens == len(library.encode_ordinary(before[r.doc_id].text))
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, near copies, and columns of clashing names."""
    near = " ".join(f"word{i}" for i in range(200))
    rows = [(i, f"the water and the stone number {i} of the house by the river light", "en", "a", 5) for i in range(60)]
    rows += [(100 + i, f"das wasser und der stein nummer {i} des hauses am fluss und licht", "de", None, None) for i in range(60)]
    rows += [(200, near, "en", "b", None), (201, near + " more", "en", "b", None), (202, "long " * 60_000, "en", "b", None), (203, "x" * 200_000, None, "b", None)]
    rows += [(None, "the water and the river", None, None, None), (None, None, None, None, None), (300, None, "en", "a", None), (301, "", "en", "a", None), (302, "12 34 !?", "en", "a", None)]
    rows += [rows[0], rows[0], (1, "the light of another text by the same number and the river", "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "id", "sha", "key", "digest", "size", "copies", "score", "bin", "place", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_pipeline_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    columns, rows = docs.columns, Counter(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        kept = out.collect()
        assert kept and all(repr(r) in rows for r in kept)
        texts = [r.text for r in kept]
        if name == "language_id":
            assert len(kept) == sum(rows.values()) - 4 and None not in texts and "" not in texts and Counter(r.doc_id for r in kept)[None] == 1
        elif name == "exact_dedup":
            assert len(texts) == len(set(texts)) and Counter(r.doc_id for r in kept)[0] == 1 and Counter(r.doc_id for r in kept)[1] == 2
        elif name == "ngram_dedup":
            assert 200 in [r.doc_id for r in kept] and 201 not in [r.doc_id for r in kept] and Counter(r.doc_id for r in kept)[None] == 1
        docs = spark.createDataFrame(kept, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    odd_documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages_give_the_driver_s_memory_back(spark, monkeypatch):
    jvm, client = spark.sparkContext._jvm, spark.sparkContext._gateway._gateway_client
    for operator in ("drop_unidentified", "drop_copies", "drop_near_copies", "draw_mix", "round_trip"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda docs, *args, **options: docs)
    for name, stage in corpus_pipeline.STAGES:
        garbage = jvm.java.lang.Object()
        left = jvm.java.lang.ref.WeakReference(garbage)
        client.garbage_collect_object(garbage._target_id, False)  # Python's hold on it
        stage(spark, spark.range(0), SF)
        assert left.get() is None, name
    assert release_driver(spark) or not sys.platform.startswith("linux")
