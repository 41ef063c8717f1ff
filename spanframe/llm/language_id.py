"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are the 1- to ORDER-grams of lower-cased words with a space at either side, hashed to DIMS places; a text's
term frequencies are shares of its n-grams, times the inverse document frequency in the sample. Training is
follow-the-regularised-leader with elastic-net penalties on the driver, over a sample of at most SAMPLE labelled rows,
about as many of each language, drawn by a hash of doc_id; a fifth of the sample sets the temperature that calibrates
the probabilities. As a text's score is linear in its words, each worker scores a distinct word once and keeps it.

Defined cases: a text that is null or has no letter gets `und` with score 0; so does every text when no row is labelled;
with one label every text with a letter gets it; a null doc_id is held out; repeated rows get equal answers; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bounded_batches, checked_broadcast, held_out, kept_by_worker, portions, release, training_row
from spanframe.llm.linear import Ftrl, softmax, temperature
from spanframe.llm.mixing import draw

ORDER, DIMS, SAMPLE, EPOCHS, SCALE = 3, 1 << 17, 6_000, 2, 100.0
WORDS_KEPT, LONGEST_KEPT = 120_000, 48
UNKNOWN = "und"
#: Calibrated probability below which a text counts as of no language. It is low, as short texts in a language stay.
REJECT_BELOW = 0.3


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, index of the word of each), for all words together."""
    padded = "".join([f" {w} " for w in words])
    chars = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    hashes, owners, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(chars), np.uint64)
    for n in range(1, ORDER + 1):
        if len(chars) < n:
            break
        m = len(chars) - n + 1
        h = h[:m] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
        ok = word[:m] == word[n - 1 :]
        if n == 1:
            ok &= chars != 32
        mixed = (h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
        hashes.append(mixed.astype(np.int64))
        owners.append(word[:m][ok])
    return np.concatenate(hashes), np.concatenate(owners)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    grams, _ = gram_features(text.lower().split())
    at, counts = np.unique(grams, return_counts=True)
    return at, counts


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, scale: float):
        self.labels, self.weights, self.bias, self.scale = labels, weights, bias, scale
        self.index, self.rows, self.used = {}, np.zeros((1024, len(labels) + 1), np.float32), 0

    def _score(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each word's n-grams, and their number."""
        grams, owner = gram_features(words)
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, self.weights[grams, k], len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def _learn(self, words: list[str]) -> None:
        if self.used + len(words) > WORDS_KEPT:
            self.index, self.used = {}, 0
        scores = self._score(words)
        while self.used + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used : self.used + len(words)] = scores
        self.index.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def predict(self, texts: list[str | None]) -> Iterable[tuple[str, float]]:
        for start in range(0, len(texts), 64):
            part = texts[start : start + 64]
            split = [t.lower().split() if self.labels and has_letter(t) else None for t in part]
            distinct = set().union(*[s for s in split if s])
            fresh = list(distinct.difference(self.index))
            if fresh and self.used + len(fresh) > WORDS_KEPT:
                self.index, self.used, fresh = {}, 0, list(distinct)
            short = [w for w in fresh if len(w) <= LONGEST_KEPT]
            if short:
                self._learn(short)
            odd = {w: self._score([w])[0] for w in fresh if len(w) > LONGEST_KEPT}
            for words in split:
                if words is None:
                    yield UNKNOWN, 0.0
                    continue
                kept = [w for w in words if w not in odd] if odd else words
                total = self.rows[list(map(self.index.__getitem__, kept))].sum(0, dtype=np.float64)
                for w in words if odd else ():
                    if w in odd:
                        total = total + odd[w]
                p = softmax((total[:-1] / max(total[-1], 1.0) + self.bias) / self.scale)
                k = int(np.argmax(p))
                yield self.labels[k], min(1.0, max(0.0, float(p[k])))


def labelled_sample(docs: DataFrame, sample: int) -> list[tuple]:
    """(lang, draw, doc_id, places, counts) of about sample / languages rows of each language."""
    rows = docs.where(training_row() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = F.count("*").over(_whole())
    quotas = counts.select(F.col("lang").alias("quota_lang"), (F.lit(float(sample)) / languages / F.col("n")).alias("part"))
    drawn = draw(F.concat(F.lit("language"), F.col("doc_id").cast("string")))
    picked = rows.select("doc_id", "lang", "text", drawn.alias("draw")).join(checked_broadcast(quotas), F.col("lang") == F.col("quota_lang")).where(F.col("draw") < F.col("part"))

    def features(batches):
        for b in portions(batches, 3):
            found = [term_counts(t or "") for t in b.column(3).to_pylist()]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists], names=["lang", "draw", "doc_id", "places", "counts"])

    # features are made where the texts are; rows that repeat an id are drawn together, so their number is bounded here
    found = picked.select("lang", "draw", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = found.mapInArrow(features, "lang string, draw double, doc_id long, places array<int>, counts array<int>")
    found = found.orderBy("draw", "doc_id").limit(2 * sample).toArrow()
    columns = [found.column(k).combine_chunks() for k in range(5)]
    order = sorted(range(found.num_rows), key=lambda i: (columns[1][i].as_py(), columns[2][i].as_py()))
    return [(columns[0][i].as_py(), np.asarray(columns[3][i].values), np.asarray(columns[4][i].values)) for i in order]


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def fit(docs: DataFrame, sample: int = SAMPLE, l1: float = 0.02, l2: float = 0.1, alpha: float = 0.5) -> LanguageModel:
    rows = [(lang, at, c) for lang, at, c in labelled_sample(docs, sample) if len(at)]
    labels = sorted({r[0] for r in rows})
    if len(labels) < 2:
        return LanguageModel(labels, np.zeros((DIMS, len(labels)), np.float32), np.zeros(len(labels)), 1.0)
    seen = np.zeros(DIMS)
    for _, at, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    values = lambda at, c: c / c.sum() * SCALE * idf[at]  # noqa: E731  made when they are used: they are twice as large as the counts
    train, tune = [x for i, x in enumerate(rows) if i % 5], rows[::5]
    model = Ftrl(DIMS, len(labels), alpha=alpha, l1=l1, l2=l2)
    for _ in range(EPOCHS):
        for lang, at, c in train:
            model.step(at, values(at, c), labels.index(lang))
    logits = np.array([model.logits(at, values(at, c)) for _, at, c in tune]).reshape(len(tune), len(labels))
    scale = temperature(logits, np.array([labels.index(lang) for lang, *_ in tune], int))
    return LanguageModel(labels, (model.weights() * idf[:, None] * SCALE).astype(np.float32), model.bias, scale)


def identify(docs: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",), model: LanguageModel | None = None) -> DataFrame:
    """The columns `keep` of each row with lang_pred and score; docs need text, and lang and doc_id if no model is given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = model or fit(docs, sample)
    shared, key = spark.sparkContext.broadcast((model.labels, model.weights, model.bias, model.scale)), uuid.uuid4().hex
    release()  # what the fit needed
    rows = docs.select(*keep, F.col("text").alias("text_to_identify"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        own = kept_by_worker(("language", key), lambda: LanguageModel(*shared.value))
        for b in portions(batches, len(keep)):
            found = list(own.predict(b.column(b.num_columns - 1).to_pylist()))
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def drop_unidentified(docs: DataFrame, least: float = REJECT_BELOW, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and a language of at least this score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = fit(docs, sample)
    shared, key = spark.sparkContext.broadcast((model.labels, model.weights, model.bias, model.scale)), uuid.uuid4().hex
    release()  # what the fit needed
    at = docs.columns.index("text")

    def run(batches):
        own = kept_by_worker(("language", key), lambda: LanguageModel(*shared.value))
        for b in portions(batches, at):
            keep = [lang != UNKNOWN and score >= least for lang, score in own.predict(b.column(at).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_report(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
