"""Toxicity: a counterfactual-regularised classifier of words.

A logistic model of the distinct words of a text, fitted by follow-the-regularised-leader with an L1 penalty that
leaves few words, on a bounded sample of labelled rows: at most POSITIVE toxic and NEGATIVE other texts, drawn by a
hash of doc_id. For each labelled text that names a group, a counterfactual is made by swapping its identity terms for
others of their list, and the squared change of the score is penalised, so that a neutral mention of a group carries
no weight of its own. A fifth of the sample sets the temperature. Scoring needs one set lookup a word; words that the
model does not hold weigh nothing, so long texts gather no chance weights.

Defined cases: a null text counts as empty; a text without known words gets the prior's score; without toxic labels
every score is 0; of several labels of one id the highest counts; null labels and ids are not learned from; a null
doc_id is held out; repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm.common import bounded_batches, held_out, portions, text_or_empty, training_row
from spanframe.llm.linear import Ftrl, softmax, temperature
from spanframe.llm.mixing import draw

POSITIVE, NEGATIVE, EPOCHS, PENALTY = 3_000, 5_000, 5, 2.0
LEAST_L1, PER_TOXIC, MOST_L1 = 4.0, 150, 8.0
#: Identity terms that may stand for each other, by list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives"), ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
#: Lengths of the beginnings of words that are features besides the words.
BEGINNINGS = (4, 5)
NAMED = frozenset(t for group in IDENTITY_TERMS for t in group)
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The distinct words, and the beginnings of the longer ones, marked, which forms of one root share.

    Identity terms have no beginnings as features, so that a swap changes all there is of them.
    """
    words = set(WORD.findall(text.lower()))
    longer = [w for w in words if len(w) > BEGINNINGS[0] and w not in NAMED]
    return words.union(*[{f"^{w[:n]}" for w in longer} for n in BEGINNINGS])


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float, scale: float, learned: bool = True):
        self.weights, self.bias, self.scale, self.learned = weights, bias, scale, learned

    def score(self, text: str) -> float:
        if not self.learned:
            return 0.0
        # in the order of code points: a sum of floats depends on its order
        total = sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip((total + self.bias) / self.scale, -500, 500))))


def counterfactual(words: set[str], terms: tuple[tuple[str, ...], ...]) -> set[str]:
    """The words with each identity term swapped for the next of its list."""
    swap = {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}
    return {swap.get(w, w) for w in words}


def fit_words(examples: list[tuple[set[str], int]], **options) -> ToxicityModel:
    """A model of (words, 0 or 1) examples."""
    words = [sorted(w) for w, _ in examples]
    flat = pa.array([w for own in words for w in own], pa.string())
    return fit_flat(flat, np.array([len(own) for own in words], int), np.array([y for _, y in examples], int), **options)


def fit_flat(flat: pa.Array, lengths: np.ndarray, labels: np.ndarray, terms=IDENTITY_TERMS, penalty: float = PENALTY, epochs: int = EPOCHS, least: int = 3, l1: float | None = None, l2: float = 0.5, alpha: float = 1.0) -> ToxicityModel:
    """A model of examples whose words lie in one array; words that fewer than `least` of them hold are left out.

    The L1 penalty follows the number of toxic examples, PER_TOXIC of them to a unit, between LEAST_L1 and MOST_L1: few
    examples bear a small penalty only, and with many of them a word must show its worth.
    """
    if not labels.any():
        return ToxicityModel({}, 0.0, 1.0, learned=False)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices)
    often = np.flatnonzero(np.bincount(codes, minlength=len(coded.dictionary)) >= least)
    frequent = dict(zip(coded.dictionary.take(pa.array(often)).to_pylist(), often.tolist(), strict=True))
    names = sorted(frequent.keys() | {t for group in terms for t in group})
    at = {w: i for i, w in enumerate(names)}
    place = np.full(len(coded.dictionary) + 1, -1)
    for w, code in frequent.items():
        place[code] = at[w]
    swap = {at[t]: at[group[(i + 1) % len(group)]] for group in terms for i, t in enumerate(group)}
    data, start = [], 0
    for n, y in zip(lengths.tolist(), labels.tolist(), strict=True):
        own = np.unique(place[codes[start : start + n]])
        own, start = own[own >= 0], start + n
        mine = set(own.tolist())
        other = {swap.get(i, i) for i in mine} if mine & swap.keys() else mine
        both = sorted(mine ^ other)
        data.append((own, y, np.array(both, int), np.array([1.0 if i in mine else -1.0 for i in both])))
    train, tune = [x for i, x in enumerate(data) if i % 5], data[::5]
    positive = sum(x[1] for x in train)
    l1 = max(LEAST_L1, min(MOST_L1, positive / PER_TOXIC)) if l1 is None else l1
    cost = (1.0, min(20.0, max(1.0, (len(train) - positive) / max(positive, 1))))
    model = Ftrl(len(at), 2, alpha=alpha, l1=l1, l2=l2)
    for _ in range(epochs):
        for own, y, both, change in train:
            model.step(own, np.ones(len(own)), y, cost[y])
            if len(both):
                model.agree(both, change, penalty)
    logits = np.array([model.logits(own, np.ones(len(own))) for own, *_ in tune]).reshape(len(tune), 2)
    scale = temperature(logits, np.array([x[1] for x in tune], int))
    w = model.weights()
    difference = w[:, 1] - w[:, 0]
    return ToxicityModel({x: float(difference[i]) for x, i in at.items() if difference[i]}, float(model.bias[1] - model.bias[0]), scale)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE, **options) -> ToxicityModel:
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(training_row() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(known.groupBy((F.col("toxic") == 1).alias("y")).count().collect())
    drawn = draw(F.concat(F.lit("toxicity"), F.col("doc_id").cast("string")))
    part = F.when(F.col("toxic") == 1, positive / max(n.get(True, 0), 1)).otherwise(negative / max(n.get(False, 0), 1))
    # about positive + negative rows are drawn, so the side has a bound
    picked = known.withColumn("draw", drawn).where(F.col("draw") < part).limit(2 * (positive + negative))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id").select("draw", "doc_id", "toxic", "text")

    def features(batches):
        for b in portions(batches, 3):
            words = pa.array([sorted(words_of(t)) for t in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], words], names=["draw", "doc_id", "toxic", "words"])

    schema = picked.select("draw", "doc_id", F.col("toxic").cast("int").alias("toxic")).schema.add("words", T.ArrayType(T.StringType()))
    # rows that repeat an id are drawn together, so their number is bounded here
    rows = texts.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(features, schema).orderBy("draw", "doc_id").limit(4 * (positive + negative)).toArrow()
    rows = rows.take(pc.sort_indices(rows, [("draw", "ascending"), ("doc_id", "ascending")])).combine_chunks()
    if not rows.num_rows:
        return ToxicityModel({}, 0.0, 1.0, learned=False)
    words = rows.column("words").combine_chunks()
    return fit_flat(words.flatten(), np.diff(np.asarray(words.offsets)), (np.asarray(rows.column("toxic")) == 1).astype(int), **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with score and predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, text_or_empty().alias("text_to_score"))

    def run(batches):
        own = shared.value
        for b in portions(batches, len(keep)):
            scores = pa.array([own.score(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, docs.select(*keep).schema.add("score", "double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
