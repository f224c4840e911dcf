"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is fitted from confirmed toxic
texts and from texts of which nothing is known. With p the share of toxic texts among the
unlabelled (the class prior), the risk of calling a text harmless is estimated without any
negative label as

    p * R(toxic, wanted toxic) + max(0, R(unlabelled, wanted harmless) - p * R(toxic, wanted harmless))

and where the second term falls below zero the step goes the other way, which keeps the
estimator from overfitting (non-negative PU learning). The loss is logistic.

Only fitting is bounded: at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts, taken by
the smallest hash of their text. Scoring reads every whole text, in Arrow batches, with
the weights in the task's closure (2**20 bytes, whatever the corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.registry import query

#: Texts a fit takes at most.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
#: Hashed features, and the lengths in bytes of word beginnings among them (besides whole words).
FEATURES, BEGINNINGS = 1 << 18, (4, 6, 8)
#: Passes over the sample, texts in a step, step size and weight decay of the fit.
EPOCHS, STEP_TEXTS, STEP_SIZE, DECAY = 20, 512, 0.02, 1e-4
#: A feature enters the fit when its count among the positive texts is so many standard deviations off the unlabelled.
LEAST_SCORE = 5.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature numbers of all texts in turn, where each text's begin; one more at the end).

    Words are runs of bytes other than ASCII white space and punctuation, lower-cased in A-Z.
    """
    data, starts = ta.joined(texts)
    data = ta.lower_ascii(data)
    plain = np.where(_LETTERS[data], data, 10).astype(np.uint8)
    first, end = ta.word_bounds(plain)
    sums = ta.prefix_sums(plain)
    hashes = [ta.range_hashes(sums, first, end)]
    places = [first]
    for size in BEGINNINGS:
        longer = end - first > size
        hashes.append(ta.range_hashes(sums, first[longer], first[longer] + size) ^ np.uint64(size))
        places.append(first[longer])
    owner = np.searchsorted(starts, np.concatenate(places), side="right") - 1
    number = (np.concatenate(hashes) % np.uint64(FEATURES)).astype(np.int64)
    pairs = np.unique(owner * FEATURES + number)
    return (pairs % FEATURES).astype(np.uint32), np.searchsorted(pairs, np.arange(len(texts) + 1) * FEATURES)


_LETTERS = np.ones(256, dtype=bool)
_LETTERS[:48] = _LETTERS[58:65] = _LETTERS[91:97] = _LETTERS[123:128] = False


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margins(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[numbers], dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]] + self.bias

    def scores(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(numbers, bounds))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def distinct(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One text of those that share their smallest mixed feature numbers: most copies and near copies go.

    Copies of one toxic text would otherwise make all of its words look like marks of toxicity.
    """
    seen, out = set(), []
    for text in texts:
        for size in (1, 2):  # two chances for near copies to meet
            low = np.sort(ta.mix(text.astype(np.uint64) * np.uint64(size + 4)))[:3].tobytes() + bytes([size])
            if low in seen:
                break
        else:
            out.append(text)
        for size in (1, 2):
            seen.add(np.sort(ta.mix(text.astype(np.uint64) * np.uint64(size + 4)))[:3].tobytes() + bytes([size]))
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 7) -> Model:
    """A linear model from the feature numbers of positive and unlabelled texts."""
    weights = np.zeros(FEATURES)
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    if not positive or not unlabelled:
        # nothing is known of one of the sides: every text gets the prior
        return Model(weights.astype(np.float32), float(np.log(prior / (1 - prior))))
    counts = [np.bincount(np.concatenate(x), minlength=FEATURES) for x in (positive, unlabelled)]
    rates = [(c + 0.5) / (len(x) + 1) for c, x in zip(counts, (positive, unlabelled))]
    off = (counts[0] - len(positive) * rates[1]) / np.sqrt(len(positive) * rates[1] * (1 - np.minimum(rates[1], 0.99)))
    used = np.flatnonzero((np.abs(off) >= LEAST_SCORE) & (counts[0] + counts[1] > 3))
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    scale = np.log(rates[0] / rates[1])[used]  # a feature counts by how much oftener it stands in toxic texts
    texts = [place[t] for t in (*positive, *unlabelled)]
    texts = [t[t >= 0] for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64)
    dense = np.concatenate(texts)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n_positive, n = len(positive), len(sizes)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    rng, step = np.random.default_rng(seed), 0
    steps = max(1, -(-n // STEP_TEXTS))
    for _ in range(EPOCHS):
        parts = zip(np.array_split(rng.permutation(n_positive), steps), np.array_split(n_positive + rng.permutation(n - n_positive), steps))
        for p_rows, u_rows in parts:
            if not len(p_rows) or not len(u_rows):
                continue
            rows = np.concatenate([p_rows, u_rows])
            own = sizes[rows]
            at = np.repeat(bounds[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            numbers = dense[at]
            sums = np.concatenate([[0.0], np.cumsum(w[numbers] * scale[numbers])])
            ends = np.cumsum(own)
            margin = sums[ends] - sums[ends - own] + w[-1]
            share = _sigmoid(margin)
            k = len(p_rows)
            # logistic loss: wanted toxic log(1 + e^-g), wanted harmless log(1 + e^g)
            harmless = np.logaddexp(0, margin[k:]).mean() - prior * np.logaddexp(0, margin[:k]).mean()
            slope = np.empty(len(rows))
            if harmless >= 0:
                slope[:k] = prior * ((share[:k] - 1) - share[:k]) / k
                slope[k:] = share[k:] / (len(rows) - k)
            else:  # walk back out of the negative part
                slope[:k] = prior * share[:k] / k
                slope[k:] = -share[k:] / (len(rows) - k)
            step += 1
            grad = np.bincount(numbers, weights=np.repeat(slope, own) * scale[numbers], minlength=len(w))
            grad[-1] = slope.sum()
            grad[:-1] += DECAY * w[:-1]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= STEP_SIZE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights[used] = w[:-1] * scale
    return Model(weights.astype(np.float32), float(w[-1]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(2)):
            numbers, bounds = features(texts)
            yield pa.record_batch([*(batch.column(i).slice(first, last - first) for i in (0, 1)), pa.array(
                [numbers[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["hash", "toxic", "numbers"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model, key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(model.scores(*features(texts)))],
                                  names=[key, "score"])


def fit_toxicity(df: DataFrame, toxic_keys: DataFrame, prior: float, key: str = "doc_id", text: str = "text") -> Model:
    """A model from the texts of ``df`` whose keys stand in ``toxic_keys`` and from the others as unlabelled.

    ``toxic_keys`` has one column, the key. Equal texts count once, as toxic if one of them
    is. The sample is the texts with the smallest hashes on either side, so the same rows
    give the same model, however they are stored.
    """
    marks = toxic_keys.toDF("key").where("key IS NOT NULL").distinct().withColumn("toxic", F.lit(True))
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL AND key IS NOT NULL")
    known = (texts.select("key", F.xxhash64("text").alias("hash")).join(marks, "key", "left")
             .groupBy("hash").agg(F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"), F.min("key").alias("key")))
    chosen = (known.where("toxic").orderBy("hash").limit(MOST_POSITIVE)
              .unionByName(known.where("NOT toxic").orderBy("hash").limit(MOST_UNLABELLED)))
    # at most MOST_POSITIVE + MOST_UNLABELLED rows of 17 bytes: a bounded broadcast instead of a shuffle of all texts
    sample = (texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["key", "hash"])
              .select("hash", "toxic", "text").mapInArrow(_featured, "hash long, toxic boolean, numbers binary")
              .groupBy("hash").agg(F.max("toxic").alias("toxic"), F.first("numbers").alias("numbers")).toArrow())
    numbers, toxic = [np.frombuffer(x.as_buffer(), np.uint32) for x in sample["numbers"]], sample["toxic"].to_pylist()
    order = np.argsort(sample["hash"].to_numpy())
    model = fit([numbers[i] for i in order if toxic[i]], [numbers[i] for i in order if not toxic[i]], prior)
    del sample, numbers
    ta.give_back()  # the driver lives on
    return model


def score_toxicity(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; a null or empty text gets the score of no evidence. Only the text is an input."""
    kind = df.select(key).schema.fields[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(partial(_scored, model=model, key=key), f"`{key}` {kind}, score double")


def _harmless(batches: Iterator[pa.RecordBatch], model: Model, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.scores(*features(texts)) for _, _, texts in ta.slices(batch.column(column))]
        if scores:
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5))


def drop_toxic_rows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts the model does not call toxic, with all their columns, where they are."""
    return df.mapInArrow(partial(_harmless, model=model, column=df.columns.index(text)), df.schema)


def held_out(key: str = "doc_id"):
    """True for a fifth of the keys by their CRC-32; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_toxicity(docs: DataFrame, labels: DataFrame, default_prior: float = 0.1) -> Model:
    """The model of the documents that are not held out, and of their labels.

    The class prior is the share of toxic rows among the labelled ones, between 0.001 and
    0.5; without labels it is ``default_prior`` and every text gets it as its score.
    """
    open_labels = labels.select("doc_id", "toxic").where("toxic IS NOT NULL").where(~held_out())
    prior = open_labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(0.5, max(0.001, default_prior if prior is None else prior))
    return fit_toxicity(docs.where(~held_out()), open_labels.where("toxic = 1").select("doc_id"), prior)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = score_toxicity(docs, learn_toxicity(docs, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
