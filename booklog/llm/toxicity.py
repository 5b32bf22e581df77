"""Toxicity by non-negative positive-unlabelled learning over hashed words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import ALPHANUMERIC, mix, word_hashes, word_spans
from .shared import batch_of, stored, text_slices, where_text, whole_text

FEATURES = 1 << 18
# Bounds of the sample that the classifier is fitted on.
POSITIVES = 20_000
UNLABELLED = 20_000
LEAST_TEXTS = 3
DEVIATIONS = 5.0
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """A score is the logistic of ``bias`` plus the summed weights of a text's distinct words."""

    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(features) + 1)
        np.cumsum(self.weights[features], out=sums[1:])
        return _logistic(sums[bounds[1:]] - sums[bounds[:-1]] + self.bias)


def _logistic(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def held_out() -> Column:
    """Whether a document's labels may not be learnt from; a null id's may not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def distinct_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed distinct words of each text, and where each text's start and end."""
    starts, ends = word_spans(data, bounds, ALPHANUMERIC)
    slots = (word_hashes(data, starts, ends) >> np.uint64(46)).astype(np.int64)
    owners = np.searchsorted(bounds, starts, "right") - 1
    keys = np.unique(owners * FEATURES + slots)
    return keys % FEATURES, np.searchsorted(keys, np.arange(len(bounds)) * FEATURES)


def sample_features(texts: DataFrame) -> DataFrame:
    """``doc_id, features`` of a sample, with all features of each text; stored."""
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32()))])

    def extract(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            found, borders = distinct_features(data, bounds)
            yield batch_of(schema, rows.column("doc_id"), np.split(found.astype(np.int32), borders[1:-1]))

    return stored(texts.mapInArrow(extract, "doc_id long, features array<int>"), "toxicity-sample")


def feature_counts(sample: DataFrame) -> np.ndarray:
    """Texts of a sample with each feature: at most ``FEATURES`` numbers, whatever the texts."""
    slots = sample.select(F.explode("features").alias("slot"))
    rows = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(FEATURES, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def restricted(sample: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places among ``kept`` of each text's features, in order of the ids, on the driver."""
    place = np.full(FEATURES, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = sample.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(pa.int32()))])

    def restrict(batches):
        for batch in batches:
            column = batch.column("features")
            mapped = shared.value[column.flatten().to_numpy()]
            bounds = np.cumsum([0, *column.value_lengths().to_pylist()])
            borders = np.cumsum(np.append(0, mapped >= 0))[bounds].astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(borders), pa.array(mapped[mapped >= 0]))
            yield batch_of(schema, batch.column("doc_id"), places.cast(schema.field("places").type))

    found = sample.mapInArrow(restrict, "doc_id long, places array<int>").toArrow().sort_by("doc_id")
    rows = found.column("places").combine_chunks()
    sizes = np.asarray(rows.value_lengths(), np.int64)
    return np.asarray(rows.flatten(), np.int64), np.cumsum([0, *sizes])


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Confirmed toxic texts, unlabelled texts, and the share of toxic ones among the labelled.

    Labels of held-out documents are not used. Both samples take the rows with the smallest
    hashes of their ids, so that they are the same on every run; of rows with equal ids the one
    with the greatest text. The share counts all labelled ids.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = F.xxhash64("doc_id")
    toxic = known.filter("toxic = 1").orderBy(order, "doc_id").limit(POSITIVES).select("doc_id")
    ids = docs.select(F.col("doc_id").cast("long")).filter(F.col("doc_id").isNotNull())
    others = ids.join(known, "doc_id", "left_anti").distinct()
    unlabelled = others.orderBy(order, "doc_id").limit(UNLABELLED)
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def of(chosen: DataFrame) -> DataFrame:
        # At most POSITIVES or UNLABELLED ids of eight bytes each, and a row for each of them.
        found = texts.join(F.broadcast(chosen), "doc_id")
        return found.groupBy("doc_id").agg(F.max("text").alias("text"))

    return of(toxic), of(unlabelled), share or 0.0


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 1000, step: float = 0.05) -> Model:
    """Learns from confirmed toxic and unlabelled texts only, never from confirmed clean ones.

    The risk is that of the toxic texts, weighted by their prior share, plus that of the
    unlabelled ones less what their hidden toxic part contributes. Where that difference turns
    negative the model has begun to fit the sample, and the step undoes that part instead.
    """
    toxic, unlabelled, prior = training_rows(docs, labels)
    samples = [sample_features(x) for x in (toxic, unlabelled)]
    sizes = [x.count() for x in samples]
    weights = np.zeros(FEATURES)
    if not all(sizes):
        return Model(weights, -4.0)
    kept = telling_features([feature_counts(x) for x in samples], sizes)
    positive, unknown = (restricted(x, kept) for x in samples)
    small, bias = _descend(positive, unknown, len(kept), min(max(prior, 1e-3), 0.9), rounds, step)
    weights[kept] = small
    return Model(weights, bias)


def telling_features(found: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Features whose share differs between the samples by ``DEVIATIONS`` standard errors.

    A feature must occur in ``LEAST_TEXTS`` texts; weights of rarer ones would only memorise.
    """
    pooled = (found[0] + found[1]) / sum(sizes)
    error = np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    difference = np.abs(found[0] / sizes[0] - found[1] / sizes[1])
    return np.flatnonzero((found[0] + found[1] >= LEAST_TEXTS) & (difference > DEVIATIONS * error))


def _descend(positive, unknown, size: int, prior: float, rounds: int, step: float):
    weights, bias = np.zeros(size), 0.0
    means, squares = np.zeros(size + 1), np.zeros(size + 1)
    counts = [np.diff(x[1]) for x in (positive, unknown)]

    def slope(features: np.ndarray, sizes: np.ndarray, of_each: np.ndarray) -> np.ndarray:
        total = np.bincount(features, np.repeat(of_each, sizes), size) if size else np.zeros(0)
        return np.append(total, of_each.sum())

    for turn in range(1, rounds + 1):
        model = Model(weights, bias)
        scores = [model.scores(*x) for x in (positive, unknown)]
        # Sigmoid loss: 1 - score where toxic is right, the score where clean is.
        steep = [s * (1 - s) / len(s) for s in scores]
        toxic_slope = prior * slope(positive[0], counts[0], steep[0])
        clean_slope = slope(unknown[0], counts[1], steep[1]) - toxic_slope
        clean_risk = scores[1].mean() - prior * scores[0].mean()
        gradient = -clean_slope if clean_risk < 0 else clean_slope - toxic_slope
        gradient[:-1] += 1e-5 * weights
        means = 0.9 * means + 0.1 * gradient
        squares = 0.999 * squares + 0.001 * gradient**2
        move = step * (means / (1 - 0.9**turn)) / (np.sqrt(squares / (1 - 0.999**turn)) + 1e-8)
        weights = weights - move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    A null or empty text scores by the bias. Rows with null or repeated ids keep their own row.
    Columns besides ``doc_id`` and ``text`` are not read. Held-out texts can be among the
    unlabelled ones of the training; their labels are not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches):
        for rows, data, bounds in text_slices(batches, "text"):
            yield batch_of(schema, rows.column("doc_id"), shared.value.scores(*distinct_features(data, bounds)))

    read = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = read.mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold.

    A null or empty text scores by the bias; repeated rows and null ids stay or go one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(where_text(lambda data, bounds: shared.value.scores(*distinct_features(data, bounds)) < threshold))
