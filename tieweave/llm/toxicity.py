"""Toxicity: a linear classifier whose scores are held steady under swaps of identity terms.

Features are the presence of words and of word beginnings. They are counted by label over the
training sample, and the most telling ones are kept, with those of all identity terms. Where a
labelled text names groups, each name is swapped for another of its kind, and the squared
change of the score's logit is penalised, so that naming a group adds nothing by itself. The
fit is ridge logistic regression by Newton steps on at most ``TRAIN_ROWS`` labelled texts.

Null and empty texts get the score of a text without any feature. Rows without a label, and
labels without a text, do not train; several labels of one document count as their largest.
With no labelled rows, or one kind of label only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tieweave.llm import text as tx
from tieweave.llm.names import unused

#: Largest number of labelled texts that are learned from (in the mean; picked by hash).
TRAIN_ROWS = 20_000
FEATURES = 800
#: A feature has to occur in so many training texts of label 1.
MIN_SUPPORT = 5
THRESHOLD = 0.3
RIDGE = 0.2
SWAP_PENALTY = 25.0
#: A text's words, features and their numbers take some 30 times its bytes, so few bytes are looked at together.
SLICE_BYTES = 1 << 20
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)

# Group names by kind; a name is only swapped within its kind.
IDENTITY_TERMS = {
    "belief": ["atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant", "sikh"],
    "origin": ["african", "american", "arab", "asian", "chinese", "european", "indian", "latino", "mexican", "turkish"],
    "colour": ["black", "brown", "white"],
    "gender": ["female", "male", "nonbinary", "transgender"],
    "people": ["boys", "girls", "men", "women"],
    "love": ["bisexual", "gay", "heterosexual", "homosexual", "lesbian", "straight"],
    "body": ["blind", "deaf", "disabled"],
    "age": ["elderly", "old", "young"],
    "standing": ["immigrant", "migrant", "refugee"],
}


@dataclass
class Model:
    """Feature strings (words end in a blank, beginnings do not), their weights, and the intercept."""

    features: list[str]
    weights: np.ndarray
    intercept: float


def held_out(doc_id: Column) -> Column:
    """Rows that never train: a quarter, by the checksum of the id's text."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def _word_features(words: pa.Array) -> list[pa.Array]:
    """For every word its features, one array a kind; null where the word is too short."""
    long = pc.utf8_length(words)
    kinds = [pc.binary_join_element_wise(words, pa.scalar(""), " ")]
    for n in BEGINNINGS:
        kinds.append(pc.if_else(pc.greater(long, n), pc.utf8_slice_codeunits(words, 0, n), pa.scalar(None, pa.string())))
    return kinds


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct (text, feature) pairs of all texts: text index, feature code, features by code."""
    words, bounds = tx.words(pc.utf8_lower(texts), tx.ALPHANUMERIC_FOLDED)
    codes, distinct = tx.coded(words)
    owner = tx.owners(bounds)
    pair = np.unique(owner * max(1, len(distinct)) + codes)
    owner, codes = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    kinds = [tx.coded(k.drop_null()) + (pc.is_valid(k).to_numpy(zero_copy_only=False),) for k in _word_features(distinct)]
    at, feature, names, shift = [], [], [], 0
    for found, values, valid in kinds:
        of_word = np.full(len(distinct), -1, np.int64)
        of_word[valid] = found + shift
        mine = of_word[codes]
        at.append(owner[mine >= 0])
        feature.append(mine[mine >= 0])
        names.append(values)
        shift += len(values)
    pair = np.unique(np.concatenate(at) * max(1, shift) + np.concatenate(feature))
    return pair // max(1, shift), pair % max(1, shift), pa.concat_arrays(names)


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and label y of at most about ``rows`` labelled documents outside the held-out part."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    parts = 1 << 20
    share = min(1.0, rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(share * parts))
    # About ``rows`` rows of an id and a label.
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("text", "y")


def _feature_counts(training: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.slices(batches, "text", SLICE_BYTES):
            at, feature, names = text_features(texts)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)[at]
            ones = np.bincount(feature, weights=y, minlength=len(names)).astype(np.int64)
            every = np.bincount(feature, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(ones), pa.array(every)], names=["feature", "n1", "n"])

    return training.mapInArrow(run, "feature string, n1 long, n long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))


def choose_features(training: DataFrame, most: int = FEATURES) -> tuple[list[str], int, int]:
    """The features whose share of label 1 stands out most from the rest, and the label counts."""
    total, ones = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones or ones == total:
        return [], total, ones
    expected = F.col("n") * F.lit(ones / total)
    # Signed root of the chi-square share: how far the count of label 1 is above its expectation.
    stands_out = (F.col("n1") - expected) / F.sqrt(expected)
    best = _feature_counts(training).filter(F.col("n1") >= MIN_SUPPORT).orderBy(stands_out.desc(), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()], total, ones


def _rows_of(training: DataFrame, features: list[str]) -> list:
    """Feature numbers of each training text, and its label; the sample is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = pa.array(features, pa.string())
        for batch, texts in tx.slices(batches, "text", SLICE_BYTES):
            at, feature, names = text_features(texts)
            place = pc.fill_null(pc.index_in(names, value_set=chosen), -1).to_numpy(zero_copy_only=False)[feature]
            at, place = at[place >= 0], place[place >= 0]
            bounds = np.searchsorted(at, np.arange(len(texts) + 1))
            held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([held, batch.column("y")], names=["held", "y"])

    return training.mapInArrow(run, "held array<int>, y int").collect()


def identity_features() -> tuple[list[str], list[tuple[list[str], list[str]]]]:
    """Features of the identity terms, and for each term its own and those of the next of its kind."""
    swaps, names = [], []
    for terms in IDENTITY_TERMS.values():
        own = [[v.as_py() for v in (k[0] for k in _word_features(pa.array([t]))) if v.as_py() is not None] for t in terms]
        names += [f for fs in own for f in fs]
        swaps += list(zip(own, own[1:] + own[:1], strict=True))
    return list(dict.fromkeys(names)), swaps


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    training = training_texts(docs, labels, rows)
    chosen, total, ones = choose_features(training, features)
    prior = (ones + 0.5) / (total + 1.0)
    if not chosen:
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))))
    terms, swaps = identity_features()
    names = list(dict.fromkeys([*chosen, *terms]))
    place = {f: i for i, f in enumerate(names)}
    held = _rows_of(training, names)
    x = np.zeros((len(held), len(names) + 1), np.float32)
    x[:, -1] = 1.0
    for i, r in enumerate(held):
        x[i, r["held"]] = 1.0
    y = np.array([r["y"] > 0 for r in held], np.float32)
    return Model(names, *_newton(x, y, swap_differences(x, place, swaps)))


def swap_differences(x: np.ndarray, place: dict[str, int], swaps: list) -> np.ndarray:
    """Feature changes of the swaps: in every training text that names the term, and one bare mention a term."""
    rows = []
    for own, other in swaps:
        at, to = [place[f] for f in own], [place[f] for f in other]
        change = np.zeros(x.shape[1], np.float32)
        change[at] -= 1
        change[to] += 1
        bare = np.zeros(x.shape[1], np.float32)
        bare[at] = 1
        # A text's swaps by one term all change alike, so their number is a weight.
        times = 1 + int((x[:, at[0]] > 0).sum())
        rows += [change * np.sqrt(times), bare]
    return np.array(rows, np.float32)


def _newton(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the log loss, the ridge and the swap penalty."""
    penalty = np.eye(x.shape[1]) * RIDGE
    penalty[-1, -1] = 1e-6
    penalty += SWAP_PENALTY * (swaps.T @ swaps)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        curve = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x + penalty
        move = np.linalg.solve(curve, gradient)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All documents with the score and the prediction under ``names``; other columns stay, those of the same names give way."""
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "double").add(names[1], "integer")
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, intercept = shared.value
        chosen = pa.array(features, pa.string())
        for batch, texts in tx.slices(batches, "text", SLICE_BYTES):
            at, feature, held = text_features(texts)
            place = pc.fill_null(pc.index_in(held, value_set=chosen), -1).to_numpy(zero_copy_only=False)[feature]
            logit = intercept + np.bincount(at[place >= 0], weights=weights[place[place >= 0]], minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, rows)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def not_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    names = unused(docs, "score", "predicted")
    return scored(docs, fit(docs, labels, rows), names=tuple(names)).filter(F.col(names[1]) == 0).select(*docs.columns)
