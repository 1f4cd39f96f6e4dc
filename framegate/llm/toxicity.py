"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model gives each sentence that holds a telling
word the odds of being offensive, and the document's score is their noisy-or,
1 - (1 - leak) prod(1 - p). The leak is what a document without such a sentence scores,
however many others it has. Only documents
carry labels; the gradient of the bag's likelihood reaches each sentence through the
noisy-or, so the model learns which sentences offend, and offending() returns them.

Features of a sentence: its words and their first 4, 5 and 6 bytes, hashed. The fit runs on
FIT_DOCS labelled documents; features are chosen there by a test of significance over their
distinct texts, so that a rare word that only offends counts as well as a common one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, held_out, written
from framegate.llm.labelled import sample
from framegate.llm.textvec import Spans, chunks, joined

FIT_DOCS = 6000
BITS = 20
HEADS = (4, 5, 6)
#: So many features may be chosen by chance, of all; the fit gives those no weight.
ERROR = 100.0
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True


@dataclass
class Model:
    weights: np.ndarray  # one a hashed feature
    bias: float
    leak: float  # log-odds


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence of each feature row, document of each sentence, start, end).
    Sentences end at . ! ? or a line's end. Every document has at least one."""
    buf, at = joined(texts)
    stop = ENDS[buf].copy()
    stop[at[1:] - 1] = True
    end = np.flatnonzero(stop)
    start = np.concatenate(([0], end[:-1] + 1))
    doc = np.searchsorted(at, start, "right") - 1
    words = Spans(buf, NOT_WORD)
    owner = np.searchsorted(start, words.starts, "right") - 1
    hashed = [(h >> np.uint64(64 - BITS)).astype(np.int32) for h in words.hashes(HEADS)]
    return np.stack(hashed, axis=1) if hashed else np.zeros((0, 1 + len(HEADS)), np.int32), owner, doc, start - at[doc], end - at[doc]


def bag_scores(z: np.ndarray, doc: np.ndarray, n: int, leak: float = -np.inf) -> np.ndarray:
    """Noisy-or of sigmoid(z), and of the leak's, by document."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, z), minlength=n) - np.logaddexp(0, leak))


def telling(seen: DataFrame, n: int, bad: int) -> np.ndarray:
    """From (f, y) of each distinct labelled text, of which n there are and bad offend: the
    features that offensive texts hold far more often than chance would have it. The chance
    of so many or more, by Chernoff's bound, is below ERROR over the number of features."""
    p = min(max(bad / max(n, 1), 1e-9), 1 - 1e-9)
    counts = seen.groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    share = F.least(F.col("bad") / F.col("n"), F.lit(1 - 1e-12))
    apart = share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p))
    counts = written(counts, "toxicity-features")
    asked = counts.filter((F.col("bad") > F.col("n") * p) & (F.col("n") * apart > float(np.log(max(1, counts.count()) / ERROR))))
    return np.sort(asked.select("f").toArrow().column(0).to_numpy().astype(np.int64))


def gradient(theta: np.ndarray, sent: np.ndarray, col: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the documents' log-likelihood by the weights of words, the bias and the leak.
    sent, col: sentence and word of each pair; doc: the document of each sentence."""
    w, b, leak = theta[:-2], theta[-2], theta[-1]
    z = b + np.bincount(sent, w[col], minlength=len(doc))
    big = np.clip(bag_scores(z, doc, len(y), leak), 1e-12, 1 - 1e-12)
    lift = np.where(y > 0, (1 - big) / big, -1.0)
    pull = lift[doc] / (1 + np.exp(-z))
    return np.concatenate((np.bincount(col, pull[sent], minlength=len(w)), [pull.sum(), lift.sum() / (1 + np.exp(-leak))]))


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], chosen: np.ndarray, rounds: int = 400, rate: float = 0.3, ridge: float = 3e-6, lasso: float = 3e-6, begin: float = 2.0) -> Model:
    """From each document's (sentence, place in chosen) pairs and label."""
    weights = np.zeros(1 << BITS, np.float32)
    y = np.array([b[2] for b in bags], float)
    if not len(y) or y.min() == y.max():
        return Model(weights, -7.0, float(4 * y.mean() - 9) if len(y) else -9.0)
    n, width = len(y), len(chosen)
    sents, cols, docs, total = [], [], [], 0
    for i, (own, col, _) in enumerate(bags):
        holders, place = np.unique(own, return_inverse=True)
        sents.append(place + total)
        cols.append(col)
        docs.append(np.full(len(holders), i))
        total += len(holders)
    sent, col, doc = np.concatenate(sents), np.concatenate(cols), np.concatenate(docs)
    # All chosen words offend at first, so that blame falls on sentences that hold some.
    theta = np.append(np.full(width, begin), (-7.0, -5.0))
    m, v = np.zeros(width + 2), np.zeros(width + 2)
    for t in range(1, rounds + 1):
        grad = gradient(theta, sent, col, doc, y) / n
        grad[:-2] -= ridge * theta[:-2] + lasso
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * min(1, 20 / t**0.5 / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:-2] = np.maximum(0, theta[:-2])  # a word can only offend
    weights[chosen] = theta[:-2]
    return Model(weights, float(theta[-2]), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from all sentences of at most fit_docs labelled rows (see labelled.sample, which
    also bounds their texts together, and with them what the driver gets). Features are
    counted by Spark, each distinct text once; the driver gets the chosen ones and where they
    stand in the sample, nothing that grows with other words."""
    bounded_batches(docs.sparkSession)
    rows = written(sample(docs, labels, id_col, text_col, label_col, fit_docs).select("text", "y"), "toxicity-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(sentences([text.encode()])[0])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), label, np.int64))], ["f", "y"])

    distinct = rows.groupBy("text").agg(F.max("y").alias("y"))
    n, bad = distinct.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen = telling(distinct.mapInArrow(words, "f int, y long"), n, bad)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(1 << BITS, -1, np.int32)
        at[chosen] = np.arange(len(chosen))
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features, owner, *_ = sentences([text.encode()])
                row, head = np.nonzero(at[features] >= 0)
                # A word counts once a sentence.
                pair = np.unique(owner[row] * len(chosen) + at[features[row, head]])
                own, col = np.divmod(pair, max(1, len(chosen)))
                out.append((own.astype(np.int64).tobytes(), col.astype(np.int64).tobytes(), label))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["s", "c", "y"])

    # The order of rows must not matter.
    found = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in rows.mapInArrow(places, "s binary, c binary, y long").collect())
    return fit([(np.frombuffer(s, np.int64), np.frombuffer(c, np.int64), y) for s, c, y in found], chosen)


def _z(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Log-odds of every sentence that holds a telling word, its document, start and end."""
    features, owner, doc, start, end = sentences(texts)
    row, head = np.nonzero(model.weights[features])
    pair = np.unique((owner[row] << BITS) | features[row, head])
    pull = model.weights[pair & ((1 << BITS) - 1)].astype(np.float64)
    holders, place = np.unique(pair >> BITS, return_inverse=True)
    return model.bias + np.bincount(place, pull, minlength=len(holders)), doc[holders], start[holders], end[holders]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted of every row; no shuffle. A null or empty text scores
    the leak; a very long one is read whole, alone in its task's memory. Repeated rows score
    alike; a null id is not held out; an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            out = [np.zeros(0)]
            for part in chunks([len(t) for t in texts]):
                z, doc, *_ = _z(model, texts[part])
                out.append(bag_scores(z, doc, part.stop - part.start, model.leak))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, sentence, score of each sentence whose own score reaches the threshold, of every
    row, repeated and null ids too. Null and empty texts have none; a very long text is read
    whole; an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            out = []
            for part in chunks([len(t) for t in texts]):
                z, doc, start, end = _z(model, texts[part])
                for i in np.flatnonzero(z >= np.log(threshold / (1 - threshold))):
                    k = part.start + int(doc[i])
                    out.append((names[k], texts[k][start[i] : end[i] + 1].decode("utf-8", "replace").strip(), float(1 / (1 + np.exp(-z[i])))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64()))], ["id", "sentence", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, sentence string, score double").withColumnRenamed("id", id_col)
