"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's evidence comes from its own features and from those of
the lines before and after it; transitions tie neighbours. Lines carry no labels, so theirs
are hidden in the fit: the document's label is a sign of each line's, right with probability
TRUST, and the fit climbs the likelihood of what was seen. So it learns transitions between
good and bad lines from documents that hold both. A document's quality is the mean of its
lines' forward-backward marginals, weighted by length; line_labels() returns the lines'.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, held_out
from framegate.llm.labelled import sample
from framegate.llm.textvec import BLANK, Spans, chunks, joined

FIT_DOCS = 6000
#: The fit takes a longer document as several chains of so many lines, so that all its lines
#: teach while chains run side by side; only the transitions between its chains are not seen.
CHAIN = 64
TRUST = 0.9
#: Log-odds of a label at the start, and the share of the rounds after which TRUST holds.
SURE, BELIEVED = 20.0, 0.6
HINGES = (0.1, 0.5, 0.9)


def _class(*groups: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for g in groups:
        out[list(g)] = 1
    return out


UPPER = _class(bytes(range(65, 91)))
LETTER = _class(bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)))
DIGIT = _class(bytes(range(48, 58)))
MARKS = _class(b"#$%&*@^~<>={}[]\\_+/")
SHOUT = _class(b"!?")
BAR = _class(b"|")
STOP = _class(b".,;:")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its document, its length + 1); a line ends at \\n."""
    buf, at = joined(texts)
    cut = buf == 10
    cut[at[1:] - 1] = True
    end = np.flatnonzero(cut)
    start = np.concatenate(([0], end[:-1] + 1))
    doc = np.searchsorted(at, start, "right") - 1
    size = (end - start).astype(float)

    def count(kind: np.ndarray) -> np.ndarray:  # what ends a line is of no class
        return np.add.reduceat(kind[buf], start, dtype=np.int64).astype(float)

    words = Spans(buf, BLANK)
    (h,) = words.hashes()
    line = np.searchsorted(start, words.starts, "right") - 1
    n = len(start)
    n_words = np.bincount(line, minlength=n).astype(float)
    # Distinct words of a line, and words that repeat the one before.
    order = np.lexsort((h, line))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, minlength=n)
    stutter = np.bincount(line, doubled, minlength=n)
    # The same line elsewhere in the document.
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
    last = np.cumsum(np.bincount(line, minlength=n)).astype(int)
    summed = total[last] - total[last - n_words.astype(int)]
    order = np.lexsort((summed, doc))
    twin = np.zeros(n, bool)
    same = (summed[order[1:]] == summed[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (n_words[order[1:]] > 0)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    letters, base = np.maximum(count(LETTER), 1), np.maximum(size, 1)
    many = np.maximum(n_words, 1)
    own = np.stack(
        [
            np.log1p(size), np.log1p(n_words), count(UPPER) / letters, count(DIGIT) / base, count(MARKS) / base,
            count(SHOUT) / base, count(BAR) / base, count(STOP) / many, letters / many, repeats / many, stutter / many, twin,
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    linked = doc[1:] == doc[:-1]
    before[1:][linked], after[:-1][linked] = own[:-1][linked], own[1:][linked]
    edge = np.stack((np.concatenate(([True], ~linked)), np.concatenate((~linked, [True]))), axis=1)
    return np.concatenate((own, before, after, edge), axis=1).astype(np.float32), doc, size + 1


@dataclass
class Model:
    knots: np.ndarray  # hinge positions by feature
    scale: np.ndarray
    weights: np.ndarray  # log-odds of good, by basis function
    start: float
    move: np.ndarray  # 2 x 2, from bad/good to bad/good

    def basis(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.scale)), np.float32)
        width = x.shape[1]
        out[:, 0], out[:, 1 : 1 + width] = 1, x
        for i, knot in enumerate(self.knots):
            np.maximum(0, x - knot, out=out[:, 1 + width * (i + 1) : 1 + width * (i + 2)])
        out /= self.scale
        return out


class Chains:
    """Where chains of lines lie: lengths in turn, one after the other."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        #: Where each begins, from long to short, and how many of these have a line t.
        self.first = begin[order]
        self.alive = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
        inner = np.ones(int(lengths.sum()), bool)
        inner[begin + lengths - 1] = False
        self.inner = np.flatnonzero(inner)


def _norm(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[:, 0], a[:, 1])


def marginals(z: np.ndarray, chains: Chains, start: float, move: np.ndarray, weight: np.ndarray | None = None):
    """P(good) of every line by forward-backward, all chains at once; z: its log-odds.
    With a weight for each line, also the expected number of each transition and of good
    first lines, weighted."""
    emit = np.stack((-z / 2, z / 2), axis=1)
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    for t, n in enumerate(chains.alive):
        at = chains.first[:n] + t
        if t == 0:
            ahead[at] = emit[at] + np.array([-start / 2, start / 2])
        else:
            was = ahead[at - 1]
            ahead[at, 0] = np.logaddexp(was[:, 0] + move[0, 0], was[:, 1] + move[1, 0]) + emit[at, 0]
            ahead[at, 1] = np.logaddexp(was[:, 0] + move[0, 1], was[:, 1] + move[1, 1]) + emit[at, 1]
    for t in range(len(chains.alive) - 2, -1, -1):
        at = chains.first[: chains.alive[t + 1]] + t
        then = back[at + 1] + emit[at + 1]
        back[at, 0] = np.logaddexp(move[0, 0] + then[:, 0], move[0, 1] + then[:, 1])
        back[at, 1] = np.logaddexp(move[1, 0] + then[:, 0], move[1, 1] + then[:, 1])
    both = ahead + back
    good = np.exp(both[:, 1] - _norm(both))
    if weight is None:
        return good
    inner = chains.inner
    joint = ahead[inner][:, :, None] + move[None] + (back[inner + 1] + emit[inner + 1])[:, None, :]
    joint = np.einsum("i,ijk->jk", weight[inner], np.exp(joint - _norm(both[inner])[:, None, None]))
    return good, joint, (weight * good)[chains.first].sum()


def in_chains(lengths: np.ndarray, most: int = CHAIN) -> np.ndarray:
    """Lengths of the chains that documents of so many lines are cut into."""
    n = -(-lengths // most)
    out = np.full(int(n.sum()), most)
    out[np.cumsum(n) - 1] = lengths - most * (n - 1)
    return out


def gradient(theta: np.ndarray, x: np.ndarray, chains: Chains, weight: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of what was told of the lines (as log-odds), each chain's times
    the weight of its lines: what is expected of lines and transitions when the labels are
    known, less what is expected when they are not."""
    w, start, move = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
    z = (x @ w.astype(x.dtype)).astype(float)
    known, known_joint, known_begun = marginals(z + told, chains, start, move, weight)
    good, joint, begun = marginals(z, chains, start, move, weight)
    return np.concatenate((x.T @ (weight * (known - good)).astype(x.dtype), [known_begun - begun], (known_joint - joint).ravel()))


def fit(lines: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.15, ridge: float = 1e-3, trust: float = TRUST) -> Model:
    """lines: features of all documents' lines in turn; lengths, y: lines and label of each.
    Every document weighs alike, its lines share that."""
    width = lines.shape[1]
    knots = (np.quantile(lines, HINGES, axis=0) if len(lines) else np.zeros((len(HINGES), width))).astype(np.float32)
    model = Model(knots, np.ones(1 + width * (1 + len(HINGES)), np.float32), np.zeros(1 + width * (1 + len(HINGES))), 0.0, np.zeros((2, 2)))
    if not len(y):
        return model
    x = model.basis(lines)
    model.scale = np.maximum(np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)), 1e-3).astype(np.float32)
    x /= model.scale
    chains = Chains(in_chains(lengths))
    weight = np.repeat(1 / lengths, lengths)
    told = np.repeat(np.where(y > 0, 1.0, -1.0), lengths)
    sure, doubted = SURE, np.log(trust / (1 - trust))
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        # Labels are believed at first, so that a rare kind of bad line is not taken for an error.
        grad = gradient(theta, x, chains, weight, told * (sure if t <= BELIEVED * rounds else doubted)) / len(y)
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights, model.start, model.move = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from all lines of at most fit_docs labelled rows (see labelled.sample, which also
    bounds their lines together). Executors make the line features; the driver gets those
    of the sample alone."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append((line_features([text.encode()])[0].tobytes(), label))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64())], ["f", "y"])

    rows = sample(docs, labels, id_col, text_col, label_col, fit_docs)
    found = [(bytes(r[0]), r[1]) for r in rows.select("text", "y").mapInArrow(run, "f binary, y long").collect()]
    found.sort(key=lambda r: (zlib.crc32(r[0]), r))  # an order of its own, so that the fit is that of the rows
    width = line_features([b""])[0].shape[1]
    chains = [np.frombuffer(raw, np.float32).reshape(-1, width) for raw, _ in found]
    return fit(np.concatenate([np.zeros((0, width), np.float32), *chains]), np.array([len(c) for c in chains], int), np.array([y for _, y in found], int))


def line_scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good), document, weight) of every line."""
    x, doc, weight = line_features(texts)
    z = np.concatenate([(model.basis(x[i : i + 50_000]) @ model.weights.astype(np.float32)).astype(float) for i in range(0, len(x), 50_000)])
    return marginals(z, Chains(np.bincount(doc, minlength=len(texts))), model.start, model.move), doc, weight


def line_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, line (from 0), score, good of every line of every row. A null or empty text is one
    empty line; other columns are ignored; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                score, doc, _ = line_scores(model, texts[part])
                first = np.searchsorted(doc, doc)
                ids = batch.column(0).take(pa.array(doc + part.start))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(doc)) - first), pa.array(score)], ["id", "line", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, "id long, line long, score double")
    return found.select(F.col("id").alias(id_col), "line", "score", (F.col("score") >= threshold).alias("good"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of every row; no shuffle. A null text is an empty one:
    one empty line. A very long text is read whole, alone in its task's memory. Repeated rows
    score alike; a null id is not held out; an empty table gives no rows; other columns are
    ignored."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_scorer(model), "id long, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def document_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    out = [np.zeros(0)]
    for part in chunks([len(t) for t in texts]):
        good, doc, weight = line_scores(model, texts[part])
        n = part.stop - part.start
        out.append(np.bincount(doc, good * weight, minlength=n) / np.bincount(doc, weight, minlength=n))
    return np.clip(np.concatenate(out), 0.0, 1.0)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = document_scores(model, [(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return run


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model does not reject, in one pass without a join, with docs'
    columns whatever their names. A null or empty text is one empty line; repeated rows fare
    alike; a very long text is read whole; an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = document_scores(model, [(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
