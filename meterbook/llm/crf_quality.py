"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is good or bad.  Its features describe the line and, at
second and third place, the line before and the line after.  The field has one
weight per feature, a start weight and four transition weights; it is fitted
by maximum likelihood with the label of a document as the label of its lines.
Forward-backward gives the marginal probability of a good line, and the score
of a document is the mean of the marginals weighted by line length.

The field is fitted on at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes (a hash of the id picks them); scores cover every
document and whole texts.  Labels, language, source and id are no features.

Defined results: null text is scored as an empty one, which is one empty line;
without labels of both classes every score is 0.5; null ids are never learned
from and not held out; repeated rows are scored alike; a table without rows
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import map_batches, texts_of

TRAIN_DOCS = 3000
TRAIN_BYTES = 32_768
FOLDS = 5
THRESHOLD = 0.3
ROUNDS = 250
L2 = 1e-3
FEATURES = 13
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line, and the lines' lengths."""
    out, lengths = [], []
    lines, grams = set(), set()
    for line in text.split(b"\n"):
        parts = line.split()
        n = len(parts)
        if not n:
            out.append((0.0,) * (FEATURES - 1) + (1.0,))
            lengths.append(len(line) + 1)
            continue
        size = len(line)
        windows = [hash(w) for w in zip(parts, parts[1:], parts[2:])]
        fresh = set(windows) - grams
        grams |= fresh
        again = line in lines
        lines.add(line)
        out.append((
            math.log1p(n),
            (size - len(line.translate(None, _SYMBOLS))) / size,
            (size - len(line.translate(None, _CAPITALS))) / size,
            (size - len(line.translate(None, _DIGITS))) / size,
            line.count(b"!") / n,
            1 - len(set(parts)) / n,
            1 - len(fresh) / len(windows) if windows else 0.0,
            float(again),
            size / n / 10,
            sum(map(bytes.__eq__, parts, parts[1:])) / n,
            float(b"@" in line),
            float(n < 4),
            0.0,
        ))
        lengths.append(size + 1)
    return np.array(out, np.float64), np.array(lengths, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    zero = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


@dataclass
class Field:
    """Weights: ``unary`` for good against bad, ``start`` and ``step[from, to]`` of the two states."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray

    def potentials(self, features: np.ndarray) -> np.ndarray:
        good = ((features - self.mean) / self.scale) @ self.unary + self.bias
        return np.stack([np.zeros_like(good), good], axis=1)


def _passes(unary: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward values of padded chains sorted by falling length, and their log partition."""
    n, most, _ = unary.shape
    ahead, back = np.zeros_like(unary), np.zeros_like(unary)
    ahead[:, 0] = unary[:, 0] + start
    live = [int((lengths > t).sum()) for t in range(most)]
    for t in range(1, most):
        k = live[t]
        ahead[:k, t] = np.logaddexp(ahead[:k, t - 1, :1] + step[0], ahead[:k, t - 1, 1:] + step[1]) + unary[:k, t]
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        nxt = back[:k, t + 1] + unary[:k, t + 1]
        back[:k, t] = np.logaddexp(nxt[:, :1] + step[:, 0], nxt[:, 1:] + step[:, 1])
    last = ahead[np.arange(n), lengths - 1]
    return ahead, back, np.logaddexp(last[:, 0], last[:, 1])


def marginals(field: Field, own: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of a good line, for each line of each document."""
    out: list[np.ndarray] = [np.empty(0)] * len(own)
    order = sorted(range(len(own)), key=lambda i: -len(own[i]))
    # chains of like length are padded together, so a very long one is padded with none of the others
    at = 0
    while at < len(order):
        most = len(own[order[at]])
        to = at + 1
        while to < len(order) and len(own[order[to]]) * 4 >= most:
            to += 1
        part = order[at:to]
        lengths = np.array([len(own[i]) for i in part])
        unary = np.zeros((len(part), most, 2))
        for row, i in enumerate(part):
            unary[row, : lengths[row]] = field.potentials(with_neighbours(own[i]))
        ahead, back, whole = _passes(unary, lengths, field.start, field.step)
        good = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None])
        for row, i in enumerate(part):
            out[i] = np.clip(good[row, : lengths[row]], 0.0, 1.0)
        at = to
    return out


def fit(own: list[np.ndarray], labels: list[int], rounds: int = ROUNDS) -> Field | None:
    """Maximum likelihood by Adam on all chains at once; None where only one class is there."""
    if len(set(labels)) < 2:
        return None
    order = sorted(range(len(own)), key=lambda i: -len(own[i]))
    rows = [with_neighbours(own[i]) for i in order]
    lengths = np.array([len(r) for r in rows])
    truth = np.array([labels[i] for i in order])
    # documents count alike within a class, and the two classes alike, however long or frequent they are
    weight = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())) / len(rows) / lengths
    flat = np.vstack(rows)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-6
    flat = (flat - mean) / scale
    inside = np.arange(lengths.max())[None, :] < lengths[:, None]
    each = np.repeat(weight, lengths)
    line_truth = np.repeat(truth, lengths)
    d = flat.shape[1]
    x, m, v = np.zeros(d + 7), np.zeros(d + 7), np.zeros(d + 7)
    same = np.zeros((2, 2))
    np.add.at(same, (truth, truth), weight * (lengths - 1))
    first = np.array([weight[truth == 0].sum(), weight[truth == 1].sum()])
    unary = np.zeros((len(rows), lengths.max(), 2))
    for turn in range(1, rounds + 1):
        start, step = x[d + 1 : d + 3], x[d + 3 :].reshape(2, 2)
        unary[inside, 1] = flat @ x[:d] + x[d]
        ahead, back, whole = _passes(unary, lengths, start, step)
        node = np.exp(ahead + back - whole[:, None, None])
        edge = ahead[:, :-1, :, None] + step + (unary[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        edge = np.exp(np.minimum(edge, 0.0)) * (inside[:, 1:] * weight[:, None])[:, :, None, None]
        miss = (line_truth - node[inside, 1]) * each
        slope = np.concatenate([flat.T @ miss, [miss.sum()], first - (node[:, 0] * weight[:, None]).sum(axis=0), (same - edge.sum(axis=(0, 1))).ravel()])
        slope -= L2 * x
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        x += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Field(mean, scale, x[:d], float(x[d]), x[d + 1 : d + 3], x[d + 3 :].reshape(2, 2))


def score(field: Field | None, texts: list[bytes]) -> np.ndarray:
    """Length-weighted mean of the marginals of each text."""
    if field is None:
        return np.full(len(texts), 0.5)
    found = [line_features(t) for t in texts]
    good = marginals(field, [own for own, _ in found])
    return np.array([float(g @ w / w.sum()) for g, (_, w) in zip(good, found, strict=True)])


def _remainder(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          most: int = TRAIN_DOCS) -> Field | None:
    """Fit on the labelled documents outside the held-out fold."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (_remainder("id") != 0))
    picked = F.broadcast(marked.orderBy(F.xxhash64("id"), "id", "label").limit(most))  # a stated number of rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    chosen = short.join(picked, "id").orderBy(F.xxhash64("id"), "id", "label", "text").limit(most).collect()
    return fit([line_features((r.text or "").encode())[0] for r in chosen], [r.label for r in chosen])


def score_documents(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every document."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(field, texts_of(batch)), pa.float64())], ["id", "score"])

    scored = map_batches(own, work, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(_remainder("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    return score_documents(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
