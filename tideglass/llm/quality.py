"""Quality classifier: Naive Bayes support vectors on hashed n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import SPACE, U64, Words, mix, slices, text_buffer
from tideglass.llm.common import Shared, filter_rows, index_of, pick
from tideglass.llm.sample import bounded_sample, remainder

BITS = 18
#: At most so many labelled rows and bytes of their texts are fitted; beyond that a hash of the id picks the rows.
FIT_ROWS, FIT_BYTES = 6000, 32 << 20
UPPER, LOWER, DIGIT = ord("A"), ord("a"), ord("0")


def shape_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1], out[128:] = UPPER, LOWER, DIGIT, LOWER
    out[SPACE] = 32
    return out


SHAPE = shape_table()


def shapes(texts: pa.Array) -> pa.Array:
    """Each text with letters, digits and other characters by class, runs of one class as one."""
    data, offs = text_buffer(texts)
    kind = SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offs[(offs > 0) & (offs < len(data))]] = True
    new = np.append(0, np.cumsum(keep))[offs]
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(new.astype(np.int64)), pa.py_buffer(kind[keep].tobytes())])


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, by text, and where each text's begin: words, word pairs (a word
    repeated at once is one feature whatever the word), and word shapes up to three in a row."""
    found = []
    for w, upto, salt in ((Words(texts), 2, 0), (Words(shapes(texts)), 3, 7)):
        for n in range(1, upto + 1):
            at = np.flatnonzero(w.left >= n)
            h = w.grams(n)[at] + U64(n + salt)
            if salt == 0 and n == 2:
                h = np.where(w.hash[at] == w.hash[at + 1], U64(11), h)
            found.append((w.doc[at].astype(np.int64) << BITS) | (mix(h) >> U64(64 - BITS)).astype(np.int64))
    got = np.unique(np.concatenate(found))
    return (got & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(got >> BITS, np.arange(len(texts) + 1))


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        r = self.ratio[features].astype(np.float64)
        total = np.append(0, np.cumsum(self.weight[features] * r))
        norm = np.append(0, np.cumsum(r * r))
        a, b = first[:-1], first[1:]
        return (total[b] - total[a]) / np.sqrt(np.maximum(norm[b] - norm[a], 1e-12)) + self.bias

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.slope * self.margins(features, first) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, alpha: float = 1.0, rounds: int = 30, seed: int = 0) -> Model:
    """Log-count ratios of the classes, then dual coordinate descent for the linear hinge loss.

    Classes weigh alike in the loss. Without rows of both classes every score is 0.5, or the only class.
    """
    size = 1 << BITS
    zero = np.zeros(size, np.float32)
    if not len(label) or label.min() == label.max():
        return Model(zero, zero, 0.0, 0.0, 0.0 if not len(label) else 30.0 * (2 * int(label[0]) - 1))
    counts = [alpha + np.bincount(np.concatenate([r for r, y in zip(rows, label, strict=True) if y == c]), minlength=size) for c in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    y = np.where(label == 1, 1.0, -1.0)
    cap = cost * len(y) / 2 / np.where(label == 1, (label == 1).sum(), (label == 0).sum())
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows]
    square = np.array([(v * v).sum() + 1 for v in values])
    dual, w, bias = np.zeros(len(y)), np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(dual[i] - g / square[i], 0.0), cap[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    margin = np.array([v @ w[r] for v, r in zip(values, rows, strict=True)]) + bias
    slope, offset = scale(margin, label)
    return Model(ratio.astype(np.float32), w.astype(np.float32), bias, slope, offset)


def scale(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps; targets are smoothed by class size."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(label == 1, 0.5 / pos, 0.5 / neg)
    x, b = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)))
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Model:
    """Fit on labelled rows outside the held-out remainder, ``fit_rows`` and ``fit_bytes`` of text at most; if more
    are labelled, a hash of the id picks them. Rows without label, id or document do not count."""
    rows = pick(labels, doc_id=(doc_id, "long"), label=(label, "int"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    share = min(1.0, 1.5 * fit_rows / max(1, rows.count()))  # what is broadcast: about that many rows
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates()
    texts = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    found = bounded_sample(texts.join(F.broadcast(rows), "doc_id"), fit_rows, fit_bytes)

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                got, first = indicators(part.column("text"))
                raw = [got[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(raw, pa.binary())], names=["id", "label", "features"])

    got = sorted((r.id, r.label, bytes(r.features)) for r in found.mapInArrow(features, "id long, label int, features binary").toLocalIterator())
    return fit([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], np.int64))


def score_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """Score every whole text: doc_id, held_out (crc32 of the id modulo 3 is 1; null for a null id), score
    (0 to 1, higher: good likelier) and predicted (1 from 0.5 on).

    Only the text enters a score. Null and empty texts have no features and get the bias's score. Repeated
    rows are scored each. An empty table gives an empty result; without labels every score is 0.5. Further
    columns, whatever their names, are ignored.
    """
    model = Shared(docs.sparkSession, fit_quality(docs, labels, fit_rows, fit_bytes, doc_id, text, label))

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                s = model.value.scores(*indicators(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    return rows.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.5,
) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more; nothing is shuffled.

    Null and empty texts get the bias's score and stay or go by it, as does a score of just ``least`` (it stays).
    Repeated rows are judged each, null ids like others. An empty table gives an empty result; without labels all
    rows stay. Columns and their names are the input's, whatever they are.
    """
    model = Shared(docs.sparkSession, fit_quality(docs, labels, fit_rows, fit_bytes, doc_id, text, label))
    at = f"c{index_of(docs, text)}"

    def keep(batch):
        return np.concatenate([model.value.scores(*indicators(p.column(at).cast(pa.string()))) >= least for p in slices(batch, text=at)] or [np.zeros(0, bool)])

    return filter_rows(docs, keep)
