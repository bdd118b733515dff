"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector shared by all grades and ordered thresholds.  x
has hashed words, runs of marks and a length class of the whole text; the expected grade and the tail
probability P(grade >= wanted) come from the same score.

The model is fitted on a bounded sample of labelled documents (``max_rows``, chosen by a hash of the id); every
document is scored.  Null and empty texts have the features of no words.  Repeated rows score alike, ties of
grades are no matter, other columns are kept (results replace columns of the same name); an empty table gives an
empty table.  With no labels at all, or a single grade, everything is kept with tail probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, labelled, run_hashes, texts_of

BITS = 16
#: Features that are fitted at a time.
RUN = 1 << 17


def features(column: pa.Array):
    """For each text (indices, values) of its hashed words: damped counts, of length 1 together."""
    for _, data, offsets in texts_of(column):
        hashes, bounds = run_hashes(data, offsets, marks=True)
        index = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        for k in range(len(offsets) - 1):
            at, n = np.unique(index[bounds[k] : bounds[k + 1]], return_counts=True)
            at = np.append(at, int(np.log2(bounds[k + 1] - bounds[k] + 1)))  # length classes have the first places
            value = np.append(1 + np.log(n), 1.0)
            yield at, value / np.sqrt((value * value).sum())


@dataclass(frozen=True)
class OrdinalModel:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the first), a column for each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(index: np.ndarray, value: np.ndarray, bounds: np.ndarray, grades: np.ndarray, steps: int = 150, rate: float = 0.15, penalty: float = 1e-6) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam; thresholds stay ordered, as a first one and positive gaps."""
    levels, y = np.unique(grades, return_inverse=True)
    k, n = len(levels) - 1, len(grades)
    w, share = np.zeros(1 << BITS), np.array([(y > j).mean() for j in range(k)])
    theta = np.log((1 - share) / share)
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    # runs of rows with about RUN features: the driver holds what it works on for one of them at a time
    edges = np.unique([0, *np.searchsorted(bounds, np.arange(0, bounds[-1], RUN)), n])
    runs = [(slice(a, b), slice(bounds[a], bounds[b]), np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds[a : b + 1]))) for a, b in zip(edges, edges[1:], strict=False)]
    m = [np.zeros_like(w), np.zeros_like(free)]
    v = [np.zeros_like(w), np.zeros_like(free)]
    for t in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = np.concatenate([free[:1], free[0] + np.cumsum(gaps)])
        score = np.concatenate([np.bincount(row, w[index[at]] * value[at], rows.stop - rows.start) for rows, at, row in runs])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = (1 / (1 + np.exp(-np.clip(edge[y + d] - score, -40, 40))) for d in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = (d_upper - d_lower) / n
        g_theta = np.array([(-(d_upper[y == j]).sum() + (d_lower[y == j + 1]).sum()) / n for j in range(k)])
        g_free = np.concatenate([[g_theta.sum()], gaps * np.cumsum(g_theta[::-1])[::-1][1:]])
        g_w = np.zeros_like(w)
        for rows, at, row in runs:
            np.add.at(g_w, index[at], value[at] * g_score[rows][row])
        grads = [g_w + penalty * w, g_free]
        for j, (x, g) in enumerate(zip((w, free), grads, strict=True)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            x -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(levels.astype(float), w.astype(np.float32), np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_rows: int = 8_000, train_on: F.Column | None = None) -> OrdinalModel | None:
    """Fit on at most about ``max_rows`` labelled documents; only their sparse features reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = labelled(docs.filter(train_on) if train_on is not None else docs, labels, label, max_rows).select(text, F.col("_label").cast("double"))

    def run(batches):
        for b in batches:
            index, value, size = [], [], []
            for at, x in features(b.column(0)):
                index.append(at.astype(np.int32).tobytes())
                value.append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.binary()), pa.array(value, pa.binary()), b.column(1)], ["index", "value", "grade"])

    found = rows.mapInArrow(run, "index binary, value binary, grade double").toArrow()
    grades = found["grade"].to_numpy()
    if len(np.unique(grades)) < 2:
        return None
    order = np.array(sorted(range(len(grades)), key=found["index"].to_pylist().__getitem__))  # the same order however rows arrive
    index, value = (np.frombuffer(b"".join(found[c].take(pa.array(order)).to_pylist()), t) for c, t in (("index", np.int32), ("value", np.float32)))
    size = pa.compute.binary_length(found["index"]).to_numpy()[order] // 4
    del found
    return fit(index, value, np.append(0, np.cumsum(size)), grades[order])


def score_quality(docs: DataFrame, model: OrdinalModel | None, wanted: float = 1.0, least: float = 0.3, text: str = "text") -> DataFrame:
    """Add expected_grade, tail_prob = P(grade >= wanted) and kept = (tail_prob >= least)."""
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(wanted), "tail_prob": F.lit(1.0), "kept": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_prob double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        column = pa.array(texts, pa.string(), from_pandas=True)
        score = np.fromiter((float(m.weights[at] @ x) for at, x in features(column)), float, len(texts))
        tail = m.at_least(score)
        k = int(np.searchsorted(m.grades, wanted))
        return pd.DataFrame({"expected_grade": m.grades[0] + tail @ np.diff(m.grades), "tail_prob": np.ones(len(score)) if k == 0 else np.zeros(len(score)) if k == len(m.grades) else tail[:, k - 1]})

    scored = docs.withColumn("_judged", judge(F.col(text)))
    return scored.withColumns({"expected_grade": F.col("_judged.expected_grade"), "tail_prob": F.col("_judged.tail_prob"), "kept": F.col("_judged.tail_prob") >= least}).drop("_judged")
