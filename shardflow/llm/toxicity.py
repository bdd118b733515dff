"""Toxicity by class-conditional Kneser-Ney language models.

Bigrams of toxic and of ordinary documents are counted over all labelled training documents (up to a bound of rows).
Words are hashed to ``WORDS`` classes; no bigram of classes is left out.  For class c, with counts n, discounts D from
counts of counts, and r(v) what the discounts take of all bigrams of v:

    P_c(w | v) = (n_c(v, w) - D_c + (r_c(v) + W) S_c(w | v)) / (n_c(v) + W)      S_c: both classes' bigrams
    S_c(w | v) = (n(v, w) - D + r(v) U_c(w)) / n(v), or U_c(w) where v is new    U_c: words of the class
    U_c(w) = (1 - b) (t_c(w) - D'_c) / (all of these) + b Q(w)                   t: distinct words before w, Q: their share

All of them sum to 1 over the classes of words.  A document is compared by its length-normalised log-likelihoods under P
and under U alone, over all its words and over its ``TOP`` most toxic ones.  Training documents that the counts have
not seen (one in four) choose, of ``WEIGHTS``, what the shared bigrams weigh against a class's own (W), and a logistic
fit on them makes the score.

Counts are summed in Spark and kept in the shared folder, from which each worker reads those of bigrams once (8 bytes a
bigram; the bound of rows bounds them); tables by word (of a fixed size) are broadcast.  Null and empty texts
have no words and get the score of zeros.  Repeated rows score alike, other columns are kept (results replace columns
of the same name); an empty table gives an empty table; where the held-out quarter has labels of one class only, the
score is the share of toxic ones among all training rows (0 without any).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, labelled, run_hashes, stored, texts_of

#: Classes of words, bigrams that a worker reads at a time, words that count as a text's most toxic.
WORDS, PAIRS, TOP = 1 << 18, 1 << 20, 3
#: The largest count that is kept beside a bigram; larger ones have a table of their own.
MOST = (1 << 14) - 1
#: What the shared bigrams may weigh (in counts of the word before; the held-out fit chooses), and what the shared words do.
WEIGHTS, COMMON_WORDS = (10.0, 100.0, 1000.0, 10_000.0), 0.3


def _words(column: pa.Array):
    """Yield (first row, word before, word, range of each text); a text's first word follows word class 0."""
    for first, data, offsets in texts_of(column):
        hashes, bounds = run_hashes(data, offsets, marks=False)
        w = (hashes >> np.uint64(64 - 18)).astype(np.int64)
        v = np.concatenate([[0], w[:-1]])[: len(w)]
        v[bounds[:-1][bounds[:-1] < len(w)]] = 0
        yield first, v, w, bounds


class Bigrams:
    """All bigrams in order, each with its two counts in one number: 36 bits of words, twice 14 of counts."""

    def __init__(self, files: tuple[str, ...]):
        opened = [pq.ParquetFile(place.open_input_file(path)) for place, path in map(fs.FileSystem.from_uri, files)]
        self.packed = np.empty(sum(f.metadata.num_rows for f in opened), np.uint64)
        at, many = 0, [np.zeros((3, 0), np.uint64)]
        for f in opened:
            for b in f.iter_batches(PAIRS, columns=["v", "w", "n0", "n1"]):
                v, w, *n = (c.to_numpy().astype(np.uint64) for c in b.columns)
                key, counts = v * np.uint64(WORDS) + w, np.array(n)
                low = np.minimum(counts, np.uint64(MOST))
                self.packed[at : at + len(key)] = key << np.uint64(28) | low[0] << np.uint64(14) | low[1]
                at += len(key)
                large = (counts >= MOST).any(axis=0)
                many.append(np.array([key[large], *counts[:, large]]))
            f.close(force=True)
        self.packed.sort()
        large = np.concatenate(many, axis=1)
        self.large = large[:, np.argsort(large[0])]

    def counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How often each bigram is in ordinary and in toxic documents."""
        key, back = np.unique((v * WORDS + w).astype(np.uint64), return_inverse=True)
        n = np.zeros((2, len(key)))
        if len(self.packed):
            found = self.packed[np.minimum(np.searchsorted(self.packed, key << np.uint64(28)), len(self.packed) - 1)]
            n = np.where(found >> np.uint64(28) == key, [found >> np.uint64(14) & np.uint64(MOST), found & np.uint64(MOST)], 0).astype(float)
        if self.large.size:
            at = np.minimum(np.searchsorted(self.large[0], key), self.large.shape[1] - 1)
            n = np.where(self.large[0, at] == key, self.large[1:, at], n)
        return n[:, back]


@lru_cache(maxsize=1)
def _bigrams(files: tuple[str, ...]) -> Bigrams:
    """The bigrams of these files, which a worker reads once for all its tasks."""
    return Bigrams(files)


def count_pairs(training: DataFrame, text: str) -> DataFrame:
    """Rows (v, w, n0, n1): how often w follows v in ordinary and in toxic documents."""

    def run(batches):
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False) > 0
            for first, v, w, bounds in _words(b.column(0)):
                toxic = np.repeat(label[first : first + len(bounds) - 1], np.diff(bounds))
                key, n = np.unique((v * WORDS + w) * 2 + toxic, return_counts=True)
                key, kind = key >> 1, key & 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key // WORDS, pa.int32()), pa.array(key % WORDS, pa.int32()), pa.array(np.where(kind, 0, n), pa.int32()), pa.array(np.where(kind, n, 0), pa.int32())], ["v", "w", "n0", "n1"]
                )

    pairs = training.select(text, "_label").mapInArrow(run, "v int, w int, n0 int, n1 int")
    return pairs.groupBy("v", "w").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))


def _table(rows: DataFrame, key: str, size: int, names: list[str]) -> np.ndarray:
    """Counts by key (0 to size - 1) as an array with a row for each name."""
    found = rows.select(key, *names).toArrow()
    out = np.zeros((len(names), size))
    for k, n in enumerate(names):
        out[k, found[key].to_numpy()] = found[n].to_numpy()
    return out


def _discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3 on, from how many counts are 1, 2, 3 and 4 (modified Kneser-Ney)."""
    if not (ones and twos and threes):
        return np.array([0, 0.5, 1, 1.5])
    y = ones / (ones + 2 * twos)
    return np.clip([0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes], 0, [0, 1, 2, 3])


def _discounted(n: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return n - discounts[np.minimum(n, 3).astype(np.int64)]


def _left(discounts: np.ndarray, count: str) -> F.Column:
    """The sum of discounted counts of bigrams."""
    return F.sum(F.col(count) - F.element_at(F.array(*[F.lit(float(x)) for x in discounts]), F.expr(f"cast(least({count}, 3) as int) + 1")))


def _fit_models(pairs: DataFrame) -> dict:
    """The files of all pairs with their counts, and tables of fixed size by word."""
    pairs = stored(pairs.select("v", "w", "n0", "n1"), "toxicity-pairs")
    kinds = ("n0", "n1", "n0 + n1")
    found = pairs.agg(*[F.coalesce(F.expr(f"sum(cast({n} = {k} as long))"), F.lit(0)) for n in kinds for k in (1, 2, 3, 4)]).first()
    discounts = np.array([_discounts(*found[4 * k : 4 * k + 4]) for k in range(3)])
    seen = [F.sum((F.col(f"n{c}") > 0).cast("int")).alias(f"t{c}") for c in (0, 1)]
    before = _table(pairs.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "v", WORDS, ["n0", "n1"])
    after = _table(pairs.groupBy("w").agg(F.count("*").alias("both"), *seen), "w", WORDS, ["t0", "t1", "both"])
    kept = _table(pairs.withColumn("n", F.expr("n0 + n1")).groupBy("v").agg(*[_left(discounts[k], n).alias(f"k{k}") for k, n in enumerate(("n0", "n1", "n"))]), "v", WORDS, ["k0", "k1", "k2"])
    shared = (after[2] + 0.5) / (after[2] + 0.5).sum()
    own = []
    for c in (0, 1):
        n = _discounted(after[c], _discounts(*[(after[c] == k).sum() for k in (1, 2, 3, 4)]))
        own.append((1 - COMMON_WORDS) * n / n.sum() + COMMON_WORDS * shared if n.sum() else shared)
    rest = np.append(before, before.sum(axis=0)[None], axis=0) - kept
    return {
        "files": tuple(pairs.inputFiles()), "discounts": discounts,
        "before": before.astype(np.float32), "rest": np.maximum(rest, 0).astype(np.float32), "own": np.array(own, np.float32),
    }


def probabilities(model: dict, v: np.ndarray, w: np.ndarray, weights=WEIGHTS) -> np.ndarray:
    """P(w | v) for each weight and class."""
    n = _bigrams(model["files"]).counts(v, w)
    before, rest, own, d = model["before"][:, v].astype(float), model["rest"][:, v].astype(float), model["own"][:, w].astype(float), model["discounts"]
    total = before.sum(axis=0)
    shared = np.where(total > 0, (_discounted(n[0] + n[1], d[2]) + rest[2] * own) / np.maximum(total, 1), own)
    out = np.empty((len(weights), 2, len(v)))
    for c in (0, 1):
        mine = _discounted(n[c], d[c])
        for j, weight in enumerate(weights):
            out[j, c] = (mine + (rest[c] + weight) * shared[c]) / (before[c] + weight)
    return out


def _ratios(model: dict, v: np.ndarray, w: np.ndarray, weights=WEIGHTS) -> list[np.ndarray]:
    """log P(w | v, toxic) - log P(w | v, ordinary) for each weight, and last that of the continuation counts alone."""
    p, own = probabilities(model, v, w, weights), model["own"][:, w]
    return [*np.log(p[:, 1] / p[:, 0]), np.log(own[1] / own[0])]


def _features(model, column: pa.Array, weights=WEIGHTS) -> np.ndarray:
    """For each text and each ratio: its mean over the words, and over those that are most toxic."""
    out = np.zeros((len(column), 2 * len(weights) + 2))
    for first, v, w, bounds in _words(column):
        for j, ratio in enumerate(_ratios(model, v, w, weights)):
            for k in range(len(bounds) - 1):
                r = ratio[bounds[k] : bounds[k + 1]]
                if len(r):
                    out[first + k, 2 * j : 2 * j + 2] = r.mean(), (np.partition(r, len(r) - TOP)[-TOP:] if len(r) > TOP else r).mean()
    return out


def _choose(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Of WEIGHTS the one with the least log loss, and its logistic fit."""
    found = []
    for j, weight in enumerate(WEIGHTS):
        part = x[:, [2 * j, 2 * j + 1, -2, -1]]
        b = _logistic(part, y)
        found.append((np.logaddexp(0, np.where(y > 0, -1, 1) * (part @ b[:-1] + b[-1])).mean(), weight, b))
    return min(found, key=lambda f: f[:2])[1:]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b += np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b), -5, 5)
    return b


def score_toxicity(docs: DataFrame, labels: DataFrame, train_on: F.Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 200_000) -> DataFrame:
    """Add score and predicted.  ``train_on`` says which rows' labels may be used; at most about ``max_rows`` are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    training = labelled(docs.filter(train_on), labels, label, max_rows, doc_id).select(doc_id, text, "_label")
    held = F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(4)) == 0
    model = _fit_models(count_pairs(training.filter(~held), text))
    shared = spark.sparkContext.broadcast(model)
    names = [f"x{k}" for k in range(2 * len(WEIGHTS) + 2)]

    def measure(batches):
        for b in batches:
            x = _features(shared.value, b.column(0))
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], b.column(1)], [*names, "y"])

    sample = training.filter(held).select(text, F.col("_label").cast("int").alias("y")).mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", y int").toArrow().to_pandas().sort_values([*names, "y"])
    y = (sample["y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        rate = training.agg(F.coalesce(F.avg((F.col("_label") > 0).cast("double")), F.lit(0.0))).first()[0]
        return docs.withColumns({"score": F.lit(rate), "predicted": F.lit(int(rate >= 0.5))})
    weight, fit = _choose(sample[names].to_numpy(), y)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        x = _features(shared.value, pa.array(texts, pa.string(), from_pandas=True), (weight,))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ fit[:-1] + fit[-1], -30, 30))))

    return docs.withColumn("score", judge(F.col(text))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
