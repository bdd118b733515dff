"""Language ID by prediction by partial matching.

Each language has a context tree over bytes (A-Z lower-cased) of orders 0 to 3, counted on a bounded sample of
labelled documents and then frozen.  A byte costs -log2 of its share in the longest context that has seen it, plus
the escapes of the longer contexts that have not (method C, no exclusion); a text's code length is the sum over all
its bytes, and the language with the shortest code is predicted.  The model is bounded: it has the ``NODES`` third-order
contexts that all languages together show most and tells ``SYMBOLS`` byte values apart; the rest are one symbol, which
isn't divided among them, so that code lengths are exact in that model only.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can be learned.
Repeated rows are predicted alike, ties go to the alphabetically first language, other columns are kept (results
replace columns of the same name); an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import _LOWER, bounded_batches, texts_of

#: The most third-order contexts that are kept (those seen most), and the most byte values told apart.
NODES, SYMBOLS = 16_384, 120
_LETTER = re.compile(r"[^\W\d_]")


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At each byte the number made of it and the three bytes before it; before a text stand spaces."""
    low = _LOWER[data]
    code = low.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in (1, 2, 3):
        before = np.full(len(data), 32, np.int64)
        before[k:] = low[:-k]
        before[place < k] = 32
        code |= before << (8 * k)
    return code


def count_grams(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows (lang, gram, n) of the byte 4-grams of all texts."""

    def run(batches):
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            names, which = np.unique(langs.astype(str), return_inverse=True)
            for first, data, offsets in texts_of(b.column(0)):
                row = np.repeat(which[first : first + len(offsets) - 1], np.diff(offsets))
                key, n = np.unique((row.astype(np.int64) << 32) | _grams(data, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key >> 32], pa.string()), pa.array(key & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.select(text, lang).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen costs in bits: row (context) x symbol x language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        lang = np.searchsorted(self.langs, counts["lang"].to_numpy(str))
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(float)
        often = np.bincount(gram & 255, n, 256)
        kept = np.argsort(-often, kind="stable")[: min(SYMBOLS, int((often > 0).sum()))]
        s = len(kept) + 1  # the last symbol is any other byte
        self.symbol = np.full(256, s - 1, np.int64)
        self.symbol[kept] = np.arange(s - 1)
        x, c1, c2, c3 = (self.symbol[(gram >> (8 * k)) & 255] for k in range(4))
        size = len(self.langs)

        def costs(context: np.ndarray, rows: int, below: np.ndarray) -> np.ndarray:
            """below: the costs of the next shorter context, a row for each."""
            count = np.bincount((context * s + x) * size + lang, n, rows * s * size).reshape(rows, s, size)
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = -np.log2(count / (total + kinds))
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            return np.where(count > 0, found, escape + below).astype(np.float32)

        zero = np.zeros(len(x), np.int64)
        order0 = costs(zero, 1, np.full((1, s, size), np.log2(256), np.float32))
        order1 = costs(c1, s, np.broadcast_to(order0, (s, s, size)))
        order2 = costs(c2 * s + c1, s * s, np.tile(order1, (s, 1, 1)))
        context = (c3 * s + c2) * s + c1
        weight = np.bincount(context, n, s**3)
        nodes = np.sort(np.argsort(-weight, kind="stable")[: min(NODES, int((weight > 1).sum()))])
        self.row = np.tile(np.arange(s * s), s).astype(np.int32)  # contexts without a node of their own use the shorter one
        at = np.full(s**3, -1, np.int64)
        at[nodes] = np.arange(len(nodes))
        use = at[context] >= 0
        x, n, lang, context = x[use], n[use], lang[use], at[context[use]]
        order3 = costs(context, len(nodes), order2[nodes % (s * s)])
        self.row[nodes] = s * s + np.arange(len(nodes))
        self.cost, self.s = np.concatenate([order2, order3]).reshape(-1, size), s

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(column), len(self.langs)))
        for first, data, offsets in texts_of(column, max(1 << 16, (1 << 22) // len(self.langs))):
            # long texts are summed in pieces; the contexts of a piece reach back into the one before
            for a in range(0, len(data), 1 << 20):
                b, back = min(len(data), a + (1 << 20)), max(0, a - 3)
                inner = np.clip(offsets, back, b) - back
                code = _grams(data[back:b], inner)[a - back :]
                x, c1, c2, c3 = (self.symbol[(code >> (8 * k)) & 255] for k in range(4))
                bits = self.cost[self.row[(c3 * self.s + c2) * self.s + c1].astype(np.int64) * self.s + x]
                cut = np.clip(offsets, a, b) - a
                full = np.flatnonzero(np.diff(cut))
                if len(full):
                    out[first + full] += np.add.reduceat(bits, cut[:-1][full], axis=0, dtype=float)
        return out


def train(docs: DataFrame, train_on: F.Column, text: str = "text", lang: str = "lang", max_rows: int = 3_000) -> ContextTrees | None:
    """Learn from at most about ``max_rows`` documents a language (chosen by a hash of the doc_id)."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(train_on & F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not n:
        return None
    share = F.lit(0)
    for name, count in n.items():
        share = F.when(F.col(lang) == name, int(min(1.0, max_rows / count) * (1 << 30))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share)
    counts = count_grams(sample, text, lang).toArrow().to_pandas()
    return ContextTrees(counts.sort_values(["lang", "gram"])) if len(counts) else None


def identify(docs: DataFrame, trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the share of the predicted language when each has the weight 2 ** -bits."""
    bounded_batches(docs.sparkSession)
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        bits = m.code_lengths(pa.array(texts, pa.string(), from_pandas=True))
        best = bits.argmin(axis=1)
        weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
        known = np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
        return pd.DataFrame({"lang_pred": np.where(known, np.array(m.langs, object)[best], "und"), "score": np.where(known, 1 / weight.sum(axis=1), 0.0)})

    found = docs.withColumn("_judged", judge(F.col(text)))
    return found.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")
