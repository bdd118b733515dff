"""Ranked lexical search: document-sharded CSR postings with integer impacts, scored a term at a time.

Terms are the longest runs of ASCII letters and digits and of bytes from 0x80 on, A-Z lower-cased, told apart by 64-bit
hashes.  Queries come in blocks of at most ``block`` items, so that what a job broadcasts (a block's terms) is bounded.
For each block every task turns its documents into shards of about ``SHARD`` bytes of text: which documents hold which
of the block's terms how often, as compressed rows by term, with the lengths of those documents.  The shards are
written once; document frequencies, the number of documents and their total length are sums over them.  A second pass
reads the shards, computes the impact of every posting, and for each item adds the impacts of its terms, one after the
other, into a dense array over the shard's documents.  Each task merges the best ``k`` of its shards and tasks' lists
are merged by a window.  Selection takes all documents that tie with the k-th score before it sorts, so that ties go by
ascending doc_id.

Null and empty texts have no terms: such documents are found by nothing and count nothing, such items find nothing.
Every row is a document and every row of the items is a query of its own (repeated rows give repeated ranks); null
doc_ids come last among ties.  Other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardflow.llm.common import bounded_batches, gathered, hash_spans, lowered, spans_of, stored, texts_of

#: Bytes of text in a shard, items in a block of queries.
SHARD, BLOCK = 1 << 24, 2000
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SHARD_SCHEMA = "docs long, length long, ids array<bigint>, n array<int>, term array<int>, ends array<int>, doc array<int>, tf array<int>"


def term_hashes(column: pa.Array):
    """Yield (first row, hashes of the terms of a run of texts, for each text the range of its terms)."""
    for first, data, offsets in texts_of(column):
        start, end, bounds = spans_of(data, offsets, _TERM)
        yield first, hash_spans(lowered(data), start, end), bounds


def _shard(table: pa.Table, vocabulary: np.ndarray) -> list:
    """The row of ``_SHARD_SCHEMA`` of some documents (id, text): postings of the vocabulary's terms by term."""
    n, rows, terms = np.zeros(table.num_rows, np.int64), [], []
    column = table.column(1).combine_chunks() if table.column(1).num_chunks != 1 else table.column(1).chunk(0)
    for first, hashes, bounds in term_hashes(column):
        n[first : first + len(bounds) - 1] = np.diff(bounds)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == hashes)
        terms.append(at[hit])
        rows.append(first + np.searchsorted(bounds, hit, "right") - 1)
    key, tf = np.unique(np.concatenate(terms or [np.zeros(0, np.int64)]) * max(1, len(n)) + np.concatenate(rows or [np.zeros(0, np.int64)]), return_counts=True)
    term, row = np.divmod(key, max(1, len(n)))
    found, doc = np.unique(row, return_inverse=True)
    present, first_of = np.unique(term, return_index=True)
    ids = table.column(0).take(pa.array(found)).combine_chunks()
    return [int((n > 0).sum()), int(n.sum()), ids, n[found], present, np.append(first_of[1:], len(term)) if len(present) else first_of, doc, tf]


def build_shards(docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: its number of documents with terms, their length, and the postings of a sorted array of
    term hashes; ``ends`` are where the postings of each of ``term`` end in ``doc`` and ``tf``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches):
        for table in gathered(batches, 1, SHARD):
            docs_, length, ids, *arrays = _shard(table, shared.value)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)]
            lists += [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, pa.int32())) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([docs_], pa.int64()), pa.array([length], pa.int64()), *lists], ["docs", "length", "ids", "n", "term", "ends", "doc", "tf"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(build, _SHARD_SCHEMA)


def _best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending id, null ids last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    return found[np.lexsort((ids[found], null[found], -scores[found]))][:k]


def _score_shards(batches, items: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int):
    """Rows (item, doc_id, score) of the best k documents of a task for each item (an array of places in the vocabulary)."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
    for b in batches:
        for row in range(b.num_rows):
            ids, n, term, ends, doc, tf = (b.column(c)[row].values for c in range(2, 8))
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            n, term, ends, doc, tf = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n, term, ends, doc, tf))
            m = 100 - 50 + (50 * n * n_docs) // max(1, length)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            impacts = np.repeat(weights[term], ends - starts) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            place = np.full(len(weights), -1)
            place[term] = np.arange(len(term))
            scores = np.zeros(len(ids), np.int64)
            for j, wanted in enumerate(items):
                scores[:] = 0
                for t in place[wanted]:
                    if t >= 0:
                        scores[doc[starts[t] : ends[t]]] += impacts[starts[t] : ends[t]]
                best = _best(scores, ids, null, k)
                if len(best):
                    merged = [np.concatenate(x) for x in zip(held[j], (scores[best], ids[best], null[best]), strict=True)]
                    keep = _best(*merged, k)
                    held[j] = tuple(x[keep] for x in merged)
    item = np.repeat(np.arange(len(items)), [len(h[0]) for h in held])
    score, ids, null = (np.concatenate([h[c] for h in held]) for c in range(3)) if held else (np.zeros(0, np.int64),) * 3
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _search_block(docs: DataFrame, items: list, id_type: str, k: int, doc_id: str, text: str) -> DataFrame:
    """The results of one block of items, rows (id, text)."""
    spark = docs.sparkSession
    hashes = [np.zeros(0, np.uint64)] * len(items)
    for first, found, bounds in term_hashes(pa.array([r[1] for r in items], pa.string())):
        for j in range(len(bounds) - 1):
            hashes[first + j] = np.unique(found[bounds[j] : bounds[j + 1]])
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(1, np.uint64)]))
    places = [np.searchsorted(vocabulary, h) for h in hashes]
    shards = stored(build_shards(docs, vocabulary, doc_id, text), "search-shards")
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    each = shards.select(F.explode(F.arrays_zip("term", "ends", F.concat(F.array(F.lit(0)), "ends").alias("starts"))).alias("x")).filter("x.term IS NOT NULL")
    counts = each.groupBy("x.term").agg(F.sum(F.expr("x.ends - x.starts")).alias("df")).collect()  # a row for each of the block's terms
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        weights[r["term"]] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast((places, weights))
    found = shards.mapInArrow(lambda batches: _score_shards(batches, *shared.value, total[0], total[1], k), "item int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(j, r[0]) for j, r in enumerate(items)], f"item int, item_id {id_type}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents with a score above 0 for each item."""
    id_type = items.schema[item_id].dataType.simpleString()
    found, held = [], []
    for r in items.select(item_id, item_text).toLocalIterator():
        held.append(r)
        if len(held) == block:
            found.append(_search_block(docs, held, id_type, k, doc_id, text))
            held = []
    if held or not found:
        found.append(_search_block(docs, held, id_type, k, doc_id, text))
    return reduce(DataFrame.union, found)
